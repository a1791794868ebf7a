"""Reviewer verdicts: parsing, repair, joining back, batches and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx


def numbered_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, region_id, answer, confirmed): numbered lines of an answer; of two with one number the later counts."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    hit = lines.withColumn("n", F.regexp_extract("line", tx.NUMBERED, 1)).where("n <> ''").withColumn("answer", F.trim(F.regexp_extract("line", tx.NUMBERED, 2)))
    last = hit.where(F.length("n") <= 9).groupBy(key, F.col("n").cast("int").alias("region_id")).agg(F.max(F.struct("pos", "answer"))["answer"].alias("answer"))
    return last.withColumn("confirmed", tx.is_confirmed(F.col("answer")))


def parse_audit(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, real_change, category, reason) of JSON answers, repaired if need be; broken ones give no row."""
    plain = F.from_json(text, tx.AUDIT)
    fixed = F.from_json(tx.repaired_json(F.col(text)), tx.AUDIT)
    regions = F.coalesce(plain["regions"], fixed["regions"])
    rows = texts.select(key, F.posexplode(regions).alias("pos", "r")).where(F.col("r.id").rlike(r"^\s*-?\d{1,9}\s*$"))
    rows = rows.select(key, "pos", F.trim(F.col("r.id")).cast("int").alias("id"), tx.truthy(F.col("r.real_change")).alias("real_change"), F.coalesce("r.category", F.lit("")).alias("category"), F.coalesce("r.reason", F.lit("")).alias("reason"))
    last = rows.groupBy(key, "id").agg(F.max(F.struct("pos", "real_change", "category", "reason")).alias("v"))
    return last.select(key, "id", "v.real_change", "v.category", "v.reason")


def join_verdicts(regions: DataFrame, verdicts: DataFrame, keys=("id",)) -> DataFrame:
    """Every region with its verdict, or UNREVIEWED; verdicts on unknown regions fall away."""
    known = verdicts.join(regions.select(*keys), list(keys), "left_semi")
    joined = regions.join(known, list(keys), "left")
    return joined.withColumn("status", F.when(F.col("real_change").isNull(), "UNREVIEWED").when(F.col("real_change"), "REAL").otherwise("FALSE POSITIVE"))


def audit(regions: DataFrame, client: Callable[[list[dict]], str], batch: int = 8) -> DataFrame:
    """Ask a reviewer about regions in batches; the client gets rows as dicts and returns its text.

    Batches are numbered by region id and dealt out, so a lost task asks its own batches again.
    """
    names = regions.columns
    dealt = regions.withColumn("batch", F.floor((F.col("id") - 1) / batch)).repartition("batch").sortWithinPartitions("batch", "id")

    def ask(batches: Iterator[pa.RecordBatch]):
        held: list[dict] = []

        def answer():
            return pa.RecordBatch.from_pydict({"batch": pa.array([held[0]["batch"]], pa.int64()), "answer": pa.array([client([{k: r[k] for k in names} for r in held])], pa.string())})

        for b in batches:
            for row in b.to_pylist():
                if held and row["batch"] != held[0]["batch"]:
                    yield answer()
                    held = []
                held.append(row)
        if held:
            yield answer()

    return dealt.mapInArrow(ask, "batch long, answer string")


def last_turns(turns: DataFrame, key: str, order: str, n: int = 6) -> DataFrame:
    """The last n turns of each conversation."""
    k = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return turns.withColumn("_k", k).where(F.col("_k") <= n).drop("_k")


def evidence_lines(regions: DataFrame) -> DataFrame:
    """One line of text a region, for reports and prompts."""
    line = F.format_string(
        "#%d: position=%s, size=%d px (%.3f ha), dNDVI=%+.2f, dBrightness=%+.3f, sources=%s",
        F.col("id"), F.col("position"), F.col("area_px"), F.col("area_ha"), F.col("d_ndvi"), F.col("d_bright"), tx.source_list(F.col("sources")),
    )
    return regions.select("id", line.alias("line"))
