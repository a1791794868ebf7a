"""Token counts of whole texts for a byte-level BPE vocabulary; huge texts are cut and spliced.

A huge text is encoded in overlapping chunks on many tasks. Two neighbours are spliced at a
position inside their overlap where both have a token boundary and where the characters
prove that the whole text has one too. Where an overlap has no such position it is widened,
and where no overlap of a whole chunk has one, the chunks become one.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WorkFolder, long_rows, quoted, table, text_batches

#: Characters of a chunk, of the first overlap, and how many times wider each next one is.
CHUNK, OVERLAP, WIDER = 32_768, 512, 8
#: Characters a call of the library encodes at once.
SLICE = 500_000

_LETTER = "A-Za-zÀ-ÖØ-öø-ɏА-я一-龥"
_MARK = "!-/:-@\\[-`{-~、。，"
_BLANK = " \t\n\r\f\v"
#: Positions that end a pre-token of any text: the splitting pattern of byte-level BPE (words, numbers
#: and runs of marks, each with one space before it; contractions; white space) joins nothing across
#: them. Only characters whose class no version of Unicode changes are named.
STABLE = re.compile(
    f"(?<=[{_LETTER}{_MARK}0-9])(?=[{_BLANK}])"
    f"|(?<=[{_LETTER}])(?=[{_MARK}0-9])|(?<=[0-9])(?=[{_LETTER}{_MARK}])|(?<=[{_MARK.replace('!-/', '!-&(-/')}])(?=[{_LETTER}0-9])"
    "|(?<=[\t\n\r\f\v])(?=[" + _LETTER + _MARK + "0-9])"
)

#: Texts of only these characters fall into pieces that begin at stable positions: white space and what follows it.
KNOWN = re.compile(f"[{_LETTER}{_MARK}0-9{_BLANK}]*")
PIECE = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
#: Pieces a worker remembers the counts of, and characters from which one is not remembered.
CACHE, LONG_PIECE = 300_000, 64

_OPEN: dict[str, tuple] = {}
_COUNTS: dict[str, dict[str, int]] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path: str) -> tuple:
    """(the worker's tokenizer, length of its longest special string); others than byte-level BPE are an error."""
    if path not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            kept = {k: v for k, v in json.load(f).items() if k != "model"}
        pre, added = kept.get("pre_tokenizer") or {}, kept.get("added_tokens") or []
        if kept.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: boundaries are proven for byte-level BPE without normalizer, prefix space or stripping tokens only")
        opened = Tokenizer.from_file(path)
        opened.no_truncation()
        opened.no_padding()
        _OPEN[path] = opened, max([1, *(len(t["content"]) for t in added)])
    return _OPEN[path]


def boundaries(text: str, offsets: np.ndarray, lo: int, hi: int, end: bool) -> list[dict]:
    """Proven positions in ``[lo, hi]`` that are token boundaries too, each with the tokens before it; ``end``: the text's end is one."""
    at = [m.start() for m in STABLE.finditer(text, max(lo, 1), min(hi + 1, len(text)))]
    if end and lo <= len(text) <= hi:
        at.append(len(text))
    at = np.unique(np.array([p for p in at if p <= hi], np.int64))
    if not len(offsets):
        return [{"at": int(p), "before": 0} for p in at]
    before = np.searchsorted(offsets[:, 0], at, "left")
    last = np.maximum.accumulate(offsets[:, 1])
    fits = (before == 0) | (last[np.maximum(before, 1) - 1] <= at)
    return [{"at": int(p), "before": int(b)} for p, b in zip(at[fits], before[fits])]


_EDGE = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))


def _append(batch: pa.RecordBatch, take: list[int], keep: list[str], more: dict) -> pa.RecordBatch:
    rows = batch.select(keep).take(pa.array(take, pa.int64()))
    return pa.RecordBatch.from_arrays([*rows.columns, *more.values()], [*keep, *more])


def _cut(batches):
    """Chunks of each text by its array of specs."""
    keep = ["uid", "id", "n_bytes"]
    for batch in batches:
        texts, specs = batch.column("text"), batch.column("specs")
        for row in range(batch.num_rows):
            text, todo = texts[row].as_py(), specs[row].as_py()
            for a in range(0, len(todo), 32):  # a message holds some chunks, not a whole text again
                part = todo[a : a + 32]
                more = {c: pa.array([s[c] for s in part], pa.int64()) for c in ("k", "start", "next", "width")}
                stops = [min(len(text), s["next"] + s["width"]) for s in part]
                more["is_end"] = pa.array([e == len(text) for e in stops])
                more["text"] = pa.array([text[s["start"] : e] for s, e in zip(part, stops)], pa.string())
                yield _append(batch, [row] * len(part), keep, more)


def _encode(path: str):
    keep = ["uid", "id", "n_bytes", "k", "start", "next", "width"]

    def each(batches):
        t, longest = tokenizer(path)
        for batch in text_batches(batches, "text", SLICE):
            texts = batch.column("text").to_pylist()
            heads, tails, counts = [], [], []
            numbers = (batch.column(c).to_pylist() for c in ("start", "next", "width", "is_end"))
            for text, got, start, after, width, end in zip(texts, t.encode_batch(texts, add_special_tokens=False), *numbers):
                offsets = np.array(got.offsets, np.int64).reshape(-1, 2)
                # a special string that the chunk's end cuts must not begin at a position used
                hi = len(text) if end else len(text) - longest
                tail = boundaries(text, offsets, after - start, hi, end)
                head = boundaries(text, offsets, 0, min(width, len(text)), end)
                shift = lambda found, by=start: [{"at": x["at"] + by, "before": x["before"]} for x in found]
                heads.append(shift(head))
                tails.append(shift(tail))
                counts.append(len(got))
            yield _append(batch, list(range(len(texts))), keep, {"n_tokens": pa.array(counts, pa.int64()), "head": pa.array(heads, _EDGE), "tail": pa.array(tails, _EDGE)})

    return each


def sizes(texts: list[str], path: str) -> list[int]:
    """Tokens of each text: the sum over its pieces, each of which the library encodes once a worker; other texts as they are."""
    t, _ = tokenizer(path)
    count = lambda parts: [len(e) for e in t.encode_batch_fast(parts, add_special_tokens=False)]
    known = _COUNTS.setdefault(path, {})
    if len(known) > CACHE:
        known.clear()
    pieces = [PIECE.findall(x) if len(x) > LONG_PIECE and KNOWN.fullmatch(x) else [x] for x in texts]
    new = list(set().union(*pieces).difference(known))
    known.update(zip(new, count(new)))
    out = [sum(map(known.__getitem__, p)) for p in pieces]
    for p in new:
        if len(p) > LONG_PIECE:
            del known[p]
    return out


def _whole(path: str):
    def each(batches):
        for batch in text_batches(batches, "text", SLICE):
            counts = sizes([x or "" for x in batch.column("text").to_pylist()], path)
            yield _append(batch, list(range(len(counts))), ["id", "n_bytes"], {"n_tokens": pa.array(counts, pa.int64())})

    return each


def _by_text() -> W:
    """Chunks of one text in order; a text has 2^31 characters at most, so they are bounded."""
    return W.partitionBy("uid").orderBy("k")


def _spliced(chunks: DataFrame) -> DataFrame:
    """Chunks with ``at``, the last position at which both it and the next have a proven boundary, and the tokens of both before it."""
    both = chunks.withColumn("follower", F.lead("head").over(_by_text()))
    at = F.array_max(F.array_intersect(F.col("tail.at"), F.col("follower.at")))
    before = lambda side: F.get(F.filter(side, lambda x: x["at"] == F.col("at")), F.lit(0))["before"]
    return both.withColumn("at", at).withColumn("mine", before("tail")).withColumn("skip", before("follower")).withColumn("fails", F.expr("follower IS NOT NULL AND at IS NULL")).drop("head", "tail", "follower")


def _widened(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Specs of the chunks beside cuts that failed: wider overlaps, or one chunk for a run whose overlaps are a chunk wide."""
    rows = chunks.select("uid", "k", "start", "next", "width", "fails").withColumn("after", F.coalesce(F.lag("fails").over(_by_text()), F.lit(False)))
    # a cut between two chunks of full width goes: the right one is absorbed
    left_width = F.coalesce(F.lag("width").over(_by_text()), F.lit(0))
    rows = rows.withColumn("gone", F.col("after") & (F.least("width", left_width) >= chunk))
    rows = rows.withColumn("run", F.sum(F.when(F.col("gone"), 0).otherwise(1)).over(_by_text().rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy("uid", "run").agg(
        F.min("k").alias("k"), F.min("start").alias("start"), F.max("next").alias("next"), F.max("width").alias("width"),
        F.max(F.col("fails") | F.col("after")).alias("redo"), F.collect_list("k").alias("replaces"),
    )
    width = F.when(F.size("replaces") > 1, F.col("width")).otherwise(F.least(F.col("width") * WIDER, F.lit(chunk)))
    return runs.where("redo").withColumn("width", F.greatest(width, F.lit(overlap)))


def count(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row a document, counts as the library gives them for the whole text.

    ``path`` is a byte-level BPE file of the tokenizers library. No begin, end or added special
    tokens; a special string inside a text is one token, the library's default. Null and empty
    texts have no bytes and no tokens. Null ids stay null, repeated rows and ids give a row
    each, columns other than the two named are ignored whatever their names, an empty table
    gives an empty result.

    Texts of over ``chunk`` bytes are written once and encoded in chunks of ``chunk`` characters
    on as many tasks. Overlaps begin at ``overlap`` characters and widen only beside cuts without a
    proven common boundary; a stretch without any (one word of many chunks) is encoded as a whole.
    """
    if overlap < 32 or chunk < overlap:
        raise ValueError("overlap must be 32 at least, a chunk no shorter")
    spark = docs.sparkSession
    longest = tokenizer(path)[1]
    if longest > overlap:
        raise ValueError("overlap must be longer than every special string")
    rows = long_rows(docs).select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("text")).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    kind = rows.schema["id"].dataType.simpleString()
    whole = rows.where(F.col("n_bytes") <= chunk).mapInArrow(_whole(path), f"id {kind}, n_bytes long, n_tokens long")

    work = WorkFolder(spark, "token-counts")
    texts = work.put("texts", rows.where(F.col("n_bytes") > chunk).withColumn("uid", F.monotonically_increasing_id()).withColumn("n", F.length("text").cast("long")))
    starts = F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(n - 1, 0) div {chunk}"))
    spec = lambda k, start, after, width: F.struct(k.alias("k"), start.alias("start"), after.alias("next"), width.alias("width"))
    specs = texts.withColumn("specs", F.transform(starts, lambda k: spec(k, k * chunk, F.least((k + 1) * chunk, "n"), F.lit(overlap).cast("long"))))
    carried = f"uid long, id {kind}, n_bytes long, k long, start long, next long, width long"

    def encoded(name: str, specs: DataFrame) -> DataFrame:
        cut = specs.select("uid", "id", "n_bytes", "text", "specs").mapInArrow(_cut, f"{carried}, is_end boolean, text string")
        got = cut.repartition(F.col("uid"), F.col("k")).mapInArrow(_encode(path), f"{carried}, n_tokens long, head array<struct<at: long, before: long>>, tail array<struct<at: long, before: long>>")
        return work.put(name, got)

    chunks, turn = encoded("chunks-0", specs), 0
    while True:
        spliced = work.put(f"spliced-{turn}", _spliced(chunks))
        failed = spliced.where("fails").select("uid").distinct()
        if failed.isEmpty():
            break
        turn += 1
        redo = work.put(f"redo-{turn}", _widened(spliced.join(failed, "uid", "left_semi"), chunk, overlap))
        again = redo.groupBy("uid").agg(F.collect_list(spec(*map(F.col, ("k", "start", "next", "width")))).alias("specs"))
        new = encoded(f"again-{turn}", texts.join(again, "uid"))
        replaced = redo.select("uid", F.explode("replaces").alias("k"))
        chunks = work.put(f"chunks-{turn}", chunks.join(replaced, ["uid", "k"], "left_anti").unionByName(new))
    # tokens of a chunk: those before its right splice without those before its left one
    share = F.coalesce("mine", "n_tokens") - F.coalesce("skip", F.lit(0))
    long_ = spliced.groupBy("uid").agg(F.first("id").alias("id"), F.first("n_bytes").alias("n_bytes"), F.sum(share).alias("n_tokens")).drop("uid")
    return whole.unionByName(long_).select(F.col("id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_token_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"), tokenizer_path())
