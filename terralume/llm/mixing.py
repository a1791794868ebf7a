"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, quoted, spread_join, table

#: Sources up to which their small table is broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 10_000
#: 13 hexadecimal digits of md5 are 52 random bits.
DIGITS, UNIT = 13, float(16**13)
#: Longest cumulative distribution of a source; rates above RATE_LIMIT are split in equal Poisson parts.
RATE_LIMIT, TERMS = 16.0, 96


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the seed and the parts."""
    key = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double") / UNIT


def poisson_cdf(rate: Column) -> Column:
    """Cumulative probabilities P(N <= 0..TERMS-1) as an array."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    step = lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * rate / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda s: s["c"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None, factor: float, source: str = "source") -> DataFrame:
    """(source, n_docs, rate): copies a document of the source should get in the mean.

    ``weights`` are target shares; None means the square root of each source's count, which
    lifts small sources. Sources that ``weights`` leaves out get weight 0. The result has
    ``factor`` times as many rows as the input, in the mean.
    """
    n = docs.groupBy(F.coalesce(F.col(quoted(source)).cast("string"), F.lit("~")).alias("mix_source")).agg(F.count("*").alias("mix_n"))
    if weights is None:
        w = F.sqrt(F.col("mix_n").cast("double"))
    else:
        known = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        w = F.coalesce(F.try_element_at(known, F.col("mix_source")), F.lit(0.0))
    n = n.withColumn("mix_w", w)
    total = n.agg(F.coalesce(F.sum("mix_w"), F.lit(0.0)).alias("w"), F.coalesce(F.sum("mix_n"), F.lit(0)).alias("n")).first()
    rate = factor * total["n"] * F.col("mix_w") / total["w"] / F.col("mix_n") if total["w"] > 0 else F.lit(0.0)
    return n.select("mix_source", "mix_n", rate.alias("mix_rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, factor: float = 1.0, seed: str = "mix-1", id_col: str = "doc_id", source: str = "source", shuffle: bool = True) -> DataFrame:
    """Replicate every row a Poisson number of times and put the copies in random global order.

    A row's number of copies inverts the Poisson distribution of its source's rate at a
    number hashed from seed and id, so it is the same on every run and after a lost task;
    rows with one id (repeated rows) get equal counts. A rate above :data:`RATE_LIMIT` is
    the sum of equal parts, each inverted at its own number. A null source is a source of
    its own, a null id hashes as one id. Adds mix_copy int (from 0), mix_copies int and
    mix_key string, the random sort key (md5). Columns of these names in the input are
    replaced, all others stay whatever their names. Texts are carried whatever their length, null
    and empty ones too. Empty input gives an empty result.

    The only shuffle of the rows is the global one; the per-source
    table is broadcast after its size is checked, and beyond it only its hot sources are.
    """
    docs = docs.select([F.col(quoted(c)) for c in docs.columns if c in (id_col, source) or c.lower() not in ("mix_copy", "mix_copies", "mix_key")])
    of, n_parts, cdf = fresh(docs.columns, "mix_source", "mix_parts", "mix_cdf")
    rates = source_rates(docs, weights, factor, source)
    # few parts of at most RATE_LIMIT, each with its cumulative distribution
    parts = F.greatest(F.ceil(F.col("mix_rate") / RATE_LIMIT), F.lit(1)).cast("int")
    rates = rates.withColumn("mix_parts", parts).withColumn("mix_cdf", poisson_cdf(F.col("mix_rate") / F.col("mix_parts")))
    few = rates.select("mix_source").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    weight = fresh([*docs.columns, of, n_parts, cdf], "mix_rows")[0]
    rates = rates.select(F.col("mix_source").alias(of), F.col("mix_parts").alias(n_parts), F.col("mix_cdf").alias(cdf), F.col("mix_n").alias(weight))
    rows = docs.withColumn(of, F.coalesce(F.col(quoted(source)).cast("string"), F.lit("~")))
    rows = rows.join(F.broadcast(rates), of) if few else spread_join(rows, rates, of, weight, rates.agg(F.sum(weight)).first()[0])
    draw = lambda k: F.size(F.filter(cdf, lambda c: c <= uniform(seed, F.col(quoted(id_col)), k)))
    copies = F.aggregate(F.sequence(F.lit(1), F.col(n_parts)), F.lit(0), lambda s, k: s + draw(k))
    rows = rows.withColumn("mix_copies", copies).where("mix_copies > 0").drop(of, n_parts, cdf, weight)
    rows = rows.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    rows = rows.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("~")), F.col("mix_copy").cast("string"))))
    return global_shuffle(rows) if shuffle else rows


def global_shuffle(rows: DataFrame, key: str = "mix_key") -> DataFrame:
    """Rows dealt to partitions and sorted in them by a random key: a global random order.

    The key is uniform, so partitions are even without the sampling pass of a range sort.
    """
    return rows.repartition(F.col(key)).sortWithinPartitions(key)


#: Production parameters of the query: square-root weights, as many rows out as in.
OP4_SEED, OP4_FACTOR = "mix-1", 1.0


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), None, OP4_FACTOR, OP4_SEED).select("doc_id", "source", "text", "mix_copy", "mix_copies", "mix_key")


OP4_SQL = f"""
WITH n AS (SELECT coalesce(source, '~') AS s, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT s, n, sqrt(CAST(n AS DOUBLE)) AS w FROM n),
r AS (SELECT s, {OP4_FACTOR} * (SELECT sum(n) FROM w) * w / (SELECT sum(w) FROM w) / n AS rate FROM w),
t AS (SELECT s, rate, greatest(CAST(ceil(rate / {RATE_LIMIT}) AS INTEGER), 1) AS parts FROM r),
c AS (
  SELECT s, parts, k, sum(exp(-rate / parts) * pow(rate / parts, k) / gamma(k + 1.0)) OVER (PARTITION BY s ORDER BY k) AS cdf
  FROM t, (SELECT unnest(range({TERMS})) AS k) AS ks
),
a AS (SELECT s, any_value(parts) AS parts, list(cdf ORDER BY k) AS cdf FROM c GROUP BY s),
d AS (
  SELECT doc_id, source, text, CAST(list_sum(list_transform(range(1, parts + 1), lambda p:
    len(list_filter(cdf, lambda x: x <= CAST(('0x' || substr(md5('{OP4_SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || CAST(p AS VARCHAR)), 1, {DIGITS})) AS BIGINT) / {UNIT})))) AS INTEGER) AS mix_copies
  FROM documents JOIN a ON coalesce(source, '~') = s
),
e AS (SELECT *, CAST(unnest(range(mix_copies)) AS INTEGER) AS mix_copy FROM d)
SELECT doc_id, source, text, mix_copy, mix_copies,
       md5('{OP4_SEED}|order|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || CAST(mix_copy AS VARCHAR)) AS mix_key
FROM e
"""
