"""Class shares, confusion matrices, scores, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a, b):
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def class_share(rows: DataFrame, code: str, pixel_m2: float = 100.0) -> DataFrame:
    """Pixels, percent (two decimals) and square kilometres of each class."""
    n = rows.groupBy(code).agg(F.count("*").alias("pixels"))
    total = F.sum("pixels").over(W.partitionBy(F.lit(0)))
    return n.select(code, "pixels", F.round(100.0 * F.col("pixels") / total, 2).alias("percent"), (F.col("pixels") * pixel_m2 / 1e6).alias("area_km2"))


def built_up(rows: DataFrame, image: str, code: str) -> DataFrame:
    """Share of built-up codes 250 and 255, and of each among them (null without any)."""
    n = lambda *c: F.sum(F.col(code).isin(*c).cast("long"))
    return rows.groupBy(image).agg(ratio(n(250, 255).cast("double"), F.count("*")).alias("bu_prop"), ratio(n(250).cast("double"), n(250, 255)).alias("p250_in_bu"), ratio(n(255).cast("double"), n(250, 255)).alias("p255_in_bu"))


def compare_proportions(original: DataFrame, predicted: DataFrame, key: str, value: str) -> DataFrame:
    """ORIG, PRED and DIFF rows of each image; one that is missing on a side counts 0."""
    both = original.select(key, F.col(value).alias("o")).join(predicted.select(key, F.col(value).alias("p")), key, "full").fillna(0.0, ["o", "p"])
    return both.selectExpr(key, "stack(3, 'ORIG', o, 'PRED', p, 'DIFF', abs(o - p)) AS (type, value)")


def confusion(rows: DataFrame, truth: str, predicted: str, classes: int) -> DataFrame:
    """(truth, predicted, n) with every cell; values out of range drop out."""
    ok = rows.where(F.col(truth).between(0, classes - 1) & F.col(predicted).between(0, classes - 1))
    n = ok.groupBy(F.col(truth).cast("int").alias("t"), F.col(predicted).cast("int").alias("p")).agg(F.count("*").alias("n"))
    cells = rows.sparkSession.range(classes * classes).select((F.floor(F.col("id") / classes)).cast("int").alias("t"), (F.col("id") % classes).cast("int").alias("p"))
    return cells.join(n, ["t", "p"], "left").select("t", "p", F.coalesce("n", F.lit(0)).alias("n"))


def class_scores(cells: DataFrame) -> DataFrame:
    """Accuracy (recall), precision, Dice and support of each class."""
    per = cells.groupBy("t").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    got = cells.groupBy(F.col("p").alias("t")).agg(F.sum("n").alias("found"))
    df = per.join(got, "t")
    return df.select(F.col("t").alias("class"), "support", ratio(F.col("hit").cast("double"), F.col("support")).alias("accuracy"), ratio(F.col("hit").cast("double"), F.col("found")).alias("precision"), ratio(2.0 * F.col("hit"), F.col("support") + F.col("found")).alias("dice"))


def summary(scores: DataFrame) -> DataFrame:
    """Mean class accuracy (classes without pixels aside) and support-weighted Dice."""
    return scores.agg(F.avg("accuracy").alias("mean_accuracy"), ratio(F.sum(F.coalesce("dice", F.lit(0.0)) * F.col("support")), F.sum("support").cast("double")).alias("weighted_dice"), F.sum("support").alias("n"))


def precision_recall(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts and rates of a Boolean prediction; divisions by at least one."""
    n = lambda c: F.sum(c.cast("long"))
    r = rows.agg(n(F.col(truth) & F.col(predicted)).alias("tp"), n(~F.col(truth) & F.col(predicted)).alias("fp"), n(F.col(truth) & ~F.col(predicted)).alias("fn"))
    return r.withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).withColumn("recall", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)))


def intervals(rows: DataFrame, group: str, value: str, z: float = 1.96) -> DataFrame:
    """Mean and its normal confidence interval."""
    r = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = z * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return r.select(group, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def binomial_interval(p, n, z: float = 1.96):
    half = z * F.sqrt(p * (1.0 - p) / n)
    return p - half, p + half


def rank_correlation(rows: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """Spearman's correlation (mean ranks for ties) and the least-squares line, by group."""
    ranks = rows
    for c in (x, y):
        w = W.partitionBy(group).orderBy(c)
        ranks = ranks.withColumn(f"_r_{c}", F.rank().over(w) + (F.count("*").over(W.partitionBy(group, c)) - 1) / 2.0)
    return ranks.groupBy(group).agg(F.corr(f"_r_{x}", f"_r_{y}").alias("spearman"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def band_stats(rows: DataFrame, group: str, bands: list[str]) -> DataFrame:
    """Mean over tiles of each band's mean and population deviation."""
    per = rows.groupBy(group).agg(*[f(b).alias(f"{b}_{n}") for b in bands for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    parts = ", ".join(f"'{b}', {b}_mean, {b}_std" for b in bands)
    return per.selectExpr(group, f"stack({len(bands)}, {parts}) AS (band, m, s)").groupBy("band").agg(F.avg("m").alias("mean"), F.avg("s").alias("std"))


def band_mse(rows: DataFrame, bands: list[str]) -> DataFrame:
    """Mean squared difference of every two bands, in one pass."""
    pairs = [(a, b) for i, a in enumerate(bands) for b in bands[i + 1 :]]
    one = rows.agg(*[F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))).alias(f"{a}__{b}") for a, b in pairs])
    return one.selectExpr(f"stack({len(pairs)}, " + ", ".join(f"'{a}', '{b}', {a}__{b}" for a, b in pairs) + ") AS (band, other, mse)")


def otsu(rows: DataFrame, group: str | list[str], value: str, bins: int = 256) -> DataFrame:
    """(group, threshold): the histogram's split of greatest variance between its sides, by group; none where all values are equal.

    Only bins that hold something are rows; an empty bin splits like the one before it.
    """
    group = [group] if isinstance(group, str) else list(group)
    ends = rows.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).where("_lo < _hi")
    step = (F.col("_hi") - F.col("_lo")) / float(bins)
    n = rows.join(ends, group).withColumn("_k", F.least(F.floor((F.col(value) - F.col("_lo")) / step), F.lit(bins - 1)))
    n = n.groupBy(*group, "_k").agg(F.count("*").cast("double").alias("_n"), F.first(F.col("_lo") + (F.col("_k") + 0.5) * step).alias("_mid"))
    every, so_far = W.partitionBy(*group), W.partitionBy(*group).orderBy("_k").rowsBetween(W.unboundedPreceding, 0)
    mass = F.col("_n") * F.col("_mid")
    n = n.withColumns({"_w": F.sum("_n").over(so_far), "_s": F.sum(mass).over(so_far), "_all": F.sum("_n").over(every), "_sum": F.sum(mass).over(every)})
    rest = F.col("_all") - F.col("_w")
    gap = F.col("_s") / F.col("_w") - (F.col("_sum") - F.col("_s")) / rest
    n = n.where(rest > 0).withColumn("_v", F.round(F.col("_w") * rest * gap * gap, 9))
    return n.groupBy(*group).agg(F.max(F.struct("_v", -F.col("_k"), "_mid"))["_mid"].alias("threshold"))
