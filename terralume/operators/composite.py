"""Temporal composites and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seasonal(obs: DataFrame, keys: list[str], bands: list[str], clear: Column, min_obs: int = 5, scale: float = 1.0) -> DataFrame:
    """Median of the clear, whole observations of each key and their number; null medians where too few."""
    whole = clear
    for b in bands:
        whole = whole & F.col(b).isNotNull()
    n = F.count("*").alias("clear_observations")
    got = obs.where(whole).groupBy(*keys).agg(n, *[(F.median(b) * scale).alias(b) for b in bands])
    enough = F.col("clear_observations") >= min_obs
    return got.select(*keys, "clear_observations", *[F.when(enough, F.col(b)).alias(b) for b in bands])


def mean(obs: DataFrame, keys: list[str], bands: list[str], clear: Column) -> DataFrame:
    return obs.where(clear).groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(b).alias(b) for b in bands])


def coverage(composite: DataFrame, band: str) -> DataFrame:
    """Percent of keys with a value, two decimals."""
    return composite.agg(F.round(100.0 * F.avg(F.col(band).isNotNull().cast("double")), 2).alias("coverage_pct"), F.count("*").alias("n"))


def minmax(rows: DataFrame, group: list[str], bands: list[str]) -> DataFrame:
    """Bands scaled to 0..1 in each tile; missing values first become the band's mean; a constant band is 0."""
    stats = rows.groupBy(*group).agg(*[f(b).alias(f"{b}_{n}") for b in bands for n, f in (("lo", F.min), ("hi", F.max), ("mu", F.avg))])
    df = rows.join(stats, group)
    for b in bands:
        span = F.col(f"{b}_hi") - F.col(f"{b}_lo")
        df = df.withColumn(b, F.when(span > 0, (F.coalesce(F.col(b), F.col(f"{b}_mu")) - F.col(f"{b}_lo")) / F.when(span > 0, span).otherwise(1)).otherwise(0.0))
    return df.select(*rows.columns)


def first_wins(mosaic: DataFrame, value: str, seq: str, nodata: int = 255) -> DataFrame:
    """One value a pixel: that of the first tile that has data there, else nodata."""
    has = F.min(F.when(F.col(value) != nodata, F.struct(seq, value)))
    return mosaic.groupBy("x", "y").agg(F.coalesce(has[value], F.lit(nodata)).alias(value))


def last_wins(patches: DataFrame, value: str, seq: str) -> DataFrame:
    return patches.groupBy("x", "y").agg(F.max(F.struct(seq, value))[value].alias(value))


def overlap_mean(patches: DataFrame, value: str) -> DataFrame:
    """Sum of the values of overlapping patches over their number."""
    return patches.groupBy("x", "y").agg((F.sum(value) / F.count(value)).alias(value), F.count(value).alias("weight"))


def in_patches(pixels: DataFrame, width: int, height: int, size: int, stride: int) -> DataFrame:
    """Each pixel once for every patch that holds it, with the patch's corner and running number.

    Which patches of an axis hold a pixel is arithmetic on its place, so a row's cost does not grow with the
    raster. A pixel without a place is in no patch.
    """

    def held(axis: str, n: int):
        """(k, at): numbers and starts of the patches that hold the pixel; the last starts at ``n - size``."""
        last = max(n - size, 0)
        first = F.greatest(F.lit(0).cast("long"), F.floor((F.col(axis) - size) / float(stride)) + 1)
        final = F.floor(F.least(F.col(axis), F.lit(last)) / float(stride))
        some = F.col(axis).isNotNull() & (first <= final)
        starts = F.transform(F.when(some, F.sequence(first, final)), lambda k: F.struct(k.alias("k"), (k * stride).cast("int").alias("at")))
        if last % stride == 0:
            return starts
        at_end = (F.col(axis) >= last) & (F.col(axis) < last + size)
        end = F.array(F.struct(F.lit(last // stride + 1).cast("long").alias("k"), F.lit(last).alias("at")))
        return F.when(at_end, F.concat(F.coalesce(starts, F.slice(end, 1, 0)), end)).otherwise(starts)

    last = max(width - size, 0)
    across = last // stride + 1 + (last % stride > 0)
    df = pixels.withColumn("_px", F.explode(held("x", width))).withColumn("_py", F.explode(held("y", height)))
    return df.withColumns({"px": F.col("_px.at"), "py": F.col("_py.at"), "patch": F.col("_py.k") * across + F.col("_px.k")}).drop("_px", "_py")


def rotate90(pixels: DataFrame, height: int) -> DataFrame:
    """A quarter turn by arithmetic on the place."""
    return pixels.withColumn("_x", F.lit(height - 1) - F.col("y")).withColumn("y", F.col("x")).withColumn("x", F.col("_x")).drop("_x")


def crop_pad(pixels: DataFrame, x: int, y: int, w: int, h: int, pad: int, columns: list[str]) -> DataFrame:
    """A window moved to the origin, with a border of zeros."""
    wide, high = w + 2 * pad, h + 2 * pad
    grid = pixels.sparkSession.range(wide * high).select((F.col("id") % wide).alias("x"), F.floor(F.col("id") / float(wide)).alias("y"))
    inside = pixels.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
    moved = inside.select((F.col("x") - x + pad).alias("x"), (F.col("y") - y + pad).alias("y"), *columns)
    return grid.join(moved, ["x", "y"], "left").select("x", "y", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def top_similar(pairs: DataFrame, by: str, score: str, n: int = 3, least: float = 0.5) -> DataFrame:
    k = F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), "other"))
    return pairs.where(F.col(score) > least).withColumn("k", k).where(F.col("k") <= n)
