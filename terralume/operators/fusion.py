"""Score fusion of several change signals, candidate masks and support."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import indices as ix
from . import focal

#: Weights and thresholds of the unified and of the fused variant.
UNIFIED_WEIGHTS = {"irmad": 0.30, "spectral": 0.20, "dino": 0.35, "structure": 0.15}
UNIFIED_THRESHOLDS = {"irmad": 0.35, "spectral": 0.35, "dino": 0.35, "structure": 0.25, "fused": 0.45}
FUSED_WEIGHTS = {"dino": 0.35, "bit": 0.30, "spectral": 0.15, "structure": 0.20}
FUSED_THRESHOLDS = {"dino": 0.35, "bit": 0.30, "spectral": 0.35, "structure": 0.25, "fused": 0.45}

#: Detectors by name: each adds one score column to a pixel table, or returns None if it cannot run.
DETECTORS: dict[str, Callable[[DataFrame], DataFrame | None]] = {}


def detector(name: str):
    """Register a detector; one that is missing leaves its signal and weight out of the fusion."""

    def add(f):
        DETECTORS[name] = f
        return f

    return add


def run_detectors(pixels: DataFrame, names) -> tuple[DataFrame, list[str]]:
    ran = []
    for n in names:
        found = DETECTORS[n](pixels) if n in DETECTORS else None
        if found is not None:
            pixels, ran = found, [*ran, n]
    return pixels, ran


@detector("structure")
def structure(pixels: DataFrame) -> DataFrame | None:
    """Gain of edge density between grey_b and grey_a, three times, clipped to 0..1."""
    if not {"grey_b", "grey_a"} <= set(pixels.columns):
        return None
    df = focal.edge_density(focal.edge_density(pixels, "grey_b", out="_eb"), "grey_a", out="_ea")
    return df.withColumn("structure", ix.clip((F.col("_ea") - F.col("_eb")) * 3.0, 0.0, 1.0)).drop("_ea", "_eb")


@detector("spectral")
def spectral(pixels: DataFrame) -> DataFrame | None:
    """Half brightness gain and half gain of green over red, from 8-bit colours."""
    need = {f"{c}_{s}" for c in "rgb" for s in "ba"}
    if not need <= set(pixels.columns):
        return None
    mean = lambda s: ix.brightness(*[F.col(f"{c}_{s}") / 255.0 for c in "rgb"])
    green = lambda s: ix.nd_floor(F.col(f"g_{s}") / 255.0, F.col(f"r_{s}") / 255.0, 0.02)
    return pixels.withColumn("spectral", ix.clip(0.5 * F.abs(mean("a") - mean("b")) + 0.5 * F.abs(green("a") - green("b")), 0.0, 1.0))


def fuse(df: DataFrame, weights: dict[str, float], out: str = "fused") -> DataFrame:
    """Weighted mean of the signal columns that exist."""
    return df.withColumn(out, ix.weighted_mean(weights, set(df.columns)))


def candidate(df: DataFrame, thresholds: dict[str, float], opened: bool = True, out: str = "candidate", keys=()) -> DataFrame:
    """Any signal, or the fused score, at its threshold; then a 3x3 opening."""
    hit: Column = F.lit(False)
    for name, least in thresholds.items():
        if name in df.columns:
            hit = hit | F.coalesce(F.col(name) >= least, F.lit(False))
    df = df.withColumn("_hit", hit)
    return focal.open_(df, "_hit", 1, out, keys).drop("_hit") if opened else df.withColumnRenamed("_hit", out)


def support(rows: DataFrame, thresholds: dict[str, float], keys=("region",)) -> DataFrame:
    """(keys, sources): names of the signals whose mean over a region is at their threshold, sorted."""
    names = [n for n in thresholds if n in rows.columns]
    means = rows.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])
    fired = F.array_compact(F.array(*[F.when(F.col(n) >= thresholds[n], F.lit(n)) for n in sorted(names)]))
    return means.select(*keys, fired.alias("sources"), *[F.col(n).alias(f"mean_{n}") for n in names])


def bare_soil(rows: DataFrame, keys=("region",), least: float = 0.65) -> DataFrame:
    """Share of pixels with little green over red, the lower of both dates, and whether it counts as bare."""
    bare = lambda s: F.avg(((F.col(f"g_{s}") - F.col(f"r_{s}")) / 255.0 < 0.02).cast("double"))
    f = rows.groupBy(*keys).agg(bare("b").alias("bare_before"), bare("a").alias("bare_after"))
    return f.withColumn("bare", F.least("bare_before", "bare_after")).withColumn("bare_context", F.col("bare") >= least)


def segments(rows: DataFrame, least_overlap: float = 0.10, least_score: float = 0.2, least_area: int = 5, most_share: float = 0.35, total: int | None = None, keys=("segment",)) -> DataFrame:
    """Proposed segments worth keeping: enough pixels, candidates and score, and not most of the scene.

    ``rows`` holds each segment's pixels with candidate (Boolean) and score.
    """
    s = rows.groupBy(*keys).agg(F.count("*").alias("area_px"), F.avg(F.col("candidate").cast("double")).alias("overlap"), F.avg("score").alias("score"))
    keep = (F.col("area_px") >= least_area) & (F.col("overlap") >= least_overlap) & (F.col("score") >= least_score)
    return s.where(keep & (F.col("area_px") <= most_share * total) if total else keep)


def directional(d_ndbi: Column, d_ndvi: Column, semantic: Column) -> Column:
    """Built-up rises, vegetation changes or the semantic distance is large."""
    return (d_ndbi > 0.20) | (F.abs(d_ndvi) > 0.15) | (semantic > 0.15)
