"""Land-cover transition rules, vetoes, class codes and the structure verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class code, name.
CLASSES = (
    (1, "bright non-vegetated surface appeared (building / pavement / bare)"),
    (2, "vegetation loss / ground exposed"),
    (3, "vegetation gain"),
    (4, "water appeared"),
    (5, "water disappeared"),
    (6, "dark surface appeared (asphalt / burn scar / wet soil)"),
    (7, "other material change"),
    (8, "construction site / active earthworks"),
)
#: Preset, seed and growth significance.
PRESETS = {"strict": (1e-7, 1e-5), "balanced": (1e-5, 1e-3), "sensitive": (1e-4, 1e-2)}


@dataclass(frozen=True)
class Params:
    """Defaults of the change test."""

    sensitivity: str = "balanced"
    min_area_px: int = 5
    sam_min: float = 0.05
    min_significance: float = 7.0
    reject_slivers: bool = True
    ignore_water_variability: bool = True
    smooth_sigma: float = 1.0
    calibrate: bool = True
    semantic_min_pct: float = 60.0
    target: str = "structures"
    min_rect: float = 0.80
    min_solidity: float = 0.88
    building_max_aspect: float = 4.0
    building_max_px: int = 150
    road_min_len_px: int = 12
    road_max_width_px: float = 6.0
    road_min_aspect: float = 3.5
    min_shape_px: int = 16
    tiny_min_significance: float = 12.0
    max_ndvi_after: float = 0.30


RULES = ("veg_loss", "veg_gain", "w_gain", "w_loss", "built_candidate", "construction_candidate")


def two_valued(c: Column) -> Column:
    """Masks are never null."""
    return F.coalesce(c, F.lit(False))


def evidence(sam: Column | None = None, sam_min: float = 0.05) -> dict[str, Column]:
    """The six rules over ndvi_b, ndvi_a, mndwi_b, mndwi_a and the differences d_ndvi, d_ndbi, d_mndwi, d_bright.

    Without an angle the two surface rules do not ask for one.
    """
    c = F.col
    turned = lambda least: F.lit(True) if sam is None else sam > least
    # fixed values: thresholds of the transition rules
    rules = {
        "veg_loss": (c("ndvi_b") > 0.20) & (c("ndvi_a") < 0.15) & (c("d_ndvi") < -0.12),
        "veg_gain": (c("ndvi_a") > 0.25) & (c("d_ndvi") > 0.12),
        "w_gain": (c("mndwi_a") > 0.10) & (c("d_mndwi") > 0.20),
        "w_loss": (c("mndwi_b") > 0.10) & (c("d_mndwi") < -0.20),
        "built_candidate": (c("ndvi_a") < 0.25) & (c("d_ndbi") > 0.08) & (c("d_bright") > 0.02) & turned(sam_min),
        "construction_candidate": (c("ndvi_a") < 0.40) & (c("d_ndbi") > 0.04) & (c("d_bright") > 0.01) & turned(0.08),
    }
    return {k: two_valued(v) for k, v in rules.items()}


def any_of(*columns: str) -> Column:
    out = F.col(columns[0])
    for x in columns[1:]:
        out = out | F.col(x)
    return out


def dark_new() -> Column:
    return two_valued((F.col("ndvi_a") < 0.20) & (F.col("ndvi_b") < 0.20) & (F.col("d_bright") < -0.02))


def class_code() -> Column:
    """The strongest rule's code: construction, water gain and loss, built, vegetation loss and gain, dark, other."""
    order = (("construction_candidate", 8), ("w_gain", 4), ("w_loss", 5), ("built_candidate", 1), ("veg_loss", 2), ("veg_gain", 3))
    out = F.when(F.col(order[0][0]), order[0][1])
    for name, code in order[1:]:
        out = out.when(F.col(name), code)
    return out.when(dark_new(), 6).otherwise(7)


def brightness_only(sam: Column, sam_min: float = 0.05) -> Column:
    """A change of brightness without one of spectral shape or index."""
    small = (F.abs("d_ndvi") < 0.05) & (F.abs("d_ndbi") < 0.05) & (F.abs("d_mndwi") < 0.05)
    return two_valued((sam < sam_min) & small)


def both_water() -> Column:
    return two_valued((F.col("mndwi_b") > 0.10) & (F.col("mndwi_a") > 0.10) & ~(F.col("w_gain") | F.col("w_loss")))


def snow_cloud(green, nir, swir) -> tuple[Column, Column]:
    """(snow, cloud) of dark-object-subtracted reflectances."""
    from .indices import nd

    snow = two_valued((nd(green, swir) > 0.40) & (green > 0.25) & (nir > 0.11))
    return snow, two_valued((green > 0.30) & (nir > 0.28) & (swir > 0.22)) & ~snow


#: Scene-classification codes that count as invalid, by use.
INVALID_SCL = {"pair": (0, 1, 3, 8, 9, 10), "cloud": (3, 8, 9, 10), "strict_cloud": (3, 9), "composite": (0, 1, 3, 8, 9, 10, 11)}


def clear_scl(scl: Column, use: str = "composite") -> Column:
    return ~scl.isin(*INVALID_SCL[use])


def shape_kind(p: Params = Params()) -> Column:
    """Kind of a region from area, rectangularity, solidity, aspect, skeleton_px (rounded as reported)."""
    c = F.col
    width = c("area") / F.greatest(c("skeleton_px"), F.lit(1))
    road = (c("skeleton_px") >= p.road_min_len_px) & (width <= p.road_max_width_px) & (c("aspect") >= p.road_min_aspect)
    box = (c("rectangularity") >= p.min_rect) & (c("solidity") >= p.min_solidity) & (c("aspect") <= p.building_max_aspect)
    return (
        F.when(c("area") < p.min_shape_px, "tiny").when(road, "road-like")
        .when(box & (c("area") <= p.building_max_px), "building-like").when(box, "large rectangle (field-like)")
        .otherwise("irregular")
    )


def structure_verdict(p: Params = Params()) -> tuple[Column, Column]:
    """(accept, reason) from kind, class_code, significance, ndvi_after, ndvi_after_p25, rectangularity, solidity; the first row that fits decides."""
    c = F.col
    kind, code = c("kind"), c("class_code")
    # fixed values: kinds, codes, verdicts and reasons of the decision table
    green = F.when(kind == "road-like", c("ndvi_after_p25")).otherwise(c("ndvi_after"))
    table = (
        (green > p.max_ndvi_after, False, F.format_string("still vegetated afterwards (NDVI %.2f)", green)),
        ((kind == "tiny") & code.isin(1, 7, 8) & (c("significance") >= p.tiny_min_significance), True, F.lit("")),
        (kind == "tiny", False, F.lit("too small to confirm a structure")),
        ((kind == "road-like") & code.isin(1, 2, 6, 7, 8), True, F.lit("")),
        (kind == "road-like", False, F.lit("thin line but spectral type is not road-like")),
        ((kind == "building-like") & (code == 6), False, F.lit("dark compact patch - wet ground / shadow, not a roof (dark = road only if linear)")),
        ((kind == "building-like") & code.isin(1, 2, 7, 8), True, F.lit("")),
        (kind == "building-like", False, F.lit("rectangular but water/vegetation change")),
        (kind.startswith("large rectangle") & (code == 8), True, F.lit("")),
        (kind.startswith("large rectangle"), False, F.lit(f"rectangle larger than {p.building_max_px} px - looks like a farm plot")),
        ((code == 8) & (c("significance") >= p.min_significance), True, F.lit("")),
        (code == 8, False, F.lit("construction candidate but low statistical significance")),
    )
    outline = F.format_string("irregular outline (rectangularity %s, solidity %s) - not a building or road", c("rectangularity").cast("string"), c("solidity").cast("string"))
    accept, reason = F.when(table[0][0], F.lit(table[0][1])), F.when(table[0][0], table[0][2])
    for when, yes, why in table[1:]:
        accept, reason = accept.when(when, F.lit(yes)), reason.when(when, why)
    return accept.otherwise(False), reason.otherwise(outline)


def construction_code(majority: Column) -> Column:
    """Class 8 if the mean shares of construction, built and vegetation-loss pixels and the structure signal say so."""
    score = F.col("construction_frac") + 0.5 * F.col("built_frac") + 0.3 * F.col("veg_loss_frac")
    return F.when((score > 0.22) & (F.col("structure_mean") > 0.15), F.lit(8)).otherwise(majority)
