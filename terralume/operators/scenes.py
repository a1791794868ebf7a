"""Scene catalogs: completeness, pairing, best scenes, tiles and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def complete(files: DataFrame, needed: int = 5) -> DataFrame:
    """Dates that have a file of every band, with their files by band."""
    return files.groupBy("acq_date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("band", "path")))).alias("paths"), F.count_distinct("band").alias("n")).where(F.col("n") >= needed).drop("n")


def farthest_partner(scenes: DataFrame, tile: str = "tile", date: str = "acq_date", key: str = "scene_id") -> DataFrame:
    """For each scene the scene of its tile that is farthest in time; ties to the smaller id.

    The farthest is the first or the last scene of the tile, so two aggregates replace a self-join.
    """
    ends = scenes.groupBy(tile).agg(F.min(F.struct(date, key)).alias("first"), F.max(F.struct(F.col(date).alias("d"), (-F.col(key)).alias("k"))).alias("last"), F.count("*").alias("n"))
    df = scenes.join(ends, tile).where("n > 1")
    early = F.abs(F.datediff(date, F.col(f"first.{date}")))
    late = F.abs(F.datediff(date, F.col("last.d")))
    first_id, last_id = F.col(f"first.{key}"), -F.col("last.k")
    pick_first = (early > late) | ((early == late) & (first_id < last_id))
    return df.select(tile, key, date, F.when(pick_first, first_id).otherwise(last_id).alias("partner_id"), F.greatest(early, late).alias("days"))


def best(scenes: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order that must name a key last."""
    return scenes.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def best_pair(before: DataFrame, after: DataFrame, grid: str = "tile", cloud: str = "cloud_pct", key: str = "scene_id") -> DataFrame:
    """The clearest scene before and the clearest after on each common grid."""
    order = [F.col(cloud), F.col(key)]
    a = best(before, [grid], order).select(grid, F.col(key).alias("before_id"), F.col(cloud).alias("before_cloud"))
    b = best(after, [grid], order).select(grid, F.col(key).alias("after_id"), F.col(cloud).alias("after_cloud"))
    return a.join(b, grid)


def with_quality(scenes: DataFrame, quality: DataFrame, key: str = "scene_id") -> DataFrame:
    """Scenes with their first quality record; scenes without one go."""
    return scenes.join(quality.dropDuplicates([key]), key)


def without_quality(scenes: DataFrame, quality: DataFrame, key: str = "scene_id") -> DataFrame:
    return scenes.join(quality.select(key), key, "left_anti")


def containing(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """The first raster, by id, whose bounds hold each point; a point outside all gets the first raster of all.

    Rasters of ``bounds`` (raster_id, x0, y0, x1, y1) are dealt to square cells as wide as the
    largest one, at most four or nine each, and meet the points of their cells. Rasters of equal bounds
    meet as one, that of the least id, and points of one place as one, so repeats cost no pairs.
    """
    inside = (F.col("px") >= F.col("x0")) & (F.col("px") <= F.col("x1")) & (F.col("py") >= F.col("y0")) & (F.col("py") <= F.col("y1"))
    wide, fallback = bounds.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), F.min("raster_id")).first()
    cell = lambda c: F.floor(F.col(c) / float(wide or 1.0))
    boxes = bounds.groupBy("x0", "y0", "x1", "y1").agg(F.min("raster_id").alias("raster_id"))
    dealt = boxes.withColumn("gx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("gy", F.explode(F.sequence(cell("y0"), cell("y1"))))
    places = points.select("px", "py").distinct()
    met = places.withColumn("gx", cell("px")).withColumn("gy", cell("py")).join(dealt, ["gx", "gy"]).where(inside)
    hit = met.groupBy("px", "py").agg(F.min("raster_id").alias("raster_id"))
    return points.join(hit, ["px", "py"], "left").select("point_id", F.coalesce("raster_id", F.lit(fallback)).alias("raster_id"), F.col("raster_id").isNotNull().alias("inside"))


def clip_bounds(rasters: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Each raster's part of an area; rasters that miss it go."""
    lo = lambda c, v: F.greatest(F.col(c), F.lit(v))
    hi = lambda c, v: F.least(F.col(c), F.lit(v))
    df = rasters.withColumn("cx0", lo("x0", x0)).withColumn("cy0", lo("y0", y0)).withColumn("cx1", hi("x1", x1)).withColumn("cy1", hi("y1", y1))
    return df.where("cx0 < cx1 AND cy0 < cy1")


def alignment_problems(before: dict, after: dict) -> list[str]:
    """All that keeps two grids (crs, shape, transform) from being compared pixel by pixel.

    ``transform`` is (a, b, c, d, e, f). Tolerances are 1e-3 of a pixel and 1e-6 for its size.
    """
    found = []
    if before["crs"] != after["crs"]:
        found.append("different coordinate systems")
    if tuple(before["shape"]) != tuple(after["shape"]):
        found.append("different shapes")
    b, a = before["transform"], after["transform"]
    if any(abs(b[k] - a[k]) > 1e-6 * max(1.0, abs(b[k])) for k in (0, 1, 3, 4)):
        found.append("different pixel sizes")
    size = abs(b[0]) or 1.0
    if any(abs(b[k] - a[k]) > 1e-3 * size for k in (2, 5)):
        found.append("different origins")
    phase = [((a[k] - b[k]) / size) % 1.0 for k in (2, 5)]
    if any(min(p, 1 - p) > 1e-3 for p in phase):
        found.append("grids are shifted by a part of a pixel")
    return found


def tiles(extent_m: float, size_m: float, spark) -> DataFrame:
    """Grid of square tiles that starts at the lower left corner; the extent must hold whole pixels of 10 m."""
    if abs(extent_m / 10 - round(extent_m / 10)) > 1e-9:
        raise ValueError("the extent is no whole number of pixels")
    n = int(-(-extent_m // size_m))
    k = spark.range(n)
    return k.select(F.col("id").alias("tx")).withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("tx", F.col("ty").cast("long").alias("ty"), (F.col("tx") * size_m).alias("x0"), (F.col("ty") * size_m).alias("y0"))


def season(year: Column, first: int, last: int) -> tuple[Column, Column]:
    """[start, end) of the months first..last of a year."""
    start = F.make_date(year, F.lit(first), F.lit(1))
    return start, F.add_months(F.make_date(year, F.lit(last), F.lit(1)), 1)


def patch_starts(length: Column, size: int, stride: int) -> Column:
    """Starts of patches along one axis; a last one ends at the edge."""
    edge = F.greatest(length - size, F.lit(0))
    return F.array_union(F.sequence(F.lit(0), edge, F.lit(stride)), F.array(edge))


def argument_problems(lat: float, lon: float, size_km: float, years: tuple[int, int], months: tuple[int, int], max_cloud: float, min_clear: float, min_obs: int) -> list[str]:
    """All that is wrong with the arguments of a seasonal composite; an empty list if nothing is."""
    tests = (
        (-80 <= lat <= 84, "latitude outside the UTM range"),
        (-180 <= lon <= 180, "longitude outside -180..180"),
        (size_km > 0 and abs(size_km * 100 - round(size_km * 100)) < 1e-9, "the size is no whole number of pixels"),
        (years[0] <= years[1], "the years run backwards"),
        (1 <= months[0] <= months[1] <= 12, "the months run backwards or do not exist"),
        (0 <= max_cloud <= 100, "cloud cover outside 0..100"),
        (0 <= min_clear <= 1, "clear score outside 0..1"),
        (min_obs >= 1, "fewer than one observation"),
    )
    return [why for ok, why in tests if not ok]


def _problems(*tests: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(wrong, F.lit(why)) for wrong, why in tests]))


def alignment_columns() -> Column:
    """:func:`alignment_problems` of rows with crs, width, pixel size and origin of both grids (crs_b, crs_a, w_b, ...)."""
    c = F.col
    off = F.abs(c("x_a") - c("x_b")) / c("size_b")
    phase = off - F.floor(off)
    return _problems(
        (c("crs_b") != c("crs_a"), "different coordinate systems"), (c("w_b") != c("w_a"), "different shapes"),
        (F.abs(c("size_b") - c("size_a")) > 1e-6 * F.greatest(F.lit(1.0), F.abs("size_b")), "different pixel sizes"),
        (off > 1e-3, "different origins"), (F.least(phase, 1 - phase) > 1e-3, "grids are shifted by a part of a pixel"),
    )


def argument_columns() -> Column:
    """:func:`argument_problems` of rows of requests."""
    c = F.col
    return _problems(
        (~c("lat").between(-80, 84), "latitude outside the UTM range"), (~c("lon").between(-180, 180), "longitude outside -180..180"),
        (c("first_year") > c("last_year"), "the years run backwards"),
        (~(c("first_month").between(1, 12) & c("last_month").between(1, 12) & (c("first_month") <= c("last_month"))), "the months run backwards or do not exist"),
        (~c("max_cloud").between(0, 100), "cloud cover outside 0..100"),
    )


def buffer_km(tile_px: Column, tiles: Column, metres: int = 10) -> Column:
    """Kilometres of a side that holds whole tiles."""
    return F.round(tile_px * tiles * metres / 1000.0, 2)


def lookup(asked: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of ``asked`` with the place, lat and lon of its name; null where no place has it. Places are a small table."""
    name = lambda c: F.lower(F.trim(F.col(c)))
    return asked.join(F.broadcast(places.withColumn("_name", name("place"))), name("asked") == F.col("_name"), "left").drop("_name")
