"""Connected regions, zonal statistics, shapes and merging."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import indices as ix
from ..sources.work import WorkFolder
from . import evaluate, geometry
from .graph import components
from .shapes import by_group, filled, hulls, shapes

__all__ = ["fill_holes", "footprints", "greedy_merge", "hulls", "hysteresis", "label", "majority", "overlapping", "position", "ranked", "remove_small", "shapes", "top", "without_slivers", "zonal"]

#: Side of the tiles that are labelled on their own.
TILE = 512


def label(pixels: DataFrame, mask: Column, width: int, keys=(), tile: int = TILE, name: str = "region") -> DataFrame:
    """(keys, x, y, <name>): 8-connected regions of the set pixels, named by their least y * width + x.

    Tiles are labelled on their own; pixels on both sides of a tile border tie their labels,
    and only those ties go through the distributed component search. The result does not
    depend on the tiling. No set pixel, no row.
    """
    on = pixels.where(mask).select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    on = on.withColumn("tx", F.floor(F.col("x") / tile)).withColumn("ty", F.floor(F.col("y") / tile))

    def one(group: dict) -> dict:
        x, y = group["x"], group["y"]
        m = np.zeros((np.ptp(y) + 1, np.ptp(x) + 1), bool)
        m[y - y.min(), x - x.min()] = True
        lab = geometry.label8(m)[y - y.min(), x - x.min()]
        place = y * width + x
        least = np.full(lab.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, lab, place)
        return {"x": x, "y": y, name: least[lab]}

    tiled = WorkFolder(pixels.sparkSession, "label").put("tiled", by_group(on, [*keys, "tx", "ty"], one, f"x long, y long, `{name}` long"))
    if not tiled.groupBy(*keys).agg(((F.min("tx") < F.max("tx")) | (F.min("ty") < F.max("ty"))).alias("many")).where("many").head(1):
        return tiled.drop("tx", "ty")  # one tile a scene
    border = tiled.where((F.pmod("x", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("y", F.lit(tile)).isin(0, tile - 1)))
    move = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    reach = border.select(*keys, "tx", "ty", F.col(name).alias("other"), "x", "y", move.alias("m")).select(*keys, (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y"), "tx", "ty", "other")
    ties = border.withColumnRenamed("tx", "bx").withColumnRenamed("ty", "by").join(reach, [*keys, "x", "y"]).where("tx <> bx OR ty <> by")
    # labels of different scenes may be equal: they are told apart by a number of the scene and label
    node = (lambda c: F.xxhash64(*keys, c)) if keys else F.col
    roots = components(ties.select(node(name).alias("u"), node("other").alias("v")), "regions")
    grouped = tiled.withColumn("node", node(name)).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = grouped.groupBy("root").agg(F.min(name).alias("least"))
    return grouped.join(names, "root").select(*keys, "x", "y", F.col("least").alias(name))


def fill_holes(pixels: DataFrame, mask: Column, keys=(), tile: int = TILE) -> DataFrame:
    """(keys, x, y): the set pixels and the holes among them: background that no four-connected path leads out of.

    Holes of any size: parts of the background are found tile by tile and tied across borders, see
    :func:`shapes.filled`. Pixels that are not rows are background. No set pixel, no row.
    """
    on = pixels.where(mask).select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    own = [*keys, "_scene"]  # a key of its own, as there may be no other
    on = on.withColumn("_scene", F.lit(0)).withColumn("tx", F.floor(F.col("x") / tile)).withColumn("ty", F.floor(F.col("y") / tile))
    on = WorkFolder(pixels.sparkSession, "fill-holes").put("mask", on.select(*own, "tx", "ty", "x", "y"))
    return filled(on, own, tile).select(*keys, "x", "y")


def hysteresis(pixels: DataFrame, value: str, low: float, high: float, width: int, keys=(), valid: Column | None = None) -> DataFrame:
    """Regions of ``value`` above ``low`` that hold a pixel above ``high``."""
    lab = label(pixels, F.col(value) > low, width, keys).join(pixels.select(*keys, "x", "y", value), [*keys, "x", "y"])
    top = lab.groupBy(*keys, "region").agg(F.max(value).alias("_top")).where(F.col("_top") > high).drop("_top")
    return lab.join(top, [*keys, "region"])


def zonal(rows: DataFrame, means: list[str] = (), keys=("region",)) -> DataFrame:
    """Area, box, centroid and means of the pixels of each region."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("area_px"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), *[F.avg(m).alias(f"mean_{m}") for m in means],
    )


def majority(rows: DataFrame, code: str = "class_code", keys=("region",)) -> DataFrame:
    """The most frequent code of each region, the lowest of equally frequent ones; code 0 never wins."""
    n = rows.where(F.col(code) != 0).groupBy(*keys, code).agg(F.count("*").alias("_n"))
    best = n.groupBy(*keys).agg(F.min(F.struct(-F.col("_n"), F.col(code).alias("c"))).alias("_b"))
    return best.select(*keys, F.col("_b.c").alias(code))


def without_slivers(regions: DataFrame, min_area: int = 5, sliver_area: int = 12, keys=()) -> DataFrame:
    """Regions of enough pixels; those one pixel thin need more.

    A distance to the background above 1 means that all four neighbours are set, so a region
    is thin if none of its pixels has four neighbours.
    """
    wx, wy = W.partitionBy(*keys, "y").orderBy("x").rangeBetween, W.partitionBy(*keys, "x").orderBy("y").rangeBetween
    core = (F.count("*").over(wx(-1, 1)) == 3) & (F.count("*").over(wy(-1, 1)) == 3)
    stats = regions.withColumn("_core", core).groupBy(*keys, "region").agg(F.count("*").alias("area_px"), F.max("_core").alias("thick"))
    keep = stats.where((F.col("area_px") >= min_area) & (F.col("thick") | (F.col("area_px") >= sliver_area))).select(*keys, "region")
    return regions.join(keep, [*keys, "region"], "left_semi")


def remove_small(regions: DataFrame, least: int, keys=()) -> DataFrame:
    big = regions.groupBy(*keys, "region").count().where(F.col("count") >= least).drop("count")
    return regions.join(big, [*keys, "region"], "left_semi")


def ranked(regions: DataFrame, significance: str = "significance", keys=()) -> DataFrame:
    """Regions renumbered from 1 by area times significance, ties by their old number.

    Without keys there is one order for all: rows are dealt by ranges of it and written, each
    task's rows are numbered, and the counts of earlier tasks are added.
    """
    value = F.col("area_px") * F.col(significance)
    if keys:
        return regions.withColumn("id", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(value), "region")))
    names = regions.columns
    order = [F.desc("_value"), F.asc("region")]
    dealt = regions.withColumn("_value", value).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = WorkFolder(regions.sparkSession, "ranked").put("rows", dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))  # one row a task
    inside = F.col("_at") - F.shiftleft(F.col("_part"), 33) + 1
    got = dealt.withColumn("_part", part).join(before, "_part")
    return got.withColumn("id", (F.col("_before") + inside).cast("int")).select(*[c for c in names if c != "id"], "id")


def top(regions: DataFrame, score: str, n: int, tie: str = "region") -> DataFrame:
    return regions.orderBy(F.desc(score), tie).limit(n)


def footprints(regions: DataFrame, pixels: DataFrame, magnitude: str, keys=(), width: int | None = None) -> DataFrame:
    """(keys, region, x, y) of each region's footprint, from the unsmoothed magnitude around it.

    Pixels at most two steps from the region, of at least the Otsu threshold of their magnitude, in pieces of at
    least 6 pixels and 8 percent of the largest. The region itself where there are fewer than 12
    pixels, no contrast, or fewer than 4 left. Rows are made by offsets from the region's pixels, the threshold from a
    histogram by region, pieces by :func:`label` with the region as a key, so no region is one group.
    ``width`` is the raster's, by which pieces are named (a bound taken from the pixels if not given).
    """
    of = [*keys, "region"]
    work = WorkFolder(pixels.sparkSession, "footprints")
    own = work.put("own", regions.select(*of, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct())
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-2, 3) for dy in range(-2, 3) if abs(dx) + abs(dy) <= 2]))
    near = own.withColumn("s", steps).select(*of, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y")).distinct()
    near = work.put("near", near.join(pixels.select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col(magnitude).cast("double").alias("_m")), [*keys, "x", "y"]))
    width = width or (pixels.agg(F.max("x")).first()[0] or 0) + 1
    fit = near.groupBy(*of).agg(F.count("*").alias("n"), (F.max("_m") - F.min("_m")).alias("span")).where("n >= 12 AND span >= 1e-4").select(*of)
    strong = near.join(evaluate.otsu(near.join(fit, of), of, "_m"), of).where(F.col("_m") >= F.col("threshold"))
    pieces = work.put("pieces", label(strong.select(*of, "x", "y"), F.lit(True), width, of, name="piece"))
    sizes = pieces.groupBy(*of, "piece").agg(F.count("*").alias("n"))
    largest = sizes.groupBy(*of).agg(F.max("n").alias("most"))
    kept = sizes.join(largest, of).where((F.col("n") >= 6) & (F.col("n") >= 0.08 * F.col("most")))
    good = kept.groupBy(*of).agg(F.sum("n").alias("n")).where("n >= 4").select(*of)
    found = pieces.join(kept.select(*of, "piece"), [*of, "piece"], "left_semi").join(good, of, "left_semi").select(*of, "x", "y")
    return found.unionByName(own.join(good, of, "left_anti"))


def overlapping(boxes: DataFrame, least: float = 0.4, cell: int = 256, keys=()) -> DataFrame:
    """Pairs (a, b), a < b, of boxes (id, x, y, w, h) whose common area is at least a share of the smaller.

    Boxes are dealt to the grid cells they touch and meet in the cell of the common area's
    upper left corner, so the theta join is an equi-join and each pair is found once.
    """
    cells = lambda p, s: F.sequence(F.floor(F.col(p) / cell), F.floor((F.col(p) + F.col(s) - 1) / cell))
    dealt = boxes.select(*keys, "id", "x", "y", "w", "h").withColumn("gx", F.explode(cells("x", "w"))).withColumn("gy", F.explode(cells("y", "h")))
    a = dealt.select(*keys, "gx", "gy", *[F.col(c).alias(f"a_{c}") for c in ("id", "x", "y", "w", "h")])
    b = dealt.select(*keys, "gx", "gy", *[F.col(c).alias(f"b_{c}") for c in ("id", "x", "y", "w", "h")])
    c = F.col
    left, upper = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    iw = F.least(c("a_x") + c("a_w"), c("b_x") + c("b_w")) - left
    ih = F.least(c("a_y") + c("a_h"), c("b_y") + c("b_h")) - upper
    met = a.join(b, [*keys, "gx", "gy"]).where(c("a_id") < c("b_id")).withColumn("iw", iw).withColumn("ih", ih).where("iw > 0 AND ih > 0")
    met = met.where((c("gx") == F.floor(left / cell)) & (c("gy") == F.floor(upper / cell)))
    share = c("iw") * c("ih") / F.least(c("a_w") * c("a_h"), c("b_w") * c("b_h"))
    return met.withColumn("overlap", share).where(c("overlap") >= least).select(*keys, c("a_id").alias("a"), c("b_id").alias("b"), "overlap")


def greedy_merge(boxes: DataFrame, most: int, overlap: float = 0.4, keys=("scene",)) -> DataFrame:
    """Boxes in order of score; one that overlaps a kept box gives the first such its sources, else it is kept.

    Ends as soon as ``most`` are kept: later boxes give nothing. Which boxes are kept is settled in rounds on
    the table of overlapping pairs: a box is kept once every better one that it overlaps has gone, and goes
    once one of them is kept, so no scene is one group. Order is by score, then id. Columns:
    keys, id, x, y, w, h, score, sources. No box, no row.
    """
    keys = list(keys)
    names = [*keys, "id", "x", "y", "w", "h", "score", "sources"]
    work = WorkFolder(boxes.sparkSession, "greedy-merge")
    boxes = work.put("boxes", boxes.select(*names))
    order = lambda p="": F.struct((-F.col(p + "score")).alias("s"), F.col(p + "id").alias("i"))
    place = boxes.select(*keys, "id", order().alias("o"))
    side = lambda p: place.select(*keys, F.col("id").alias(p), F.col("o").alias("o_" + p))
    pairs = overlapping(boxes, overlap, keys=keys).select(*keys, "a", "b").join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"])
    first = F.col("o_a") < F.col("o_b")
    pairs = work.put("pairs", pairs.select(*keys, F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse")))
    # only boxes of some pair take part in rounds
    box = [*keys, "id"]
    named = lambda df, c: df.select(*keys, F.col(c).alias("id"))
    as_ = lambda df, c: df.select(*keys, F.col("id").alias(c))
    open_, edges = work.put("open-0", named(pairs, "better").unionAll(named(pairs, "worse")).distinct()), pairs
    turn, gone_parts = 0, []
    while not open_.isEmpty():
        turn += 1
        kept = work.put(f"kept-{turn}", open_.join(named(edges, "worse"), box, "left_anti"))
        gone = work.put(f"gone-{turn}", named(edges.join(as_(kept, "better"), [*keys, "better"], "left_semi"), "worse").distinct())
        gone_parts.append(gone)
        open_ = work.put(f"open-{turn}", open_.join(kept, box, "left_anti").join(gone, box, "left_anti"))
        edges = work.put(f"edges-{turn}", edges.join(as_(open_, "better"), [*keys, "better"], "left_semi").join(as_(open_, "worse"), [*keys, "worse"], "left_semi"))
    held = boxes
    for gone in gone_parts:
        held = held.join(gone, box, "left_anti")
    at = W.partitionBy(*keys).orderBy(order())
    held = work.put("held", held.withColumn("_rank", F.row_number().over(at)).where(F.col("_rank") <= most))
    ends = held.where(F.col("_rank") == most).select(*keys, order().alias("end"))
    # a box that went belongs to the best kept box that it overlaps
    lost = pairs.join(held.select(*keys, F.col("id").alias("better"), order().alias("o")), [*keys, "better"])
    lost = lost.groupBy(*keys, "worse").agg(F.min("o").alias("o")).select(*keys, F.col("worse").alias("id"), F.col("o.i").alias("to"))
    lost = lost.join(boxes.select(*box, order().alias("o"), "sources"), box).join(ends, keys, "left").where("end IS NULL OR o < end")
    given = lost.select(*keys, F.col("to").alias("id"), "sources").unionAll(held.select(*box, "sources"))
    sources = given.select(*box, F.explode("sources").alias("s")).groupBy(*box).agg(F.array_sort(F.collect_set("s")).alias("merged"))
    empty = F.array().cast(boxes.schema["sources"].dataType)
    return held.drop("_rank").join(sources, box, "left").withColumn("sources", F.coalesce("merged", empty)).select(*names)


def position(regions: DataFrame, width: int, height: int) -> DataFrame:
    return regions.withColumn("position", ix.position_word(F.col("cx") / float(width), F.col("cy") / float(height)))
