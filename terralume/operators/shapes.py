"""Shapes of regions of any size: by region where one fits a tile, over tiles with halos where not."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.work import WorkFolder
from . import geometry
from .graph import components

#: Side of the tiles; a region whose box fits one is worked on as a whole.
TILE = 512
#: Pixels of the neighbours that a tile sees in a round of thinning.
HALO = 64
#: Lines whose ends make one hull.
BAND = 4096


def _fields(rows: DataFrame, keys, more: str) -> str:
    return ", ".join([*[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys], more])


def by_group(rows: DataFrame, at, fn, more: str) -> DataFrame:
    """(at, more): what ``fn`` makes of the numpy columns of each group, a dict of arrays of one length.

    Many groups come and go in one Arrow batch, so a group of a few pixels costs its kernel only.
    """
    at, names = list(at), rows.columns
    schema = _fields(rows, at, more)
    made = T._parse_datatype_string(more).fieldNames()

    def each(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            cuts = _cuts(t, at)
            held = t.slice(cuts[-1]) if len(t) else held
            if cuts[-1]:
                yield from run(t.slice(0, cuts[-1]), cuts)
        if held is not None and len(held):
            yield from run(held, [0, len(held)])

    def run(t, cuts):
        columns = {c: t.column(c).to_numpy() for c in names}
        out = [fn({c: v[a:z] for c, v in columns.items()}) for a, z in zip(cuts[:-1], cuts[1:])]
        n = [len(o[made[0]]) for o in out]
        if sum(n):
            first = pa.array(np.repeat(np.array(cuts[:-1]), n))
            keys = [t.column(k).take(first).combine_chunks() for k in at]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(np.concatenate([o[c] for o in out])) for c in made]], [*at, *made])

    return rows.repartition(*at).sortWithinPartitions(*at).mapInArrow(each, schema)


def _cuts(t: pa.Table, at: list[str]) -> list[int]:
    """Places at which groups of sorted rows begin; 0 first, and the beginning of the last, which may go on."""
    new = np.zeros(len(t), bool)
    for k in at:
        code = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return [0, *np.flatnonzero(new).tolist()]


def dealt(rows: DataFrame, tile: int, halo: int) -> DataFrame:
    """Rows with tx and ty of every tile within ``halo`` pixels."""
    reach = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    return rows.withColumn("tx", F.explode(reach("x"))).withColumn("ty", F.explode(reach("y")))


def _raster(pdf: pd.DataFrame, tile: int, halo: int) -> tuple[np.ndarray, int, int]:
    """A tile's pixels with its halo, and the place of the upper left one."""
    tx, ty, x, y = (np.asarray(pdf[c]) for c in ("tx", "ty", "x", "y"))
    x0, y0 = int(tx[0]) * tile - halo, int(ty[0]) * tile - halo
    m = np.zeros((tile + 2 * halo,) * 2, bool)
    m[y - y0, x - x0] = True
    return m, x0, y0


def _same(row: pd.Series, keys, n: int) -> dict[str, pd.Series]:
    """The keys of a row, n times, as plain objects."""
    return {k: pd.Series([row[k]] * n, dtype=object) for k in keys}


def _rows(pdf: pd.DataFrame, keys, m: np.ndarray, x0: int, y0: int) -> pd.DataFrame:
    y, x = np.nonzero(m)
    first = pdf.iloc[0]
    return pd.DataFrame({**_same(first, keys, len(x)), "tx": int(first["tx"]), "ty": int(first["ty"]), "x": x + x0, "y": y + y0})


def by_tile(rows: DataFrame, keys, kernel, tile: int, halo: int) -> DataFrame:
    """(keys, tx, ty, x, y): a mask kernel that looks at most ``halo`` pixels around, tile by tile."""
    keys = list(keys)

    def one(group: dict) -> dict:
        m, x0, y0 = _raster(group, tile, halo)
        y, x = np.nonzero(kernel(m)[halo : halo + tile, halo : halo + tile])
        return {"x": x + (x0 + halo), "y": y + (y0 + halo)}

    return by_group(dealt(rows.select(*keys, "x", "y"), tile, halo), [*keys, "tx", "ty"], one, "x long, y long")


def filled(mask: DataFrame, keys, tile: int = TILE) -> DataFrame:
    """(keys, tx, ty, x, y): the mask and its holes, background that reaches no frame around the mask by four-connected steps.

    Background is numbered in each tile that holds mask pixels; a part that touches no border is
    a hole at once, all others meet across borders, with tiles that hold no mask pixel as
    one part each. Parts that do not connect to the ring of tiles around the box are holes.
    ``mask`` has keys, tx, ty, x and y as from :func:`by_tile`. An empty mask stays empty.
    """
    keys = list(keys)
    work = WorkFolder(mask.sparkSession, "holes")
    at = [*keys, "tx", "ty"]

    def borders(group: dict) -> dict:
        m, x0, y0 = _raster(group, tile, 0)
        part = geometry.label4(~m)
        frame = np.zeros_like(m)
        frame[[0, -1]] = frame[:, [0, -1]] = True
        y, x = np.nonzero(frame & ~m)
        return {"x": x + x0, "y": y + y0, "part": part[y, x]}

    edge = work.put("edge", by_group(mask.select(*at, "x", "y"), at, borders, "x long, y long, part long"))
    held = mask.select(*at).distinct()
    box = held.groupBy(*keys).agg(*[f(c).alias(f"{n}{c}") for c in ("tx", "ty") for n, f in (("a", F.min), ("b", F.max))])
    grid = box.withColumn("tx", F.explode(F.expr("sequence(atx - 1, btx + 1)"))).withColumn("ty", F.explode(F.expr("sequence(aty - 1, bty + 1)")))
    blank = work.put("blank", grid.select(*at).join(held, at, "left_anti").withColumn("part", F.lit(1).cast("long")))
    node = lambda tx="tx", ty="ty", part="part": F.xxhash64(*keys, tx, ty, part)

    pairs = []
    for dx, dy in ((1, 0), (0, 1)):
        on = F.pmod("x", F.lit(tile)) == tile - 1 if dx else F.pmod("y", F.lit(tile)) == tile - 1
        ahead = edge.where(on).select(*keys, (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), node().alias("u"))
        pairs.append(ahead.join(edge.select(*keys, "x", "y", node().alias("v")), [*keys, "x", "y"]).select("u", "v").distinct())
        for step in (1, -1):
            side = F.pmod("x" if dx else "y", F.lit(tile)) == (tile - 1 if step > 0 else 0)
            next_ = edge.where(side).select(*keys, (F.col("tx") + dx * step).alias("tx"), (F.col("ty") + dy * step).alias("ty"), node().alias("u")).distinct()
            pairs.append(next_.join(blank, at).select("u", node().alias("v")))
        moved = blank.select(*keys, (F.col("tx") + dx).alias("tx"), (F.col("ty") + dy).alias("ty"), node().alias("u"))
        pairs.append(moved.join(blank, at).select("u", node().alias("v")))
    ties = pairs[0]
    for p in pairs[1:]:
        ties = ties.unionAll(p)
    roots = components(ties, "holes-parts")
    ring = box.select(*keys, node(F.col("atx") - 1, F.col("aty") - 1, F.lit(1).cast("long")).alias("node")).join(roots, "node", "left").select(*keys, F.coalesce("root", "node").alias("outside"))
    parts = edge.select(*at, "part").distinct().withColumn("blank", F.lit(False)).unionAll(blank.withColumn("blank", F.lit(True)))
    holes = parts.withColumn("node", node()).join(roots, "node", "left").join(ring, keys).where(F.coalesce("root", "node") != F.col("outside"))
    holes = work.put("parts", holes.select(*at, "part", "blank"))

    def fill(pdf: pd.DataFrame, inside: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: pd.Series([], dtype=object if c in keys else "int64") for c in [*at, "x", "y"]})
        m, x0, y0 = _raster(pdf, tile, 0)
        part = geometry.label4(~m)
        open_ = np.zeros(part.max() + 1, bool)
        open_[part[[0, -1]].ravel()] = open_[part[:, [0, -1]].ravel()] = True  # 0 is the mask
        open_[inside["part"].to_numpy(np.int64)] = False
        open_[0] = False
        return _rows(pdf, keys, ~open_[part], x0, y0)

    full = mask.groupBy(*at).cogroup(holes.where("NOT blank").groupBy(*at)).applyInPandas(fill, _fields(mask, keys, "tx long, ty long, x long, y long"))
    line = lambda c: F.sequence(F.col("t" + c) * tile, (F.col("t" + c) + 1) * tile - 1)
    return full.unionByName(holes.where("blank").select(*at, F.explode(line("y")).alias("y"), line("x").alias("xs")).select(*at, F.explode("xs").alias("x"), "y"))


def thinned(rows: DataFrame, keys, tile: int = TILE, halo: int = HALO) -> DataFrame:
    """(keys, x, y): the skeleton; rounds of steps inside tiles that see ``halo`` pixels around them, until none removes a pixel."""
    work = WorkFolder(rows.sparkSession, "thinned")
    now, last, turn = rows.select(*keys, "x", "y"), -1, 0
    while True:
        now = work.put(str(turn), by_tile(now, keys, lambda m: geometry.skeleton(m, halo // 2), tile, halo).select(*keys, "x", "y"))
        n = now.count()
        if n == last:
            return now
        if turn > 1:
            work.drop(str(turn - 2))
        last, turn = n, turn + 1


def outlines(rows: DataFrame, keys) -> DataFrame:
    """(keys, area, long and short side of the least rectangle, hull_px), from the ends of lines and hulls of them by bands of lines."""
    keys = list(keys)
    area = rows.groupBy(*keys).agg(F.count("*").alias("area"))
    ends = rows.groupBy(*keys, "y").agg(F.min("x").alias("a"), F.max("x").alias("b")).withColumn("band", F.floor(F.col("y") / BAND))

    def points(group: dict) -> np.ndarray:
        return geometry.hull(np.concatenate([np.column_stack([group[c], group["y"]]) for c in ("a", "b")]))

    def part(group: dict) -> dict:
        h = points(group)
        return {"a": h[:, 0], "b": h[:, 0], "y": h[:, 1]}

    def whole(group: dict) -> dict:
        h = points(group)
        short, long = sorted(side + 1.0 for side in geometry.least_rectangle(h))
        return {"short": np.array([short]), "long": np.array([long]), "hull_px": np.array([geometry.hull_pixels(h)])}

    bands = by_group(ends, [*keys, "band"], part, "a long, b long, y long").drop("band")
    return by_group(bands, keys, whole, "short double, long double, hull_px long").join(area, keys)


def closed_and_filled(rows: DataFrame, keys, tile: int = TILE) -> DataFrame:
    """(keys, x, y): every region closed by a 3x3 square, its holes filled, over tiles."""
    work = WorkFolder(rows.sparkSession, "closed")
    closed = work.put("closed", by_tile(rows, keys, geometry.close3, tile, 2))
    return filled(closed, keys, tile).select(*keys, "x", "y")


def split_by_size(rows: DataFrame, keys, tile: int, work: WorkFolder) -> tuple[DataFrame, DataFrame | None]:
    """Rows of regions whose box fits a tile, and those of all others (None if there are none)."""
    rows = work.put("rows", rows.select(*keys, "x", "y"))
    box = rows.groupBy(*keys).agg((F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) >= tile).alias("large"))
    large = work.put("large", box.where("large").drop("large"))
    if large.isEmpty():
        return rows, None
    return rows.join(large, list(keys), "left_anti"), rows.join(large, list(keys), "left_semi")


def shapes(rows: DataFrame, keys=("region",), least_px: int = 16, tile: int = TILE) -> DataFrame:
    """Area after closing and filling, rectangularity, solidity, aspect, skeleton length and mean width of each region.

    ``rows`` has keys, x and y. A region whose box fits a tile is one group; a larger one never
    is: it is closed, filled and thinned over tiles, and its hull is a hull of hulls. The result
    does not depend on ``tile``. A region below ``least_px`` has neutral values but its area.
    Repeated pixels count once; no row, no region.
    """
    keys = list(keys)
    work = WorkFolder(rows.sparkSession, "shapes")
    small, large = split_by_size(rows, keys, tile, work)

    def one(group: dict) -> dict:
        return {k: np.array([v]) for k, v in geometry.metrics(group["x"].astype(np.int64), group["y"].astype(np.int64), least_px).items()}

    out = by_group(small, keys, one, "area long, rectangularity double, solidity double, aspect double, skeleton_px long, mean_width_px double")
    if large is None:
        return out
    full = work.put("full", closed_and_filled(large, keys, tile))
    halo = min(HALO, tile)
    bones = thinned(full, keys, tile, halo).groupBy(*keys).agg(F.count("*").alias("skeleton_px"))
    got = outlines(full, keys).join(bones, keys)

    def finish(batches):
        for batch in batches:
            rows = batch.select(["area", "short", "long", "hull_px", "skeleton_px"]).to_pylist()
            found = [geometry.rounded(r["area"], r["short"], r["long"], r["hull_px"], r["skeleton_px"]) if r["area"] >= least_px else geometry.NEUTRAL for r in rows]
            columns = [pa.array(v, k) for v, k in zip(zip(*found), (pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.select([*keys, "area"]).columns, *columns], [*keys, "area", *geometry.SHAPE])

    schema = _fields(rows, keys, "area long, rectangularity double, solidity double, aspect double, skeleton_px long, mean_width_px double")
    return out.unionByName(got.select(*keys, "area", "short", "long", "hull_px", "skeleton_px").mapInArrow(finish, schema))


def hulls(rows: DataFrame, keys=("region",), tile: int = TILE) -> DataFrame:
    """(keys, area, hull_px): pixels of each region, closed and filled, and those whose centre its convex hull holds."""
    keys = list(keys)
    work = WorkFolder(rows.sparkSession, "hulls")
    small, large = split_by_size(rows, keys, tile, work)

    def one(group: dict) -> dict:
        y, x = np.nonzero(geometry.fill_holes(geometry.close3(geometry.crop_mask(group["x"].astype(np.int64), group["y"].astype(np.int64)))))
        return {"area": np.array([len(x)]), "hull_px": np.array([geometry.hull_pixels(geometry.hull(np.column_stack([x, y])))])}

    out = by_group(small, keys, one, "area long, hull_px long")
    return out if large is None else out.unionByName(outlines(closed_and_filled(large, keys, tile), keys).select(*keys, "area", "hull_px"))
