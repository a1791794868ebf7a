"""Neighbourhood operators on pixel tables: separable windows, kernels, histogram matching.

Each pass partitions by one raster line (scene and row, or scene and column), so a window
holds at most a line and all lines run in parallel; nothing gathers a whole scene.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import indices as ix
from ..sources.work import WorkFolder


def _line(keys, along: str, across: str, before: int, after: int):
    return W.partitionBy(*keys, across).orderBy(along).rangeBetween(-before, after)


def box_sum(df: DataFrame, column: str, k: int, out: str | None = None, keys=(), mean: bool = False) -> DataFrame:
    """Sum (or mean of the pixels there) over a (2k+1) x (2k+1) window; pixels off the raster do not count."""
    out = out or f"{column}_box"
    df = df.withColumn("_r", F.sum(column).over(_line(keys, "x", "y", k, k))).withColumn("_n", F.count(column).over(_line(keys, "x", "y", k, k)))
    column_line = _line(keys, "y", "x", k, k)
    df = df.withColumn("_s", F.sum("_r").over(column_line)).withColumn("_m", F.sum("_n").over(column_line))
    value = F.when(F.col("_m") > 0, F.col("_s") / F.when(F.col("_m") > 0, F.col("_m")).otherwise(1)) if mean else F.col("_s")
    return df.withColumn(out, value).drop("_r", "_n", "_s", "_m")


def _morph(df: DataFrame, column: str, k: int, out: str, keys, f) -> DataFrame:
    df = df.withColumn("_r", f(F.col(column).cast("int")).over(_line(keys, "x", "y", k, k)))
    return df.withColumn(out, f("_r").over(_line(keys, "y", "x", k, k)) == 1).drop("_r")


def dilate(df: DataFrame, column: str, k: int = 1, out: str | None = None, keys=()) -> DataFrame:
    """Any pixel set within a (2k+1) square; k = 4 is the 3x3 dilation four times."""
    return _morph(df, column, k, out or f"{column}_dilated", keys, F.max)


def erode(df: DataFrame, column: str, k: int = 1, out: str | None = None, keys=()) -> DataFrame:
    return _morph(df, column, k, out or f"{column}_eroded", keys, F.min)


def close(df: DataFrame, column: str, k: int = 1, out: str | None = None, keys=()) -> DataFrame:
    """Dilate, then erode."""
    return erode(dilate(df, column, k, "_c", keys), "_c", k, out or f"{column}_closed", keys).drop("_c")


def open_(df: DataFrame, column: str, k: int = 1, out: str | None = None, keys=()) -> DataFrame:
    """Erode, then dilate."""
    return dilate(erode(df, column, k, "_o", keys), "_o", k, out or f"{column}_opened", keys).drop("_o")


def disk(radius: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]


def dilate_offsets(df: DataFrame, column: str, offsets: list[tuple[int, int]], out: str, keys=()) -> DataFrame:
    """Dilation by any structuring element: set pixels are replicated by the offsets and joined back."""
    moves = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets]))
    hit = df.where(column).select(*keys, "x", "y", moves.alias("m")).select(*keys, (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y")).distinct().withColumn(out, F.lit(True))
    return df.join(hit, [*keys, "x", "y"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def gaussian_kernel(sigma: float, radius: int | None = None) -> list[float]:
    radius = radius if radius is not None else max(1, (round(sigma * 8 + 1) | 1) // 2)
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def convolve(df: DataFrame, columns: list[str], kernel: list[float], keys=()) -> DataFrame:
    """Separable convolution of dense rasters, border mirrored without repeating the edge pixel; columns keep their names.

    Lines are dealt out and sorted by Spark and convolved as arrays, some lines at a time.
    """
    for along, across in (("x", "y"), ("y", "x")):
        df = _convolve_lines(df, columns, kernel, list(keys), along, across)
    return df


def mirrored(v: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Convolution of one line; a line shorter than the kernel is mirrored again and again."""
    r, n = len(kernel) // 2, len(v)
    if n == 1:
        return v * kernel.sum()
    place = np.abs((np.arange(-r, n + r) + n - 1) % (2 * (n - 1)) - (n - 1))
    return np.convolve(v[place], kernel[::-1], "valid")


def _convolve_lines(df: DataFrame, columns, kernel, keys, along, across) -> DataFrame:
    names, line = df.columns, [*keys, across]
    df = df.withColumns({c: F.col(c).cast("double") for c in columns})
    weights = np.array(kernel)

    def whole(t: pa.Table, ends: np.ndarray):
        out = {c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False).copy() for c in columns}
        start = 0
        for end in ends.tolist():
            for v in out.values():
                v[start:end] = mirrored(v[start:end], weights)
            start = end
        for c in columns:
            t = t.set_column(t.schema.get_field_index(c), c, pa.array(out[c]))
        yield from t.to_batches()

    def each(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            differs = np.zeros(len(t) - 1, bool)
            for c in line:
                v = t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
                differs |= v[1:] != v[:-1]
            ends = np.flatnonzero(differs) + 1
            if len(ends):
                yield from whole(t.slice(0, int(ends[-1])), ends)
                t = t.slice(int(ends[-1]))
            held = t
        if held is not None and len(held):
            yield from whole(held, np.array([len(held)]))

    return df.repartition(*line).sortWithinPartitions(*line, along).mapInArrow(each, df.schema).select(names)


def sobel(df: DataFrame, column: str, out: str, keys=()) -> DataFrame:
    """Gradient length of the 3x3 Sobel pair; missing neighbours repeat the pixel at the border."""
    wx, wy = W.partitionBy(*keys, "y").orderBy("x"), W.partitionBy(*keys, "x").orderBy("y")
    near = lambda f, w, c: F.coalesce(f(c, 1).over(w), F.col(c))
    df = df.withColumn("_l", near(F.lag, wx, column)).withColumn("_e", near(F.lead, wx, column))
    df = df.withColumn("_dx", F.col("_e") - F.col("_l")).withColumn("_sx", F.col("_l") + 2 * F.col(column) + F.col("_e"))
    gx = near(F.lag, wy, "_dx") + 2 * F.col("_dx") + near(F.lead, wy, "_dx")
    gy = near(F.lead, wy, "_sx") - near(F.lag, wy, "_sx")
    df = df.withColumn("_gx", gx).withColumn("_gy", gy)
    return df.withColumn(out, F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))).drop("_l", "_e", "_dx", "_sx", "_gx", "_gy")


def edge_density(df: DataFrame, column: str, threshold: float = 60.0, k: int = 7, out: str = "edge_density", keys=()) -> DataFrame:
    """Share of strong edges in a (2k+1) square."""
    df = sobel(df, column, "_g", keys).withColumn("_edge", (F.col("_g") > threshold).cast("double"))
    return box_sum(df, "_edge", k, out, keys, mean=True).drop("_g", "_edge")


def ssim(df: DataFrame, a: str, b: str, span: float, k: int = 3, out: str = "ssim", keys=()) -> DataFrame:
    """Structural similarity of two bands in a (2k+1) square around each pixel; ``span`` is the range of values.

    Sample variances over the pixels there; two constants steady the ratio as usual (1 and 3 percent of the span).
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    df = df.withColumns({"_x": x, "_y": y, "_xx": x * x, "_yy": y * y, "_xy": x * y})
    for c in ("_x", "_y", "_xx", "_yy", "_xy"):
        df = box_sum(df, c, k, f"{c}m", keys, mean=True)
    df = box_sum(df.withColumn("_1", F.lit(1)), "_1", k, "_k", keys)
    unbias = F.col("_k") / F.greatest(F.col("_k") - 1, F.lit(1))
    mx, my = F.col("_xm"), F.col("_ym")
    vx, vy, vxy = ((F.col(c) - m) * unbias for c, m in (("_xxm", mx * mx), ("_yym", my * my), ("_xym", mx * my)))
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    value = (2 * mx * my + c1) * (2 * vxy + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))
    return df.withColumn(out, value).drop("_x", "_y", "_xx", "_yy", "_xy", "_xm", "_ym", "_xxm", "_yym", "_xym", "_1", "_k")


def nearest(coarse: DataFrame, fine: DataFrame, factor: int, columns: list[str], keys=()) -> DataFrame:
    """Values of a grid ``factor`` times as coarse on the fine grid, by an equi-join on the divided place."""
    place = {a: F.floor(F.col(a) / float(factor)).cast("int") for a in ("x", "y")}
    return fine.withColumn("_cx", place["x"]).withColumn("_cy", place["y"]).join(coarse.select(*keys, F.col("x").alias("_cx"), F.col("y").alias("_cy"), *columns), [*keys, "_cx", "_cy"]).drop("_cx", "_cy")


def _weighted(coarse: DataFrame, fine: DataFrame, factor: int, column: str, size: dict[str, int], reach: tuple[int, int], weight) -> DataFrame:
    """(x, y, column): each fine pixel's weighted sum over the coarse pixels around its place; the border repeats.

    ``reach`` is the first and last neighbour of the coarse pixel at or before the place, ``weight`` gives a neighbour's weight by
    its distance. The neighbours of every coarse pixel become columns, first along one axis, then along the other, and fine
    pixels join them once: four rows a coarse pixel and axis travel, not all neighbours of every fine
    pixel. Sides are dealt by the key: the size that Spark guesses for them before it reads them is too small.
    """
    low, high = reach
    offsets = range(low, high + 1)
    cut = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v))
    held = coarse.select(*[F.col(a).cast("long").alias(f"_b{a}") for a in ("x", "y")], F.col(column).cast("double").alias("_v"))
    values = ["_v"]
    for a, n in size.items():
        b = f"_b{a}"
        held = held.withColumn("_at", F.explode(F.sequence(F.col(b) - high, F.col(b) - low)))
        near = {f"{v}_{k}": F.sum(F.when(cut(F.col("_at") + i, n) == F.col(b), F.col(v))) for v in values for k, i in enumerate(offsets)}
        rest = [c for c in ("_bx", "_by") if c != b]
        held = held.groupBy(F.col("_at").alias(b), *rest).agg(*[c.alias(v) for v, c in near.items()])
        values = list(near)
    df = fine.select("x", "y")
    df = df.withColumns({f"_f{a}": (F.col(a) + 0.5) / factor - 0.5 for a in size})
    df = df.withColumns({f"_b{a}": F.greatest(F.lit(-high), F.least(F.lit(n - 1 - low), F.floor(f"_f{a}"))).cast("long") for a, n in size.items()})
    df = df.withColumns({f"_w{a}_{k}": weight(F.col(f"_f{a}") - F.floor(f"_f{a}") - i) for a in size for k, i in enumerate(offsets)})
    first, second = size
    met = df.join(held.hint("merge"), ["_bx", "_by"])
    total = ix.sum_of(*[F.col(f"_w{first}_{k}") * F.col(f"_w{second}_{m}") * F.coalesce(F.col(f"_v_{k}_{m}"), F.lit(0.0)) for k, _ in enumerate(offsets) for m, _ in enumerate(offsets)])
    return met.select("x", "y", F.when(F.coalesce(*values).isNotNull(), total).alias(column))


def bilinear(coarse: DataFrame, fine: DataFrame, factor: int, column: str, width: int, height: int) -> DataFrame:
    """Four weighted neighbours of a pixel-centred coarse grid; the border repeats."""
    return _weighted(coarse, fine, factor, column, {"x": width, "y": height}, (0, 1), lambda t: 1 - F.abs(t))


def area(pixels: DataFrame, factor: int, columns: list[str], keys=()) -> DataFrame:
    """Means of ``factor`` x ``factor`` pixels."""
    place = [F.floor(F.col(a) / float(factor)).alias(a) for a in ("x", "y")]
    return pixels.groupBy(*keys, *place).agg(*[F.avg(c).alias(c) for c in columns])


def _cubic(t):
    """Weight of a neighbour at distance t; the free parameter is -0.75."""
    d = F.abs(t)
    return F.when(d <= 1, 1.25 * d * d * d - 2.25 * d * d + 1).when(d < 2, -0.75 * d * d * d + 3.75 * d * d - 6 * d + 3).otherwise(0.0)


def bicubic(coarse: DataFrame, fine: DataFrame, factor: int, column: str, width: int, height: int) -> DataFrame:
    """Sixteen weighted neighbours of a pixel-centred coarse grid; the border repeats."""
    return _weighted(coarse, fine, factor, column, {"x": width, "y": height}, (-1, 2), _cubic)


def warp_utm(source: DataFrame, grid: DataFrame, bands: list[str], source_at: tuple[int, tuple], grid_at: tuple[int, tuple], smooth: bool = False) -> DataFrame:
    """(x, y, bands): ``source`` on another grid of pixels, which may be of another UTM zone.

    ``source_at`` and ``grid_at`` are (zone, affine transform of pixel centres). Each pixel of ``grid`` (x, y) is taken
    back to a place in the source, by latitude and longitude where zones differ: its value is the nearest
    source pixel's, or (``smooth``) the bilinear mean of the four around it, those that are there counting
    in proportion. Pixels whose place meets no source pixel go. The grid meets the
    source by an equi-join on source pixels, one row or four a pixel.
    """
    e, n = ix.affine("x", "y", grid_at[1])
    at = grid.select("x", "y", e.alias("_e"), n.alias("_n"))
    if source_at[0] != grid_at[0]:  # by steps: written out in one, the series would repeat in one another
        lat, lon = ix.utm_inverse(F.col("_e"), F.col("_n"), grid_at[0])
        at = at.select("x", "y", lat.alias("_lat"), lon.alias("_lon"))
        e, n = ix.utm_forward(F.col("_lat"), F.col("_lon"), source_at[0])
        # written, or a join's filters would be pushed down through all of them
        at = WorkFolder(grid.sparkSession, "warp").put("places", at.select("x", "y", e.alias("_e"), n.alias("_n")))
    column, line = ix.affine("_e", "_n", ix.inverse_affine(source_at[1]))
    at = at.select("x", "y", column.alias("_c"), line.alias("_l"))
    if not smooth:
        near = lambda c: F.floor(F.col(c) + 0.5).cast("long")
        values = source.select(F.col("x").cast("long").alias("_x"), F.col("y").cast("long").alias("_y"), *bands)
        return at.select("x", "y", near("_c").alias("_x"), near("_l").alias("_y")).join(values, ["_x", "_y"]).select("x", "y", *bands)
    base = at.withColumn("_x", F.floor("_c").cast("long")).withColumn("_y", F.floor("_l").cast("long")).withColumn("_fx", F.col("_c") - F.col("_x")).withColumn("_fy", F.col("_l") - F.col("_y"))
    corners = [F.struct((F.col("_x") + dx).alias("_x"), (F.col("_y") + dy).alias("_y"), ((F.col("_fx") if dx else 1 - F.col("_fx")) * (F.col("_fy") if dy else 1 - F.col("_fy"))).alias("_w")) for dx in (0, 1) for dy in (0, 1)]
    four = base.select("x", "y", F.inline(F.array(*corners))).where(F.col("_w") > 1e-4)
    values = source.select(F.col("x").cast("long").alias("_x"), F.col("y").cast("long").alias("_y"), *[F.col(b).alias("_" + b) for b in bands])
    met = four.join(values, ["_x", "_y"])
    return met.groupBy("x", "y").agg(*[(F.sum(F.col("_w") * F.col("_" + b)) / F.sum("_w")).alias(b) for b in bands])


def phase_shift(rows: DataFrame, a: str, b: str, keys=("tile",), block: int = 64) -> DataFrame:
    """(keys, dx, dy, sub_dx, sub_dy, blocks, share): the shift that takes band a to band b, by vote of blocks.

    Blocks of ``block`` pixels that overlap by half each give the peak of the phase correlation of their
    tapered bands, a fraction of a pixel fitted beside it, and as weight how far the peak stands out. The whole shift
    of most weight wins; its blocks' mean fraction is added in sub_dx and sub_dy; ``share`` is its share of the
    weight. Missing pixels count as the block's mean; blocks of fewer than half their pixels or
    without contrast have no vote. A shift must be less than half a block.
    """
    import numpy as np
    import pandas as pd

    names = list(keys)
    step = block // 2
    taper = np.hanning(block + 2)[1:-1]
    window = taper[:, None] * taper[None, :]

    def one(pdf):
        y, x = (pdf[c].to_numpy(np.int64) - int(pdf[d].iloc[0]) * step for c, d in (("y", "by"), ("x", "bx")))
        spectra = []
        for c in (a, b):
            v = pdf[c].to_numpy(float)
            m = np.zeros((block, block))
            m[y, x] = v - v.mean()
            spectra.append(np.fft.fft2(m * window))
        cross = spectra[1] * np.conj(spectra[0])
        if len(pdf) < block * block / 2 or not np.abs(cross).max() > 1e-9:
            return pd.DataFrame({c: pd.Series([], dtype=object if c in names else float) for c in [*names, "dx", "dy", "fx", "fy", "weight"]})
        peak = np.real(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)))
        top = np.unravel_index(peak.argmax(), peak.shape)
        whole, part = [], []
        for axis in (0, 1):
            low, mid, high = (peak[tuple((t + d) % block if k == axis else t for k, t in enumerate(top))] for d in (-1, 0, 1))
            bend = low - 2 * mid + high
            part.append(0.5 * (low - high) / bend if bend < 0 else 0.0)
            whole.append(int(top[axis] - block if top[axis] > block // 2 else top[axis]))
        first = pdf.iloc[0]
        return pd.DataFrame({**{k: pd.Series([first[k]], dtype=object) for k in names}, "dx": [whole[1]], "dy": [whole[0]], "fx": [part[1]], "fy": [part[0]], "weight": [float(peak.max() / (np.abs(peak).mean() + 1e-12))]})

    schema = ", ".join([*[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in names], "dx int, dy int, fx double, fy double, weight double"])
    # a pixel lies in two blocks of each axis
    both = lambda c: F.explode(F.array(F.floor(F.col(c) / step).cast("long") - 1, F.floor(F.col(c) / step).cast("long")))
    dealt = rows.select(*names, "x", "y", a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("bx", both("x")).withColumn("by", both("y"))
    votes = dealt.groupBy(*names, "bx", "by").applyInPandas(one, schema)
    w = F.col("weight")
    sums = votes.groupBy(*names, "dx", "dy").agg(F.sum(w).alias("w"), (F.sum(w * F.col("fx")) / F.sum(w)).alias("fx"), (F.sum(w * F.col("fy")) / F.sum(w)).alias("fy"), F.count("*").alias("n"))
    best = sums.groupBy(*names).agg(F.max(F.struct("w", (-F.abs("dx") - F.abs("dy")).alias("near"), "dx", "dy", "fx", "fy", "n")).alias("s"), F.sum("w").alias("all"))
    s = lambda c: F.col(f"s.{c}")
    return best.select(*names, s("dx").alias("dx"), s("dy").alias("dy"), (s("dx") + s("fx")).alias("sub_dx"), (s("dy") + s("fy")).alias("sub_dy"), s("n").alias("blocks"), (s("w") / F.col("all")).alias("share"))


def histogram_match(source: DataFrame, reference: DataFrame, column: str, out: str = "matched") -> DataFrame:
    """Each source value becomes the reference value of its cumulative share, interpolated between neighbours.

    For values of few distinct levels (16-bit bands have 65 536): both sides shrink to their
    levels, whose shares are summed up in one sorted union; pixels join their level's result.
    """
    levels = lambda df, side: df.groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n")).withColumn("side", F.lit(side))
    both = levels(source, 0).unionAll(levels(reference, 1))
    mine = W.partitionBy("side")
    both = both.withColumn("q", F.sum("n").over(mine.orderBy("v").rowsBetween(W.unboundedPreceding, 0)) / F.sum("n").over(mine).cast("double"))
    seen = lambda c: F.when(F.col("side") == 1, F.col(c))
    up = W.orderBy("q", F.desc("side")).rowsBetween(W.unboundedPreceding, 0)
    down = W.orderBy(F.desc("q"), F.desc("side")).rowsBetween(W.unboundedPreceding, 0)
    for name, w in (("l", up), ("h", down)):
        both = both.withColumns({f"q{name}": F.last(seen("q"), True).over(w), f"v{name}": F.last(seen("v"), True).over(w)})
    c = F.col
    between = c("vl") + (c("vh") - c("vl")) * ((c("q") - c("ql")) / (c("qh") - c("ql")))
    value = F.when(c("vl").isNull(), c("vh")).when(c("vh").isNull() | (c("qh") == c("ql")), c("vl")).otherwise(between)
    table = both.where("side = 0").select(c("v").alias("_level"), value.alias(out))
    return source.join(table, F.col(column).cast("double") == F.col("_level")).drop("_level")
