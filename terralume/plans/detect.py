"""The whole change test between two dates, from pixels to judged regions; and a synthetic pair to try it on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indices as ix
from ..functions import rules
from ..functions import significance as sg
from ..operators import blocks as bk
from ..operators import focal
from ..operators import pixels as px
from ..operators import regions as rg
from ..sources.work import WorkFolder


@dataclass
class Detection:
    regions: DataFrame
    rejected: DataFrame
    region_pixels: DataFrame
    funnel: DataFrame
    fit: dict  # figures of the run
    diagnostics: dict


#: Least cloud, reach of clouds and snow, least valid pixels.
CLOUD_PX, MASK_REACH, LEAST_VALID = 50, 4, 100


#: Bands of both dates, as columns of a pair.
BOTH = [p + b for p in ("b_", "a_") for b in ix.BANDS]
CLOUD_BANDS = ("green", "nir", "swir16")
#: Columns of a block that place its pixels.
HELD = ["tx", "ty", "x0", "y0", "h", "w", "there"]
#: Pixels of a row that IR-MAD reads; its arrays fit a core's cache.
PIECE = 2048
#: Steps between a candidate and the pixels that a later stage looks at: closing takes one and its erosion one more, footprints two from a closed pixel.
NEAR = 3


def dark_levels(blocks: DataFrame) -> dict[str, float]:
    """The 0.5 percent quantile of each band that clouds and snow are told by, of either date, over its pixels whose bands are above zero."""
    names = [p + b for p in ("b_", "a_") for b in CLOUD_BANDS]

    def ok(row: dict) -> dict:
        block, out = bk.Block(row), {}
        for p in ("b_", "a_"):
            good = (block.there & (np.fmin.reduce([block.band(p + b) for b in ix.BANDS]) > 0))[block.own]
            out |= {p + b: block.band(p + b)[block.own][good] for b in CLOUD_BANDS}
        return out

    found = bk.quantiles(blocks, [*HELD, *BOTH], ok, names, [0.005])
    return {b: found[b][0] or 0.0 for b in names}


def cloud_snow(blocks: DataFrame, low: dict[str, float], width: int, prefix: str, work: WorkFolder) -> tuple[DataFrame, DataFrame]:
    """(x, y) of one date's clouds and of its snow, after dark-object subtraction of the levels ``low``.

    Clouds of fewer than 50 pixels go, as they are bright roofs rather. Only bright pixels become rows.
    """
    bands = [prefix + b for b in CLOUD_BANDS]

    def bright(row: dict) -> dict | None:
        block = bk.Block(row)
        # green of 0.25 or less is neither snow nor cloud, see rules.snow_cloud
        m = block.there[block.own] & (block.band(bands[0])[block.own] - low[bands[0]] > 0.25)
        return {**block.places(m), **{b: block.band(b)[block.own][m] for b in bands}} if m.any() else None

    rows = bk.per_block(blocks, bright, ", ".join(["x long, y long", *[f"`{b}` double" for b in bands]]), [*HELD, *bands])
    snow, cloud = rules.snow_cloud(*[ix.clip(F.col(b) - low[b], 0.0, 1.0) for b in bands])
    rows = work.put(f"{prefix}bright", rows.select("x", "y", cloud.alias("cloud"), snow.alias("snow")))
    return rg.remove_small(rg.label(rows, F.col("cloud"), width), CLOUD_PX).select("x", "y"), rows.where("snow").select("x", "y")


def clear_pair(pair: DataFrame, width: int, work: WorkFolder, halo: int = 4) -> tuple[DataFrame, DataFrame, dict]:
    """The pair's blocks, the packed mask of each tile's valid pixels (tx, ty, n, ok), and percentages of clouds and snow.

    Clouds and snow of either date, and four pixels around them, are not valid.
    """
    blocks = work.put("blocks", bk.blocked(pair, BOTH, halo), bk.WRITE)
    low = dark_levels(blocks)
    found = [cloud_snow(blocks, low, width, p, work) for p in ("b_", "a_")]
    flag = lambda df, c: df.select("x", "y", (F.lit(c == "cloud")).alias("cloud"), F.lit(c == "snow").alias("snow"))
    marks = flag(found[0][0], "cloud")
    for df, c in ((found[1][0], "cloud"), (found[0][1], "snow"), (found[1][1], "snow")):
        marks = marks.unionAll(flag(df, c))
    marks = work.put("marks", marks.groupBy("x", "y").agg(F.max("cloud").alias("cloud"), F.max("snow").alias("snow")))
    bad = work.put("bad", bk.around(marks, MASK_REACH, "bad"))

    def clear(row: dict) -> dict:
        block = bk.Block(row)
        m = np.zeros((bk.SIDE,) * 2, bool)
        m[block.tile] = block.flags("valid")[block.own] & ~block.mask("bad")
        return {"tx": [row["tx"]], "ty": [row["ty"]], "pixels": [int(block.there[block.own].sum())], "n": [int(m.sum())], "ok": [bk.packed(m)]}

    held = bk.with_mask(blocks.select(*HELD, "valid"), bad, "bad")
    valid = work.put("valid", bk.per_block(held, clear, "tx long, ty long, pixels long, n long, ok binary"))
    size = valid.agg(F.sum("pixels").alias("pixels"), F.sum("n").alias("n")).first()
    if (size["n"] or 0) < LEAST_VALID:
        raise ValueError("almost the whole area is without data, cloud or snow")
    counts = marks.agg(*[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in ("cloud", "snow")]).first()
    work.drop("b_bright", "a_bright", "marks", "bad")
    return blocks, valid.select("tx", "ty", "n", "ok"), {f"{c}_pct": 100.0 * counts[c] / size["pixels"] for c in ("cloud", "snow")}


def detect_changes(pair: DataFrame, width: int, height: int, params: rules.Params = rules.Params(), pixel_m2: float = 100.0, semantic: str | None = None) -> Detection:
    """Statistical candidates that also show a land-cover transition, as regions with shape and verdict.

    ``pair`` has x, y, b_<band> and a_<band> reflectances and valid. Clouds and snow are not valid;
    fewer than 100 valid pixels are an error. Stages: IR-MAD on smoothed
    bands, calibrated and with hysteresis; normalisation on stable pixels; transition rules;
    vetoes; closing, size and slivers; region significance; footprint, shape, verdict.

    Stages over all pixels work on blocks (:mod:`operators.blocks`), written once with the halo that smoothing needs;
    rows are made of the pixels beyond the lower threshold, and of those near a candidate that the vetoes leave.
    The funnel reads all pixels again, only if it is asked for. A line ends where a pixel is missing.
    """
    work = WorkFolder(pair.sparkSession, "detect")
    # a block is a long row
    pair.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    kernel = focal.gaussian_kernel(params.smooth_sigma) if params.smooth_sigma > 0 else [1.0]
    sharp = focal.gaussian_kernel(0.6)
    blocks, valid, shares = clear_pair(pair, width, work, max(len(kernel), len(sharp)) // 2)
    blocks = bk.with_mask(blocks, valid, "ok", "inner")

    def soft(block: bk.Block) -> np.ndarray:
        """Smoothed bands of a block's own part, (bands, lines, columns)."""
        return np.stack([bk.smoothed(block.band(b), block.there, kernel)[block.own] for b in BOTH])

    def of_valid(row: dict) -> dict | None:
        block = bk.Block(row)
        m = block.mask("ok")
        s = soft(block)[:, m]
        return {"s": [s[:, k : k + PIECE].tobytes() for k in range(0, s.shape[1], PIECE)]} if m.any() else None

    # read some thirty times, and doubles with noise hardly compress
    smooth = work.put("smooth", bk.per_block(blocks, of_valid, "s binary"), {**bk.WRITE, "compression": "none"})
    fit = px.irmad_blocks(smooth, "s", len(BOTH))
    over = 1.0
    if params.calibrate:
        t_of = lambda row: {"t": fit.of_bands(np.frombuffer(row["s"], np.float64).reshape(len(BOTH), -1))}
        over = max(1.0, (bk.quantiles(smooth, ["s"], t_of, ["t"], [0.5])["t"][0] or 0.0) / sg.MEDIAN)
    work.drop("smooth")
    high, low = (sg.quantile_value(a) for a in rules.PRESETS[params.sensitivity])
    names = ["x", "y", "valid", "t", *BOTH, *["s_" + b for b in BOTH]]
    schema = ", ".join(["x long, y long, valid boolean, t double", *[f"`{c}` double" for c in names[4:]]])

    def pixels(block: bk.Block, ok: np.ndarray, m: np.ndarray, t: np.ndarray, s: np.ndarray) -> dict:
        """Rows of the set pixels of a mask of the own part."""
        raw = {b: block.band(b)[block.own][m] for b in BOTH}
        return {**block.places(m), "valid": ok[m], "t": np.where(ok, t, 0.0)[m], **raw, **{"s_" + b: s[k][m] for k, b in enumerate(BOTH)}}

    def statistic(s: np.ndarray) -> np.ndarray:
        return fit.of_bands(s) / over

    def beyond(row: dict) -> dict | None:
        block = bk.Block(row)
        ok, s = block.mask("ok"), soft(block)
        t = statistic(s)
        m = ok & (t > low)
        return pixels(block, ok, m, t, s) if m.any() else None

    def stable(row: dict) -> dict:
        """Bands of both dates on stable pixels: number and sums of products around the fit's means."""
        block = bk.Block(row)
        m = block.mask("ok") & (statistic(soft(block)) < sg.MEDIAN)
        x = np.column_stack([*[block.band(b)[block.own][m] - c for b, c in zip(BOTH, fit.mean)], np.ones(m.sum())])
        return {"m": [(x.T @ x).ravel().tolist()]}

    gains = px.radiometric_gains(bk.per_block(blocks, stable, "m array<double>"), fit.mean)
    some = work.put("beyond", bk.per_block(blocks, beyond, schema))
    candidate = work.put("candidate", rg.hysteresis(some, "t", low, high, width).select("x", "y", F.lit(True).alias("stat")))

    def judged_pixels(rows: DataFrame) -> DataFrame:
        """Rows with stat, indices, rules and class; the angle is taken between smoothed bands, all else between plain ones."""
        smoothed = {f"a_{b}": (f"s_a_{b}", s, i) for b, (s, i) in gains.items()}
        after = {c: ix.clip(F.col(v) * s + i, 0.0, 1.0) for c, (v, s, i) in smoothed.items()}
        rows = rows.join(candidate, ["x", "y"], "left").withColumn("stat", F.coalesce("stat", F.lit(False)) & F.col("valid"))
        rows = px.normalised(rows.withColumns({"s_" + c: v for c, v in after.items()}), gains)
        rows = rows.withColumn("sam", ix.spectral_angle(["s_b_" + b for b in ix.BANDS], ["s_a_" + b for b in ix.BANDS]))
        return px.evidence(px.features(rows, sam=False), sam_min=params.sam_min)

    cand = F.col("stat") & F.col("landcover_evidence") & F.col("valid")
    kept = cand & ~rules.brightness_only(F.col("sam"), params.sam_min)
    wet = kept & ~rules.both_water() if params.ignore_water_variability else kept
    figures = ("t", "sam", "class_code", "d_ndvi", "d_ndbi", "d_mndwi", "d_bright", "ndvi_a", "magnitude", *([semantic] if semantic else []))
    flags = [kept.alias("kept"), wet.alias("mask")]
    near = work.put("near", bk.around(judged_pixels(some).where(wet).select("x", "y"), NEAR, "near"))

    def close_by(row: dict) -> dict | None:
        block = bk.Block(row)
        m = block.mask("near") & block.there[block.own]
        if not m.any():
            return None
        s, ok = soft(block), block.mask("ok")
        moved = [bk.smoothed(np.clip(block.band("a_" + b) * g + i, 0.0, 1.0) - block.band("b_" + b), block.there, sharp)[block.own][m] for b, (g, i) in gains.items()]
        return {**pixels(block, ok, m, statistic(s), s), "magnitude": np.sqrt(sum(v * v for v in moved))}

    rows = bk.per_block(bk.with_mask(blocks, near, "near", "inner"), close_by, schema + ", magnitude double")
    if semantic:
        rows = rows.join(pair.select("x", "y", semantic), ["x", "y"])
    # only what is read below is written: bands and most indices go
    rows = work.put("rows", judged_pixels(rows).select("x", "y", "valid", *flags, *figures))
    work.drop("beyond", "near")
    closed = focal.close(rows.select("x", "y", "mask", "valid"), "mask", 1, "m").withColumn("m", F.col("m") & F.col("valid"))
    regions = rg.label(closed, F.col("m"), width)
    regions = work.put("labels", rg.without_slivers(regions, params.min_area_px) if params.reject_slivers else rg.remove_small(regions, params.min_area_px))

    detail = rows.select("x", "y", *figures)
    inside = regions.join(detail, ["x", "y"]).withColumn("sig", sg.neg_log10("t"))
    if semantic:
        valid_places = lambda row: (lambda b: b.places(b.mask("ok")))(bk.Block(row))
        least = px.quantiles(bk.per_block(blocks, valid_places, "x long, y long").join(pair.select("x", "y", semantic), ["x", "y"]), [semantic], [params.semantic_min_pct / 100.0])[semantic][0]
        good = inside.groupBy("region").agg(F.avg(semantic).alias("m")).where(F.col("m") >= least).select("region")
        inside = inside.join(good, "region", "left_semi")
    zones = rg.zonal(inside, ["sig", "sam", "d_ndvi", "d_ndbi"]).select("region", F.col("mean_sig").alias("sig"), "mean_sam", "mean_d_ndvi", "mean_d_ndbi").join(rg.majority(inside), "region")
    dull = (F.col("mean_sam") < params.sam_min) & (F.abs("mean_d_ndvi") < 0.05) & (F.abs("mean_d_ndbi") < 0.05) & ~F.col("class_code").isin(4, 5)
    zones = work.put("zones", zones.where((F.col("sig") >= params.min_significance) & ~dull))

    body = regions.join(zones.select("region"), "region", "left_semi")
    if params.target == "structures":
        body = rg.footprints(body, rows.select("x", "y", "magnitude"), "magnitude")
    body = work.put("body", body.select("region", "x", "y"))
    full = body.join(detail, ["x", "y"])
    mean = lambda c, k: F.round(F.avg(c), k).alias(c)
    stats = full.groupBy("region").agg(
        mean("d_ndvi", 3), mean("d_ndbi", 3), mean("d_mndwi", 3), mean("d_bright", 3), F.round(F.degrees(F.avg("sam")), 1).alias("spectral_angle_deg"),
        F.round(F.median("ndvi_a"), 2).alias("ndvi_after"), F.round(F.percentile("ndvi_a", 0.25), 2).alias("ndvi_after_p25"),
    )
    shapes = rg.shapes(body, least_px=params.min_shape_px).withColumn("kind", rules.shape_kind(params))
    judged = rg.position(rg.zonal(body), width, height).join(stats, "region").join(shapes, "region").join(zones.select("region", "class_code", F.round("sig", 1).alias("significance")), "region")
    judged = judged.withColumn("area_ha", ix.area_ha("area_px", pixel_m2))
    accept, reason = rules.structure_verdict(params) if params.target == "structures" else (F.lit(True), F.lit(""))
    judged = work.put("judged", judged.withColumn("accept", accept).withColumn("reason", reason))
    final = rg.ranked(judged.where("accept")).drop("accept", "reason")
    n = F.sum
    on = lambda c: F.coalesce(n(c.cast("long")), F.lit(0))
    stages = [("valid pixels", F.col("valid")), ("statistical candidate", F.col("stat")), ("land-cover evidence", F.col("landcover_evidence") & F.col("valid")), ("candidate", F.col("cand")), ("after brightness-only veto", F.col("kept")), ("after water veto", F.col("mask"))]

    def every(row: dict) -> dict:
        block = bk.Block(row)
        s, ok = soft(block), block.mask("ok")
        return pixels(block, ok, block.there[block.own], statistic(s), s)

    funnel = px.funnel(judged_pixels(bk.per_block(blocks, every, schema)).select("valid", "stat", "landcover_evidence", *flags, cand.alias("cand")), stages)
    tail = regions.agg(on(F.lit(True)).alias("n")).select(F.lit(7).alias("stage_no"), F.lit("after size and sliver filter").alias("stage"), "n")
    tail = tail.unionAll(body.agg(on(F.lit(True)).alias("n")).select(F.lit(8), F.lit("after region significance"), "n"))
    tail = tail.unionAll(body.join(final, "region", "left_semi").agg(on(F.lit(True)).alias("n")).select(F.lit(9), F.lit("after the structure verdict"), "n"))
    return Detection(final, judged.where("NOT accept"), body.join(final.select("region", "id"), "region"), funnel.unionAll(tail), gains, {**shares, "irmad": fit, "overdispersion": over, "thresholds": (low, high)})


#: Green, red, nir, swir16 reflectance of four surfaces.
SURFACES = {"soil": (0.12, 0.16, 0.22, 0.30), "vegetation": (0.06, 0.04, 0.35, 0.18), "roof": (0.30, 0.31, 0.32, 0.36), "asphalt": (0.07, 0.07, 0.08, 0.09)}
#: Y, x, height, width and surfaces before and after of the planted changes.
PLANTED = (
    (100, 100, 5, 5, None, "roof"),
    (300, 500, 4, 6, None, "roof"),
    (600, 200, 2, 90, None, "asphalt"),
    (400, 300, 30, 30, "vegetation", "soil"),
    (700, 600, 25, 25, "soil", "vegetation"),
)
#: Y, x, height, width of the clouds of the after date, and their reflectance.
CLOUDS, CLOUD = ((40, 700, 40, 50),), (0.5, 0.5, 0.5, 0.4)


def synthetic_pair(spark: SparkSession, width: int = 900, height: int = 900, changes=PLANTED, seed: int = 7, noise: float = 0.008, clouds=CLOUDS) -> DataFrame:
    """x, y, both dates' reflectances, valid and truth: a patchy ground with planted changes and traps.

    Everything is an expression of the place and a hash of it, so any part of the raster can
    be made anywhere. Traps: a moisture patch, clouds, a gain and offset, bright speckles, noise.
    """
    y, x = F.floor(F.col("id") / float(width)).cast("int"), (F.col("id") % width).cast("int")
    return planted_pair(spark.range(width * height).select(x.alias("x"), y.alias("y"), F.lit(0.0).alias("salt")), changes, seed, noise, clouds)


def planted_pair(places: DataFrame, changes=PLANTED, seed: int = 7, noise: float = 0.008, clouds=CLOUDS, lines: int | None = None) -> DataFrame:
    """The same on given places (x, y, salt); noise depends on the salt, the plan of changes repeats every ``lines`` lines.

    Made by Arrow batch: as one expression it outgrows what Java compiles.
    """
    names = [d + band + k for band in ix.BANDS for d in "ba" for k in ("", "2", "3")]
    first = places.sparkSession.range(1).select(*[F.xxhash64(F.lit(seed), F.lit(k)).alias(k) for k in ("patch", "speckle", *names)]).first().asDict()
    first = {k: np.uint64(v % (1 << 64)) for k, v in first.items()}
    kinds = [places.schema[c].dataType.simpleString() for c in ("x", "y")]

    def unit(key: str, *hashed) -> np.ndarray:
        h = first[key]
        for f in hashed:
            h = f(h)
        return (h & np.uint64((1 << 20) - 1)).astype(float) / float(1 << 20)

    def one(batch: pa.RecordBatch) -> dict:
        x, y, salt = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        keys = [_hasher(v) for v in (x, y, salt)]
        if batch.column(2).null_count:  # a null leaves a hash as it is
            there, salted = batch.column(2).is_valid().to_numpy(zero_copy_only=False), keys[2]
            keys[2] = lambda h: np.where(there, salted(h), h)
        yy = y % lines if lines else y
        inside = lambda c: (yy >= c[0]) & (yy < c[0] + c[2]) & (x >= c[1]) & (x < c[1] + c[3])
        patch = unit("patch", *[_hasher(np.floor(v / 20).astype(np.int64)) for v in (x, y)])
        changed, cloudy = [inside(c) for c in changes], [inside(c) for c in clouds]
        truth = np.logical_or.reduce([*changed, np.zeros(len(x), bool)]) & ~np.logical_or.reduce([*cloudy, np.zeros(len(x), bool)])
        moist, speckle = inside((200, 650, 60, 60)), unit("speckle", *keys) < 5e-5
        out = {}
        for k, band in enumerate(ix.BANDS):
            before = np.where(patch < 0.5, SURFACES["soil"][k], SURFACES["vegetation"][k]) * (0.9 + 0.2 * patch)
            after = before
            for c, m in zip(changes, changed):
                if c[4]:
                    before = np.where(m, SURFACES[c[4]][k], before)
                after = np.where(m, SURFACES[c[5]][k], after)
            after = np.where(moist, after * 0.78, after)
            for m in cloudy:
                after = np.where(m, CLOUD[k], after)
            after = np.where(speckle, after * 1.8, after) * 1.06 + 0.005
            for d, v in (("b", before), ("a", after)):
                bell = (unit(d + band, *keys) + unit(d + band + "2", *keys) + unit(d + band + "3", *keys) - 1.5) * 2.0
                out[f"{d}_{band}"] = np.maximum(0.001, np.minimum(1.0, v + noise * bell))
        return {"x": batch.column(0), "y": batch.column(1), "truth": truth, **out, "valid": np.ones(len(x), bool)}

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(one(batch))

    bands = ", ".join(f"{d}_{b} double" for b in ix.BANDS for d in "ba")
    return places.select("x", "y", F.col("salt").cast("double").alias("salt")).mapInArrow(each, f"x {kinds[0]}, y {kinds[1]}, truth boolean, {bands}, valid boolean")


#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _hasher(v: np.ndarray):
    """A function of the hash so far to Spark's xxhash64 with one more column of ints, longs or doubles; what does not depend on the first is made once."""
    turned = lambda h, k: (h << np.uint64(k)) | (h >> np.uint64(64 - k))
    if v.dtype == np.int32:
        own, size, turn, by, plus = v.view(np.uint32).astype(np.uint64) * _P1, np.uint64(4), 23, _P2, _P3
    else:
        bits = np.ascontiguousarray(v + 0.0 if v.dtype == np.float64 else v).view(np.uint64)
        own, size, turn, by, plus = turned(bits * _P2, 31) * _P1, np.uint64(8), 27, _P1, _P4

    def hashed(h):
        with np.errstate(over="ignore"):
            h = turned((h + _P5 + size) ^ own, turn) * by + plus
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            return h ^ (h >> np.uint64(32))

    return hashed
