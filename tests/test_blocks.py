"""Rasters as blocks, and the change test that works on them (F1 of FINDINGS_r04.md)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terralume.functions import rules
from terralume.operators import blocks as bk
from terralume.operators import focal
from terralume.operators import pixels as px


def raster(spark, width, height, seed=3):
    rng = np.random.default_rng(seed)
    y, x = np.divmod(np.arange(width * height), width)
    return spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "valid": rng.random(len(x)) < 0.8, "v": rng.normal(size=len(x)), "u": rng.normal(size=len(x))}))


def own_pixels(blocks, names, values):
    schema = ", ".join(["x long, y long", *[f"{c} double" for c in names]])

    def one(row):
        block = bk.Block(row)
        m = block.there[block.own]
        return {**block.places(m), **{c: v[block.own][m] for c, v in zip(names, values(block))}}

    return bk.per_block(blocks, one, schema)


@pytest.mark.parametrize("width, height", [(300, 140), (3, 5), (1, 200), (129, 2)])
def test_smoothed_blocks_equal_lines(spark, width, height):
    rows, kernel = raster(spark, width, height), focal.gaussian_kernel(1.0)
    blocks = bk.blocked(rows, ["v", "u"], 4, flush=1000)
    got = own_pixels(blocks, ["v", "u"], lambda b: [bk.smoothed(b.band(c), b.there, kernel) for c in ("v", "u")]).toPandas().sort_values(["y", "x"])
    want = focal.convolve(rows, ["v", "u"], kernel).toPandas().sort_values(["y", "x"])
    assert len(got) == width * height
    np.testing.assert_allclose(got[["x", "y", "v", "u"]].to_numpy(), want[["x", "y", "v", "u"]].to_numpy(), atol=1e-13)


def test_a_line_ends_at_a_missing_pixel(spark):
    rows = raster(spark, 20, 1).where("x <> 9")
    got = own_pixels(bk.blocked(rows, ["v"], 4), ["v"], lambda b: [bk.smoothed(b.band("v"), b.there, focal.gaussian_kernel(1.0))]).toPandas()
    want = [focal.convolve(rows.where(side), ["v"], focal.gaussian_kernel(1.0)).toPandas() for side in ("x < 9", "x > 9")]
    want = pd.concat(want).sort_values("x")["v"]
    np.testing.assert_allclose(got.sort_values("x")["v"], want, atol=1e-13)


def test_masks_reach_across_tiles(spark):
    places = [(0, 0), (127, 128), (260, 5), (40, 40)]
    masks = bk.around(spark.createDataFrame(places, "x long, y long"), 3, "m").collect()
    got = {(x + 128 * r["tx"], y + 128 * r["ty"]) for r in masks for y, x in zip(*np.nonzero(bk.unpacked(bytes(r["m"]))))}
    assert got == {(x + i, y + j) for x, y in places for i in range(-3, 4) for j in range(-3, 4)}


@pytest.mark.parametrize("few", [0, 10, 100_000])
def test_quantiles_of_blocks_are_exact(spark, few):
    rows = raster(spark, 150, 90).withColumn("u", F.round("u", 1))
    qs = [0.0, 0.005, 0.5, 0.77, 1.0]

    def values(row):
        block = bk.Block(row)
        return {c: block.band(c)[block.own][block.flags("valid")[block.own]] for c in ("v", "u")}

    found = bk.quantiles(bk.blocked(rows, ["v", "u"], 4), None, values, ["v", "u"], qs, few)
    valid = rows.where("valid").toPandas()
    for c in ("v", "u"):
        assert found[c] == pytest.approx(np.quantile(valid[c], qs), rel=1e-12, abs=1e-15)
    assert bk.quantiles(bk.blocked(rows.where("x < 0"), ["v", "u"], 4), None, values, ["v"], [0.5])["v"] == [None]


def test_noise_is_spark_s_hash(spark):
    from terralume.plans.detect import _hasher

    rows = spark.range(500).select((F.col("id") - 250).cast("int").alias("i"), (F.col("id") * 12345678901 - 3).alias("l"), F.when(F.col("id") > 0, F.col("id") * -1.37).otherwise(-0.0).alias("d"))
    got = rows.select("i", "l", "d", F.xxhash64(F.lit(7), F.lit("k")).alias("k"), F.xxhash64(F.lit(7), F.lit("k"), "i", "l", "d").alias("h")).toPandas()
    h = np.uint64(int(got["k"][0]) % (1 << 64))
    for c in ("i", "l", "d"):
        h = _hasher(got[c].to_numpy())(h)
    assert (h.view(np.int64) == got["h"].to_numpy()).all()


def test_change_test_moves_no_row_of_every_pixel(spark, monkeypatch):
    """Tables of a row a pixel, which the change test wrote many of, are those of pixels beyond a threshold only."""
    from terralume.plans.detect import detect_changes, synthetic_pair
    from terralume.sources.work import WorkFolder

    sizes, put = {}, WorkFolder.put

    def counted(self, name, df, *more):
        out = put(self, name, df, *more)
        sizes[self.path.rsplit("/", 1)[1].rsplit("-", 1)[0], name] = out.count()
        return out

    monkeypatch.setattr(WorkFolder, "put", counted)
    found = detect_changes(synthetic_pair(spark, 180, 180, ((40, 40, 5, 5, None, "roof"), (60, 110, 25, 25, "vegetation", "soil")), clouds=()), 180, 180, rules.Params(target="all"))
    assert found.regions.count() >= 2
    assert max(sizes.values()) < 180 * 180 / 4, sizes


def test_block_fit_equals_row_fit(spark):
    rng = np.random.default_rng(5)
    b = rng.normal(0.3, 0.05, (3000, 4))
    x = np.hstack([b, 1.1 * b + rng.normal(0, 0.01, b.shape)])
    x[:40, 4:] += 0.3
    names = ["b_green", "b_red", "b_nir", "b_swir16", "a_green", "a_red", "a_nir", "a_swir16"]
    rows = spark.createDataFrame(pd.DataFrame(x, columns=names))
    blocks = spark.createDataFrame([(bytearray(np.ascontiguousarray(x[k : k + 700].T).tobytes()),) for k in range(0, 3000, 700)], "s binary")
    fit = px.irmad_blocks(blocks, "s", 8)
    stat, want = px.irmad(rows, F.lit(True))
    assert fit.rounds == want.rounds and fit.settled == want.settled
    np.testing.assert_allclose(fit.rho, want.rho, rtol=1e-9)
    np.testing.assert_allclose(sorted(fit.of_bands(x.T)), sorted(r["t"] for r in stat.select("t").collect()), rtol=1e-6, atol=1e-9)
    with pytest.raises(ValueError):
        px.irmad_blocks(blocks.limit(0), "s", 8)
