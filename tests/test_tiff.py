"""TIFF files and folders: round trips, windows that read their tiles, push-down, odd files."""

import numpy as np
import pytest
from pyarrow import BufferReader
from pyspark.sql import functions as F

from terralume.sources import tiff


@pytest.mark.parametrize("kind", ["u1", "u2", "i2", "i4", "f4", "f8"])
def test_files_round_trip(kind):
    a = (np.random.default_rng(3).normal(size=(37, 50, 3)) * 90 + 100).clip(0, 250).astype(kind)
    for tile, compression, predictor in ((None, 1, 1), (16, 8, 1), (32, 8, 2 if kind[0] != "f" else 1)):
        data = tiff.encode(a, tile, compression, predictor)
        r = tiff.header(BufferReader(data))
        assert (r.width, r.height, r.bands, len(r.tiles)) == (50, 37, 3, 1 if tile is None else -(-50 // tile) * -(-37 // tile))
        out = np.zeros_like(a)
        for x, y, w, h, at, size in r.tiles:
            part = tiff.decode(data[at : at + size], r, w, h)
            out[y : y + h, x : x + w] = part[: 37 - y, : 50 - x]
        assert (out == a).all()


def test_a_window_reads_its_tiles(spark, tmp_path):
    a = np.arange(100 * 120 * 2).reshape(100, 120, 2).astype("u2")
    (tmp_path / "one.tif").write_bytes(tiff.encode(a, 32, predictor=2))
    path = str(tmp_path / "one.tif")
    assert tiff.read_tiff(spark, path).rdd.getNumPartitions() == 16
    part = tiff.read_tiff(spark, path, (30, 60, 10, 5), ["red", "nir"])
    assert part.rdd.getNumPartitions() == 4 and part.columns == ["x", "y", "red", "nir"]
    got = {(r.x, r.y): (r.red, r.nir) for r in part.collect()}
    assert got == {(x, y): tuple(a[y, x].tolist()) for x in range(30, 40) for y in range(60, 65)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        few = tiff.read_tiff(spark, path, pushdown=True).where((F.col("x") >= 64) & (F.col("x") < 96) & (F.col("y") == 99) & (F.col("b1") > 0))
        assert few.rdd.getNumPartitions() == 1
        assert sorted((r.x, r.b2) for r in few.collect()) == [(x, int(a[99, x, 1])) for x in range(64, 96)]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_folders_round_trip(spark, tmp_path):
    rows = spark.range(70 * 45).select((F.col("id") % 70).alias("x"), F.floor(F.col("id") / 70).alias("y"), (F.col("id") * 3).cast("int").alias("v"), (-F.col("id")).cast("int").alias("w"))
    path = f"file://{tmp_path}/raster"
    tiff.write_tiff(rows, path, ["v", "w"], 32)
    want = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, tiff.read_tiff(spark, path).collect())) == want
    assert tiff.read_tiff(spark, path, (33, 0, 4, 10)).rdd.getNumPartitions() == 1
    tiff.write_tiff(rows.where("x + y > 20"), path, ["v", "w"], 32, nodata=-9_999_999)  # replaces the raster, drops its files
    assert sorted(map(tuple, tiff.read_tiff(spark, path).collect())) == [r for r in want if r[0] + r[1] > 20]
    assert len(list((tmp_path / "raster").glob("*.tif"))) == 6
    with pytest.raises(Exception, match="give nodata"):
        tiff.write_tiff(rows.where("x <> 5"), f"file://{tmp_path}/gaps", ["v"], 32)


def test_other_files_are_errors():
    with pytest.raises(ValueError, match="not a TIFF"):
        tiff.header(BufferReader(b"\x89PNG\r\n\x1a\n" + bytes(20)))
    data = bytearray(tiff.encode(np.zeros((2, 2, 1), "u1")))
    at = data.index(b"\x03\x01\x03\x00\x01\x00\x00\x00\x08\x00")  # the compression entry
    data[at + 8] = 5
    with pytest.raises(ValueError, match="isn't read"):
        tiff.header(BufferReader(bytes(data)))
