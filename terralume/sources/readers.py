"""Scene files, pixel tables, images, grids and sinks."""

from __future__ import annotations

import contextlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scene_files(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """(path, name, product, acq_date, band) of product files, without reading their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumn("name", name)
    for k, c in ((1, "product"), (2, "acq_date"), (3, "band")):
        files = files.withColumn(c, F.regexp_extract("name", tx.PRODUCT, k))
    return files.where("product <> ''")


def latest_path(files: DataFrame) -> str | None:
    """The newest file's path, ties to the later path; None if there is none."""
    return files.agg(F.max(F.struct("acq_date", "path"))["path"]).first()[0]


def latest() -> Column:
    """Aggregate: the path of the newest date, ties to the later path."""
    return F.max(F.struct("acq_date", "path"))["path"]


def tile_gate(pixels: DataFrame, bands, tile: int, expected: int) -> DataFrame:
    """Tiles with nothing in their first three bands are skipped; the number of bands is checked."""
    some = sum((F.abs(F.coalesce(F.col(b), F.lit(0))) for b in bands[1:3]), F.abs(F.coalesce(F.col(bands[0]), F.lit(0))))
    place = [F.floor(F.col(a) / float(tile)).alias(f"t{a}") for a in ("x", "y")]
    return pixels.groupBy(*place).agg(F.count("*").alias("pixels"), (F.sum(some) == 0).alias("skipped")).withColumn("bands_ok", F.lit(len(bands) == expected))


def chunk_check(pixels: DataFrame, tile: int) -> DataFrame:
    """Count and extent of each chunk, and whether it is whole."""
    place = [F.floor(F.col(a) / float(tile)).alias(f"t{a}") for a in ("x", "y")]
    got = pixels.groupBy(*place).agg(F.count("*").alias("pixels"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda a: (F.col(f"{a}0") == F.col(f"t{a}") * tile) & (F.col(f"{a}1") == F.col(f"t{a}") * tile + tile - 1)
    return got.withColumn("whole", (F.col("pixels") == tile * tile) & at("x") & at("y"))


def band_like(bands: DataFrame, word: str) -> DataFrame:
    """The first band, by number, whose description holds a word."""
    return bands.where(F.lower("description").contains(word.lower())).orderBy("band_no").limit(1)


def aoi(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Pixels of a window; both ranges are pushed to the scan, which skips row groups sorted by tile."""
    return pixels.where((F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h))


# ------------------------------------------------------------------ PNG and portable maps


def read_png(data: bytes) -> np.ndarray:
    """8-bit grey, grey-alpha, RGB or RGBA without interlacing, as (height, width, channels)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("this kind of PNG isn't read")
    w, h, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.int32)
    for i in range(h):
        kind, line = raw[i, 0], raw[i, 1:].astype(np.int32)
        if kind == 2:
            line = (line + above) & 255
        elif kind == 1:
            line = np.cumsum(line.reshape(w, channels), 0).reshape(-1) & 255
        elif kind in (3, 4):
            done = np.zeros(w * channels, np.int32)
            for j in range(w * channels):
                a = int(done[j - channels]) if j >= channels else 0
                b = int(above[j])
                if kind == 3:
                    p = (a + b) // 2
                else:
                    c = int(above[j - channels]) if j >= channels else 0
                    d = (abs(b - c), abs(a - c), abs(a + b - 2 * c))
                    p = (a, b, c)[d.index(min(d))]
                done[j] = (int(line[j]) + p) & 255
            line = done
        out[i] = line
        above = line
    return out.reshape(h, w, channels)


def write_png(a: np.ndarray) -> bytes:
    h, w = a.shape[:2]
    channels = a.shape[2] if a.ndim == 3 else 1
    raw = np.concatenate([np.zeros((h, 1), np.uint8), a.astype(np.uint8).reshape(h, w * channels)], 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def image_pixels(files: DataFrame) -> DataFrame:
    """(path, x, y, r, g, b) of PNG files from a binaryFile scan; grey becomes three equal channels, alpha goes."""

    def each(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = read_png(data)
                a = np.repeat(a[:, :, :1], 3, 2) if a.shape[2] < 3 else a[:, :, :3]
                h, w = a.shape[:2]
                yy, xx = np.divmod(np.arange(h * w), w)
                for k in range(0, h * w, 65536):
                    part = slice(k, k + 65536)
                    rgb = a.reshape(-1, 3)[part].astype(np.int16)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rgb)), pa.array(xx[part], pa.int32()), pa.array(yy[part], pa.int32()), *(pa.array(rgb[:, c]) for c in range(3))], ["path", "x", "y", "r", "g", "b"])

    return files.select("path", "content").mapInArrow(each, "path string, x int, y int, r short, g short, b short")


# ------------------------------------------------------------------ sinks


def write_regions_csv(regions: DataFrame, path: str) -> None:
    regions.write.mode("overwrite").csv(path, header=True)


def write_report(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


#: Tile rows whose files share a folder.
TILE_ROWS = 64


def write_tiles(pixels: DataFrame, path: str, tile: int = 512) -> None:
    """Pixels partitioned by bands of tile rows and sorted by tile, so that window scans prune folders and row groups.

    A folder a band, not a tile row: the number of files, which costs more than the pixels where tiles are small, is less by that factor.
    """
    df = pixels.withColumn("ty", F.floor(F.col("y") / tile).cast("int")).withColumn("tx", F.floor(F.col("x") / tile).cast("int"))
    df = df.withColumn("tile_band", F.floor(F.col("ty") / TILE_ROWS).cast("int"))
    df.repartition("tile_band", "tx").sortWithinPartitions("tile_band", "ty", "tx", "y", "x").write.mode("overwrite").partitionBy("tile_band").parquet(path)


def write_bucketed(pixels: DataFrame, table: str, path: str, tile: int = 512, buckets: int = 64) -> DataFrame:
    """A scene as a table of the session's catalog, its files dealt by tile (ty, tx) and sorted in it; returns its rows.

    Tables written with the same ``tile`` and ``buckets`` join by (ty, tx, y, x), and group by tile, where they lie:
    :func:`co_located` lets Spark take the tile alone for the join's dealing.
    """
    df = pixels.withColumn("ty", F.floor(F.col("y") / tile).cast("int")).withColumn("tx", F.floor(F.col("x") / tile).cast("int"))
    out = df.repartition(buckets, "ty", "tx").write.mode("overwrite").option("path", path)
    out.bucketBy(buckets, "ty", "tx").sortBy("ty", "tx", "y", "x").saveAsTable(table)
    return pixels.sparkSession.table(table)


@contextlib.contextmanager
def co_located(spark: SparkSession):
    """Inside, plans that run join tables dealt by tile where they lie, also on more columns than the tile."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def geojson(regions: DataFrame, t: tuple[float, ...]) -> DataFrame:
    """One GeoJSON feature a row: the region's box as a closed ring in world coordinates."""
    a, b, c, d, e, f = t
    corner = lambda x, y: F.array(a * x + b * y + c, d * x + e * y + f)
    x0, y0, x1, y1 = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    ring = F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct("id", "area_px").alias("properties"))
    return regions.select("id", F.to_json(feature).alias("feature"))


def same_config(existing: str | None, config: dict) -> None:
    """A stored JSON configuration must equal the new one."""
    if existing is not None and json.loads(existing) != config:
        raise ValueError("the folder holds results of another configuration")


def write_stats(stats: DataFrame, path: str) -> None:
    """Statistics as JSON, written last: its _SUCCESS file marks a finished run."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def tile_window(spark: SparkSession, path: str, x: int, y: int, w: int, h: int, tile: int = 512) -> DataFrame:
    """A window of what :func:`write_tiles` wrote; folders of other bands and row groups of other tiles stay unread."""
    first, last = y // tile, (y + h - 1) // tile
    rows = spark.read.parquet(path).where(F.col("tile_band").between(first // TILE_ROWS, last // TILE_ROWS) & F.col("ty").between(first, last))
    return aoi(rows.where(F.col("tx").between(x // tile, (x + w - 1) // tile)).drop("tile_band"), x, y, w, h)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows of one run added to a log; runs before stay."""
    rows.write.mode("append").csv(path, header=True)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)
