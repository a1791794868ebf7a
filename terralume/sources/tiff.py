"""Tiled TIFF rasters as a Spark data source: one partition a tile, and windows that read their tiles only.

A path is one file, or a folder of files of one tile each with an index, as the writer makes it.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Fixed values of the format: tag numbers, sizes and codes of field types, sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, BANDS, STRIP_LINES, STRIP_SIZES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 12: "d", 16: "Q"}
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
PLAIN, DEFLATE, OLD_DEFLATE = 1, 8, 32946
SQL_TYPE = {"u1": "short", "u2": "int", "u4": "long", "i1": "short", "i2": "short", "i4": "int", "f4": "float", "f8": "double"}
ARROW_TYPE = {"short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}
INDEX = "index.json"


@dataclass(frozen=True)
class Raster:
    """What the header of a file tells: size, sample kind with byte order, coding, and (x, y, width, height, offset, size) of its tiles or strips."""

    width: int
    height: int
    bands: int
    kind: str
    compression: int
    predictor: int
    tiles: tuple


@dataclass
class Tile(InputPartition):
    """A tile of a file; x0 and y0 are the place of the file in the whole raster."""

    path: str
    x0: int
    y0: int
    raster: Raster
    tile: tuple

    def box(self) -> tuple[int, int, int, int]:
        """First and last column and line."""
        x, y, w, h = self.tile[:4]
        return self.x0 + x, self.x0 + min(x + w, self.raster.width) - 1, self.y0 + y, self.y0 + min(y + h, self.raster.height) - 1


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def header(f) -> Raster:
    """Reads the first directory of a file, of either byte order; other codings than none and deflate are an error."""
    start = f.read(8)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if order is None or struct.unpack(order + "H", start[2:4])[0] != 42:
        raise ValueError("not a TIFF of 32-bit offsets")
    f.seek(struct.unpack(order + "I", start[4:])[0])
    n = struct.unpack(order + "H", f.read(2))[0]
    tags = {}
    for k, raw in enumerate(struct.iter_unpack("12s", f.read(12 * n))):
        tag, kind, count = struct.unpack(order + "HHI", raw[0][:8])
        if kind in FIELD:
            tags[tag] = (FIELD[kind], count, raw[0][8:])

    def values(tag: int, default=None) -> list:
        if tag not in tags:
            return default
        code, count, raw = tags[tag]
        size = struct.calcsize(order + code) * count
        if size > 4:
            f.seek(struct.unpack(order + "I", raw)[0])
            raw = f.read(size)
        return list(struct.unpack(f"{order}{count}{code}", raw[:size]))

    width, height, bands = values(WIDTH)[0], values(HEIGHT)[0], values(BANDS, [1])[0]
    bits, formats = set(values(BITS, [1])), set(values(FORMAT, [1]))
    compression, predictor = values(COMPRESSION, [1])[0], values(PREDICTOR, [1])[0]
    kind = KINDS.get((formats.pop(), bits.pop())) if len(bits) == len(formats) == 1 else None
    if kind is None or compression not in (PLAIN, DEFLATE, OLD_DEFLATE) or predictor not in (1, 2) or values(PLANAR, [1])[0] != 1:
        raise ValueError("this kind of TIFF isn't read")
    if TILE_OFFSETS in tags:
        w, h, offsets, sizes = values(TILE_WIDTH)[0], values(TILE_HEIGHT)[0], values(TILE_OFFSETS), values(TILE_SIZES)
    else:
        w, h, offsets, sizes = width, min(height, values(STRIP_LINES, [height])[0]), values(STRIP_OFFSETS), values(STRIP_SIZES)
    across = -(-width // w)
    strips = TILE_OFFSETS not in tags
    tiles = tuple((k % across * w, k // across * h, w, min(h, height - k // across * h) if strips else h, at, size) for k, (at, size) in enumerate(zip(offsets, sizes)))
    return Raster(width, height, bands, order + kind, compression, predictor, tiles)


def decode(data: bytes, raster: Raster, w: int, h: int) -> np.ndarray:
    """(h, w, bands) of a tile's stored bytes."""
    raw = data if raster.compression == PLAIN else zlib.decompress(data)
    a = np.frombuffer(raw, raster.kind, count=w * h * raster.bands).reshape(h, w, raster.bands)
    return np.cumsum(a, 1, dtype=a.dtype) if raster.predictor == 2 else a


def encode(a: np.ndarray, tile: int | None = None, compression: int = DEFLATE, predictor: int = 1) -> bytes:
    """A file of an array (height, width, bands): one strip, or tiles of a multiple of 16 pixels."""
    height, width, bands = a.shape
    kind = a.dtype.newbyteorder("<")
    w, h = (tile, tile) if tile else (width, height)
    blocks = []
    for y in range(0, height, h):
        for x in range(0, width, w):
            block = np.zeros((h, w, bands), kind)
            part = a[y : y + h, x : x + w]
            block[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                block[:, 1:] = block[:, 1:] - block[:, :-1]
            raw = block.tobytes()
            blocks.append(raw if compression == PLAIN else zlib.compress(raw))
    sizes = [len(b) for b in blocks]
    offsets = [8 + sum(sizes[:k]) for k in range(len(blocks))]
    formats = {"u": 1, "i": 2, "f": 3}
    entries = [(WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [kind.itemsize * 8] * bands), (COMPRESSION, "H", [compression]), (PHOTOMETRIC, "H", [1])]
    entries += [(BANDS, "H", [bands]), (PLANAR, "H", [1]), (PREDICTOR, "H", [predictor]), (FORMAT, "H", [formats[kind.kind]] * bands)]
    entries += [(TILE_WIDTH, "I", [w]), (TILE_HEIGHT, "I", [h]), (TILE_OFFSETS, "I", offsets), (TILE_SIZES, "I", sizes)] if tile else [(STRIP_OFFSETS, "I", offsets), (STRIP_LINES, "I", [h]), (STRIP_SIZES, "I", sizes)]
    entries.sort()
    body = b"".join(blocks)
    body += b"\0" * (len(body) % 2)
    at = 8 + len(body) + 2 + 12 * len(entries) + 4
    directory, tail = struct.pack("<H", len(entries)), b""
    for tag, code, v in entries:
        raw = struct.pack(f"<{len(v)}{code}", *v)
        if len(raw) > 4:
            raw, tail = struct.pack("<I", at + len(tail)), tail + raw + b"\0" * (len(raw) % 2)
        directory += struct.pack("<HHI", tag, {"H": 3, "I": 4}[code], len(v)) + raw.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + directory + b"\0\0\0\0" + tail


class TiffSource(DataSource):
    """``spark.read.format("tiff")``: x, y and a column a band.

    Options: ``bands`` (names, by commas), ``window`` (x,y,w,h: other tiles are no partitions). With ``pushdown`` (true), which
    needs ``spark.sql.python.filterPushdown.enabled``, filters on x and y do the same. For writing: ``tile``
    and ``nodata``, the value of pixels that are not there.
    """

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def _listed(self) -> tuple[list[Tile], list[str], float | None]:
        system, path = filesystem(self.options["path"])
        names = [b for b in self.options.get("bands", "").split(",") if b]
        if system.get_file_info(path).type == fs.FileType.Directory:
            with system.open_input_file(posixpath.join(path, INDEX)) as f:
                index = json.loads(f.read())
            of = [Tile(posixpath.join(path, e["file"]), e["x"], e["y"], Raster(**{**e["raster"], "tiles": ()}), tuple(e["tile"])) for e in index["tiles"]]
            return of, names or index["bands"], index["nodata"]
        with system.open_input_file(path) as f:
            raster = header(f)
        bare = Raster(raster.width, raster.height, raster.bands, raster.kind, raster.compression, raster.predictor, ())
        nodata = self.options.get("nodata")
        return [Tile(path, 0, 0, bare, t) for t in raster.tiles], names or [f"b{k + 1}" for k in range(raster.bands)], None if nodata is None else float(nodata)

    def schema(self) -> str:
        tiles, names, _ = self._listed()
        kind = SQL_TYPE[tiles[0].raster.kind[1:]] if tiles else "double"
        return ", ".join(["x int", "y int", *(f"`{b}` {kind}" for b in names)])

    def reader(self, schema) -> DataSourceReader:
        tiles, _, nodata = self._listed()
        window = [int(v) for v in self.options["window"].split(",")] if "window" in self.options else None
        kind = PushingReader if self.options.get("pushdown") == "true" else TiffReader
        return kind(self.options["path"], tiles, schema, nodata, window)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        nodata = self.options.get("nodata")
        return TiffWriter(self.options["path"], [f.name for f in schema.fields], int(self.options.get("tile", 512)), None if nodata is None else float(nodata), overwrite)


class TiffReader(DataSourceReader):
    def __init__(self, path: str, tiles: list[Tile], schema, nodata, window):
        self.path, self.tiles, self.nodata = path, tiles, nodata
        self.names, self.kinds = [f.name for f in schema.fields], [f.dataType.simpleString() for f in schema.fields]
        big = 1 << 40
        x, y, w, h = window or (-big, -big, 2 * big, 2 * big)
        self.low, self.high = {"x": x, "y": y}, {"x": x + w - 1, "y": y + h - 1}

    def partitions(self) -> list[Tile]:
        def meets(t: Tile) -> bool:
            x0, x1, y0, y1 = t.box()
            return x0 <= self.high["x"] and x1 >= self.low["x"] and y0 <= self.high["y"] and y1 >= self.low["y"]

        return [t for t in self.tiles if meets(t)]

    def read(self, t: Tile):
        system, _ = filesystem(self.path)
        _, _, w, h, at, size = t.tile
        with system.open_input_file(t.path) as f:
            f.seek(at)
            a = decode(f.read(size), t.raster, w, h)
        x0, x1, y0, y1 = t.box()
        left, right = max(x0, self.low["x"]), min(x1, self.high["x"])
        top, bottom = max(y0, self.low["y"]), min(y1, self.high["y"])
        lines = max(1, 65_536 // max(1, right - left + 1))
        for y in range(top, bottom + 1, lines):
            part = a[y - y0 : min(y + lines, bottom + 1) - y0, left - x0 : right + 1 - x0]
            yy, xx = np.mgrid[y : y + part.shape[0], left : right + 1]
            rows = part.reshape(-1, t.raster.bands)
            there = np.ones(len(rows), bool) if self.nodata is None else ~(rows == self.nodata).all(1)
            columns = [xx.ravel()[there], yy.ravel()[there], *(rows[there, k] for k in range(t.raster.bands))]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c.astype(c.dtype.newbyteorder("=")))).cast(ARROW_TYPE[_named(k)]) for c, k in zip(columns, self.kinds)], self.names)


class PushingReader(TiffReader):
    """A reader of its own, as Spark refuses one that takes filters while its setting is off."""

    def pushFilters(self, filters):
        """Bounds on x and y leave tiles out; Spark still filters the rows."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("x",), ("y",)):
                c = f.attribute[0]
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low[c] = max(self.low[c], f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high[c] = min(self.high[c], f.value - isinstance(f, LessThan))
            yield f


def _named(kind: str) -> str:
    return {"smallint": "short", "bigint": "long"}.get(kind, kind)


@dataclass
class Written(WriterCommitMessage):
    tiles: list[dict]


class TiffWriter(DataSourceArrowWriter):
    """A file a tile, and an index of them at the commit; rows come with those of a tile together, as :func:`write_tiff` deals them."""

    def __init__(self, path: str, names: list[str], tile: int, nodata: float | None, overwrite: bool):
        self.path, self.names, self.tile, self.nodata, self.overwrite = path, names, tile, nodata, overwrite

    def write(self, iterator) -> Written:
        system, path = filesystem(self.path)
        system.create_dir(path, recursive=True)
        done, held, at = [], [], None
        bands = [n for n in self.names if n not in ("x", "y")]
        for batch in iterator:
            x, y = (batch.column(self.names.index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in "xy")
            values = np.column_stack([batch.column(self.names.index(b)).to_numpy(zero_copy_only=False) for b in bands])
            tx, ty = x // self.tile, y // self.tile
            cuts = np.flatnonzero((np.diff(tx) != 0) | (np.diff(ty) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(x)]):
                if a == b:
                    continue
                if at is not None and (tx[a], ty[a]) != at:
                    done.append(self._flush(system, path, held))
                    held = []
                at = (tx[a], ty[a])
                held.append((x[a:b], y[a:b], values[a:b]))
        if held:
            done.append(self._flush(system, path, held))
        return Written(done)

    def _flush(self, system, path: str, held: list) -> dict:
        x, y, v = (np.concatenate(c) for c in zip(*held))
        x0, y0, w, h = int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1
        if len(x) < w * h and self.nodata is None:
            raise ValueError("pixels of a tile are missing: give nodata, and rows of a tile together")
        kind = v.dtype if v.dtype.kind == "f" else np.dtype("i2" if v.dtype.itemsize <= 2 else "i4")
        if v.dtype.itemsize > 4 and v.dtype.kind == "i" and len(v) and (v.min() < -(2**31) or v.max() >= 2**31):
            raise ValueError("whole numbers beyond 32 bits are not written")
        a = np.full((h, w, v.shape[1]), self.nodata or 0, kind)
        a[y - y0, x - x0] = v
        name = f"tile-{y0 // self.tile}-{x0 // self.tile}-{uuid.uuid4().hex}.tif"
        data = encode(a)
        with system.open_output_stream(posixpath.join(path, name)) as f:
            f.write(data)
        (tile,) = (r := header(pa.BufferReader(data))).tiles
        shown = {c: getattr(r, c) for c in ("width", "height", "bands", "kind", "compression", "predictor")}
        return {"file": name, "x": x0, "y": y0, "raster": shown, "tile": list(tile)}

    def commit(self, messages) -> None:
        """The index makes the files a raster: those that no index names are left over from lost tasks or earlier rasters, and go."""
        system, path = filesystem(self.path)
        place = posixpath.join(path, INDEX)
        tiles = [t for m in messages if m for t in m.tiles]
        if not self.overwrite and system.get_file_info(place).type == fs.FileType.File:
            with system.open_input_file(place) as f:
                tiles = json.loads(f.read())["tiles"] + tiles
        system.create_dir(path, recursive=True)
        with system.open_output_stream(place + ".new") as f:
            f.write(json.dumps({"bands": [n for n in self.names if n not in ("x", "y")], "nodata": self.nodata, "tiles": tiles}).encode())
        system.move(place + ".new", place)
        kept = {t["file"] for t in tiles}
        for info in system.get_file_info(fs.FileSelector(path)):
            if info.base_name.endswith(".tif") and info.base_name not in kept:
                system.delete_file(info.path)

    def abort(self, messages) -> None:
        system, path = filesystem(self.path)
        for m in messages:
            for t in m.tiles if m else ():
                system.delete_file(posixpath.join(path, t["file"]))


def write_tiff(pixels: DataFrame, path: str, bands: list[str], tile: int = 512, nodata: float | None = None) -> None:
    """A raster as a folder of deflated tiles; without ``nodata`` every pixel of a tile's box must be there."""
    spark = pixels.sparkSession
    spark.dataSource.register(TiffSource)
    place = lambda c: F.floor(F.col(c) / tile)
    dealt = pixels.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *bands).repartition(place("y"), place("x")).sortWithinPartitions(place("y"), place("x"))
    out = dealt.write.format("tiff").mode("overwrite").option("tile", tile)
    (out if nodata is None else out.option("nodata", nodata)).save(path)


def read_tiff(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, bands: list[str] = (), pushdown: bool = False) -> DataFrame:
    """x, y and bands of a TIFF file or folder; ``window`` (x, y, width, height) reads only the tiles that it meets, as filters do with ``pushdown``."""
    spark.dataSource.register(TiffSource)
    source = spark.read.format("tiff").option("pushdown", "true" if pushdown else "false")
    if window:
        source = source.option("window", ",".join(map(str, window)))
    if bands:
        source = source.option("bands", ",".join(bands))
    return source.load(path)
