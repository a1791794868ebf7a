"""Rasters as blocks: one row holds a tile's pixels, so that stages over all pixels are array operations, not joins of rows.

A block has tx, ty, the place and size (x0, y0, h, w) of its pixels with a halo around the tile, ``there`` (a byte a pixel),
``valid`` and one binary column of doubles a band. Masks travel as compressed bits of the tile, one row a tile.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shapes import by_group, dealt

#: Side of a tile.
SIDE = 128
#: Bytes of packed masks up to which they are broadcast; beyond it they and the blocks are joined by the tile.
MASK_BYTES = 64 << 20
#: Blocks are rows of a megabyte: writers look at their size at every row, and batches hold few.
WRITE = {"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "parquet.block.size": str(32 << 20), "parquet.enable.dictionary": "false"}
PLACE = "x0 long, y0 long, h int, w int"


def blocked(rows: DataFrame, bands: list[str], halo: int, side: int = SIDE, flush: int = 1 << 18) -> DataFrame:
    """Blocks of (x, y, valid, bands); a tile without a pixel of its own has none.

    Tasks pack the pixels they read by tile, ``flush`` pixels at a time, and what travels are those packs.
    """
    if 2 * halo >= side:
        raise ValueError("a halo must be smaller than half a tile")
    p = len(bands)

    def deal(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= flush:
                yield packs(held)
                held, n = [], 0
        if n:
            yield packs(held)

    def packs(batches) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        x, y, valid, *values = (t.column(c).to_numpy() for c in t.column_names)
        lower, upper = [np.floor_divide(v - halo, side) for v in (x, y)], [np.floor_divide(v + halo, side) for v in (x, y)]
        at, tx, ty = [], [], []
        for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):  # a pixel within the halo of a border goes to both sides
            go = np.flatnonzero((upper[0] > lower[0] if i else True) & (upper[1] > lower[1] if j else np.ones(len(x), bool)))
            at.append(go)
            tx.append((upper if i else lower)[0][go])
            ty.append((upper if j else lower)[1][go])
        at, tx, ty = (np.concatenate(v) for v in (at, tx, ty))
        order = np.lexsort((tx, ty))
        at, tx, ty = at[order], tx[order], ty[order]
        cuts = [0, *(np.flatnonzero((np.diff(tx) != 0) | (np.diff(ty) != 0)) + 1).tolist(), len(at)]
        starts = cuts[:-1]
        place, flags, data = np.stack([x[at], y[at]]), valid[at].astype(bool), np.stack([v[at] for v in values])
        bytes_of = lambda v: [v[..., i:j].tobytes() for i, j in zip(starts, cuts[1:])]
        return pa.RecordBatch.from_pydict({"tx": tx[starts], "ty": ty[starts], "place": bytes_of(place), "valid": bytes_of(flags), "data": bytes_of(data)})

    def one(group: dict) -> dict:
        tx, ty = int(group["tx"][0]), int(group["ty"][0])
        x, y = np.concatenate([np.frombuffer(v, np.int64).reshape(2, -1) for v in group["place"]], axis=1)
        own = (x // side == tx) & (y // side == ty)
        if not own.any():
            return {c: np.array([], k) for c, k in (("x0", np.int64), ("y0", np.int64), ("h", np.int32), ("w", np.int32), *[(b, object) for b in ("there", "valid", *bands)])}
        x0, y0 = int(x.min()), int(y.min())
        shape = (int(y.max()) - y0 + 1, int(x.max()) - x0 + 1)
        out = {"x0": np.array([x0]), "y0": np.array([y0]), "h": np.array([shape[0]], np.int32), "w": np.array([shape[1]], np.int32)}
        at = (y - y0, x - x0)
        valid = np.concatenate([np.frombuffer(v, bool) for v in group["valid"]])
        data = np.concatenate([np.frombuffer(v, np.float64).reshape(p, -1) for v in group["data"]], axis=1)
        for c, v, kind in (("there", True, bool), ("valid", valid, bool), *[(b, data[k], np.float64) for k, b in enumerate(bands)]):
            m = np.full(shape, np.nan if kind is np.float64 else False, kind)
            m[at] = v
            out[c] = np.array([m.tobytes()], object)
        return out

    rows = rows.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.coalesce("valid", F.lit(False)).alias("valid"), *[F.col(b).cast("double").alias(b) for b in bands])
    chunks = rows.mapInArrow(deal, "tx long, ty long, place binary, valid binary, data binary")
    return by_group(chunks, ["tx", "ty"], one, ", ".join([PLACE, "there binary", "valid binary", *[f"`{b}` binary" for b in bands]]))


class Block:
    """One block's arrays. ``own`` is the part inside the tile, as slices; masks of the tile are ``side`` x ``side``."""

    def __init__(self, row: dict, side: int = SIDE):
        self.row, self.x0, self.y0, self.shape = row, row["x0"], row["y0"], (row["h"], row["w"])
        self.left, self.top = row["tx"] * side, row["ty"] * side
        (a, b), (c, d) = ((max(low, start), min(low + side, start + n)) for low, start, n in ((self.top, self.y0, row["h"]), (self.left, self.x0, row["w"])))
        self.own = (slice(a - self.y0, b - self.y0), slice(c - self.x0, d - self.x0))
        self.tile = (slice(a - self.top, b - self.top), slice(c - self.left, d - self.left))
        self.first = (a, c)
        self.there = self.flags("there")

    def flags(self, name: str) -> np.ndarray:
        return np.frombuffer(self.row[name], bool).reshape(self.shape)

    def band(self, name: str) -> np.ndarray:
        return np.frombuffer(self.row[name], np.float64).reshape(self.shape)

    def mask(self, name: str) -> np.ndarray:
        """A packed mask of the tile on the block's own part."""
        return unpacked(self.row[name])[self.tile]

    def places(self, m: np.ndarray) -> dict[str, np.ndarray]:
        """x and y of the set pixels of a mask of the own part."""
        y, x = np.nonzero(m)
        return {"x": x + self.first[1], "y": y + self.first[0]}


def packed(m: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(m).tobytes(), 1)


def unpacked(data: bytes | None, side: int = SIDE) -> np.ndarray:
    if data is None:
        return np.zeros((side, side), bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=side * side).astype(bool).reshape(side, side)


def around(places: DataFrame, reach: int, name: str, side: int = SIDE) -> DataFrame:
    """(tx, ty, <name>): the packed mask of pixels at most ``reach`` columns and lines from one of ``places``, by tile."""

    def one(group: dict) -> dict:
        m = np.zeros((side + 2 * reach,) * 2, bool)
        m[group["y"] - (int(group["ty"][0]) * side - reach), group["x"] - (int(group["tx"][0]) * side - reach)] = True
        for axis in (0, 1):
            n = m.shape[axis] - 2 * reach
            m = np.logical_or.reduce([m.take(range(k, k + n), axis) for k in range(2 * reach + 1)])
        return {name: np.array([packed(m)], object)}

    rows = places.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    return by_group(dealt(rows, side, reach), ["tx", "ty"], one, f"`{name}` binary")


def with_mask(blocks: DataFrame, masks: DataFrame, name: str, how: str = "left") -> DataFrame:
    """Blocks with a written table's packed mask; it is broadcast where its size allows that."""
    size = masks.agg(F.coalesce(F.sum(F.length(name) + 64), F.lit(0))).first()[0]
    return blocks.join(F.broadcast(masks) if size <= MASK_BYTES else masks, ["tx", "ty"], how)


def per_block(blocks: DataFrame, fn, schema: str, columns: list[str] | None = None, last=None) -> DataFrame:
    """Rows of the dicts of arrays that ``fn`` makes of each row's dict of values; ``last`` gives one more dict at a task's end."""
    blocks = blocks.select(*columns) if columns else blocks
    names = blocks.columns

    def each(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(j)[k].as_py() if not pa.types.is_binary(batch.schema.types[j]) else _bytes(batch.column(j)[k]) for j, c in enumerate(names)}
                made = fn(row)
                if made is not None:
                    yield pa.RecordBatch.from_pydict(made)
        if last is not None:
            made = last()
            if made is not None:
                yield pa.RecordBatch.from_pydict(made)

    return blocks.mapInArrow(each, schema)


def _bytes(v: pa.Scalar):
    """A binary value without a copy."""
    return v.as_buffer() if v.is_valid else None


def smoothed(v: np.ndarray, there: np.ndarray, kernel: list[float]) -> np.ndarray:
    """Separable convolution; lines end where a pixel is missing, and are mirrored there without repeating the last pixel.

    Values are right wherever the array holds the pixels within the kernel's reach.
    """
    for axis in (1, 0):
        lines, on = (v, there) if axis else (v.T, there.T)
        out = _along(lines, on, np.array(kernel))
        v = out if axis else out.T
    return v


def _along(v: np.ndarray, on: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    r, out = len(kernel) // 2, np.full(v.shape, np.nan)
    # lines of one run are taken together by the run's ends
    edge = np.diff(np.pad(on, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (sl, s), (_, e) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    for a, b in set(zip(s.tolist(), e.tolist())):
        rows = sl[(s == a) & (e == b)]
        part, n = np.ascontiguousarray(v[rows, a:b]), b - a
        if n == 1:
            out[rows, a:b] = part * kernel.sum()
            continue
        place = np.abs((np.arange(-r, n + r) + n - 1) % (2 * (n - 1)) - (n - 1))
        wide = part[:, place]
        total = wide[:, :n] * kernel[0]
        for k in range(1, 2 * r + 1):
            total += wide[:, k : k + n] * kernel[k]
        out[rows, a:b] = total
    return out


def quantiles(blocks: DataFrame, columns: list[str], values, names: list[str], qs: list[float], few: int = 100_000) -> dict[str, list[float | None]]:
    """Exact percentiles by linear interpolation of the arrays that ``values`` makes of each block, a dict by name; NaN does not count.

    Numbers are compared by their bits, sixteen a scan, until at most ``few`` are left beside a rank; those come to the driver.
    """
    at: dict[str, list[float]] = {}
    ranks: dict[tuple[str, int], tuple[int, int]] = {}  # rank -> known leading bits, how many numbers lie below them
    found: dict[tuple[str, int], float] = {}
    sizes: dict[tuple[str, int], int] = {}
    todo, bits = {(c, 0) for c in names}, 0  # name and known leading bits

    def scan(todo, bits, whole):
        """(name, key, n): counts by the next sixteen bits, or of every number (``whole``), behind the known leading bits."""

        held: dict = {}

        def one(row):
            for c, v in values(row).items():
                key = _key(v[~np.isnan(v)])
                for name, lead in todo:
                    if name == c:
                        k = key if not bits else key[(key >> np.uint64(64 - bits)) == np.uint64(lead)]
                        if whole:
                            held.setdefault((c, lead), []).append(k)
                        else:
                            n = np.bincount(((k >> np.uint64(48 - bits)) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
                            held[c, lead] = held.get((c, lead), 0) + n

        def last():
            out = {"name": [], "lead": [], "key": [], "n": []}
            for (c, lead), v in held.items():
                if whole:
                    k, n = np.unique(np.concatenate(v), return_counts=True)
                else:
                    k, n = np.flatnonzero(v), v[v > 0]
                out["name"] += [c] * len(k)
                out["lead"] += [str(lead)] * len(k)
                out["key"] += [str(x) for x in k.tolist()]
                out["n"] += n.tolist()
            return out if out["n"] else None

        got = per_block(blocks, one, "name string, lead string, key string, n long", columns, last)
        counts: dict = {}
        for r in got.groupBy("name", "lead", "key").agg(F.sum("n").alias("n")).collect():
            counts.setdefault((r["name"], int(r["lead"])), []).append((int(r["key"]), r["n"]))
        return {k: sorted(v) for k, v in counts.items()}

    while todo:
        whole = bool(bits) and (bits == 64 or max(sizes.get(t, 0) for t in todo) <= few)
        counts = scan(todo, bits, whole)
        if not bits:
            n = {c: sum(m for _, m in counts.get((c, 0), [])) for c in names}
            at = {c: [q * (n[c] - 1) for q in qs] if n[c] else [] for c in names}
            ranks = {(c, int(r)): (0, 0) for c in names for p in at[c] for r in (np.floor(p), np.ceil(p))}
        left, todo, sizes = ranks, set(), {}
        ranks = {}
        for (c, r), (lead, below) in left.items():
            for key, m in counts[c, lead]:
                if r < below + m:
                    break
                below += m
            if whole:
                found[c, r] = _number(key)
            else:
                lead = (lead << 16) | key
                if bits + 16 == 64:
                    found[c, r] = _number(lead)
                else:
                    ranks[c, r] = (lead, below)
                    todo.add((c, lead))
                    sizes[c, lead] = m
        bits += 16
    value = lambda c, p: found[c, int(np.floor(p))] + (found[c, int(np.ceil(p))] - found[c, int(np.floor(p))]) * (p - np.floor(p))
    return {c: [value(c, p) for p in at[c]] if at[c] else [None] * len(qs) for c in names}


def _key(v: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of doubles."""
    b = (np.ascontiguousarray(v, np.float64) + 0.0).view(np.uint64)
    return np.where(b >> np.uint64(63) == 1, ~b, b | np.uint64(1 << 63))


def _number(key: int) -> float:
    b = key ^ (1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([b], np.uint64).view(np.float64)[0])
