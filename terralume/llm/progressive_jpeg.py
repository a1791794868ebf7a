"""Media columns: progressive JPEG, decoded scan by scan into coefficient arrays.

The decoder takes any baseline-precision progressive file (SOF2): spectral selection,
successive approximation, end-of-band runs, chroma subsampling. Scans whose Huffman table
has a single code have blocks of equal length and are decoded as arrays; other scans go bit
by bit. The writer stores bytes as quantised coefficients, the format's own lossless unit, of
a picture with chroma at half the resolution (4:2:0).
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_rows, table, text_batches, with_fields

#: Payloads are multiples of UNIT bytes; bytes of one MCU of four luma and two chroma 8x8 blocks; most MCUs in a row of the picture.
#: A picture has at most 65535 lines, so a payload at most ROW * 4095 * MCU bytes (1.6 GB).
UNIT, MCU, ROW = 192, 384, 1024
#: MCUs that are turned to pixels at once (or one row of them).
CHUNK = 2048


def zigzag() -> np.ndarray:
    """Row-major place of the k-th coefficient: by diagonals, in alternate directions."""
    place = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([8 * r + c for r, c in place])


ZIGZAG = zigzag()
_k, _x = np.arange(8)[:, None], np.arange(8)[None, :]
#: Row u, column x: the inverse transform's weight of frequency u at sample x.
BASIS = (np.where(_k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * _x + 1) * _k * np.pi / 16)).astype(np.float32)


# ------------------------------------------------------------------ writer


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _single_code(kind: int, symbol: int) -> bytes:
    """A Huffman table whose one code is the bit 0."""
    return _segment(0xC4, bytes([kind << 4, 1, *[0] * 15, symbol]))


def _scan(components: list[int], start: int, end: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components), *[x for c in components for x in (c, 0)], start, end, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _bits(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled up with ones."""
    bits = bits.ravel()
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def store_bytes(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose quantised coefficients are the payload (a positive multiple of 192 bytes).

    An MCU holds 384 bytes: its four luma blocks, then blue and red chroma.

    Byte b is the DC coefficient b, or the AC coefficient b if b > 127, else b - 255: never
    zero, always of magnitude category 8 and so of fixed code length. DC goes out in one
    first scan and eight refinements, AC in a first scan without the last bit and one
    refinement for each component.
    """
    n = -(-len(payload) // MCU)
    rows = -(-n // ROW)
    columns = -(-n // rows)
    if rows > 4095:
        raise ValueError("the payload is too long for one picture")
    b = np.zeros(rows * columns * MCU, np.uint8)
    b[: len(payload)] = np.frombuffer(payload, np.uint8)
    b = b.reshape(-1, 6, 64)
    out = [b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(payload)), _segment(0xDB, bytes([0, *[1] * 64]))]
    out.append(_segment(0xC2, bytes([8]) + (rows * 16).to_bytes(2, "big") + (columns * 16).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    dc = b[:, :, 0]
    out += [_single_code(0, 0), _scan([1, 2, 3], 0, 0, 0, 8, _bits(np.zeros(dc.size, np.uint8)))]
    out += [_scan([1, 2, 3], 0, 0, low + 1, low, _bits(dc >> low & 1)) for low in range(7, -1, -1)]
    ac = [x[:, 1:] for x in (_luma(b[:, :4], rows, columns), b[:, 4], b[:, 5])]
    out.append(_single_code(1, 0x07))
    out += [_scan([c + 1], 1, 63, 0, 1, (x >> 1).tobytes()) for c, x in enumerate(ac)]
    out.append(_single_code(1, 0x00))
    for c, x in enumerate(ac):
        bits = np.zeros((len(x), 64), np.uint8)
        bits[:, 1:] = (x & 1) ^ (x < 128)
        out.append(_scan([c + 1], 1, 63, 1, 0, np.packbits(bits).tobytes()))
    return b"".join([*out, b"\xff\xd9"])


def _luma(blocks: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Blocks (MCU, 4, 64) in the order of picture lines."""
    return blocks.reshape(rows, columns, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)


# ------------------------------------------------------------------ decoder


@dataclass
class Picture:
    """Coefficients of each component in scan order: (block rows, block columns, 64)."""

    width: int
    height: int
    sampling: list[tuple[int, int]]
    quant: list[np.ndarray]
    coefficients: list[np.ndarray]
    comment: bytes = b""
    ids: list[int] = field(default_factory=list)
    orders: dict = field(default_factory=dict)


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | (self.bits[self.at] if self.at < len(self.bits) else 1)
            self.at += 1
        return v

    def code(self, codes: dict[tuple[int, int], int]) -> int:
        length = v = 0
        while length < 17:
            v, length = v << 1 | self.take(1), length + 1
            if (length, v) in codes:
                return codes[length, v]
        raise ValueError("no such Huffman code")


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _extend(v, size):
    return np.where(v < (1 << size >> 1), v - (1 << size) + 1, v)


def _fixed(data: bytes, blocks: int, width: int) -> np.ndarray | None:
    """(blocks, width) bits if the data hold just so many."""
    if not 0 <= 8 * len(data) - blocks * width < 8:
        return None
    return np.unpackbits(np.frombuffer(data, np.uint8))[: blocks * width].reshape(blocks, width)


def _ac_first_fixed(data: bytes, c: np.ndarray, start: int, end: int, low: int, codes: dict) -> bool:
    ((length, _), symbol), *more = codes.items()
    if more or symbol >> 4 or not symbol or not c.size:
        return False
    n, band, size = len(c), end - start + 1, symbol & 15
    if length + size == 8 and len(data) == n * band:
        v = np.frombuffer(data, np.uint8).reshape(n, band).astype(np.int16) & (1 << size) - 1
    else:
        bits = _fixed(data, n, band * (length + size))
        if bits is None:
            return False
        v = bits.reshape(n, band, length + size)[:, :, length:] @ (1 << np.arange(size)[::-1]).astype(np.int16)
    c[:, start : end + 1] = _extend(v, size) << low
    return True


def _ac_refine_fixed(data: bytes, c: np.ndarray, start: int, end: int, low: int, codes: dict) -> bool:
    ((length, _), symbol), *more = codes.items()
    band = c[:, start : end + 1]
    if more or symbol or not band.size or not band.all():
        return False
    bits = _fixed(data, len(c), length + end - start + 1)
    if bits is None:
        return False
    band += np.where(band > 0, 1, -1).astype(np.int16) * (bits[:, length:].astype(np.int16) << low)
    return True


def _ac_first(bits: _Bits, c: np.ndarray, start: int, end: int, low: int, codes: dict) -> None:
    run = 0
    for block in c:
        if run:
            run -= 1
            continue
        k = start
        while k <= end:
            zeros, size = divmod(bits.code(codes), 16)
            if size:
                k += zeros
                block[k] = int(_extend(bits.take(size), size)) << low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) - 1 + bits.take(zeros)
                break


def _ac_refine(bits: _Bits, c: np.ndarray, start: int, end: int, low: int, codes: dict) -> None:
    run, one = 0, 1 << low

    def correct(block, k):
        if bits.take(1):
            block[k] += one if block[k] > 0 else -one

    for block in c:
        k = start
        while not run and k <= end:
            zeros, size = divmod(bits.code(codes), 16)
            value = 0
            if size:
                value = one if bits.take(1) else -one
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= end:
                if block[k]:
                    correct(block, k)
                elif zeros:
                    zeros -= 1
                else:
                    if value:
                        block[k] = value
                    k += 1
                    break
                k += 1
        if run:
            for j in range(k, end + 1):
                if block[j]:
                    correct(block, j)
            run -= 1


def decode(media: bytes) -> Picture:
    """Accumulate all scans of a progressive JPEG; a ValueError tells of any other or broken file."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, huffman, tables, restart = 2, {}, {}, 0
    pic: Picture | None = None
    comment = b""
    quant_of: list[int] = []
    while at + 4 <= len(media):
        if media[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker = media[at + 1]
        if marker == 0xD9:
            break
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(media[at + 2 : at + 4], "big")
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                tables[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            if body[0] != 8:
                raise ValueError("only 8-bit samples")
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(body[5])]
            sampling = [(p[1] >> 4, p[1] & 15) for p in parts]
            across, down = (-(-s // (8 * max(x[i] for x in sampling))) for i, s in ((0, width), (1, height)))
            pic = Picture(width, height, sampling, [], [np.zeros((down * v, across * h, 64), np.int16) for h, v in sampling], comment, [p[0] for p in parts])
            quant_of = [p[2] for p in parts]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not progressive Huffman coding")
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xFE:
            comment = body
            if pic:
                pic.comment = body
        elif marker == 0xDA:
            if pic is None:
                raise ValueError("a scan before its frame")
            if restart:
                raise ValueError("restart intervals aren't read")
            end = at
            while True:  # the next marker: 0xFF before anything but a stuffed zero
                end = media.find(b"\xff", end)
                if end < 0:
                    end = len(media)
                    break
                if media[end + 1 : end + 2] != b"\x00":
                    break
                end += 2
            data, at = media[at:end].replace(b"\xff\x00", b"\xff"), end
            n = body[0]
            chosen = [(pic.ids.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            start, stop, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            _read_scan(pic, data, chosen, start, stop, ah, al, huffman)
    if pic is None:
        raise ValueError("no frame")
    pic.quant = [tables[q] for q in quant_of]
    return pic


def _own_blocks(pic: Picture, c: int) -> np.ndarray:
    """A view of the blocks that a scan of this component alone holds."""
    h, v = pic.sampling[c]
    mh, mv = max(s[0] for s in pic.sampling), max(s[1] for s in pic.sampling)
    columns, rows = -(-(-(-pic.width * h // mh)) // 8), -(-(-(-pic.height * v // mv)) // 8)
    return pic.coefficients[c][:rows, :columns]


def _read_scan(pic: Picture, data: bytes, chosen: list[tuple[int, int]], start: int, end: int, ah: int, al: int, huffman: dict) -> None:
    if start == 0:
        key = tuple(c for c, _ in chosen)
        order = pic.orders.get(key)
        if order is None:
            order = pic.orders[key] = _dc_order(pic, list(key))
        flat = [pic.coefficients[c].reshape(-1, 64) for c, _ in chosen]
        if ah:
            bits = np.unpackbits(np.frombuffer(data, np.uint8))[: len(order)].astype(np.int16)
            for i, f in enumerate(flat):
                own = order[:, 0] == i
                f[order[own, 1], 0] |= bits[own] << al
            return
        codes = [huffman[t >> 4] for _, t in chosen]
        if all(len(x) == 1 and next(iter(x.values())) == 0 for x in codes):
            return  # every difference is zero
        bits, last = _Bits(data), [0] * len(chosen)
        for i, block in order.tolist():
            size = bits.code(codes[i])
            last[i] += int(_extend(bits.take(size), size)) if size else 0
            flat[i][block, 0] = last[i] << al
        return
    c, t = chosen[0]
    view = _own_blocks(pic, c)
    blocks = np.ascontiguousarray(view).reshape(-1, 64)
    codes = huffman[0x10 | t & 15]
    fixed, general = (_ac_refine_fixed, _ac_refine) if ah else (_ac_first_fixed, _ac_first)
    if not fixed(data, blocks, start, end, al, codes):
        general(_Bits(data), blocks, start, end, al, codes)
    view[...] = blocks.reshape(view.shape)


def _dc_order(pic: Picture, chosen: list[int]) -> np.ndarray:
    """(component's place in the scan, block number) in the order of the stream."""
    if len(chosen) == 1:
        rows, columns = _own_blocks(pic, chosen[0]).shape[:2]
        stride = pic.coefficients[chosen[0]].shape[1]
        block = (np.arange(rows)[:, None] * stride + np.arange(columns)).ravel()
        return np.stack([np.zeros_like(block), block], 1)
    parts = []
    for i, c in enumerate(chosen):
        h, v = pic.sampling[c]
        rows, columns = pic.coefficients[c].shape[:2]
        number = np.arange(rows * columns).reshape(rows // v, v, columns // h, h).transpose(0, 2, 1, 3).reshape(-1, v * h)
        parts.append(np.stack([np.full_like(number, i), number], 2))
    return np.concatenate(parts, 1).reshape(-1, 2)


def planes(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Samples of blocks (n, 64) in scan order: (n, 8, 8) float32, level-shifted."""
    raw = np.empty(coefficients.shape, np.float32)
    raw[:, ZIGZAG] = coefficients * quant
    half = (raw.reshape(-1, 8) @ BASIS).reshape(-1, 8, 8)  # rows: frequency v, columns: x
    return np.matmul(BASIS.T, half) + 128


def strips(pic: Picture):
    """Full-resolution uint8 strips (lines, width, 3) from the top; chroma samples are repeated to the luma grid.

    A strip is a few rows of MCUs, so memory follows the width and not the picture.
    """
    mh, mv = max(s[0] for s in pic.sampling), max(s[1] for s in pic.sampling)
    down = pic.coefficients[0].shape[0] // pic.sampling[0][1]
    step = max(1, CHUNK * pic.sampling[0][0] // pic.coefficients[0].shape[1])
    for first in range(0, down, step):
        parts = []
        for (h, v), q, c in zip(pic.sampling, pic.quant, pic.coefficients):
            own = c[first * v : (first + step) * v]
            rows, columns = own.shape[:2]
            p = planes(own.reshape(-1, 64), q).reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
            parts.append((np.clip(np.rint(p), 0, 255), mv // v, mh // h))
        lines = min(pic.height, (first + step) * mv * 8) - first * mv * 8
        yield _coloured(parts)[:lines, : pic.width]


def _coloured(parts: list[tuple[np.ndarray, int, int]]) -> np.ndarray:
    """RGB of planes with their repeats down and across; what chroma adds is found before it is repeated."""
    full = lambda x, k: np.repeat(np.repeat(x, parts[k][1], 0), parts[k][2], 1)
    y = full(parts[0][0], 0)
    out = np.empty((*y.shape, 3), np.uint8)
    if len(parts) == 1:
        out[...] = y[..., None]
        return out
    cb, cr = parts[1][0] - np.float32(128), parts[2][0] - np.float32(128)
    red, blue = full(np.float32(1.402) * cr, 2), full(np.float32(1.772) * cb, 1)
    if parts[1][1:] == parts[2][1:]:
        green = full(np.float32(-0.344136) * cb - np.float32(0.714136) * cr, 1)
    else:
        green = full(np.float32(-0.344136) * cb, 1) - full(np.float32(0.714136) * cr, 2)
    for k, add in enumerate((red, green, blue)):
        add += y
        np.rint(add, out=add)
        np.clip(add, 0, 255, out=add)
        out[..., k] = add
    return out


def rgb(pic: Picture) -> np.ndarray:
    """Full-resolution uint8 tensor (height, width, 3)."""
    return np.concatenate(list(strips(pic)))


def read_payload(pic: Picture) -> bytes:
    """The bytes that :func:`store_bytes` stored, from the decoded coefficients."""
    size = int(pic.comment.removeprefix(b"payload="))
    y, cb, cr = pic.coefficients
    rows, columns = cb.shape[:2]
    c = np.empty((rows * columns, 6, 64), np.int16)
    c[:, :4] = y.reshape(rows, 2, columns, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    c[:, 4], c[:, 5] = cb.reshape(-1, 64), cr.reshape(-1, 64)
    return np.where(c < 0, c + 255, c).astype(np.uint8).tobytes()[:size]


def feature(pic: Picture) -> tuple[str, str]:
    """What the full-resolution tensor looks like, and its sha256, strip by strip.

    Mean and deviation of each colour and the share of 4 levels of green, as text. Pixels of
    the MCUs that fill the last row of the picture count as well.
    """
    histogram, digest = np.zeros((3, 256), np.int64), hashlib.sha256()
    for x in strips(pic):
        x = np.ascontiguousarray(x)
        digest.update(x)
        histogram += np.stack([np.bincount(x[..., i].ravel(), minlength=256) for i in range(3)])
    n, level = histogram[0].sum(), np.arange(256)
    mean = histogram @ level / n
    deviation = np.sqrt(np.maximum(histogram @ level**2 / n - mean**2, 0))
    quarters = histogram[1].reshape(4, 64).sum(1) / n
    return ",".join(f"{v:.3f}" for v in [*mean, *deviation, *quarters]), digest.hexdigest()


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0), len(raw)


def media_table(docs: DataFrame, text: str = "text", tensors: bool = True) -> DataFrame:
    """All columns of ``docs`` with media binary (the JPEG) and, if asked for, the decoded tensor.

    Adds n_bytes, payload_bytes, media, and with ``tensors`` height, width and rgb (binary,
    row-major uint8). Null and empty texts become 192 spaces; equal texts equal files. Texts are
    stored whole, up to 1.6 GB (:data:`ROW`); a longer one is an error. Columns of the added
    names are replaced; an empty table gives an empty result. One pass, no shuffle.
    """
    docs = long_rows(docs).drop("n_bytes", "payload_bytes", "media", "height", "width", "rgb")
    extra = "n_bytes long, payload_bytes long, media binary" + (", height int, width int, rgb binary" if tensors else "")

    def each(batches):
        for batch in text_batches(batches, text, 1_000_000):
            rows = []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                payload, n = payload_of(t)
                media = store_bytes(payload)
                row = [n, len(payload), media]
                if tensors:
                    pic = decode(media)
                    row += [pic.height, pic.width, rgb(pic).tobytes()]
                rows.append(row)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], [*batch.schema.names, *[x.split()[0] for x in extra.split(", ")]])

    return docs.mapInArrow(each, with_fields(docs, extra))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb_sha256 string"


def digest(docs: DataFrame) -> DataFrame:
    """Store each whole text, read it back from the stored bytes and describe both; see :data:`DIGEST`."""

    def each(batches):
        names = [x.split()[0] for x in DIGEST.split(", ")]
        for batch in text_batches(batches, "text", 2_000_000):
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                payload, n = payload_of(t)
                media = store_bytes(payload)
                pic = decode(media)
                back = read_payload(pic)
                seen, tensor = feature(pic)
                rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), seen, pic.height, pic.width, tensor))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return long_rows(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(each, DIGEST)


def op5_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
