"""Shared plumbing: token ids of a block of texts, folds, schemas."""

from __future__ import annotations

import contextlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.work import WorkFolder


__all__ = ["WorkFolder", "Ids", "bitmap", "fold", "fresh", "long_rows", "mix64", "quoted", "spread_join", "table", "text_batches", "units", "with_fields", "word_ids", "words"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``; a null id is in fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts, F.lit(0))


def quoted(name: str) -> str:
    """A column's name as Spark reads it whatever dots or marks it has."""
    return "`" + name.replace("`", "``") + "`"


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to clash with no column."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: A key on more than this share of the rows is hot; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 0.001


def spread_join(rows: DataFrame, small: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``small`` (one row a key), without one hot key in one task.

    ``weight`` is a column of ``small``: how many of the ``total`` rows have the key. Keys of over
    :data:`HOT_SHARE` of the rows, so a bounded number, go by broadcast, all others by key.
    """
    bar = int(HOT_SHARE * total)
    hot, cold = small.where(F.col(weight) > bar), small.where(F.col(weight) <= bar)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key, how))


def with_fields(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` and further fields."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(ddl).fields])


class Ids(dict):
    """Numbers keys in the order they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased; null has none.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is the definition.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_ids(texts, ids: Ids, split=words) -> tuple[np.ndarray, np.ndarray]:
    """Flat int32 ids of all words of ``texts`` and the offsets of each text in them."""
    parts, offsets = [], np.zeros(len(texts) + 1, np.int64)
    for k, text in enumerate(texts):
        w = split(text)
        parts.append(np.fromiter(map(ids.__getitem__, w), np.int32, len(w)))
        offsets[k + 1] = offsets[k] + len(w)
    return (np.concatenate(parts) if parts else np.empty(0, np.int32)), offsets


def give_back() -> None:
    """Return freed memory to the system: workers live on, and share their executor's limit with it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def bitmap(rows: DataFrame, size: int) -> np.ndarray:
    """A filter of ``size`` bits as bytes, set at the places ``bit`` (from 1) of the rows."""
    maps = rows.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).where("k IS NOT NULL").collect()
    bits = np.zeros(size // 8, np.uint8)
    for r in maps:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[(r["k"] - 1) * 4096 : (r["k"] - 1) * 4096 + len(part)] = part
    return bits


def units(batches, key: list[str]):
    """Arrow batches sorted by ``key``, cut anew so that no unit is split."""
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        cols = [t.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in key]
        differs = np.zeros(len(t) - 1, bool)
        for c in cols:
            differs |= c[1:] != c[:-1]
        cuts = np.flatnonzero(differs) + 1
        if len(cuts):
            yield t.slice(0, int(cuts[-1])), cuts
            held = t.slice(int(cuts[-1]))
        else:
            held = t
    if held is not None and len(held):
        yield held, np.array([len(held)])
    del held
    give_back()


def long_rows(df: DataFrame) -> DataFrame:
    """The same rows, in a session whose Arrow batches hold at most 2000 rows or 4 MB: whole texts are long rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df


def text_batches(batches, column: str = "text", chars: int = 4_000_000):
    """Slices of Arrow batches whose texts sum to about ``chars``; one longer text is a slice of its own."""
    import pyarrow.compute as pc

    give_back()  # what earlier tasks of this worker have freed since
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64)
        block = (np.cumsum(size) - size // 2) // chars
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))
        give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
