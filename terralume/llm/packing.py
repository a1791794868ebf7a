"""Best-fit packing with large-item matching, on the histogram of lengths."""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Ids, WorkFolder, fresh, long_rows, quoted, table, text_batches, with_fields

CAPACITY = 2048
#: Words a worker remembers the ids of.
CACHE_WORDS = 450_000
#: Marks that end a word; after an ASCII letter or digit the vocabulary's splitting parts them in any case.
TAIL = b".,!*$%&#"
#: Stands between texts; no text holds this byte.
BETWEEN = b"\xff"
_KIND = np.zeros(256, np.uint8)  # 1 tail mark, 2 white space, 3 ASCII letter or digit
_KIND[list(TAIL)], _KIND[[9, 10, 11, 12, 13, 32]] = 1, 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 3


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def split_tails(raw: bytes) -> bytes:
    """A space before every run of :data:`TAIL` marks that ends a word after an ASCII letter or digit."""
    b = np.frombuffer(raw, np.uint8)
    kind = _KIND[b]
    edge = np.flatnonzero(np.diff((kind == 1).astype(np.int8), prepend=0, append=0))
    first, end = edge[::2], edge[1::2]
    follows = np.append(kind, 2)[end] == 2
    cut = first[follows & (first > 0) & (kind[first - 1] == 3)]
    return np.insert(b, cut, 32).tobytes()


class WordTokenizer:
    """Ids of whole texts for a vocabulary that drops white space: word by word, each word once.

    The vocabulary's splitting joins nothing across ASCII white space, nor an ASCII letter or
    digit with a mark, and ignores ASCII case, so a text's ids are those of its lower-cased
    words without their tails, and of the tails, in a row. Each comes from the tokenizers
    library; the ids of all words met lie in one array.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    @classmethod
    def shared(cls, path: str) -> WordTokenizer:
        """The worker's own, so that its later tasks start with the words of its earlier ones."""
        if path not in _OPEN:
            _OPEN[path] = cls(path)
        return _OPEN[path]

    def forget(self) -> None:
        self.words, self.flat, self.starts = Ids({BETWEEN: 0}), np.empty(0, np.uint32), np.zeros(2, np.int64)

    def _learn(self) -> None:
        unknown = [w.decode("utf-8", "surrogatepass") for w in islice(self.words, len(self.starts) - 1, None)]
        starts, flat = [self.starts], [self.flat]
        for a in range(0, len(unknown), 8192):
            part = unknown[a : a + 8192]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            size = np.bincount(np.array(got.word_ids, dtype=np.int64), minlength=len(part))
            starts.append(starts[-1][-1] + np.cumsum(size))
            flat.append(np.array(got.ids, dtype=np.uint32))
        self.starts, self.flat = np.concatenate(starts), np.concatenate(flat)

    def encode(self, texts) -> list[np.ndarray]:
        if not len(texts):
            return []
        if len(self.words) > CACHE_WORDS:
            self.forget()
        raw = (t.encode("utf-8", "surrogatepass") if t else b"" for t in texts)
        # a text with a bracket may hold a special token's name, which is written in one case only
        words = split_tails((b" " + BETWEEN + b" ").join(x if b"<" in x else x.lower() for x in raw)).split()
        ids = np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))
        if len(self.starts) <= len(self.words):
            self._learn()
        first = self.starts[ids]
        size = self.starts[ids + 1] - first
        ends = np.cumsum(size)
        out = self.flat[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return np.split(out, ends[ids == 0])


_OPEN: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids and ``end_id``, cut only beyond the capacity.

    A null or empty text is ``end_id`` alone. The ids themselves are not carried.
    """

    def each(batches):
        tokenizer = WordTokenizer.shared(path)
        for batch in text_batches(batches, "text", 1_000_000):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    rows.append((doc, k, a, len(part), zlib.crc32(part)))
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])
    return long_rows(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place every item.

    Works on counts of lengths, so its size is bounded by the capacity and not by the
    number of items. Items above a third of the capacity are matched first, the longest
    with the longest that still fits, at most two in a sequence; then each shorter length,
    from the longest, goes to the smallest gap that holds it.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by size: (first sequence, count)
    sequences = 0

    def place(n: int, count: int, sequence: int, offset: int) -> None:
        runs.append((n, rank[n], count, sequence, offset))
        rank[n] += count
        left[n] -= count

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((n for n in large if n <= min(a, capacity - a) and left[n] > (n == a)), None)
            if b is None:
                count = left[a]
                place(a, count, sequences, 0)
                gaps[capacity - a].append((sequences, count))
            else:
                count = left[a] // 2 if a == b else min(left[a], left[b])
                place(a, count, sequences, 0)
                place(b, count, sequences, a)
                gaps[capacity - a - b].append((sequences, count))
            sequences += count
    full = np.array([bool(g) for g in gaps])
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            size = n + int(np.argmax(full[n:]))
            if not full[size]:
                size, count = capacity, -(-left[n] // (capacity // n))
                gaps[size].append((sequences, count))
                sequences += count
            first, count = gaps[size].pop()
            used = min(count, left[n])
            place(n, used, first, capacity - size)
            if used < count:
                gaps[size].append((first + used, count - used))
            full[size] = bool(gaps[size])
            gaps[size - n].append((first, used))
            full[size - n] = True
    return runs


def pack(items: DataFrame, capacity: int = CAPACITY, length: str = "length", work: WorkFolder | None = None) -> DataFrame:
    """All rows of ``items`` with sequence_id and offset (long), packed into sequences of ``capacity``.

    Rows may repeat. A row whose ``length`` is null, below 1 or above the capacity can't be
    packed and gets null for both. An empty table gives an empty result. Columns of the two
    names are replaced, all others stay whatever their names.

    An item's place is its rank among the items of its length: its rank among those that its
    task wrote, and the items of earlier tasks. So one hot length is as spread as the rows are;
    only the counts of lengths (at most ``capacity`` rows) reach the driver.
    """
    work = work or WorkFolder(items.sparkSession, "packing")
    items = items.select([F.col(quoted(c)) for c in items.columns if c == length or c.lower() not in ("sequence_id", "offset")])
    given = items.columns
    items = items.toDF(*[f"item_{k}" for k in range(len(given))])  # Arrow functions know no names with dots
    length = items.columns[given.index(length)]
    row, rank, before, of, by = fresh([*items.columns, "sequence_id", "offset"], "pack_row", "pack_rank", "pack_before", "pack_length", "pack_task")
    rows = work.put("rows", items.withColumn(row, F.monotonically_increasing_id()))
    n = F.col(length).cast("long")
    rows = rows.withColumn(of, F.when(n.between(1, capacity), n)).withColumn(by, F.shiftright(row, 33))
    sizes = rows.where(F.col(of).isNotNull()).groupBy(of, by).agg(F.count("*").alias("c"))
    counts = {r[of]: r["c"] for r in sizes.groupBy(of).agg(F.sum("c").alias("c")).collect()}
    runs = np.array(sorted(plan(counts, capacity)) or np.empty((0, 5)), dtype=np.int64)
    first = sizes.select(of, by, (F.sum("c").over(W.partitionBy(of).orderBy(by)) - F.col("c")).alias(before))
    ranked = rows.withColumn(rank, F.row_number().over(W.partitionBy(of, by).orderBy(row)) - 1).join(first, [of, by], "left")
    ranked = ranked.select(*items.columns, F.when(F.col(of).isNotNull(), F.col(rank) + F.col(before)).alias(rank))
    sent = items.sparkSession.sparkContext.broadcast(runs)
    names = items.columns

    def each(batches):
        runs = sent.value
        start = {int(n): np.searchsorted(runs[:, 0], [n, n + 1]) for n in np.unique(runs[:, 0])}
        for batch in batches:
            if not batch.num_rows:
                continue
            none = np.asarray(batch.column(len(names)).is_null())
            n = np.where(none, 0, np.asarray(batch.column(names.index(length)).cast(pa.int64()).fill_null(0)))
            r = np.asarray(batch.column(len(names)).fill_null(0))
            at = np.zeros(len(n), np.int64)
            for v in np.unique(n[~none]):
                a, b = start[int(v)]
                own = n == v
                at[own] = a + np.searchsorted(runs[a:b, 1], r[own], side="right") - 1
            place = (runs[at, 3] + r - runs[at, 1], runs[at, 4]) if len(runs) else (r, r)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, mask=none) for x in place)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(each, with_fields(items, "sequence_id long, offset long")).toDF(*given, "sequence_id", "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return pack(pieces(docs, tokenizer_path()))
