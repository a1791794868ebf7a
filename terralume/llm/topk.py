"""Exact top-k inner-product search by columnar branch and bound.

Queries and candidates are packed into blocks of whole numbers and written; every pair of a
query block and a group of candidate blocks is one unit of bounded size. Neither queries nor
candidates pass through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WorkFolder, table

#: Dimensions added between two prunings.
BLOCK_DIMS = 16
#: Rows of a vertical candidate block and queries scored together.
BLOCK_ROWS, QUERY_ROWS = 8192, 256
#: Queries of a block and candidate blocks of a group: what one unit compares.
QUERY_BLOCK, GROUP_BLOCKS = 16_384, 8


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) with only whole, finite vectors; a null id takes no part either."""
    v = F.col(vec_col)
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & F.coalesce(whole, F.lit(False)))


def quantise(vec: np.ndarray) -> np.ndarray:
    return np.floor(vec * 256.0)


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length in an Arrow list column."""
    lengths = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(lengths) - lengths
    return [(rows, quantise(flat[start[rows][:, None] + np.arange(d)])) for d in np.unique(lengths) for rows in [np.flatnonzero(lengths == d)]]


def _tail_norms(m: np.ndarray) -> np.ndarray:
    """Norm of each row's dimensions from block b on, for b = 0..blocks."""
    edges = list(range(0, m.shape[1], BLOCK_DIMS))
    sums = np.array([np.square(m[:, e : e + BLOCK_DIMS]).sum(1) for e in edges]).reshape(len(edges), m.shape[0])
    tail = np.vstack([np.cumsum(sums[::-1], axis=0)[::-1], np.zeros((1, m.shape[0]))])
    return np.sqrt(tail) * (1 + 1e-9) + 1e-6


class Searcher:
    """Keeps, for each query of one length, the best k (score, id, twin) seen so far.

    A twin has the query's id and vector. Scores are sums of products of integers in float64,
    exact below 2**53; beyond that Python integers are used and results saturate at the
    limits of a long.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.tails = _tail_norms(q)
        self.best = [(np.empty(0), np.empty(0, np.int64), np.empty(0, bool))] * len(ids)
        self.bound = np.full(len(ids), -np.inf)
        self.top = float(np.abs(q).max(initial=0))

    def _merge(self, i: int, score: np.ndarray, ids: np.ndarray, twin: np.ndarray) -> None:
        s, r, t = (np.concatenate([x, y]) for x, y in zip(self.best[i], (score, ids, twin)))
        order = np.lexsort((r, -s))[: self.k]
        self.best[i] = (s[order], r[order], t[order])
        if len(order) == self.k:
            self.bound[i] = s[order[-1]]

    def _twins(self, i: int, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        twin = ids == self.ids[i]
        for j in np.flatnonzero(twin):
            twin[j] = bool((rows[:, j] == self.q[i]).all())
        return twin

    def add(self, ids: np.ndarray, c: np.ndarray) -> None:
        d = c.shape[1]
        if self.top * float(np.abs(c).max(initial=0)) * max(d, 1) >= 2.0**53:
            return self._add_exact(ids, c)
        columns = np.ascontiguousarray(c.T)  # vertical: one dimension is one run of memory
        tails, edges = _tail_norms(c), list(range(0, d, BLOCK_DIMS))
        probe = slice(0, len(ids), max(1, len(ids) // 64))
        for a in range(0, len(self.ids), QUERY_ROWS):
            qs = self.q[a : a + QUERY_ROWS]
            if not np.isfinite(self.bound[a : a + QUERY_ROWS]).all():
                # a few whole rows first, so that pruning starts with a bound
                s = qs @ columns[:, probe]
                if s.shape[1] >= self.k:
                    self.bound[a : a + len(qs)] = np.maximum(self.bound[a : a + len(qs)], np.partition(s, -self.k, 1)[:, -self.k])
            first = qs[:, :BLOCK_DIMS] @ columns[:BLOCK_DIMS] if d else np.zeros((len(qs), len(ids)))
            for j in range(len(qs)):
                i, part = a + j, first[j]
                alive = np.flatnonzero(part + tails[min(1, len(edges))] * self.tails[min(1, len(edges)), i] >= self.bound[i])
                part = part[alive]
                for b, e in enumerate(edges[1:], 1):
                    if not len(alive):
                        break
                    part = part + qs[j, e : e + BLOCK_DIMS] @ columns[e : e + BLOCK_DIMS, alive]
                    keep = part + tails[b + 1, alive] * self.tails[b + 1, i] >= self.bound[i]
                    alive, part = alive[keep], part[keep]
                if len(alive):
                    self._merge(i, part, ids[alive], self._twins(i, ids[alive], columns[:, alive]))

    def _add_exact(self, ids: np.ndarray, c: np.ndarray) -> None:
        low, high = -(2**63), 2**63 - 1
        rows = [[int(x) for x in r] for r in c]
        for i, q in enumerate(self.q):
            whole = [int(x) for x in q]
            scored = [(-min(high, max(low, sum(x * y for x, y in zip(whole, r)))), int(n), int(n) == self.ids[i] and r == whole) for n, r in zip(ids, rows)]
            old = [(-int(s), int(n), bool(t)) for s, n, t in zip(*self.best[i])]
            best = sorted(old + sorted(scored)[: self.k])[: self.k]
            self.best[i] = (np.array([-s for s, _, _ in best], dtype=object), np.array([n for _, n, _ in best], np.int64), np.array([t for _, _, t in best], bool))


def _packed(ids: np.ndarray, m: np.ndarray) -> bytes:
    """Ids and whole numbers in the smallest type that holds them."""
    top = float(np.abs(m).max(initial=0))
    kind = next((t for t, most in (("<i1", 127), ("<i2", 32767), ("<i4", 2**31 - 1)) if top <= most), "<f8")
    return kind.encode() + ids.astype("<i8").tobytes() + m.astype(kind).tobytes()


def _unpacked(data: bytes, n: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    kind = np.dtype(data[:3].decode())
    return np.frombuffer(data, "<i8", n, 3), np.frombuffer(data, kind, n * dims, 3 + 8 * n).reshape(n, dims).astype(np.float64)


def _blocks(batches, rows: int):
    """Packed blocks (part, no, dims, n, data) of at most ``rows`` vectors of one length; ``part`` is the task's number."""
    held: dict[int, list] = {}
    part, no = TaskContext.get().partitionId(), 0
    names = ["part", "no", "dims", "n", "data"]

    def block(dims):
        nonlocal no
        ids, m = (np.concatenate(x) for x in zip(*held[dims]))
        for a in range(0, len(ids), rows):
            no += 1
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([dims], pa.int32()), pa.array([len(ids[a : a + rows])], pa.int32()), pa.array([_packed(ids[a : a + rows], m[a : a + rows])], pa.binary())], names)
        held[dims] = []

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for at, m in _matrix(batch.column(1)):
            held.setdefault(m.shape[1], []).append((ids[at], m))
            if sum(len(x) for x, _ in held[m.shape[1]]) >= rows:
                yield from block(m.shape[1])
    for dims, some in held.items():
        if some:
            yield from block(dims)


def _search(batches, k: int):
    """The best k of every query of a unit; rows (query_part, unit_group, side, no, dims, n, data) are sorted, queries first."""
    unit, kept = None, []

    def found():
        first = 0
        for s in kept:
            size = [len(r) for _, r, _ in s.best]
            number, first = np.arange(first, first + len(s.ids)), first + len(s.ids)
            if sum(size):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(sum(size), unit[0], np.int32)), pa.array(np.repeat(number, size)), pa.array(np.repeat(s.ids, size)), pa.array(np.concatenate([r for _, r, _ in s.best])),
                     pa.array([int(x) for v, _, _ in s.best for x in v], pa.int64()), pa.array(np.concatenate([t for _, _, t in s.best]))],
                    ["query_part", "query_number", "query_id", "vec_id", "score", "twin"],
                )

    for batch in batches:
        for i in range(batch.num_rows):
            part, group, side, _, dims, n, data = (c[i].as_py() for c in batch.columns)
            if (part, group) != unit:
                yield from found()
                unit, kept = (part, group), []
            ids, m = _unpacked(data, n, dims)
            if side == 0:
                kept.append(Searcher(ids, m, k))
            for s in kept if side else ():
                if s.q.shape[1] == dims:
                    s.add(ids, m)
    yield from found()


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best candidates of each query by integer inner product, ties to the smaller id.

    ``queries`` and ``candidates`` are (id long, vec array<double>) as from :func:`vectors`.
    Every query row is asked, also one of a repeated id. A candidate row equal to the query in
    id and vector is the query itself and left out, once; other rows of its id, and a second
    equal row, are candidates like all. Vectors meet only vectors of their length. An empty
    side gives an empty result. Returns query_id long, rank int, vec_id long, score long.

    Blocks of about ``query_block`` queries meet groups of :data:`GROUP_BLOCKS` candidate blocks
    of at most ``block_rows``; a unit holds one of the former and one candidate block at a time and returns k + 1
    rows a query, so memory is bounded and candidates travel once for each query block.
    """
    spark = queries.sparkSession
    work = WorkFolder(spark, "top-k")
    n_blocks = max(1, -(-queries.count() // query_block))
    packed = "part int, no int, dims int, n int, data binary"
    asked = work.put("queries", queries.select("id", "vec").repartition(n_blocks).mapInArrow(lambda it: _blocks(it, query_block), packed))
    told = work.put("candidates", candidates.select("id", "vec").mapInArrow(lambda it: _blocks(it, block_rows), packed))
    groups = max(1, -(-told.count() // GROUP_BLOCKS))
    left = asked.select(F.col("part").alias("query_part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("unit_group"), F.lit(0).alias("side"), "no", "dims", "n", "data")
    group = F.pmod(F.xxhash64("data"), F.lit(groups)).cast("int")
    right = told.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("query_part"), group.alias("unit_group"), F.lit(1).alias("side"), "no", "dims", "n", "data")
    units = left.unionAll(right).repartition(min(n_blocks * groups, 100_000), "query_part", "unit_group").sortWithinPartitions("query_part", "unit_group", "side", "no")
    found = units.mapInArrow(lambda it: _search(it, k + 1), "query_part int, query_number long, query_id long, vec_id long, score long, twin boolean")
    order = W.partitionBy("query_part", "query_number").orderBy(F.desc("score"), "vec_id", F.desc("twin"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    best = best.withColumn("twins", F.sum(F.col("twin").cast("int")).over(so_far))
    best = best.withColumn("rank", F.col("rank") - F.least("twins", F.lit(1))).withColumn("itself", F.col("twin") & (F.col("twins") == 1))
    return best.where(~F.col("itself") & (F.col("rank") <= k)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows.where(F.col("id") % 50 == 0), rows, 5)


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
