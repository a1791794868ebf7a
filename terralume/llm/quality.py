"""Quality classifier: Bradley-Terry pairwise ranking over whole-text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WorkFolder, bitmap, fold, long_rows, table, text_batches, units, with_fields

#: Pairs below which all rows of one label meet all of the other; rows of the rarer label, and at most about so many of the other, in a group beyond that.
TRAIN_PAIRS, FEW, MANY = 40_000, 16, 4096
#: Bits of the filter of labelled ids; bins of a round, and rows that are left, when the score at a rank is looked for.
FILTER_BITS, BINS, LEFT = 1 << 23, 1024, 10_000
FEATURES = ("words", "word_length", "distinct", "top_word", "adjacent_equal", "period_2_3", "upper", "digit", "punct", "punct_pair", "bare_punct", "space", "line_length", "repeated_lines", "non_ascii", "stops")

_byte = np.arange(256)
_UPPER, _LOWER = (_byte >= 65) & (_byte <= 90), (_byte >= 97) & (_byte <= 122)
_DIGIT, _SPACE = (_byte >= 48) & (_byte <= 57), np.isin(_byte, [9, 10, 11, 12, 13, 32])
_PUNCT = (_byte > 32) & (_byte < 127) & ~_UPPER & ~_LOWER & ~_DIGIT
_CLASS = np.where(_PUNCT, 1, 0).astype(np.uint8)


def features(text: str | None) -> list[float]:
    """:data:`FEATURES` of one whole text; null and empty texts are all zero."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    b = np.frombuffer(raw, np.uint8)
    count = np.bincount(b, minlength=256)
    punct = _CLASS[b]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    equal = sum(map(bytes.__eq__, words, words[1:])) / n
    period = max(sum(map(bytes.__eq__, words, words[k:])) for k in (2, 3)) / n
    letters = max(1, count[_UPPER].sum() + count[_LOWER].sum())
    bare = sum(v for w, v in seen.items() if len(w) == 1 and _PUNCT[w[0]]) / n
    return [
        np.log1p(n), np.log1p(size / n), len(seen) / n, max(seen.values()) / n if n > 3 else 0.0, equal, period,
        count[_UPPER].sum() / letters, count[_DIGIT].sum() / size, count[_PUNCT].sum() / size, float((punct[1:] & punct[:-1]).sum()) / n, bare, count[_SPACE].sum() / size,
        np.log1p(size / len(lines)), 1 - len(set(lines)) / len(lines), count[128:].sum() / size, sum(w.endswith(b".") for w in words) / n,
    ]


@dataclass
class Ranker:
    """score = sigmoid(w . (x - mean) / scale - cut); ``cut`` is the score quantile at the share of label 0."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    cut: float
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut, -500, 500)))


def dealt(n_good: int, n_bad: int) -> tuple[int, int]:
    """Groups that rows of the rarer label are dealt to, and groups in all, a multiple of it: a rare row is in all groups of equal remainder."""
    few, many = min(n_good, n_bad), max(n_good, n_bad)
    of_few = max(1, min(few // FEW, n_good * n_bad // TRAIN_PAIRS))
    return of_few, of_few * max(1, -(-many // (of_few * MANY)))


def slope(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and Hessian (one row each below the other) of the logistic loss on the differences of all rows of ``good`` and ``bad``."""
    p = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - bad @ w, -500, 500)))  # chance that the worse one wins
    q = p * (1 - p)
    across = good.T @ q @ bad
    hessian = (good.T * q.sum(1)) @ good + (bad.T * q.sum(0)) @ bad - across - across.T
    return np.vstack([good.T @ p.sum(1) - bad.T @ p.sum(0), hessian])


def _newton(total, d: int, penalty: float, steps: int) -> np.ndarray:
    """Weights at which the gradient of all groups, less the penalty, is zero; ``total`` sums :func:`slope` over groups."""
    w = np.zeros(d)
    for _ in range(steps):
        both = total(w)
        step = np.linalg.solve(both[1:] + penalty * np.eye(d), both[0] - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return np.round(w, 9)  # sums differ in their last digits by where rows lie


def _one_class(n_good: int, n_bad: int, d: int) -> Ranker:
    return Ranker(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0 if n_good else 0.0 if n_bad else 0.5)


def fit(x: np.ndarray, y: np.ndarray, share: float, penalty: float = 1.0, steps: int = 25) -> Ranker:
    """Logistic loss on differences of label-1 and label-0 rows (Bradley-Terry), by Newton's method, for rows in memory.

    Every row takes part: all pairs if they are few, else all pairs within groups of rows. ``share`` is the share of
    label 0 among all labelled rows. With one class only, every text scores 1 or 0 (0.5 without any labels).
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not len(good) or not len(bad):
        return _one_class(len(good), len(bad), d)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    of_few, groups = dealt(len(good), len(bad))
    g = np.arange(len(good)) % (of_few if len(good) <= len(bad) else groups)
    b = np.arange(len(bad)) % (groups if len(good) <= len(bad) else of_few)
    at = [(z[good[g == (k % of_few if len(good) <= len(bad) else k)]], z[bad[b == (k if len(good) <= len(bad) else k % of_few)]]) for k in range(groups)]
    w = _newton(lambda w: sum(slope(*k, w) for k in at), d, penalty, steps)
    s = z @ w
    weight = np.where(y == 1, (1 - share) / len(good), share / len(bad))
    order = np.argsort(s, kind="stable")
    k = min(int(np.searchsorted(np.cumsum(weight[order]), share - 1e-9)), len(s) - 2)
    return Ranker(mean, scale, w, float((s[order[k]] + s[order[k + 1]]) / 2))


def _grouped(batches):
    """(good, bad): a group's rows from rows (g, y, x) sorted by g."""
    for t, cuts in units(batches, ["g"]):
        ends = np.unique(np.concatenate([cuts, [len(t)]]))
        x = np.array(t.column("x").to_pylist(), dtype=float)
        y = t.column("y").to_numpy()
        parts = [(x[a:z][y[a:z] == 1], x[a:z][y[a:z] == 0]) for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([p[k].tobytes() for p in parts], pa.binary()) for k in (0, 1)], ["good", "bad"])


def _cut(rows: DataFrame, share: float, n: dict[int, int]) -> float:
    """Middle of the score at which rows (y, s), in order, reach ``share`` of the weight, and of the next row's; label 0 weighs ``share``.

    Rounds of counts by bins narrow the place down; only the few rows that are left come to the driver.
    """
    each = {0: share / n[0], 1: (1 - share) / n[1]}
    target, base, here = share - 1e-9, 0.0, rows
    while True:
        low, high, left = here.agg(F.min("s"), F.max("s"), F.count("*")).first()
        if left <= LEFT or low == high:
            break
        k = F.least(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(BINS - 1)).cast("int")
        bins: dict[int, float] = {}
        for r in here.groupBy(k.alias("k"), "y").agg(F.count("*").alias("n")).collect():
            bins[r["k"]] = bins.get(r["k"], 0.0) + r["n"] * each[r["y"]]
        for b in sorted(bins):
            if base + bins[b] >= target or b == max(bins):
                break
            base += bins[b]
        here = here.where(k == b)
    found = sorted((r["s"], r["y"], r["n"]) for r in here.groupBy("s", "y").agg(F.count("*").alias("n")).collect())
    for at, (s, y, m) in enumerate(found):
        j = max(1, int(np.ceil((target - base) / each[y]))) if each[y] else m + 1
        if j <= m or at + 1 == len(found):
            break
        base += m * each[y]
    if j < m:
        return s
    after = found[at + 1][0] if at + 1 < len(found) else rows.where(F.col("s") > s).agg(F.min("s")).first()[0]
    if after is None:  # the last row: the one before it
        after = s if m > 1 else rows.where(F.col("s") < s).agg(F.max("s")).first()[0]
    return (s + (s if after is None else after)) / 2


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", penalty: float = 1.0, steps: int = 25) -> Ranker:
    """Learn from all labelled documents; see :func:`fit`.

    ``labels`` are the rows that may be learnt from; those with a null id or label are
    passed over and an id with several labels takes the largest; an id on several rows is
    learnt from once, by its least features. A filter of the labelled ids is broadcast, so texts are
    scanned but not shuffled; features meet labels by id, and groups of rows give their part of each Newton
    step. Texts of any length are read whole.
    """
    spark, d = docs.sparkSession, len(FEATURES)
    work = WorkFolder(spark, "quality")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bit = F.pmod(F.xxhash64(F.col("doc_id").cast(docs.schema["doc_id"].dataType)), F.lit(FILTER_BITS)) + 1
    sent = spark.sparkContext.broadcast(bitmap(known.select(bit.alias("bit")), FILTER_BITS))

    def each(batches):
        for batch in text_batches(batches, "text", 1_000_000):
            at = np.asarray(batch.column(2)) - 1
            on = np.flatnonzero(sent.value[at >> 3] >> (at & 7) & 1)
            x = [features(batch.column(1)[int(i)].as_py()) for i in on]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(on)), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    found = long_rows(docs).where("doc_id IS NOT NULL").select("doc_id", "text", bit.alias("bit"))
    found = found.mapInArrow(each, with_fields(found.select("doc_id"), "x array<double>")).groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = work.put("features", found.join(known, "doc_id"))
    numbers = [f(F.col("x")[k]) for f in (F.avg, F.stddev_pop) for k in range(d)]
    n_good, n_bad, *numbers = rows.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0), *numbers).first()
    if not n_good or not n_bad:
        return _one_class(n_good, n_bad, d)
    mean, scale = (np.array([float(f"{v:.12g}") for v in numbers[k : k + d]]) + e for k, e in ((0, 0.0), (d, 1e-6)))

    of_few, groups = dealt(n_good, n_bad)
    place = F.xxhash64("doc_id", F.lit(7))
    rare = F.col("y") == int(n_good <= n_bad)
    own = F.sequence(F.pmod(place, F.lit(of_few)), F.lit(groups - 1).cast("long"), F.lit(of_few).cast("long"))
    g = F.explode(F.when(rare, own).otherwise(F.array(F.pmod(place, F.lit(groups)))))
    packed = rows.select(g.alias("g"), "y", "x", "doc_id").repartition("g").sortWithinPartitions("g", "y", "doc_id").select("g", "y", "x")
    packed = work.put("groups", packed.mapInArrow(_grouped, "good binary, bad binary"))

    def total_slope(w: np.ndarray) -> np.ndarray:
        def part(batches):
            out = np.zeros((d + 1, d))
            for batch in batches:
                for both in zip(*[c.to_pylist() for c in batch.columns]):
                    good, bad = (np.clip((np.frombuffer(v).reshape(-1, d) - mean) / scale, -8, 8) for v in both)
                    out += slope(good, bad, w)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["slope"])

        return sum(np.frombuffer(bytes(r["slope"])).reshape(d + 1, d) for r in packed.mapInArrow(part, "slope binary").collect())

    w = _newton(total_slope, d, penalty, steps)
    model = Ranker(mean, scale, w, 0.0)

    def scored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.raw(np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, d)))], ["y", "s"])

    scores = work.put("scores", rows.select("y", "x").mapInArrow(scored, "y int, s double"))
    model = Ranker(mean, scale, w, _cut(scores, total[0] / (total[0] + total[1]), {0: n_bad, 1: n_good}))
    work.drop("features", "groups", "scores")
    return model


def score(docs: DataFrame, model: Ranker, text: str = "text", out: str = "quality_score") -> DataFrame:
    """All rows and columns of ``docs`` and the score (0 to 1) of each whole text, in place, without a shuffle.

    Null and empty texts score as all-zero features; equal texts score alike; a text of any
    length is read whole. An empty table gives an empty result. A column named ``out`` is replaced.
    """
    docs = long_rows(docs).drop(out)
    given, at = docs.columns, docs.columns.index(text)
    docs = docs.toDF(*[f"c{k}" for k in range(len(given))])  # Arrow functions know no names with dots

    def each(batches):
        for batch in text_batches(batches, f"c{at}", 1_000_000):
            x = np.array([features(t) for t in batch.column(at).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*batch.schema.names, "score"])

    return docs.mapInArrow(each, with_fields(docs, "score double")).toDF(*given, out)


def learning_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)


def op3_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, learning_labels(spark, sf_dir))
    scored = score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.5, 1).otherwise(0).alias("predicted"))
