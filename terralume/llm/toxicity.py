"""Toxicity: a linear-chain CRF tags toxic tokens; its marginals score documents and give offsets."""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .common import Ids, WorkFolder, fold, long_rows, table, text_batches, with_fields, word_ids, words

#: Most labelled texts of either class that are learnt from.
TRAIN_ROWS = 2500
#: Tokens of a training window, windows of a text around suspect words and of a clean one anywhere, least texts of a toxic feature.
WINDOW, HIT_WINDOWS, CLEAN_WINDOWS, LEAST_TEXTS = 12, 16, 6, 4
#: Gradient steps of the chain.
STEPS = 60
#: Features a counting task holds before it hands on what it has.
COUNT_FEATURES = 400_000
CACHE_WORDS = 300_000
#: A toxic feature's share of toxic texts over that of clean ones, and least likelihood-ratio statistic.
RATIO, EVIDENCE = 5.0, 20.0
#: Marginals that count towards a text's score.
COUNTED = 0.05
#: Lengths of the beginnings of a word, in bytes, that are features; they carry over to inflections never seen.
BEGINNINGS = (4, 5, 6, 7, 8)
MARKS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def parts(word: bytes) -> list[bytes]:
    """Features of a lower-cased word: the word without outer marks, and its beginnings."""
    core = word.strip(MARKS)
    return [b"w:" + core, *[b"%d:" % n + core[:n] for n in BEGINNINGS if len(core) > n]]


@dataclass
class Tagger:
    """The chain and, by feature, the log potential of label 1 less that of label 0; features never learnt count 0."""

    chain: crf.Chain | None
    weight: dict[bytes, float]
    constant: float = 0.0

    def differences(self, vocabulary: list[bytes]) -> np.ndarray:
        get = self.weight.get
        return np.array([sum(get(f, 0.0) for f in parts(w)) for w in vocabulary])


class Scorer:
    """Marginals of all words of whole texts; remembers words it has met."""

    def __init__(self, tagger: Tagger):
        self.tagger, self.ids, self.d = tagger, Ids(), np.empty(0)

    def marginals(self, texts) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) > CACHE_WORDS:
            self.ids, self.d = Ids(), np.empty(0)
        flat, offsets = word_ids(texts, self.ids)
        if len(self.d) < len(self.ids):
            self.d = np.concatenate([self.d, self.tagger.differences(list(self.ids)[len(self.d) :])])
        return crf.two_label_marginals(self.tagger.chain, self.d[flat], offsets), offsets

    def scores(self, p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Chance that any word is toxic, taking words of some suspicion as independent, and the largest marginal at least.

        0 for a text without words.
        """
        out = np.zeros(len(offsets) - 1)
        some = np.diff(offsets) > 0
        if some.any():
            none = np.add.reduceat(np.where(p > COUNTED, np.log1p(-np.minimum(p, 1 - 1e-12)), 0.0), offsets[:-1][some])
            out[some] = np.maximum(np.maximum.reduceat(p, offsets[:-1][some]), -np.expm1(none))
        return out


def _text_features(text: str) -> set[bytes]:
    return {f for w in set(words(text)) for f in parts(w)}


def _count_features(batches):
    """(feature, toxic texts, clean texts) of (text, label) rows; the empty feature counts the texts themselves."""
    n: dict[bytes, list[int]] = {}

    def counted():
        keys, both = list(n), np.array(list(n.values()), np.int64).reshape(-1, 2)
        n.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["feature", "t", "c"])

    for batch in text_batches(batches):
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = _text_features(text)
            for f in found | {b""} if found else ():
                n.setdefault(f, [0, 0])[0 if y else 1] += 1
            if len(n) > COUNT_FEATURES:
                yield counted()
    if n:
        yield counted()


def suspects(counts: DataFrame) -> tuple[int, int, dict[bytes, bool]]:
    """Toxic and clean texts, and features that may mark toxic ones; True for those that do so by themselves.

    These many toxic texts have, several times as often as clean ones and beyond chance (a
    likelihood-ratio test). The others clean texts (almost) never have.
    """
    whole = counts.where("feature = X''").first()
    n_toxic, n_clean = (whole["t"], whole["c"]) if whole else (0, 0)
    if not n_toxic or not n_clean:
        return n_toxic, n_clean, {}
    share, rate = n_toxic / (n_toxic + n_clean), n_clean / n_toxic
    a, b = F.col("t").cast("double"), F.col("c").cast("double")
    surprise = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    marks = (a >= max(LEAST_TEXTS, 0.02 * n_toxic)) & (b * RATIO <= a * rate) & (surprise >= EVIDENCE)
    some = counts.where("feature <> X''").select("feature", marks.alias("marks")).where(F.col("marks") | ((a >= LEAST_TEXTS) & (b <= 0.02 * rate * a)))
    return n_toxic, n_clean, {bytes(r["feature"]): r["marks"] for r in some.toLocalIterator()}


def cover(found: list[list[bytes]], marks: set[bytes]) -> set[bytes]:
    """``marks`` and, greedily, the features that explain most of the toxic texts without any of these.

    ``found`` has the suspect features of each toxic text. A feature must explain several
    texts that no other does, so words that copies of one text share by chance stay out.
    """
    holds: dict[bytes, set[int]] = {}
    for i, features in enumerate(found):
        for f in features:
            holds.setdefault(f, set()).add(i)
    chosen = {f for f in marks if f in holds}
    left = set(range(len(found))).difference(*[holds[f] for f in chosen])
    # gains only fall, so a feature whose gain still holds when it comes up is the best
    queue = [(-len(holds[f] & left), -len(holds[f]), len(f), f) for f in holds if f not in chosen]
    heapq.heapify(queue)
    while queue and -queue[0][0] >= LEAST_TEXTS:
        gain, size, length, f = heapq.heappop(queue)
        now = -len(holds[f] & left)
        if now == gain:
            chosen.add(f)
            left -= holds[f]
        elif now:
            heapq.heappush(queue, (now, size, length, f))
    return chosen


def training_windows(text: str, toxic: bool, bad: set[bytes]) -> list[tuple[list[bytes], list[int]]]:
    """(words, labels) of windows of a text, drawn by a hash of the text from all of it.

    Around at most HIT_WINDOWS of its suspect words, wherever they stand; a clean text also
    gives CLEAN_WINDOWS any place. Words of a clean text are clean whatever their features.
    """
    d = words(text)
    rng = np.random.default_rng(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))
    known = {w: any(f in bad for f in parts(w)) for w in set(d)}
    hits = np.flatnonzero([known[w] for w in d])
    if len(hits) > HIT_WINDOWS:
        hits = np.sort(rng.choice(hits, HIT_WINDOWS, replace=False))
    starts = [max(0, int(k) - int(rng.integers(WINDOW))) for k in hits]
    if not toxic:
        starts += sorted({int(x) for x in rng.integers(max(1, len(d) - WINDOW + 1), size=CLEAN_WINDOWS)})
    return [(w := d[a : a + WINDOW], [int(toxic and known[x]) for x in w]) for a in starts if d]


def fit(windows: list[tuple[list[bytes], list[int]]]) -> Tagger:
    """The chain of (words, labels) windows."""
    ids, number = Ids(), Ids()
    sequences = [np.array([ids[w] for w in x]) for x, _ in windows]
    truth = [np.array(y) for _, y in windows]
    used = [[number[f] for f in parts(w)] for w in ids]
    features = np.full((len(used), 1 + len(BEGINNINGS)), len(number))
    for row, f in zip(features, used):
        row[: len(f)] = f
    chain = crf.train(features, sequences, truth, 2, len(number), steps=STEPS)
    weight = chain.emit[:, 1] - chain.emit[:, 0]
    chain.emit = chain.emit[-1:]
    return Tagger(chain, {f: float(weight[k]) for f, k in number.items()})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> Tagger:
    """Learn from at most ``rows`` labelled documents of either class, whole texts of any length, picked by hash of the id.

    An id on several rows is learnt from once, by its least text, and equal texts once. Token
    labels come from features that mark toxic texts; executors count them and cut windows, the
    driver gets suspect features, which of them each toxic text has, and a bounded number of
    windows a text. With labels of one class only, every text scores 1 or 0 (0 without any).
    The picked ids are bounded and broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("crf_label"))
    picked = None
    for v in (0, 1):
        part = known.where(F.col("crf_label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = part if picked is None else picked.unionAll(part)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    found = found.groupBy("doc_id", "crf_label").agg(F.min(F.col("text").cast("string")).alias("text"))
    work = WorkFolder(docs.sparkSession, "toxicity")
    found = long_rows(work.put("labelled", found.where("text IS NOT NULL").select("text", (F.col("crf_label") == 1).alias("y")).distinct().repartition(32)))
    sent = docs.sparkSession.sparkContext.broadcast
    counts = work.put("features", found.mapInArrow(_count_features, "feature binary, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(f"t >= {LEAST_TEXTS} OR feature = X''"))
    n_toxic, n_clean, suspect = suspects(counts)
    if not n_toxic or not n_clean:
        return Tagger(None, {}, 1.0 if n_toxic else 0.0)
    asked = sent(frozenset(suspect))

    def having(batches):
        for batch in text_batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(_text_features(t) & asked.value) for t in batch.column(0).to_pylist()], pa.list_(pa.binary()))], ["has"])

    has = [r["has"] for r in found.where("y").mapInArrow(having, "has array<binary>").where("size(has) > 0").toLocalIterator()]
    bad = sent(frozenset(cover([[bytes(f) for f in x] for x in has], {f for f, m in suspect.items() if m})))

    def cut(batches):
        for batch in text_batches(batches):
            some = [w for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in training_windows(t, y, bad.value)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.list_(pa.binary())), pa.array([y for _, y in some], pa.list_(pa.int32()))], ["words", "labels"])

    got = found.mapInArrow(cut, "words array<binary>, labels array<int>").toArrow()
    work.drop("labelled", "features")
    return fit(sorted(zip(got.column("words").to_pylist(), got.column("labels").to_pylist())))


def score(docs: DataFrame, tagger: Tagger, text: str = "text", out: str = "toxic_score", spans: str | None = None, least: float = 0.5) -> DataFrame:
    """All rows and columns of ``docs`` with the score of each whole text; one pass, no shuffle.

    With ``spans`` a column of that name lists (start, end, p) of words whose marginal is at
    least ``least``, in code points, end exclusive. Null and empty texts score 0 without spans.
    """
    docs = long_rows(docs).drop(out, *([spans] if spans else []))
    sent = docs.sparkSession.sparkContext.broadcast(tagger)
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def each(batches):
        scorer = Scorer(sent.value)
        for batch in text_batches(batches, text, 4_000_000):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = [[] for _ in texts]
            if scorer.tagger.chain is None:
                scores = np.full(len(texts), scorer.tagger.constant)
            else:
                p, offsets = scorer.marginals(texts)
                scores = scorer.scores(p, offsets)
                for i in np.unique(np.searchsorted(offsets, np.flatnonzero(p >= least), side="right") - 1) if spans else ():
                    own = p[offsets[i] : offsets[i + 1]]
                    found[i] = [{"start": m.start(), "end": m.end(), "p": float(q)} for m, q in zip(word.finditer(texts[i]), own) if q >= least]
            columns, names = [*batch.columns, pa.array(scores)], [*batch.schema.names, out]
            if spans:
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))))
                names.append(spans)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(each, with_fields(docs, f"{out} double" + (f", {spans} array<struct<start:int,end:int,p:double>>" if spans else "")))


def op6_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tagger = train(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    scored = score(docs, tagger, spans="toxic_spans")
    offsets = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("toxic_score").alias("score"), F.when(F.col("toxic_score") >= 0.7, 1).otherwise(0).alias("predicted"), offsets.alias("offsets"))
