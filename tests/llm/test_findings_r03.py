"""Findings of FINDINGS_r03.md on text operators."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from terralume.llm import jaccard, pitman_yor, quality


def _copies(seed: int, strays: int, members: int, n: int = 146) -> list[np.ndarray]:
    """Sets of ``n`` around one base: ``members`` that differ from it in 12 shingles, ``strays`` in 24."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, n, np.uint64)
    out = []
    for changed in [12] * members + [24] * strays:
        s = base.copy()
        s[rng.choice(n, changed, False)] = rng.integers(0, 2**64, changed, np.uint64)
        out.append(np.unique(s))
    return out


def test_suffix_filter_tells_strays_from_a_group_of_near_copies():
    sets = _copies(1, 40, 60)
    h = [jaccard.histogram(s) for s in sets]
    passed = linked = pairs = 0
    for i in range(60, 100):
        for j in range(60):
            common = len(np.intersect1d(sets[i], sets[j], True))
            links = 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common)
            may = jaccard._may_link(h[i], h[j], len(sets[i]), len(sets[j]), 80)
            assert may or not links
            passed, linked, pairs = passed + may, linked + links, pairs + 1
    assert pairs == 2400 and passed - linked < 0.05 * pairs


def test_candidates_of_a_unit_pass_the_suffix_filter_and_lose_no_link():
    import pyarrow as pa

    sets = _copies(2, 40, 60)
    folds = [jaccard._folded(jaccard.histogram(s), jaccard.FOLD_BITS // 8).tobytes() for s in sets]
    roots = [-1] * 60 + list(range(60, 100))  # the group is one component, strays are their own
    k = len(sets)
    zero = pa.array([0] * k, pa.int64())
    unit = pa.RecordBatch.from_arrays(
        [zero, zero, zero, pa.array(range(k), pa.int64()), pa.array([0] * k, pa.int32()), pa.array([len(s) for s in sets], pa.int32()), pa.array(roots, pa.int64()), pa.array([0] * k, pa.int32()), pa.array(folds, pa.binary())],
        ["h", "i", "j", "cls", "pos", "n", "root", "part", "fold"],
    )
    got = {(a, b) for batch in jaccard._candidates([unit], 80, False) for a, b in zip(*[c.to_pylist() for c in batch.columns])}
    common = lambda i, j: len(np.intersect1d(sets[i], sets[j], True))
    apart = {(i, j) for i in range(k) for j in range(i + 1, k) if roots[i] != roots[j]}
    links = {(i, j) for i, j in apart if 100 * common(i, j) >= 80 * (len(sets[i]) + len(sets[j]) - common(i, j))}
    assert links <= got <= apart and len(got) < 0.25 * len(apart)


def test_ranker_learns_from_every_labelled_row(spark):
    """More rows of either label than were learnt from before (4000): the scaling is that of all rows."""
    rows = [(i, " ".join(["w%d" % (i % 97)] * (1 + i % 13 + 9 * (i % 2))) + "." * (i % 3), i % 2) for i in range(8600)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = quality.train(docs, labels)
    x = np.array([quality.features(r[1]) for r in rows])
    assert model.mean == pytest.approx(x.mean(0), abs=1e-9) and model.scale == pytest.approx(x.std(0) + 1e-6, abs=1e-9)
    y = np.array([r[2] for r in rows])
    assert ((model.score(x) >= 0.5) == y).mean() > 0.7


def test_distributed_ranker_equals_the_one_in_memory(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("v%d" % k for k in rng.integers(0, 4 + 30 * (i % 3 == 0), 8 + i % 5)), int(i % 3 == 0)) for i in range(150)]
    model = quality.train(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int"))
    y = np.array([r[2] for r in rows])
    want = quality.fit(np.array([quality.features(r[1]) for r in rows]), y, 1 - y.mean())
    assert model.w == pytest.approx(want.w, abs=1e-6) and model.cut == pytest.approx(want.cut, abs=1e-6)


@pytest.mark.parametrize("few, many", [(5, 20_000), (700, 900), (1, 3)])
def test_groups_are_bounded_and_every_row_is_in_one(few, many):
    of_few, groups = quality.dealt(few, many)
    assert groups % of_few == 0 and many / groups <= quality.MANY
    assert few / of_few * many <= max(2 * quality.TRAIN_PAIRS, 2 * quality.FEW * many)  # pairs grow as rows do


def test_cut_is_the_score_at_its_rank(spark, monkeypatch):
    monkeypatch.setattr(quality, "LEFT", 5)
    monkeypatch.setattr(quality, "BINS", 4)
    rng = np.random.default_rng(5)
    for s in (rng.normal(size=300), np.round(rng.normal(size=300), 1), np.ones(40)):
        y = rng.integers(0, 2, len(s))
        y[:2] = 0, 1
        share = 0.3
        weight = np.where(y == 1, (1 - share) / y.sum(), share / (len(y) - y.sum()))
        order = np.lexsort((y, s))
        k = min(int(np.searchsorted(np.cumsum(weight[order]), share - 1e-9)), len(s) - 2)
        rows = spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "y int, s double")
        assert quality._cut(rows, share, {0: int((y == 0).sum()), 1: int(y.sum())}) == pytest.approx((s[order[k]] + s[order[k + 1]]) / 2, abs=1e-12)


def test_first_guess_of_unigrams_counts_all_training_tokens(spark, monkeypatch):
    """Words of late blocks have the guess of their count, held-out texts give none."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(pitman_yor, "BLOCK_CHARS", 40)
    seen, plain = [], pitman_yor._frequent
    monkeypatch.setattr(pitman_yor, "_frequent", lambda *a: seen.append(plain(*a)) or seen[-1])
    texts = [(i, f"common word{i // 10} word{i // 10} tail") for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    assert pitman_yor.score(docs, F.col("doc_id") % 4 != 1).count() == 120
    count = Counter(w for i, t in texts if i % 4 != 1 for w in t.encode().split())
    n = sum(count.values()) + sum(i % 4 != 1 for i, _ in texts)
    plan = seen[0]
    for w, c in count.items():
        code = plan.code(np.array([pitman_yor.xxhash.xxh3_64_intdigest(w)], np.uint64) & pitman_yor.WORD)[0]
        assert code < pitman_yor.CODES and plan.chance[code] == pytest.approx((c - 0.5) / n, rel=1e-5)


# ------------------------------------------------------------------ op2_pitman_yor: CPU seconds


def test_words_of_a_block_are_hashed_once_and_as_defined(monkeypatch):
    """A block carries its words' hashes: opening it again, as three steps do, hashes none."""
    import pyarrow as pa

    from terralume.llm import common

    texts = [None, "", " ", "\t\n", "a", "  A b\x0b\x0cC\r\nd ", "\x1cx\x1d y\x85z\xa0w q", "ÉÀ é", "".join(map(chr, range(128))), "İI", "a\x00b \x00", "b a b"]
    called, digest = [], pitman_yor.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(pitman_yor.xxhash, "xxh3_64_intdigest", lambda w: called.append(w) or digest(w))
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), pa.array([i % 3 > 0 for i in range(len(texts))])], ["doc_id", "text", "train"])
    (block,) = pitman_yor._blocks([rows])
    want = [common.words(t) for t in texts]
    assert sorted(called) == sorted({w for t in want for w in t})
    called.clear()
    b = pitman_yor.Block(block["payload"][0].as_py())
    assert not called and b.docs.to_pylist() == list(range(len(texts)))
    assert b.size.tolist() == [len(w) + 1 for w in want] and block["tokens"][0].as_py() == b.size.sum() and block["train_tokens"][0].as_py() == b.size[b.train].sum()
    hashes = [np.uint64(digest(w)) & pitman_yor.WORD for t in want for w in (*t, b" end")]
    assert b.h[b.d].tolist() == hashes


def test_sums_by_restaurant_are_the_same_by_either_way():
    rng = np.random.default_rng(5)
    for where, n in ((np.repeat(np.arange(40), rng.integers(1, 9, 40)), 40), (rng.integers(0, 9, 60), 9), (np.array([1, 1, 3]), 5), (np.array([0, 1]), 3), (np.empty(0, np.int64), 0)):
        c = rng.integers(0, 50, len(where))
        level = pitman_yor.Level(where, n, 0.5, 1.0, c)
        assert level.part()[0].tolist() == np.bincount(where, c, n).tolist() and level.part()[1].tolist() == np.bincount(where, c > 0, n).tolist()
        assert pitman_yor.distinct(c).tolist() == np.unique(c).tolist() and pitman_yor.by_number(c, 50).tolist() == pitman_yor.by_number(c, 10**6).tolist()


def test_routers_between_blocks_and_shards_change_nothing(spark, monkeypatch):
    """Beyond so many shards messages go by routers, fewer of them; every row scores as without, words without a code and too frequent contexts too."""
    import random

    from pyspark.sql import functions as F

    monkeypatch.setattr(pitman_yor, "BLOCK_CHARS", 2_000)
    frequent = pitman_yor._frequent

    def few_codes(*a):
        plan = frequent(*a)
        on = plan.codes < 40
        plan.code_hashes, plan.codes, plan.chance = plan.code_hashes[on], plan.codes[on], plan.chance[:40]
        return plan

    monkeypatch.setattr(pitman_yor, "_frequent", few_codes)
    rng = random.Random(4)
    word = lambda n: "w%d" % int(rng.paretovariate(0.8) % n)
    rows = [(i, " ".join(x for _ in range(12) for x in ("of", "the", word(300), word(30))) if i % 7 else None) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    plain, routed = (pitman_yor.score(df, F.col("doc_id") % 5 != 0, shard_tokens=300, routed=most).toPandas().sort_values("doc_id", ignore_index=True) for most in (10**9, 10))
    assert len(plain) == 240 and (plain["n_known"] < plain["n_tokens"]).any() and plain.equals(routed)
