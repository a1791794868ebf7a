"""Top-k search, mixing and packing: brute force, hot keys, odd rows."""

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest import plain
from pyspark.sql import functions as F

from terralume.llm import mixing, packing, topk
from terralume.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(name, spark, duck):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck(SF).execute(ORACLE[name]).df())


def brute_top(q, c, k):
    out = []
    for qid, qv in q:
        itself = next((j for j, (i, v) in enumerate(c) if i == qid and len(v) == len(qv) and (np.floor(v * 256) == np.floor(qv * 256)).all()), -1)
        scored = sorted((-int(np.dot(np.floor(qv * 256.0), np.floor(v * 256.0))), i) for j, (i, v) in enumerate(c) if j != itself and len(v) == len(qv))
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def vectors(spark, rows):
    return topk.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding")


@pytest.mark.parametrize("dims", [1, 16, 40, 64])
def test_top_k_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    v = rng.normal(size=(300, dims)).round(1)  # rounded: many ties
    v[50:60] = v[49]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    df = vectors(spark, rows)
    got = sorted(tuple(r) for r in topk.top_k(df.where("id % 10 = 0"), df, 5).collect())
    assert got == brute_top([(i, v[i]) for i in range(0, 300, 10)], list(enumerate(v)), 5)


def test_top_k_repeated_ids_over_many_blocks(spark):
    """Every row is asked and every other row is a candidate, whatever its id; blocks of queries and of candidates are several."""
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(40)), rng.integers(-3, 4, rng.choice([3, 5])) / 4.0) for _ in range(400)]
    rows += rows[:60]
    df = vectors(spark, [(i, x.tolist(), 0) for i, x in rows])
    got = sorted(tuple(r) for r in topk.top_k(df.where("id % 4 = 0"), df, 5, query_block=30, block_rows=16).collect())
    assert got == brute_top([(i, v) for i, v in rows if i % 4 == 0], rows, 5)


def test_top_k_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [nan, 1.0], 1), (2, [inf, 1.0], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [0.5, 0.5], 1), (6, [1.0], 1), (None, [1.0, 1.0], 1), (7, [1.0, 1.0], 1), (7, [1.0, 1.0], 1), (8, [1e300, 0.0], 1)]
    df = vectors(spark, rows)
    got = [tuple(r) for r in topk.top_k(df.where("id = 0"), df, 5).orderBy("rank").collect()]
    assert got == [(0, 1, 8, 2**63 - 1), (0, 2, 7, 65536), (0, 3, 7, 65536), (0, 4, 5, 32768)]


def test_top_k_empty(spark):
    none = vectors(spark, [])
    assert topk.top_k(none, none).count() == 0
    one = vectors(spark, [(0, [1.0], 0)])
    assert topk.top_k(one, one).count() == 0


def test_pruning_drops_no_one(spark):
    rng = np.random.default_rng(2)
    c = np.floor(rng.normal(size=(20_000, 32)) * 40)
    s = topk.Searcher(np.array([0]), np.floor(rng.normal(size=(1, 32)) * 40), 5)
    for a in range(0, len(c), 4096):
        s.add(np.arange(1 + a, 1 + a + len(c[a : a + 4096])), c[a : a + 4096])
    assert list(s.best[0][0]) == sorted(c @ s.q[0], reverse=True)[:5]


# ------------------------------------------------------------------ mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix_key string, n int")


def test_mixing_odd_rows(spark):
    rows = [(1, "a", "s", "x", 1), (1, "a", "s", "x", 1), (None, "b", None, "x", 2), (2, None, "t", None, None), (3, "", "t", "y", 3)]
    got = mixing.mix(docs(spark, rows), {"s": 1.0, "~": 1.0, "t": 1.0}, factor=5.0).collect()
    by = Counter((r["doc_id"], r["mix_copy"]) for r in got)
    assert all(n == 2 for (d, _), n in by.items() if d == 1)  # repeated rows get equal counts
    assert {r["mix_copies"] for r in got if r["doc_id"] == 1} == {max(r["mix_copy"] for r in got if r["doc_id"] == 1) + 1}
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixing_meets_targets(spark):
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 10).cast("string"))).alias("source"))
    want = {"hot": 0.1, "s1": 0.6, "s2": 0.3}
    n = {r["source"]: r["count"] for r in mixing.mix(df, want, factor=2.0).groupBy("source").count().collect()}
    assert set(n) == set(want)
    for k, share in want.items():
        assert n[k] / 120_000 == pytest.approx(share, rel=0.05)


def test_poisson_distribution(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    n = mixing.mix(df, None, factor=1.5).where("mix_copy = 0").groupBy("mix_copies").count().toPandas().set_index("mix_copies")["count"]
    for k in (1, 2, 3):
        p = np.exp(-1.5) * 1.5**k / [1, 1, 2, 6][k]
        assert n[k] / 40_000 == pytest.approx(p, rel=0.05)


def test_a_high_rate_is_split(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    total = mixing.mix(df, None, factor=70.0, shuffle=False).count()
    assert total / 2000 == pytest.approx(70, rel=0.02)


def test_mixing_is_the_same_again(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source")
    a, b = (mixing.mix(x).toPandas().sort_values("mix_key").reset_index(drop=True) for x in (df, df.repartition(7)))
    pd.testing.assert_frame_equal(a, b)


# ------------------------------------------------------------------ packing


def test_pieces_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    odd = [None, "", "  \n", "a b", "don't I'll 'S it's. X'S!", "<|endoftext|> x<|ENDOFTEXT|>", "é ́x x́. É.,!", "≮ A.̸", "ΑΣ Σ.", "x\x1cy\x85z", "İstanbul ŞI.", "日本 123 ½. 🙂👍🏽 9.", "　 q w", "ß ẞ ǅ K", "!!! .,", "word " * 5000, "x" * 30_000]
    real = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts = odd + real
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in packing.pieces(df, packing.tokenizer_path()).orderBy("doc_id", "piece").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    for i, x in enumerate(texts):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        assert got[i] == [(a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for a in range(0, len(ids), 2048)]


def check_packing(rows, capacity):
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == np.cumsum(g["length"]) - g["length"]).all() and g["length"].sum() <= capacity


def least_sequences(n, capacity):
    """No packing needs fewer: for any a, items above capacity - a are alone, and those above half each need a sequence
    in which only the rest is left for items from a to half."""
    best = 0
    for a in range(capacity // 2 + 1):
        alone, big, mid = n > capacity - a, (n > capacity / 2) & (n <= capacity - a), (n >= a) & (n <= capacity / 2)
        room = capacity * big.sum() - n[big].sum()
        best = max(best, alone.sum() + big.sum() + max(0, -(-(n[mid].sum() - room) // capacity)))
        free = int(((capacity - n[big]) // max(a, 1)).sum())  # the same by number of items
        best = max(best, alone.sum() + big.sum() + max(0, -(-(mid.sum() - free) // max(1, capacity // max(a, 1)))))
    return best


@pytest.mark.parametrize("kind", ["uniform", "small", "large", "hot"])
def test_packing_is_tight(spark, kind):
    rng = np.random.default_rng(1)
    n = {"uniform": rng.integers(1, 101, 3000), "small": rng.integers(1, 20, 3000), "large": rng.integers(34, 101, 3000), "hot": np.where(rng.random(3000) < 0.5, 40, rng.integers(1, 101, 3000))}[kind]
    df = spark.createDataFrame(pd.DataFrame({"doc_id": np.zeros(3000, int), "length": n, "offset": 5, "pack_rank": "x"}))
    got = packing.pack(df.drop("offset", "pack_rank"), 100).toPandas()
    check_packing(got, 100)
    assert sorted(got["length"]) == sorted(n)
    assert got["sequence_id"].nunique() <= least_sequences(n, 100) * 1.02 + 1


def test_large_items_meet_at_most_twice():
    runs = packing.plan({40: 7, 60: 3, 35: 4, 100: 2, 1: 5}, 100)
    large = Counter()
    for n, _, count, first, _ in runs:
        if 3 * n > 100:
            large.update(range(first, first + count))
    assert max(large.values()) == 2
    assert sum(c for n, _, c, _, _ in runs) == 21


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, length long")).count() == 0


def test_pack_lengths_that_do_not_fit(spark):
    rows = [(1, None), (2, 0), (3, 101), (4, 100), (5, -1), (6, 50), (6, 50), (7, 30)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, length long, pack_rank string, n string")
    got = packing.pack(df.withColumn("Offset", F.lit("z")), 100).toPandas()
    assert list(got.columns) == ["doc_id", "length", "pack_rank", "n", "sequence_id", "offset"] and set(got["pack_rank"]) == {"x"} and set(got["n"]) == {"y"}
    placed = got[got["sequence_id"].notna()]
    assert sorted(placed["doc_id"]) == [4, 6, 6, 7] and len(got) == len(rows) and (got["sequence_id"].isna() == got["offset"].isna()).all()
    assert placed.groupby("sequence_id")["length"].sum().max() <= 100
    only = packing.pack(df.where("doc_id IN (1, 2)"), 100).collect()
    assert len(only) == 2 and all(r["sequence_id"] is None for r in only)


def test_mix_keeps_columns_of_any_name(spark):
    names = ["mix_source", "mix_parts", "mix_cdf", "mix_n", "mix_rate", "mix_w", "mix_copies"]
    df = spark.createDataFrame([(i, "ab"[i % 2], *(["k"] * 7)) for i in range(200)], "doc_id long, source string, " + ", ".join(f"{n} string" for n in names))
    got = mixing.mix(df, None, factor=3.0)
    assert got.columns == ["doc_id", "source", *names[:-1], "mix_copies", "mix_copy", "mix_key"]
    assert {tuple(r) for r in got.select(names[:-1]).collect()} == {("k",) * 6}
