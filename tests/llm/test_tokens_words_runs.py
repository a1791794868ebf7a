"""Token counts against the library, spelling variants and periodic runs against plain loops."""

import random

import pytest

from terralume.llm import token_counts

SF = "/root/testdata/sf0.001"


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.tokenizer_path())
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def token_texts():
    r = random.Random(3)
    junk = lambda n, alphabet: "".join(r.choice(alphabet) for _ in range(n))
    texts = [None, "", "a", "x" * 5000, "<|endoftext|>" * 200, junk(4000, "ab '\n<|endoftext|>"), junk(3000, " \n\t 　a1.'s"), "漢字かな。" * 400]
    texts += ["it's we'll they're " * 300, " " * 3000, "\n" * 2000 + "b", ("word " * 50 + "<|endoftext|>\n\n") * 30, "\n\n<|endoftext|>" * 100, "aé1" * 2000]
    texts += ["y" * 700 + " z" * 700 + "w" * 2000 + " tail" * 100]
    texts += [junk(r.randint(100, 3000), r.choice(["ab", "a b", "'st re\n", "<|endoftext|>ab \n", "0a. ", "é ü x"])) for _ in range(30)]
    return texts + ["".join(r.choice([junk(r.randint(1, 400), "abcde"), "<|endoftext|>", " ", "\n", "\n\n", "'ll", "'s"]) for _ in range(60)) for _ in range(20)]


@pytest.mark.parametrize("chunk, overlap", [(128, 32), (300, 40)])
def test_token_counts_equal_the_library(spark, chunk, overlap):
    """Many chunks and short overlaps, so that splices, wider overlaps and joined chunks all happen."""
    texts = token_texts()
    df = spark.createDataFrame([(i, x, 1, 2, 3) for i, x in enumerate(texts)], "doc_id long, text string, uid int, k int, id int")
    got = {r.doc_id: tuple(r)[1:] for r in token_counts.count(df, token_counts.tokenizer_path(), chunk=chunk, overlap=overlap).collect()}
    want = {i: (len((x or "").encode()), n, n > 1024) for i, (x, n) in enumerate(zip(texts, library(texts)))}
    assert got == want


def test_token_counts_odd_rows(spark):
    path = token_counts.tokenizer_path()
    rows = [(None, "a b"), (1, "same text"), (1, "same text"), (1, None), (None, None)]
    df = spark.createDataFrame(rows, "`my.id` long, text string")
    got = sorted(map(tuple, token_counts.count(df, path, doc_id="my.id", limit=1).collect()), key=str)
    assert got == sorted([(None, 3, 2, True), (1, 9, 2, True), (1, 9, 2, True), (1, 0, 0, False), (None, 0, 0, False)], key=str)
    assert token_counts.count(df.limit(0), path, doc_id="my.id").count() == 0
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.tokenizer(path.replace("byte_bpe_50k", "word_bpe_49k"))


def test_token_counts_query(spark):
    got = {r.doc_id: r.n_tokens for r in token_counts.op11_token_resync(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in rows], library([r.text for r in rows])))


def plain_variants(docs):
    import re
    from collections import Counter
    from zlib import crc32

    n = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    shapes = {}
    for w in n:  # a replaced or deleted code point leaves a hole in common
        for k in range(len(w)):
            shapes.setdefault((w[:k], w[k + 1 :]), set()).add(w)
    near = {w: set() for w in n}
    for (a, b), same in shapes.items():
        for w in same:
            near[w] |= same - {w}
            if a + b in n:
                near[w].add(a + b)
                near[a + b].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_variants_against_all_holes(spark):
    from terralume.llm import spelling

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, spelling.op12_spelling_variants(spark, SF).collect()))
    assert got == plain_variants(docs)


@pytest.mark.parametrize("shard", [20_000, 40])
def test_variants_hot_edges_long_words_chains(spark, shard, monkeypatch):
    """Many words of one beginning or end, words of over 16 code points, chains of forms, odd rows; shards of 40 split the hot edges."""
    from terralume.llm import spelling

    r = random.Random(5)
    words = ["begin" + "".join(r.choice("abà") for _ in range(r.randint(2, 5))) for _ in range(150)]
    words += ["".join(r.choice("abÿ") for _ in range(r.randint(3, 5))) + "ending" for _ in range(150)]
    words += ["x" * 12 + "".join(r.choice("ab") for _ in range(r.randint(5, 9))) for _ in range(80)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaabaaaa"] * 3
    chain = ["chained" + "s" * k for k in range(4) for _ in range(2 * 11**k)]
    docs = [(i, " ".join(r.choices(words, k=60)) + " Ω×÷ — end") for i in range(60)] + [(None, " ".join(chain)), (None, None), (3, ""), (3, "A-Z" * 9000), (4, "word" * 900), (4, "word" * 900)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "`a.id` long, text string, word int")
    monkeypatch.setattr(spelling.near_words, "__defaults__", (shard,))
    got = sorted(map(tuple, spelling.group_variants(df, "a.id").collect()))
    assert got == plain_variants(docs)
    assert spelling.group_variants(df.limit(0), "a.id").count() == 0


def plain_runs(words, least=12):
    """All maximal runs by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            e = s + q
            while e < n and words[e] == words[e - q]:
                e += 1
            if e - s >= max(least, 2 * q):
                found.setdefault((s, e), q)  # the smallest period comes first
            s = max(s + 1, e - q + 1)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_all_periods():
    import numpy as np

    from terralume.llm import periodic

    r = random.Random(11)
    for k in range(400):
        a = r.choice([1, 2, 3, 5])
        w = [r.randrange(a) for _ in range(r.randint(0, 90))]
        for _ in range(r.randint(0, 4)):  # repeated pieces, some twice over, so that runs are copied
            piece = [r.randrange(a) for _ in range(r.randint(1, 9))] * r.randint(1, 9)
            piece = piece[: len(piece) - r.randint(0, 2)] + ([9] if r.random() < 0.5 else [])
            w += (piece + [7 + r.randrange(3)]) * r.randint(1, 3)
        least = r.choice([12, 12, 2, 5])
        assert list(map(tuple, periodic.runs(np.array(w, np.int64), least).tolist())) == plain_runs(w, least), (k, w, least)
    fib = [0, 1]
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert list(map(tuple, periodic.runs(np.array(b), 2).tolist())) == plain_runs(b, 2)
    thue = [bin(i).count("1") % 2 for i in range(512)]
    assert list(map(tuple, periodic.runs(np.array(thue), 3).tolist())) == plain_runs(thue, 3)


def plain_periodic_row(doc_id, text, rewrite):
    import hashlib
    import re
    from zlib import crc32

    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(w), crc32(str(doc_id).encode())
    if rewrite and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    row = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *row, digest("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), digest(" ".join(w[i] for i in range(n) if i not in gone)))


def test_runs_query_and_odd_rows(spark):
    from terralume.llm import periodic

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    short = {i for i, t in docs if len((t or "").split()) < 700}
    got = [tuple(r) for r in periodic.op13_periodic_runs(spark, SF).collect()]
    assert len(got) == len(docs)
    assert sorted(g for g in got if g[0] in short) == sorted(plain_periodic_row(i, t, True) for i, t in docs if i in short)
    odd = [(None, "a b " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "x " * 40_000), (5, "a b c " * 20), (5, "a b c " * 20), (5, "A a " * 6), (6, "é é " * 12)]
    df = spark.createDataFrame([(*d, 1) for d in odd], "`a.id` long, text string, key int")
    got = sorted((tuple(r) for r in periodic.find_runs(df, "a.id").collect()), key=str)
    want = [plain_periodic_row(i, t, False) if i != 4 else None for i, t in odd]
    assert [g for g in got if g[0] != 4] == sorted([w for w in want if w], key=str)
    assert [g[1:6] for g in got if g[0] == 4] == [(1, 0, 40_000, 1, 40_000_000)]
    assert periodic.find_runs(df.limit(0), "a.id").count() == 0
