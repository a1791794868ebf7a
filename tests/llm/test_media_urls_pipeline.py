"""Progressive JPEG, URL rules, the pipeline."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralume.llm import jaccard, packing, pii
from terralume.llm import progressive_jpeg as pj
from terralume.llm import url_rules as ur
from terralume.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "x"), (4, "é🙂" * 700), (None, "no id"), (5, "long " * 60_000), (5, "long " * 60_000)]


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 2500])
def test_stored_bytes_come_back(n):
    payload = np.random.default_rng(n).integers(0, 256, 192 * n, dtype=np.uint8).tobytes()
    assert pj.read_payload(pj.decode(pj.store_bytes(payload))) == payload


def test_chroma_is_repeated_and_strips_join():
    """A stored picture has half-resolution chroma; the tensor is each luma sample with its chroma neighbour's colour."""
    payload = np.random.default_rng(4).integers(0, 256, 192 * 5001, dtype=np.uint8).tobytes()
    pic = pj.decode(pj.store_bytes(payload))
    assert pic.sampling == [(2, 2), (1, 1), (1, 1)]
    y, cb, cr = (np.clip(np.rint(pj.planes(c.reshape(-1, 64), q).reshape(*c.shape[:2], 8, 8).transpose(0, 2, 1, 3).reshape(c.shape[0] * 8, -1)), 0, 255).astype(float) for c, q in zip(pic.coefficients, pic.quant))
    a = pj.rgb(pic)
    assert a.shape == (pic.height, pic.width, 3) == (*y.shape, 3) and len(list(pj.strips(pic))) > 1
    rng = np.random.default_rng(5)
    for i, j in zip(rng.integers(0, pic.height, 500), rng.integers(0, pic.width, 500)):
        b, r = cb[i // 2, j // 2] - 128, cr[i // 2, j // 2] - 128
        want = np.array([y[i, j] + 1.402 * r, y[i, j] - 0.344136 * b - 0.714136 * r, y[i, j] + 1.772 * b])
        assert np.abs(a[i, j] - np.clip(want, 0, 255)).max() <= 0.51
    seen, digest = pj.feature(pic)
    assert digest == hashlib.sha256(a.tobytes()).hexdigest()
    n = [float(v) for v in seen.split(",")]
    assert n[:3] == pytest.approx(a.reshape(-1, 3).mean(0), abs=1e-3) and n[3:6] == pytest.approx(a.reshape(-1, 3).std(0), abs=1e-3)
    assert n[6:] == pytest.approx([(a[..., 1] // 64 == k).mean() for k in range(4)], abs=1e-3)


def test_digest(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    rows = pj.digest(df).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    for i, t in ODD:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert len({(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] == 5}) == 1
    assert pj.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_media_table(spark):
    df = spark.createDataFrame(ODD[:4], "doc_id long, text string").withColumn("media", F.lit("clash"))
    for r in pj.media_table(df).collect():
        pic = pj.decode(bytes(r["media"]))
        assert (pj.rgb(pic) == np.frombuffer(bytes(r["rgb"]), np.uint8).reshape(r["height"], r["width"], 3)).all()


class Writer:
    """A plain progressive encoder with ordinary Huffman codes: runs, end-of-band runs, refinement."""

    def __init__(self):
        self.bits, self.symbols = [], []

    def code(self, symbol, extra=0, n=0):
        self.symbols.append(symbol)
        self.bits.append((symbol, [extra >> k & 1 for k in range(n - 1, -1, -1)]))

    def raw(self, bits):
        self.bits.append((None, list(bits)))

    def finish(self, kind):
        used = sorted(set(self.symbols))
        length = max(1, (len(used)).bit_length())  # all codes of one length, never all ones
        table = pj._segment(0xC4, bytes([kind << 4, *[len(used) if k == length else 0 for k in range(1, 17)], *used]))
        out = []
        for s, extra in self.bits:
            if s is not None:
                c = used.index(s)
                out += [c >> k & 1 for k in range(length - 1, -1, -1)]
            out += extra
        return table, pj._bits(np.array(out, np.uint8))


def size_of(v):
    return int(abs(v)).bit_length()


def signed(v, n):
    return v if v >= 0 else v + (1 << n) - 1


def ac_first(blocks, low):
    w = Writer()
    run = 0

    def flush():
        nonlocal run
        while run:
            n = min(run.bit_length() - 1, 14)
            w.code(n << 4, run - (1 << n), n)
            run -= min(run, (2 << n) - 1) if run < (2 << n) else run
    for b in blocks:
        v = np.sign(b[1:]) * (np.abs(b[1:]) >> low)
        zeros = 0
        if not v.any():
            run += 1
            continue
        flush()
        last = np.flatnonzero(v)[-1]
        for x in v[: last + 1].tolist():
            if x == 0:
                zeros += 1
                continue
            while zeros > 15:
                w.code(0xF0)
                zeros -= 16
            n = size_of(x)
            w.code(zeros << 4 | n, signed(x, n), n)
            zeros = 0
        if last < 62:
            run = 1
    flush()
    return w


def ac_refine(blocks, low):
    w = Writer()
    for b in blocks:
        mag = np.abs(b[1:]) >> low
        fresh = [k for k in range(63) if mag[k] == 1]
        zeros, pending = 0, []
        last = fresh[-1] if fresh else -1
        for k in range(last + 1):
            if mag[k] > 1:
                pending.append(int(mag[k] & 1))
            elif mag[k] == 0:
                zeros += 1
                if zeros == 16:
                    w.code(0xF0)
                    w.raw(pending)
                    zeros, pending = 0, []
            else:
                w.code(zeros << 4 | 1, int(b[1 + k] > 0), 1)
                w.raw(pending)
                zeros, pending = 0, []
        rest = [int(m & 1) for m in mag[last + 1 :] if m > 1]
        if last < 62:
            w.code(0x00)
            w.raw(pending + rest)
    return w


@pytest.mark.parametrize("sampling", [((1, 1), (1, 1), (1, 1)), ((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1))])
def test_decoder_reads_ordinary_files(sampling):
    """Interleaved DC, sub-sampled chroma, runs and refinements against the coefficients that went in."""
    rng = np.random.default_rng(3)
    width, height = 45, 37
    mh, mv = max(s[0] for s in sampling), max(s[1] for s in sampling)
    across, down = -(-width // (8 * mh)), -(-height // (8 * mv))
    planes = []
    for h, v in sampling:
        c = np.where(rng.random((down * v, across * h, 64)) < 0.15, rng.integers(-40, 41, (down * v, across * h, 64)), 0)
        c[..., 0] = rng.integers(-200, 200, c.shape[:2])
        planes.append(c)
    pic = pj.Picture(width, height, list(sampling), [], [p.copy() for p in planes])
    out = [b"\xff\xd8", pj._segment(0xDB, bytes([0, *([2] * 64)]))]
    out.append(pj._segment(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, *[x for k, (h, v) in enumerate(sampling) for x in (k + 1, h << 4 | v, 0)]])))
    w, last = Writer(), [0, 0, 0]
    order = pj._dc_order(pic, [0, 1, 2])
    for i, block in order.tolist():
        v = int(planes[i].reshape(-1, 64)[block, 0]) >> 1
        n = size_of(v - last[i])
        w.code(n, signed(v - last[i], n), n)
        last[i] = v
    table, data = w.finish(0)
    out += [table, pj._scan([1, 2, 3], 0, 0, 0, 1, data)]
    out.append(pj._scan([1, 2, 3], 0, 0, 1, 0, pj._bits(np.array([planes[i].reshape(-1, 64)[k, 0] & 1 for i, k in order.tolist()], np.uint8))))
    for i in range(3):
        view = pj._own_blocks(pic, i)
        blocks = planes[i][: view.shape[0], : view.shape[1]].reshape(-1, 64)
        planes[i][view.shape[0] :, :, 1:] = 0
        planes[i][:, view.shape[1] :, 1:] = 0
        table, data = ac_first(blocks, 1).finish(1)
        out += [table, pj._scan([i + 1], 1, 63, 0, 1, data)]
        table, data = ac_refine(blocks, 0).finish(1)
        out += [table, pj._scan([i + 1], 1, 63, 1, 0, data)]
    got = pj.decode(b"".join([*out, b"\xff\xd9"]))
    for want, have in zip(planes, got.coefficients):
        assert (want == have).all()
    a = pj.rgb(got)
    assert a.shape == (height, width, 3) and a.dtype == np.uint8


def test_inverse_transform():
    c = np.random.default_rng(1).integers(-30, 30, (3, 64))
    raw = np.zeros((3, 64))
    raw[:, pj.ZIGZAG] = c * 2
    raw = raw.reshape(3, 8, 8)
    want = np.zeros((3, 8, 8))
    for y in range(8):
        for x in range(8):
            for v in range(8):
                for u in range(8):
                    k = (np.sqrt(0.125) if u == 0 else 0.5) * (np.sqrt(0.125) if v == 0 else 0.5)
                    want[:, y, x] += k * raw[:, v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    assert pj.planes(c, np.full(64, 2.0, np.float32)) == pytest.approx(want + 128, abs=1e-2)


def test_zigzag():
    assert pj.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(pj.ZIGZAG) == list(range(64))


@pytest.mark.parametrize("data", [b"", b"\x89PNG", b"\xff\xd8\xff\xd9", b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00\xff\xd9"])
def test_other_files_are_refused(data):
    with pytest.raises(ValueError):
        pj.decode(data)


# ------------------------------------------------------------------ urls


def plain_rule(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:k]), rest[k:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for v, h, p in ur.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, *(best or (None, None))


URLS = [None, "", "no scheme", "http://", "http://A.COM", "https://a.com/", "http://a.com?x=/", "http://x.EXAMPLE.com/en/1", "http://www.example.com/en/1", "http://notexample.com/en/", "http://b.www.example.com/en/", "http://é.net/es/a#/b", "http://net/fr/", "http://a.net/fr", "ftp://q.org/x://y/z", "http://a.com/\nb", "HTTP://İ.ORG/q"]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in ur.judge(pages).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain_rule(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == verdict if rule else got[i]["verdict"] in ("allow", "block")


def test_columns_of_internal_names_stay(spark):
    names = ["page", "url", "tokens", "key", "copies", "said", "item", "rule_id", "n", "fixed_verdict", "mined_verdict", "url_key", "url_tokens"]
    pages = spark.createDataFrame([["x", u, *["y"] * 11] for u in URLS + ["http://hot.org/a"] * 40], ", ".join(f"{n} string" for n in names))
    got = ur.judge(pages)
    assert got.columns == [*names, "host", "path", "rule", "verdict", "mined"]
    rows = got.collect()
    assert len(rows) == len(URLS) + 40 and all(r["page"] == "x" and r["tokens"] == r["url_key"] == r["mined_verdict"] == "y" for r in rows)


def test_hot_and_rare_urls_get_the_same_verdict(spark, monkeypatch):
    """Rows that look up their verdict in the broadcast of hot urls, by the join, and not at all."""
    rows = ["http://a.net/fr/1"] * 30 + ["http://b.com/ok"] * 30 + ["http://fr.org/fr/x"] * 25 + [f"http://h{chr(97 + i)}.org/fr/" for i in range(20)] + [None] * 9
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    how = ur.Mining(support=0.1, confidence=0.9)
    seen = []
    for share in (0.0, 0.1, 1.0):
        monkeypatch.setattr(ur, "HOT_SHARE", share)
        seen.append(sorted(tuple(str(v) for v in r) for r in ur.judge(pages, how).collect()))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == len(rows)
    assert {r[5] for r in seen[0] if r[1].startswith("http://fr.org")} == {"block"}


def test_long_tokens_stay_apart(spark):
    a, b = "x" * 80 + "a", "x" * 80 + "b"
    urls = spark.createDataFrame([(f"http://h.org/{t}?{t}=1",) for t in (a, b)], "url string")
    host, path = ur.parts(F.col("url"))
    x, y = (set(r[0]) for r in urls.select(ur.tokens(F.col("url"), host, path)).collect())
    assert len(x - y) == len(y - x) == 2


def test_no_pages(spark):
    assert ur.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_mined_rules_equal_brute_force(spark):
    from itertools import combinations

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url")
    host, path = ur.parts(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    _, verdict = ur.fixed_rule(F.col("host"), F.col("path"))
    rows = rows.select("url", ur.tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), verdict.alias("verdict")).where("verdict IS NOT NULL")
    how = ur.Mining(support=0.2, confidence=0.9)
    got = {(tuple(r["items"]), r["verdict"]): r["support"] for r in ur.mine(rows, how).collect()}
    data = [(tuple(r["tokens"]), r["verdict"]) for r in rows.collect()]
    all_, hit = {}, {}
    for t, v in data:
        for n in range(1, len(t) + 1):
            for s in combinations(t, n):
                all_[s] = all_.get(s, 0) + 1
                hit[s, v] = hit.get((s, v), 0) + 1
    strong = {k: n for k, n in hit.items() if n >= 0.2 * len(data) and n / all_[k[0]] >= 0.9}
    want = {k: n for k, n in strong.items() if not any((tuple(x for x in k[0] if x != y), k[1]) in strong and strong[tuple(x for x in k[0] if x != y), k[1]] / all_[tuple(x for x in k[0] if x != y)] >= n / all_[k[0]] for y in k[0])}
    assert got == want and want


def test_rules_are_mined_from_all_rows(spark):
    """No sample: supports are counts of all labelled rows, a hot url's among them."""
    rows = spark.range(240_000).select(F.when(F.col("id") % 3 == 0, "http://hot.net/fr/").otherwise(F.concat(F.lit("http://a.example.com/en/"), F.col("id").cast("string"))).alias("url"))
    rows = rows.select("url", F.when(F.col("url").contains("hot"), F.array(F.lit("h:hot"))).otherwise(F.array(F.lit("h:a"))).alias("tokens"), F.lit("block").alias("verdict"))
    assert {(tuple(r["items"]), r["support"]) for r in ur.mine(rows).collect()} == {(("h:hot",), 80_000), (("h:a",), 160_000)}


# ------------------------------------------------------------------ pipeline


def test_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert 4 <= len(cp.STAGES) <= 5
    good = cp.quality_stage(spark, docs, sf).persist()
    assert good.columns == docs.columns
    assert good.join(labels.where("quality = 0"), "doc_id", "left_semi").count() == 0
    assert good.join(labels.where("quality = 1"), "doc_id", "left_semi").count() == labels.where("quality = 1").count()
    one = cp.near_duplicate_stage(spark, good, sf).persist()
    assert one.columns == docs.columns
    want = jaccard.near_duplicates(good, 5, 80).where("doc_id = component_id").count()
    assert one.count() == want < good.count()
    clean = cp.pii_stage(spark, one, sf).persist()
    assert clean.count() == one.count() and clean.schema == docs.schema
    assert not any(pii.base_spans(r["text"] or "") for r in clean.collect())
    mixed = cp.mixing_stage(spark, clean, sf).persist()
    assert mixed.columns == docs.columns and mixed.join(clean, "doc_id", "left_anti").count() == 0
    packed = cp.packing_stage(spark, mixed, sf).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY
    assert (packed["piece"] == 0).sum() == mixed.count()


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline as cp

    rows = [(1, None, "en", "s", None), (2, "", "en", None, 0), (3, "a few words of text", None, "s", 5), (3, "a few words of text", None, "s", 5), (None, "x +1 (499) 555-6503", "en", "s", 1), (4, "many plain words, " * 20_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("length", F.lit("clash")).withColumn("quality_score", F.lit(1))
    clashing = ("pipeline_quality", "a.b", "c0", "mix_copy", "near_key", "score", "pii_spans", "item_0")
    docs = docs.withColumns({c: F.lit("mine") for c in clashing})
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert all(r[c] == "mine" for r in got.collect() for c in clashing), name
    assert cp.packing_stage(spark, docs, SF).count() > 5
    for _, stage in cp.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_pipeline_runs(spark):
    assert QUERIES and __import__("corpus_pipeline").run(spark, SF).count() > 0


def plain_rules(rows, support, confidence):
    """All token sets counted, then pruned by their parts."""
    import math
    from itertools import combinations

    n, total = {}, len(rows)
    for tokens, verdict in rows:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(set(tokens)), k):
                for says in (verdict, ""):
                    n[c, says] = n.get((c, says), 0) + 1
    least = math.ceil(support * total)
    found = {(c, v): (m / n[c, ""], m) for (c, v), m in n.items() if v and m >= least and m / n[c, ""] >= confidence}
    return {k: x for k, x in found.items() if not any(found.get((tuple(w for w in k[0] if w != gone), k[1]), (-1, 0))[0] >= x[0] for gone in k[0])}


def test_mined_rules_equal_all_sets_pruned(spark):
    import random

    r = random.Random(6)
    words = [f"p:{k}" for k in range(8)]
    rows = [(sorted({"s:https", *(w for w in words if r.random() < 0.4), *(["p:x", "p:y"] if k % 3 else [])}), r.choice(["allow", "block", "block"]) if k % 5 else "allow") for k in range(60)]
    got = ur.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), ur.Mining(0.03, 0.8)).collect()
    assert {(tuple(x["items"]), x["verdict"]): (x["confidence"], x["support"]) for x in got} == plain_rules(rows, 0.03, 0.8)
    assert ur.mine(spark.createDataFrame([], "tokens array<string>, verdict string")).count() == 0


@pytest.mark.parametrize("rows, share", [(2, 2), (10_000, 3)])
def test_urls_of_many_words(spark, rows, share):
    """Forty words of its own are one item of the mining, wherever the url stands."""
    long_url = "http://shop.example.com/en/" + "/".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40))
    urls = [long_url if k % share == 0 else f"http://a{chr(97 + k % 5)}.net/es/{chr(97 + k % 7)}" for k in range(rows)]
    urls += ["http://other.org/waa/q", "http://other.org/none"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").withColumnRenamed("page_id", "page.id")
    got = {x["page.id"]: (x["verdict"], x["mined"] is not None) for x in ur.judge(df).collect()}
    assert got[0] == ("block", False) and got[rows] == ("block", True) and len(got) == rows + 2


def test_keep_one_of_a_row_repeated_on_most_rows(spark):
    rows = [(7, "one row that is there very often indeed")] * 3000 + [(None, "another of these rows without an id")] * 2000 + [(k, f"text number {k} has words of its own x{k} y{k}") for k in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x.y", F.lit(1))
    from terralume.llm import jaccard

    got = jaccard.keep_one(docs, 5, 80)
    assert got.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in got.collect()))) == sorted(map(str, [7, None, *range(100, 140)]))


def test_mixing_beyond_the_broadcast_of_sources(spark, monkeypatch):
    from terralume.llm import mixing

    docs = spark.createDataFrame([(k, f"t{k}", "hot" if k % 3 else f"s{k % 40}") for k in range(900)], "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == want and want


def test_hubs_beyond_the_broadcast_of_hubs(spark, monkeypatch):
    from terralume.llm import jaccard

    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(words[: 50 + k % 11] + [f"own{k}"])) for k in range(60)], "doc_id long, text string")
    want = sorted(map(tuple, jaccard.near_duplicates(docs).collect()))
    monkeypatch.setattr(jaccard, "BROADCAST_HUBS", 0)
    monkeypatch.setattr(jaccard, "HUB", 3)
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == want
