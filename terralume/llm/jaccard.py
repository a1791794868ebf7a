"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents with equal shingle sets are one class; classes are compared, copies never are.
Candidates share a shingle in their prefixes. A first round compares the classes of a
posting list with one pivot; a second compares those that the first has not linked, in
bounded units, so components are exact while a large group of near copies costs a star
and not all its pairs. Each pair is verified once, on whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import HOT_SHARE, quoted, Ids, WorkFolder, bitmap, fresh, give_back, long_rows, mix64, spread_join, table, text_batches, units, word_ids

#: Words of a shingle and the least similarity in percent.
WORDS, PERCENT = 4, 85
#: Most shingles whose frequency orders them (the rest count as rare) and least count in a task to be looked at.
FREQUENT, LOCAL_LEAST, TASK_SHINGLES = 1 << 21, 2, 1_000_000
#: Classes of a posting list that are compared in one unit; longer lists become several units.
UNIT = 256
#: Bits of the filter of wanted documents.
FILTER_BITS = 1 << 23
#: Bits of the parities that a row of a posting list carries.
FOLD_BITS = 256
CACHE_WORDS = 100_000
#: Pairs of a class that are verified in one group; a class with more has several, each with its set.
HUB = 256
#: Hubs up to which their table is broadcast.
BROADCAST_HUBS = 500_000


class Shingler:
    """Distinct 64-bit shingle hashes of whole texts; remembers words' hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.ids, self.hashes = words, Ids(), np.empty(0, np.uint64)

    def sets(self, texts) -> list[np.ndarray]:
        """A sorted array for each text: its shingles; all words as one if they are fewer; none without words."""
        if len(self.ids) > CACHE_WORDS:
            self.ids, self.hashes = Ids(), self.hashes[:0]
        flat, offsets = word_ids(texts, self.ids)
        if len(self.hashes) < len(self.ids):
            new = list(self.ids)[len(self.hashes) :]
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
        w = self.hashes[flat]
        k, n = self.words, len(flat)
        rolled = self._combine([w[i : n - k + 1 + i] for i in range(k)]) if n >= k else w[:0]
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            else:
                out.append(self._combine([w[i : i + 1] for i in range(a, b)]) if b > a else w[:0])
        return out

    @staticmethod
    def _combine(columns: list[np.ndarray]) -> np.ndarray:
        h = np.full(len(columns[0]), len(columns), np.uint64)
        for c in columns:
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + c)
        return h


def set_class(s: np.ndarray) -> int | None:
    """Signed 64-bit key of a set; among n different sets n*n/2**65 wrongly equal pairs are to be expected."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else None


def least_overlap(x, y, percent: int = PERCENT):
    """Fewest common shingles with which sets of these sizes link: i >= percent * (x + y - i) / 100."""
    return -(-percent * (x + y) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _profiles(batches, words: int):
    """Rows of kind 0 (doc_id, class, size, key of the text) and of kind 1 (shingle, count) for those repeated within a task."""
    shingler, seen, held, size = Shingler(words), set(), [], 0
    names = ["kind", "a", "b", "c", "d"]

    def repeated():
        h = np.concatenate(held)
        held.clear()
        h.sort()
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(first, append=len(h))
        some = n >= LOCAL_LEAST
        h, n = h[first[some]].view(np.int64), n[some]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int32)), pa.array(h), pa.array(n), pa.array(n), pa.nulls(len(n), pa.int64())], names)

    for batch in text_batches(batches, "text", 1_000_000):
        sets = shingler.sets(batch.column(1).to_pylist())
        keys = [set_class(s) for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keys), np.int32)), batch.column(0), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), batch.column(2)], names)
        for key, s in zip(keys, sets):
            if key is not None and key not in seen:
                seen.add(key)
                held.append(s)
                size += len(s)
        if size > TASK_SHINGLES:
            yield repeated()
            size = 0
    if held:
        yield repeated()


def histogram(s: np.ndarray) -> bytes:
    """Whether a set's counts by the last bits of a scrambled hash are odd, one bit each, four to eight buckets a shingle.

    The number of buckets is a power of two of at least FOLD_BITS; half as many are had by xor of both halves.
    """
    n = max(FOLD_BITS, 1 << (int(len(s)).bit_length() + 2))
    h = ((s * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(24)) & np.uint64(n - 1)
    return np.packbits((np.bincount(h.astype(np.int64), minlength=n) & 1).astype(bool)).tobytes()


def _folded(x: bytes, size: int) -> np.ndarray:
    """The same parities by fewer buckets, ``size`` bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), 0).view(np.uint64)


def _may_link(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """Suffix filter: two sets differ in at least one shingle for each bucket in which their parities do."""
    size = min(len(x), len(y))
    return n + m - int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) >= 2 * least_overlap(n, m, percent)


def _prefixes(batches, words: int, percent: int, frequent: np.ndarray, level: np.ndarray):
    """Prefix rows (h, cls, pos, n) of each class, and one row (null, cls, null, n, histogram, histogram of FOLD_BITS)."""
    shingler, seen = Shingler(words), set()
    names = ["h", "cls", "pos", "n", "hist", "fold"]
    for batch in text_batches(batches, "text", 1_000_000):
        hs, sizes, card = [], [], []
        for s in shingler.sets(batch.column(1).to_pylist()):
            key = set_class(s)
            if key is None or key in seen:
                continue
            seen.add(key)
            n = len(s)
            order = s
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                known = frequent[at] == s
                if known.any():
                    order = s[np.argsort(np.where(known, level[at], 0), kind="stable")]
            p = prefix_length(n, percent)
            hs.append(order[:p])
            sizes.append(p)
            card.append((key, n, histogram(s)))
        if card:
            h = np.concatenate(hs).view(np.int64)
            k, n, x = zip(*card)
            first = np.cumsum(sizes) - sizes
            pos = (np.arange(len(h)) - np.repeat(first, sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(np.array(k, np.int64), sizes)), pa.array(pos), pa.array(np.repeat(np.array(n, np.int32), sizes)), pa.nulls(len(h), pa.binary()), pa.nulls(len(h), pa.binary())], names)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.int64()), pa.array(k, pa.int64()), pa.nulls(len(k), pa.int32()), pa.array(n, pa.int32()), pa.array(x, pa.binary()), pa.array([_folded(v, FOLD_BITS // 8).tobytes() for v in x], pa.binary())], names)


def _candidates(batches, percent: int, star: bool):
    """Pairs (a, b) of a unit that pass the filters: with the pivot only, or all of different roots."""
    for t, cuts in units(batches, ["h", "i", "j"]):
        col = {k: t.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in ("cls", "pos", "n", "root", "part", "i", "j")}
        if not star:
            col["fold"] = np.frombuffer(b"".join(t.column("fold").to_pylist()), np.uint64).reshape(len(t), -1)
        ends = np.unique(np.concatenate([cuts, [len(t)]]))
        starts = np.concatenate([[0], ends[:-1]])
        size = ends - starts
        left, right = [starts[size == 2]], [starts[size == 2] + 1]
        for a, b in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
            if star:
                first = a + np.lexsort((col["cls"][a:b], col["pos"][a:b]))[0]
                left.append(np.full(b - a, first))
                right.append(np.arange(a, b))
            else:
                rows = np.arange(a, b)
                across = col["i"][a] != col["j"][a]
                x, y = rows, rows
                if across:  # two parts of a long list: each row of one with each of the other
                    x, y = rows[col["part"][a:b] == col["i"][a]], rows[col["part"][a:b] == col["j"][a]]
                for block in range(0, len(x), 64):
                    gx, gy = np.meshgrid(x[block : block + 64], y, indexing="ij")
                    gx, gy = gx.ravel(), gy.ravel()
                    ok = (gx < gy) | across
                    gx, gy = _passing(col, gx[ok], gy[ok], percent)
                    left.append(gx)
                    right.append(gy)
        x, y = _passing(col, np.concatenate(left), np.concatenate(right), percent)
        if len(x):
            pair = np.stack([np.minimum(col["cls"][x], col["cls"][y]), np.maximum(col["cls"][x], col["cls"][y])], 1)
            pair = np.unique(pair, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])


def _passing(col: dict, x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Length filter; positional filter, as if the shared shingle were the first (it is so in one list of every linked pair); suffix filter, if rows carry parities."""
    n, m = col["n"][x].astype(np.int64), col["n"][y].astype(np.int64)
    ok = (col["root"][x] != col["root"][y]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    least = least_overlap(n, m, percent)
    ok &= np.minimum(n - col["pos"][x], m - col["pos"][y]) >= least
    x, y = x[ok], y[ok]
    if "fold" in col:
        differ = np.bitwise_count(col["fold"][x] ^ col["fold"][y]).sum(1, dtype=np.int64)
        ok = (n + m)[ok] - differ >= 2 * least[ok]
        x, y = x[ok], y[ok]
    return x, y


def _filtered(batches, percent: int):
    for batch in batches:
        rows = [batch.column(k).to_pylist() for k in range(2, 6)]
        ok = np.array([_may_link(x, y, n, m, percent) for n, m, x, y in zip(*rows)], bool)
        keep = pa.array(np.flatnonzero(ok))
        yield pa.RecordBatch.from_arrays([batch.column(k).take(keep) for k in (0, 1, 6)], ["a", "b", "salt"])
    give_back()


def _wanted_sets(batches, words: int, bits: np.ndarray):
    """(cls, set) of documents whose id the filter holds, and of those without an id; once a task."""
    shingler, seen = Shingler(words), set()
    for batch in text_batches(batches, "text", 1_000_000):
        docs = batch.column(0)
        ids = np.asarray(docs.fill_null(0), dtype=np.int64)
        want = (bits[(ids & (FILTER_BITS - 1)) >> 3] >> (ids & 7) & 1).astype(bool) | np.asarray(docs.is_null())
        texts = [batch.column(1)[int(i)].as_py() for i in np.flatnonzero(want)]
        rows = [(k, s.tobytes()) for s in shingler.sets(texts) if (k := set_class(s)) is not None and not (k in seen or seen.add(k))]
        if rows:
            k, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.binary())], ["cls", "shingles"])


def _verify(batches, percent: int):
    """Links (u, v) from rows (a, salt, b, shingles) sorted by a and salt, in which a's own set comes first (b is null)."""
    own, of = None, None
    for batch in batches:
        us, vs = [], []
        for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            s = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
            if b is None:
                own, of = s.copy(), a
                continue
            assert of == a, "a pair without its set"
            x, y = (own, s) if len(own) < len(s) else (s, own)
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if 100 * common >= percent * (len(x) + len(y) - common):
                us.append(a)
                vs.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
    give_back()


class JaccardJoin:
    """The join's stages over one input; see :func:`near_duplicates`."""

    def __init__(self, docs: DataFrame, words: int = WORDS, percent: int = PERCENT):
        self.docs = long_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.words, self.percent, self.spark = words, percent, docs.sparkSession
        self.work = WorkFolder(self.spark, "jaccard")

    def run(self) -> DataFrame:
        """(doc_id, text_key, n_shingles, cls, root, copies) of every row; cls and root are null without shingles."""
        words, percent, work = self.words, self.percent, self.work
        keyed = self.docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
        profiles = work.put("profiles", keyed.mapInArrow(lambda it: _profiles(it, words), "kind int, a long, b long, c long, d long"))
        self.members = profiles.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("d").alias("text_key"), F.col("b").alias("cls"), F.col("c").alias("n_shingles"))
        sent = self.spark.sparkContext.broadcast(self._frequent(profiles))
        prefixes = work.put("prefixes", self.docs.mapInArrow(lambda it: _prefixes(it, words, percent, *sent.value), "h long, cls long, pos int, n int, hist binary, fold binary"))
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
        classes = work.put("classes", self.members.where("cls IS NOT NULL").groupBy("cls").agg(least, F.count("*").alias("copies")))
        self.ids = classes.select("cls", F.col("first.doc_id").alias("first_doc"))

        rows = prefixes.where("h IS NOT NULL").select("h", "cls", "pos", "n")
        shared = rows.groupBy("h").agg(F.count("*").alias("m"), F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("h", "m")
        shared = work.put("shared", shared)
        n_rows = shared.agg(F.sum("m")).first()[0] or 0
        lists = spread_join(rows, shared, "h", "m", n_rows).dropDuplicates(["h", "cls"])
        lists = work.put("lists", lists.withColumn("parts", F.ceil(F.col("m") / UNIT).cast("int")).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).drop("m"))
        self.cards = prefixes.where("h IS NULL").select("cls", "n", "hist", "fold")

        # first round: with the pivot of each part of a list, then the pivots of a list's parts
        stars = lists.withColumn("i", F.col("part")).withColumn("j", F.col("part")).withColumn("root", F.col("cls"))
        pivots = stars.where("parts > 1").withColumn("k", F.row_number().over(W.partitionBy("h", "part").orderBy("pos", "cls"))).where("k = 1").drop("k").withColumn("i", F.lit(-1)).withColumn("j", F.lit(-1))
        pairs = self._pairs(stars.unionByName(pivots), True)
        first = self._links("first", pairs)
        roots = components(first, "jaccard-roots")

        # second round: what is left, between different roots of one list
        left = lists.select("h", "cls", "pos", "n").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        units = self._apart(work.put("rooted", left), n_rows)
        second = self._links("second", self._pairs(units, False))
        work.drop("prefixes", "lists", "shared", "rooted", "large", "groups")
        roots = components(first.unionAll(second), "jaccard-components")
        self.owner = work.put("owner", classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
        #: one row a component: its first row, and how many classes it has
        self.least = work.put("least", self.owner.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("classes")))
        return self.members

    def found(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        members = self.run()
        n_classes = self.owner.count()
        component = spread_join(self.owner.select("cls", "root", "copies"), self.least.select("root", F.col("first.doc_id").alias("component_id"), "classes"), "root", "classes", n_classes)
        component = self.work.put("component", component.select("cls", "component_id", "copies"))
        some = spread_join(members.where("cls IS NOT NULL"), component, "cls", "copies", members.count())
        alone = members.where("cls IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return some.select("doc_id", "n_shingles", "component_id").unionAll(alone)

    def _frequent(self, profiles: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """At most FREQUENT shingles by count, ascending by hash, and eighths of the logarithm of their counts.

        Only an order: any order of shingles gives the same links.
        """
        counts = profiles.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n"))
        by_size = {r["k"]: r["m"] for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("m")).collect()}
        total, least = 0, 62
        while least > 0 and total + by_size.get(least - 1, 0) <= FREQUENT:
            least -= 1
            total += by_size.get(least, 0)
        got = counts.where(F.col("n") >= 2**least).toArrow()
        h = got.column("a").to_numpy().view(np.uint64)
        n = got.column("n").to_numpy()
        order = np.argsort(h)
        return h[order], np.minimum(8 * np.log2(np.maximum(n[order], 2)), 255).astype(np.uint8)

    def _pairs(self, units: DataFrame, star: bool) -> DataFrame:
        percent = self.percent
        units = units.select("h", "i", "j", "cls", "pos", "n", "root", "part", *([] if star else ["fold"])).repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
        return units.mapInArrow(lambda it: _candidates(it, percent, star), "a long, b long").distinct()

    def _apart(self, rows: DataFrame, total: int) -> DataFrame:
        """Units (i, j) of bins of a list's rows whose classes are of different roots.

        A root with over UNIT rows in a list has bins of its own, which never meet one another;
        the list's other rows share bins, which meet all. So a list of one large group and a
        few strangers costs its rows once for every bin of strangers.
        """
        rows = rows.withColumn("hr", F.struct("h", "root"))
        large = self.work.put("large", rows.groupBy("hr").agg(F.count("*").alias("k")).where(F.col("k") > UNIT))
        rows = rows.withColumn("k", F.lit(None).cast("long")) if large.isEmpty() else spread_join(rows, large, "hr", "k", total, "left")
        rows = rows.withColumn("hg", F.struct("h", F.col("k").isNotNull().alias("own"), F.when(F.col("k").isNotNull(), F.col("root")).otherwise(0).alias("of"))).drop("hr", "k")
        groups = rows.groupBy("hg").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).withColumn("bins", F.ceil(F.col("c") / UNIT).cast("int"))
        of_list = W.partitionBy("hg.h")
        groups = groups.withColumns({"first": (F.sum("bins").over(of_list.orderBy("hg.own", "hg.of").rowsBetween(W.unboundedPreceding, 0)) - F.col("bins")).cast("int"), "all": F.sum("bins").over(of_list).cast("int"), "least": F.min("low").over(of_list), "most": F.max("high").over(of_list)})
        groups = self.work.put("groups", groups.where("least <> most").select("hg", "c", "bins", "first", "all"))
        rows = spread_join(rows, groups, "hg", "c", total).join(self.cards.select("cls", "fold").dropDuplicates(["cls"]), "cls")
        rows = rows.withColumn("part", F.col("first") + F.pmod(F.xxhash64("cls"), F.col("bins")).cast("int"))
        others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda b: ~(F.col("hg.own") & (b >= F.col("first")) & (b < F.col("first") + F.col("bins"))))
        met = rows.withColumn("other", F.explode(others))
        return met.select("h", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "cls", "pos", "n", "root", "part", "fold")

    def _dealt(self, name: str, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b, salt) with the busier class as ``a``, and a table of hubs (node, parts): at most about HUB pairs an (a, salt)."""
        ends = F.explode(F.array("a", "b")).alias("node")
        hubs = pairs.select(ends).groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > HUB)
        hubs = self.work.put(f"{name}-hubs", hubs.select("node", F.ceil(F.col("n") / HUB).cast("int").alias("parts"), "n"))
        few = hubs.count() <= BROADCAST_HUBS
        small, total = F.broadcast if few else (lambda df: df), 0 if few else pairs.count()
        side = lambda c: hubs.select(F.col("node").alias(c), F.col("parts").alias(f"{c}_parts"), F.col("n").alias("at_hub"))
        parts = lambda df, c: (df.join(small(side(c)), c, "left") if few else spread_join(df, side(c), c, "at_hub", total, "left")).drop("at_hub")
        both = parts(parts(pairs, "a"), "b").na.fill(1, ["a_parts", "b_parts"])
        hubs = hubs.drop("n")
        swap = F.col("b_parts") > F.col("a_parts")
        both = both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest("a_parts", "b_parts").alias("parts"))
        return both.select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt")), small(hubs)

    @staticmethod
    def _salted(rows: DataFrame, hubs: DataFrame, key: str) -> DataFrame:
        """``rows`` (one a class) once for every salt of its class."""
        rows = rows.join(hubs.withColumnRenamed("node", key), key, "left")
        return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    def _links(self, name: str, pairs: DataFrame) -> DataFrame:
        """Bound each pair by parities, then verify it once on whole sets, made anew for the documents that need it."""
        words, percent, work = self.words, self.percent, self.work
        pairs, hubs = self._dealt(name, work.put(f"{name}-candidates", pairs))
        card = lambda side, n, x: self.cards.select(F.col("cls").alias(side), F.col("n").alias(n), F.col("hist").alias(x)).dropDuplicates([side])
        both = pairs.join(self._salted(card("a", "n", "x"), hubs, "a"), ["a", "salt"]).join(card("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y", "salt")
        pairs = work.put(f"{name}-pairs", both.mapInArrow(lambda it: _filtered(it, percent), "a long, b long, salt int"))
        work.drop(f"{name}-candidates")
        wanted = pairs.select("a").distinct().unionAll(pairs.select("b").distinct()).select(F.col("a").alias("cls")).distinct()
        ids = wanted.join(self.ids, "cls").select((F.pmod("first_doc", F.lit(FILTER_BITS)) + 1).alias("bit"))
        bits = bitmap(ids, FILTER_BITS)
        sent = self.spark.sparkContext.broadcast(bits)
        sets = self.docs.mapInArrow(lambda it: _wanted_sets(it, words, sent.value), "cls long, shingles binary").join(wanted, "cls", "left_semi").dropDuplicates(["cls"])
        sets = work.put(f"{name}-sets", sets)
        others = pairs.join(sets.select(F.col("cls").alias("b"), "shingles"), "b").select("a", "salt", "b", "shingles")
        owners = self._salted(sets.select(F.col("cls").alias("a"), "shingles"), hubs, "a").join(pairs.select("a", "salt").distinct(), ["a", "salt"], "left_semi")
        rows = others.unionAll(owners.select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles"))
        rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        links = work.put(f"{name}-links", rows.mapInArrow(lambda it: _verify(it, percent), "u long, v long"))
        work.drop(f"{name}-sets", f"{name}-pairs", f"{name}-hubs")
        return links


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Two documents link when their sets of ``words``-word shingles have a Jaccard similarity
    of at least ``percent`` / 100; component_id is the smallest id reachable by links. Fewer
    words make one shingle; null, empty and blank texts have none and stand alone. Texts of any
    length are read whole. Repeated rows come back as often as they came. A null id never is a
    component_id: a component of such rows alone has a null one. An empty table gives an empty
    result; further columns are passed over.
    """
    return JaccardJoin(docs, words, percent).found()


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all columns: the least by id (null ids last), then by the text's hash.

    Rows whose texts have no words are in no component and all stay. Rows equal in id and text
    are one document; of such rows that differ in other columns any one may stay. Rows of one id
    and different texts are different documents.
    """
    join = JaccardJoin(docs, words, percent)
    members = join.run()
    key, one = fresh(docs.columns, "near_key", "near_id")
    kept = join.least.select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"))
    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["text_key"] == y["text_key"])
    times = members.where("cls IS NOT NULL").groupBy("doc_id", "text_key").agg(F.count("*").alias("times"))
    many = join.work.put("many", times.where("times > 1").alias("m").join(kept.alias("k"), same({c: F.col(f"m.{c}") for c in ("doc_id", "text_key")}, {c: F.col(f"k.{c}") for c in ("doc_id", "text_key")}), "left_semi").drop("times"))
    wordy = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.withColumn(key, F.xxhash64(F.col("text").cast("string"))).withColumn(one, F.col("doc_id").cast("long"))
    # a row on so many rows is made one where it is read, before any join by its key
    bar = HOT_SHARE * members.count()
    crowd = join.work.put("crowd", times.where(F.col("times") > bar).select("doc_id", "text_key"))

    def among(df: DataFrame, these: DataFrame, how: str) -> DataFrame:
        return df.join(these.select(F.col("doc_id").alias(f"{one}_"), F.col("text_key").alias(f"{key}_")), F.col(one).eqNullSafe(F.col(f"{one}_")) & (F.col(key) == F.col(f"{key}_")), how)

    some = rows.where(wordy)
    if not crowd.isEmpty():
        of = F.broadcast(crowd)  # at most 1 / HOT_SHARE rows
        some = among(some, of, "left_anti").unionAll(among(some, of, "left_semi").dropDuplicates([one, key]))
    some = among(some, kept, "left_semi")
    if not many.isEmpty():
        some = among(some, many, "left_anti").unionAll(among(some, many, "left_semi").dropDuplicates([one, key]))
    return some.unionAll(rows.where(~wordy)).select([F.col(quoted(c)) for c in docs.columns])


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle meet, so this is for small tables.
OP9_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= {PERCENT} * (a.n + b.n - i)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
c(doc_id, least_id) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.v, c.least_id FROM c JOIN e ON e.u = c.doc_id WHERE c.least_id < e.v)
SELECT n.doc_id, n.n AS n_shingles, min(c.least_id) AS component_id FROM n JOIN c USING (doc_id) GROUP BY 1, 2
"""
