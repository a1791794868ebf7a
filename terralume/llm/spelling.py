"""Spelling variants: words one edit apart, found through intact halves by Aho-Corasick automata.

Of two words one edit apart, one half of the shorter (of either, if equally long) stands intact
in the other, at its beginning or at its end. Automaton shards hold the halves, all words are scanned; a hit
counts if its offset and the lengths fit, and the other half is then compared.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WorkFolder, long_rows, quoted, table, text_batches

MIN_LENGTH, MIN_COUNT, FORM_FACTOR = 7, 2, 10
#: One deletion in so many (document, run) pairs.
DELETE_EVERY = 31
#: Halves of an automaton shard; candidate pairs compared at once.
SHARD, PAIRS = 20_000, 1 << 19
#: Distinct words a task counts before it hands them on.
FLUSH = 150_000

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_OTHER_LEADS = bytes(b for b in range(256) if b < 128 or 128 <= b <= 0xBF or b == 0xC3)


def runs(text: str | None) -> list[bytes]:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` as UTF-8, A-Z lower-cased."""
    raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
    if raw.translate(None, _OTHER_LEADS):  # has characters of two bytes other than U+00C0 to U+00FF, or longer ones
        return _RUN.findall(raw)
    return raw.translate(_LETTERS).split()


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n): how often each word of at least ``min_length`` code points occurs.

    A run whose crc32 of ``<doc_id>:<run>`` is divisible by :data:`DELETE_EVERY` loses one code
    point. A null id reads as no text before the colon; a null text has no runs.
    """

    def each(batches):
        total: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in text_batches(batches, "text", 1_000_000):
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                of = crc32(f"{'' if i is None else i}:".encode())
                # shorter runs cannot make a word, in bytes or in code points
                for w, n in Counter([w for w in runs(t) if len(w) >= min_length]).items():
                    h = crc32(w, of)
                    if h % DELETE_EVERY == 0:
                        s = w.decode()
                        k = h % len(s)
                        w = (s[:k] + s[k + 1 :]).encode()
                    total[w] += n
            if len(total) > FLUSH:
                yield rows()
        yield rows()

    rows = long_rows(docs).select(F.col(quoted(doc_id)).cast("string").alias("id"), F.col(quoted(text)).alias("text"))
    counts = rows.mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.length("word") >= min_length)


def one_edit(w: bytes, x: bytes) -> bool:
    """Whether one insertion, deletion or replacement, and no less, makes one of the other."""
    if len(w) > len(x):
        w, x = x, w
    if len(x) - len(w) > 1 or w == x:
        return False
    k = next((i for i in range(len(w)) if w[i] != x[i]), len(w))
    return w[k + (len(w) == len(x)) :] == x[k + 1 :]


def _pack(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to 8 bytes from each place as one number, the first byte lowest."""
    cells = buf[at[:, None] + np.arange(8)]
    cells[np.arange(8) >= size[:, None]] = 0
    return np.ascontiguousarray(cells).view("<u8").ravel()


def _rest_differs_once(a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Packed bytes one replacement apart, or (``longer``) ``b`` being ``a`` with one byte inserted."""
    low7 = np.uint64(0x7F7F7F7F7F7F7F7F)
    d = a ^ b
    top = (((d & low7) + low7) | d) & ~low7  # the top bit of every byte that differs
    first = top & (~top + np.uint64(1))
    upto = (first << np.uint64(1)) - np.uint64(1)  # all bytes up to the first that differs
    inserted = ((a & ~(upto >> np.uint64(8))) << np.uint64(8)) == (b & ~upto)
    return np.where(longer, inserted, (top == first) & (top != 0))


class Shard:
    """Words by their halves: an automaton of the halves, and for each half and word length the words."""

    def __init__(self, words: list[bytes], at_end: list[bool]):
        import ahocorasick

        length = np.fromiter(map(len, words), np.int64, len(words))
        half = length // 2
        self.words, self.end = words, np.array(at_end, bool)
        numbers: dict[str, int] = {}
        key = np.empty(len(words), np.int64)
        for k, (w, h, e) in enumerate(zip(words, half.tolist(), at_end)):
            key[k] = numbers.setdefault((w[h:] if e else w[:h]).decode("latin-1"), len(numbers))
        group = (key * 2 + self.end) * (int(length.max(initial=0)) + 1) + length
        self.order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[self.order], prepend=-1))
        last = np.append(first[1:], len(words))
        rows = self.order[first]
        self.groups = {(int(key[r]), bool(self.end[r]), int(length[r])): (int(a), int(b)) for r, a, b in zip(rows, first, last)}
        self.automaton = ahocorasick.Automaton()
        for s, k in numbers.items():
            self.automaton.add_word(s, (k, len(s)))
        self.automaton.make_automaton()
        # the half that is not in the automaton
        buf = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
        start = np.cumsum(length) - length
        size = np.where(self.end, half, length - half)
        self.rest = _pack(buf, np.where(self.end, start, start + half), size)
        self.long = size > 7
        self.half = half

    def scan(self, words: list[bytes], at_end: list[bool]):
        """Pairs (number here, number in ``words``) one edit apart, the one here the shorter or the lesser; arrays, each pair once."""
        lo, hi, row, longer, half = [], [], [], [], []
        for r, (w, e) in enumerate(zip(words, at_end)):
            n = len(w)
            for end, (k, size) in self.automaton.iter(w.decode("latin-1")):
                if (end != n - 1) if e else (end != size - 1):
                    continue  # the half must stand at this word's end, or at its beginning
                for length in (n - 1, n):
                    if (length - length // 2 if e else length // 2) == size and (g := self.groups.get((k, e, length))):
                        lo.append(g[0])
                        hi.append(g[1])
                        row.append(r)
                        longer.append(length < n)
                        half.append(length // 2)
        if not row:
            return
        lo, hi, row, longer, half = (np.array(x, np.int64) for x in (lo, hi, row, longer, half))
        length = np.fromiter(map(len, words), np.int64, len(words))
        start = (np.cumsum(length) - length)[row]
        end = np.array(at_end, bool)[row]
        buf = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
        size = np.where(end, half + longer, length[row] - half)
        rest = _pack(buf, np.where(end, start, start + half), np.minimum(size, 8))
        many = np.cumsum(hi - lo)
        cuts = np.searchsorted(many, np.arange(PAIRS, many[-1], PAIRS))
        for a, b in zip([0, *cuts], [*cuts, len(row)]):
            n = hi[a:b] - lo[a:b]
            hit = np.repeat(np.arange(a, b), n)
            here = self.order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo[a:b], n)]
            long_ = self.long[here] | (size[hit] > 8)
            near = _rest_differs_once(self.rest[here], rest[hit], longer[hit].astype(bool))
            for p in np.flatnonzero(long_):
                near[p] = one_edit(self.words[here[p]], words[row[hit[p]]])
            here, hit = here[near], hit[near]
            keep = np.ones(len(here), bool)
            for p, (i, j) in enumerate(zip(here.tolist(), row[hit].tolist())):
                w, x = self.words[i], words[j]
                h = len(w) // 2
                # equal lengths meet twice; a longer word that has both halves is found by its beginning
                keep[p] = w < x if len(w) == len(x) else not (at_end[j] and x[:h] == w[:h])
            yield here[keep], row[hit[keep]]


def _scan(batches):
    """Near words of the units of a partition: rows of a unit come shard first, then the scanned words."""
    names = ["word", "n", "near", "near_n"]
    unit, held, shard = None, [], None
    for batch in batches:
        units = np.asarray(batch.column("unit"))
        cuts = np.flatnonzero(np.diff(units)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(units)]):
            part = batch.slice(int(a), int(b - a))
            if units[a] != unit:
                unit, held, shard = units[a], [], None
            asked = np.asarray(part.column("side"))
            rows = list(zip([w.encode("latin-1") for w in part.column("word").to_pylist()], part.column("n").to_pylist(), part.column("at_end").to_pylist()))
            told = int((asked == 0).sum())
            held += rows[:told]
            if told == len(rows):
                continue
            if shard is None:
                shard = Shard([r[0] for r in held], [r[2] for r in held])
            ask = rows[told:]
            for here, there in shard.scan([r[0] for r in ask], [r[2] for r in ask]):
                one, two = [held[k] for k in here], [ask[k] for k in there]
                left, right = [*one, *two], [*two, *one]
                columns = [pa.array([r[0].decode("latin-1") for r in left], pa.string()), pa.array([r[1] for r in left], pa.int64())]
                columns += [pa.array([r[0].decode("latin-1") for r in right], pa.string()), pa.array([r[1] for r in right], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)


def near_words(vocabulary: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words one edit apart, once.

    ``vocabulary`` has distinct words of seven code points or more up to U+00FF with their n.
    A half of three or more code points that two words share at the beginning or end means that they share
    their first or last three; words meet by these. Such a key's words make shards of about ``shard`` halves,
    each scanned by all of the key's words; keys with fewer share shards.
    """
    side = lambda take, end: F.struct(take.alias("edge"), F.lit(end).alias("at_end"))
    keyed = vocabulary.select("word", "n", F.inline(F.array(side(F.substring("word", 1, 3), False), side(F.expr("right(word, 3)"), True))))
    sizes = keyed.groupBy("edge", "at_end").agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    # at most total / shard rows
    hot = F.broadcast(sizes.where(F.col("size") > shard).select("edge", "at_end", F.ceil(F.col("size") / shard).cast("int").alias("parts")))
    keyed = keyed.join(hot, ["edge", "at_end"], "left").withColumn("own", F.col("parts").isNotNull()).withColumn("parts", F.coalesce("parts", F.lit(1)))
    buckets = max(1, -(-2 * total // shard))
    home = F.when(F.col("own"), F.xxhash64("edge", "at_end")).otherwise(F.pmod(F.xxhash64("edge", "at_end"), F.lit(buckets)))
    part = F.pmod(F.xxhash64("word"), "parts").cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    rows = keyed.withColumn("home", home).withColumn("part", part).withColumn("other", F.explode(every))
    told = rows.select(F.xxhash64("home", "own", "part", "other").alias("unit"), F.lit(0).alias("side"), "word", "n", "at_end")
    asked = rows.select(F.xxhash64("home", "own", F.col("other").alias("part"), F.col("part").alias("other")).alias("unit"), F.lit(1).alias("side"), "word", "n", "at_end")
    units = told.unionAll(asked).repartition(F.col("unit")).sortWithinPartitions("unit", "side")
    return units.mapInArrow(_scan, "word string, n long, near string, near_n long")


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of at least seven code points and ``min_count`` occurrences.

    A word's form is its near word of largest n, ties to the smallest in code-point order, if
    that has ten times its n at least. The root is reached over forms; each step has ten times
    the n, so a chain has 19 steps at most and no circle. Null and empty texts have no words, a text of any
    length is read whole, repeated rows count each, a null id reads as no text, other columns
    are ignored whatever their names, an empty table gives an empty result.
    """
    work = WorkFolder(docs.sparkSession, "spelling")
    words = work.put("words", count_words(docs, doc_id, text).where(F.col("n") >= min_count))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    takes = -F.col("best.less") >= FORM_FACTOR * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best.form")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"),
    )
    found = work.put("forms", found)
    roots, turn = found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 0
    while True:  # each turn doubles the steps taken
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = work.put(f"roots-{turn}", roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots, turn = jumped.drop("moved"), turn + 1
        if jumped.where("moved").isEmpty():
            break
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))
