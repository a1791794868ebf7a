"""Maximal periodic runs of words: suffix array, longest previous factors, blocks, and runs from blocks.

All arrays of a batch of texts are one: a word's number belongs to its text, so that nothing matches
across texts.
"""

from __future__ import annotations

import hashlib
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Ids, long_rows, quoted, table, text_batches

MIN_LENGTH = 12
#: Characters of texts whose arrays are made together.
SLICE = 2_000_000


def names(ids: np.ndarray, most: int = 64) -> list[np.ndarray]:
    """Level k: the rank of the 2^k words from each place among all such windows (shorter at the end), until all differ
    or ``most`` levels are there.

    Prefix doubling; each level sorts only the places that still share their rank. The last
    level is the inverse suffix array.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    edge = np.flatnonzero(np.diff(ids[order], prepend=-1))
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(edge, np.diff(np.append(edge, n)))
    levels, step = [rank], 1
    size = np.bincount(rank, minlength=n)
    open_ = np.flatnonzero(size[rank] > 1)
    while len(open_) and len(levels) < most:
        ahead = np.where(open_ + step < n, rank[np.minimum(open_ + step, n - 1)], -1).astype(np.int64)
        key = rank[open_].astype(np.int64) * (n + 1) + ahead + 1
        order = np.argsort(key, kind="stable")
        key, place = key[order], open_[order]
        old = key // (n + 1)
        first = np.diff(key, prepend=-1) != 0
        group = np.diff(old, prepend=-1) != 0
        count = np.arange(len(key))
        within = np.maximum.accumulate(np.where(first, count, 0)) - np.maximum.accumulate(np.where(group, count, 0))
        rank = rank.copy()
        rank[place] = old + within
        levels.append(rank)
        size = np.bincount(rank[place], minlength=n)
        open_ = np.sort(place[size[rank[place]] > 1])
        step *= 2
    return levels


def common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """Words that agree from places ``i < j`` on, or (``back``) before them."""
    n = len(levels[0])
    i, j = i.astype(np.int64), j.astype(np.int64)
    out = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        w = 1 << k
        # windows that the end cuts short never agree: the one at i is longer
        a, b = (i - out - w, j - out - w) if back else (i + out, j + out)
        inside = (a >= 0) if back else (b + w <= n)
        out += w * (inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)]))
    return out


def previous_factors(levels: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """For each place the longest factor from it that also begins earlier, and where.

    Along the suffix array, the nearest earlier-beginning suffix on either side; their common
    prefixes are least LCP values on the way, kept on a stack.
    """
    rank = levels[-1]
    n = len(rank)
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    lcp = np.zeros(n + 1, np.int64)
    if n > 1:
        a, b = np.minimum(suffix[:-1], suffix[1:]), np.maximum(suffix[:-1], suffix[1:])
        lcp[1:n] = common(levels, a, b)
    length, source = [0] * n, [0] * n
    stack, least = [-1], [0]  # places, and the LCP of each with what stands below it
    for place, shared in zip([*suffix.tolist(), -1], lcp.tolist()):
        while stack[-1] > place:
            top, below = stack.pop(), least.pop()
            # the nearest lesser place before and after
            if below >= shared:
                length[top], source[top] = below, stack[-1]
            else:
                length[top], source[top] = shared, place
            shared = min(shared, below)
        stack.append(place)
        least.append(shared)
    return length, source


def blocks(length: list[int]) -> list[int]:
    """Where the blocks of the factorisation begin: each the longest factor that occurred before, or one new word."""
    starts, k, n = [], 0, len(length)
    while k < n:
        starts.append(k)
        k += length[k] or 1
    return starts


def runs(ids: np.ndarray, least: int = MIN_LENGTH) -> np.ndarray:
    """(start, end, smallest period) of all maximal runs of at least ``max(least, 2 * period)`` words, by start, then period.

    A run that touches the beginning of a block is found there from two places a period apart,
    by how far they agree on and back; one inside a block is a copy of an earlier one.
    """
    n = len(ids)
    if n < least:
        return np.empty((0, 3), np.int64)
    levels = names(ids)
    length, source = previous_factors(levels)
    starts = blocks(length)
    b = np.array([*starts, n], np.int64)
    size = np.append(np.diff(b), 0)
    prior = np.append(0, size[:-1])
    # period: up to the block's size to the right, below both blocks' to the left
    reach = np.concatenate([size, size + prior])
    at = np.concatenate([b, b])
    left = np.repeat([False, True], len(b))
    found = []
    half = -(-least // 2)
    many = np.cumsum(reach)
    for lo, hi in _parts(many, 1 << 20):
        r = reach[lo:hi]
        q = np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r) + 1
        i = np.repeat(at[lo:hi], r) - np.where(np.repeat(left[lo:hi], r), q, 0)
        ok = (i >= 0) & (i + q < n + 1)
        i, q = i[ok], q[ok]
        # the two places agree on at least half / 2 words on or back
        k = max(0, (half // 2).bit_length() - 1)
        w, name = 1 << min(k, len(levels) - 1), levels[min(k, len(levels) - 1)]
        on = (i + q + w <= n) & (name[np.minimum(i, n - 1)] == name[np.minimum(i + q, n - 1)])
        back = (i >= w) & (name[np.maximum(i - w, 0)] == name[np.clip(i + q - w, 0, n - 1)])
        i, q = i[on | back], q[on | back]
        ahead, behind = common(levels, i, i + q), common(levels, i, i + q, True)
        good = (ahead + behind >= q) & (ahead + behind + q >= least)
        found.append(np.stack([i - behind, i + q + ahead, q], 1)[good])
    all_ = _smallest(np.concatenate(found))
    deep = np.flatnonzero(size > least + 1).tolist()
    if deep and len(all_):
        all_ = _copied(all_, [(starts[k], int(size[k]), source[starts[k]]) for k in deep])
    return all_


def _parts(many: np.ndarray, step: int):
    cuts = np.searchsorted(many, np.arange(step, many[-1] if len(many) else 0, step))
    edges = np.unique([0, *cuts, len(many)])
    return zip(edges[:-1].tolist(), edges[1:].tolist())


def _smallest(rows: np.ndarray) -> np.ndarray:
    """One row a stretch, with its smallest period, by start, then period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _copied(rows: np.ndarray, deep: list[tuple[int, int, int]]) -> np.ndarray:
    """Adds the runs strictly inside each block, copied from its source in order of their start.

    Buckets by start; a source may reach into its own block, whose copies are then in the bucket already.
    """
    from bisect import bisect_right, insort

    held = sorted(map(tuple, rows.tolist()))
    for start, size, source in deep:
        shift, end = start - source, source + size
        k = bisect_right(held, (source + 1,))
        while k < len(held) and held[k][0] < end:
            s, e, q = held[k]
            if e < end:
                copy = (s + shift, e + shift, q)
                place = bisect_right(held, copy)
                if not place or held[place - 1] != copy:
                    insort(held, copy)
            k += 1
    return _smallest(np.array(held, np.int64))


def may_have_runs(ids: np.ndarray, offsets: np.ndarray, least: int = MIN_LENGTH) -> np.ndarray:
    """Numbers of the texts in which some ``least / 2`` words occur twice, as they do in every run."""
    half = -(-least // 2)
    most = max(1, half.bit_length())
    levels = names(ids, most)
    if len(levels) < most or len(ids) <= half:
        return np.empty(0, np.int64)
    rank, skip = levels[-1].astype(np.int64), half - (1 << (most - 1))
    place = np.flatnonzero(np.bincount(rank, minlength=len(ids))[rank] > 1)
    place = place[place + skip < len(ids)]
    key = rank[place] * len(ids) + rank[place + skip]
    order = np.argsort(key)
    same = np.flatnonzero(np.diff(key[order]) == 0)
    return np.unique(np.searchsorted(offsets, place[order[same]], "right") - 1)


def rewritten(doc_id, n: int) -> np.ndarray | None:
    """Which word stands at each place once the tail of every tenth text repeats; None if it stays as it is."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def _digest(words: list[bytes], place: np.ndarray | None, found: np.ndarray) -> tuple:
    """The query's columns of one text from its runs."""
    longest = (None,) * 4
    if len(found):
        s, e, q = max(found.tolist(), key=lambda r: (r[1] - r[0], -r[0], -r[2]))
        longest = (s, e - s, q, 1000 * (e - s) // q)
        drops = np.zeros(len(words) + 1, np.int64)
        np.add.at(drops, found[:, 0] + found[:, 2], 1)
        np.add.at(drops, found[:, 1], -1)
        kept = np.flatnonzero(np.cumsum(drops[:-1]) == 0)
        place = kept if place is None else place[kept]
    text = words if place is None else [words[k] for k in place.tolist()]
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in found.tolist())
    return (len(found), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(text)).hexdigest())


_SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_LENGTH, rewrite: bool = False) -> DataFrame:
    """(doc_id, n_runs, the longest run, digests of all runs and of the text without repetitions), one row a document.

    A run is a stretch of at least ``max(least, 2 * period)`` words, which no neighbour extends;
    ``rewrite`` first makes the tails of some texts periodic (:func:`rewritten`; a text of null
    id stays as it is). Null, empty and blank texts have no words and no run, equal texts of one
    id equal rows, repeated rows a row each; other columns are ignored whatever their names; an
    empty table gives an empty result. A text is worked on as a whole in one task, at about 300 bytes a word.
    """

    def each(batches):
        for batch in text_batches(batches, "text", SLICE):
            keys = batch.column("key").to_pylist()
            texts = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in batch.column("text").to_pylist()]
            places = [rewritten(i, len(w)) if rewrite else None for i, w in zip(keys, texts)]
            numbers, flat = Ids(), []
            for words, place in zip(texts, places):
                got = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                flat.append(got if place is None else got[place])
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            offsets = np.append(0, np.cumsum(size))
            ids = np.concatenate(flat) + np.repeat(np.arange(len(texts)), size) * len(numbers)
            some = may_have_runs(ids, offsets[:-1], least)
            found = {}
            if len(some):
                found_in = runs(np.concatenate([ids[offsets[k] : offsets[k + 1]] for k in some]), least)
                first = np.cumsum(size[some]) - size[some]
                of = np.searchsorted(first, found_in[:, 0], "right") - 1
                for k, (a, b) in enumerate(zip(np.searchsorted(of, np.arange(len(some))), np.searchsorted(of, np.arange(len(some)), "right"))):
                    found[int(some[k])] = found_in[a:b] - np.array([first[k], first[k], 0])
            none = np.empty((0, 3), np.int64)
            rows = [_digest(w, p, found.get(k, none)) for k, (w, p) in enumerate(zip(texts, places))]
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=["id", *(f.split()[0] for f in _SCHEMA.split(", "))])

    rows = long_rows(docs).select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(doc_id)).cast("string").alias("key"), F.col(quoted(text)).alias("text"))
    out = rows.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, {_SCHEMA}")
    return out.withColumnRenamed("id", doc_id)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(table(spark, sf_dir, "documents"), rewrite=True)
