"""Language model scoring: a hierarchical Pitman-Yor model with Gibbs-sampled seating.

Restaurants. A token's context is the two words before it. Every pair of words seen as a
context has a restaurant; its parent, shared by all pairs that end alike, is the restaurant
of the last word; the parent of these is the unigram restaurant, whose base is uniform over
the known words and one unknown. No context is left out or pooled with another.

Distribution. Texts are packed in blocks. A block sends its distinct (pair, word) entries,
packed, to shards by the last word of the context, so a shard has whole restaurants of words
and of all pairs under them. A word too frequent for one shard is dealt by pair, its own
restaurant then lies with the unigrams; a pair too frequent is dealt by the word that follows.
The unigram restaurant (and those of too frequent words) is dealt by the word eaten: such
dish shards sum the tables that context shards report, sample their own seats and report
probabilities back. Shards answer blocks in the order that the blocks asked. Beyond
:data:`ROUTED` shards, blocks and shards talk by way of routers, each between a share of the blocks
and a unit of neighbouring shards, so that messages grow with the power 1.5 of the input, not with its square. Only totals of
restaurants that are dealt over shards meet on the driver; their number, like all else, follows
the input, and none of it is bounded by a setting.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WorkFolder, fold, give_back, long_rows, mix64, table, text_batches

#: Characters of a block, tokens of a shard.
BLOCK_CHARS, SHARD_TOKENS = 5_000_000, 1_000_000
#: Context shards for every dish shard, and most partitions of a shuffle (of several shards each beyond that, one after another).
CONTEXTS_A_DISH_SHARD, PARTITIONS = 4, 20_000
#: Buckets of contexts by hash for every shard, to find those too frequent for one.
BUCKETS = 64
#: Most words that entries name by number instead of by hash, the frequent ones: an encoding only.
CODES = 1_000_000
#: Words are known by this many bits of a hash: among n different ones n * n / 2**49 wrongly equal pairs are to be expected.
WORD = np.uint64((1 << 48) - 1)
#: Groups of shards that answer one after another, so that not all lie in a shuffle at once; log probabilities are kept to this part of 1.
GROUPS, GRAIN = 4, 65_536
#: Most shards that blocks write to themselves; of more, a router takes the messages of some blocks to some shards, and brings the answers back.
ROUTED = 1500
#: Discounts and strengths of the unigram, word and pair restaurants.
DISCOUNT, STRENGTH = (0.6, 0.8, 0.9), (10.0, 4.0, 1.0)
#: Gibbs sweeps of the contexts before the unigrams are sampled, of the unigrams, of the contexts after it, and of these the averaged ones.
EARLY, DISH_SWEEPS, LATE, AVERAGED = 2, 3, 3, 2
#: Texts hold no blank within a word, so no word has these hashes' names.
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) & WORD for x in (b" end", b" start"))
_STIR = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------ packed arrays


def put(*arrays: np.ndarray) -> bytes:
    """Arrays as one string, each compressed by itself; integers are stored in the fewest bytes, wide ones byte by byte."""
    head, body = [len(arrays)], []
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype.itemsize > 1:
            low, top = (int(a.min()), int(a.max())) if len(a) else (0, 0)
            wide = max(1, -(-top.bit_length() // 8)) if low >= 0 else 9  # 9: as it is
        else:
            wide = 9
        if wide < 9:
            raw = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()
        else:
            raw = a.tobytes()
        small = squeeze(raw) if len(raw) > 64 else raw
        head += [ord(a.dtype.kind), a.dtype.itemsize, wide, len(a), len(small) if len(raw) > 64 else -len(raw)]
        body.append(small)
    return np.array(head, np.int64).tobytes() + b"".join(body)


def get(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 5 * n, 8).reshape(n, 5).tolist()
    at, out = 8 + 40 * n, []
    expand = zstandard.ZstdDecompressor().decompress
    for kind, size, wide, length, stored in head:
        raw = data[at : at + abs(stored)]
        at += abs(stored)
        raw = expand(raw) if stored > 0 else raw
        if wide < 9:
            whole = np.zeros((length, 8), np.uint8)
            whole[:, :wide] = np.frombuffer(raw, np.uint8).reshape(wide, length).T
            out.append(whole.view("<u8").reshape(-1).astype(np.dtype(f"{chr(kind)}{size}"), copy=False))
        else:
            out.append(np.frombuffer(raw, np.dtype(f"{chr(kind)}{size}")))
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of a rising sequence."""
    return np.diff(a, prepend=a.dtype.type(0))


def summed(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=a.dtype if a.dtype == np.uint64 else np.int64)


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting: NumPy's own way without counts or places is a hash table, several times slower here."""
    a = np.sort(a)
    return a[np.append(True, a[1:] != a[:-1])[: len(a)]]


def by_number(a: np.ndarray, n: int) -> np.ndarray:
    """Stable order of numbers below n; those of 16 bits are sorted by radix."""
    return np.argsort(a.astype(np.uint16) if n <= 1 << 16 else a, kind="stable")


def triples(a: np.ndarray, b: np.ndarray, c: np.ndarray, m: int) -> tuple[np.ndarray, ...]:
    """Sorted distinct (a, b, c), all below m, and the place of each row among them."""
    a = a.astype(np.int64, copy=False)
    if m**3 < 2**63:
        key, at = np.unique((a * m + b) * m + c, return_inverse=True)
        pair = key // m
        return pair // m, pair % m, key % m, at
    pair, p = np.unique(a * m + b, return_inverse=True)
    key, at = np.unique(p * m + c, return_inverse=True)
    pair = pair[key // m]
    return pair // m, pair % m, key % m, at


# ------------------------------------------------------------------ seating


def seat(customers: np.ndarray, mass: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after the customers of one dish sat down one after another, for many dishes at once.

    ``mass`` is (strength + discount * other tables) * parent probability: what a new table
    weighs against the k - discount * tables of the dish's own ones. The first 32 customers
    sit down one by one; later ones in groups of a 32nd of those already seated, whose
    chances hardly differ, so the steps follow the logarithm of the largest count.
    """
    tables = (customers > 0).astype(np.int64)
    active = np.flatnonzero(customers > 1)
    c, a, t = customers[active], mass[active], np.ones(len(active), np.int64)
    k = 1
    while len(active):
        group = max(1, k // 32)
        m = np.minimum(group, c - k)
        p = a / (a + k - discount * t)
        t = t + (rng.random(len(t)) < p if group == 1 else rng.binomial(m, p))
        k += group
        done = c <= k
        if done.any():
            tables[active[done]] = t[done]
            keep = ~done
            active, c, a, t = active[keep], c[keep], a[keep], t[keep]
    return tables


@dataclass
class Level:
    """Dishes in restaurants of one level: customers ``c`` and tables ``t`` of each, and the restaurant it is in.

    ``far`` are totals of restaurants that other shards have parts of, summed at a time when
    this shard's part was ``near``: since then the whole is taken to have changed by what that part has.
    """

    where: np.ndarray
    n: int
    discount: float
    strength: float
    c: np.ndarray
    t: np.ndarray = None
    far: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    near: tuple[np.ndarray, np.ndarray] | None = None
    first: np.ndarray | None = None  # the first dish of each restaurant, if they lie one after another and none is empty

    def __post_init__(self):
        if self.t is None:
            self.t = (self.c > 0).astype(np.int64)
        rises = np.diff(self.where, prepend=-1)
        if self.n and rises.min(initial=0) >= 0 and rises.max(initial=0) <= 1 and len(self.where) and self.where[-1] == self.n - 1:
            self.first = np.flatnonzero(rises)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of whole numbers by restaurant."""
        return (np.bincount(self.where, x, self.n) if self.first is None else np.add.reduceat(x, self.first)).astype(float)

    def part(self) -> tuple[np.ndarray, np.ndarray]:
        return self.sums(self.c), self.sums(self.t)

    def share(self, at: np.ndarray, c: np.ndarray, t: np.ndarray) -> None:
        """Restaurants ``at`` have these totals over all shards now."""
        self.far, self.near = (at, c, t), tuple(x[at] for x in self.part())

    def total(self, k: int) -> np.ndarray:
        """Customers (0) or tables (1) of each restaurant, over all shards."""
        x = self.sums(self.t if k else self.c)
        if self.far is not None:
            x[self.far[0]] += self.far[1 + k] - self.near[k]
        return x

    def sweep(self, parent: np.ndarray, rng: np.random.Generator) -> None:
        """Each dish gets up from its tables and sits down again, given all other seats of the sweep before."""
        t = self.total(1)
        self.t = seat(self.c, (self.strength + self.discount * np.maximum(t[self.where] - self.t, 0)) * parent, self.discount, rng)

    def predict(self, parent: np.ndarray) -> np.ndarray:
        """Predictive probability of each dish in its restaurant under the seats of now."""
        c, t = self.total(0), self.total(1)
        own = np.maximum(self.c - self.discount * self.t, 0)
        return (own + (self.strength + self.discount * t[self.where]) * parent) / (self.strength + c[self.where])


# ------------------------------------------------------------------ blocks


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts (A-Z lower-cased, null: none): their numbers one after another, how many a text has, the hash of each number.

    Arrow's ASCII white space is that of a word's definition; it finds an empty word before and after outer white space.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    size = np.diff(np.append(0, np.cumsum(full))[np.append(0, ends)])
    coded = (flat if full.all() else flat.filter(pa.array(full))).dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(flat.type) else pa.binary()).to_numpy(zero_copy_only=False)
    return coded.indices.to_numpy(zero_copy_only=False), size, np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names)) & WORD


def _blocks(batches):
    """(payload, training tokens, tokens) of slices of the texts."""
    for batch in text_batches(batches, "text", BLOCK_CHARS):
        flat, size, hashes = _words(batch.column(1))
        train = np.asarray(batch.column(2)).astype(bool)
        used = int(size[train].sum() + train.sum())
        docs = batch.column(0)
        payload = put(np.asarray(docs.fill_null(0), dtype=np.int64).view(np.uint64), np.asarray(docs.is_null()).astype(np.uint8), train.astype(np.uint8), size, flat, hashes)
        yield pa.RecordBatch.from_arrays([pa.array([payload]), pa.array([used]), pa.array([int(len(flat) + len(train))])], ["payload", "train_tokens", "tokens"])


class Block:
    """A packed block: for each token, ends included, its word and the two before it, as numbers in order of hash."""

    def __init__(self, payload: bytes):
        ids, null, train, size, flat, hashes = get(payload)
        self.docs = pa.array(ids.astype(np.uint64).view(np.int64), mask=null.astype(bool))
        self.size = size.astype(np.int64) + 1
        self.train = train.astype(bool)
        self.h, rank = np.unique(np.append(hashes.astype(np.uint64), [END, START]), return_inverse=True)
        ends = np.cumsum(self.size) - 1
        n = int(self.size.sum())
        inner = np.ones(n, bool)
        inner[ends] = False
        self.d = np.full(n, rank[-2])
        self.d[inner] = rank[flat]
        self.starts = ends - self.size + 1
        self.w2, self.w1 = np.full(n, rank[-1]), np.full(n, rank[-1])
        self.w2[1:] = self.d[:-1]
        self.w2[self.starts] = rank[-1]
        self.w1[1:] = self.w2[:-1]
        self.w1[self.starts] = rank[-1]

    def entries(self, plan: Plan) -> None:
        """Distinct entries in the order of shards, then hashes; ``at`` is the entry of each token."""
        e2, e1, ed, at = triples(self.w2, self.w1, self.d, len(self.h))
        self.w1 = self.w2 = None  # not needed any more
        count = np.bincount(at[np.repeat(self.train, self.size)], minlength=len(e2))
        shard = plan.shard(self.h, e1, e2, ed)[0]
        order = by_number(shard, plan.shards)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.e2, self.e1, self.ed, self.count, self.at = e2[order], e1[order], ed[order], count[order], place[at]
        self.shards, first = np.unique(shard[order] // plan.width, return_index=True)
        self.edges = np.append(first, len(order))


@dataclass
class Plan:
    """Shards of contexts, buckets too frequent for one shard, and the words with a code (hashes sorted, and their codes)."""

    shards: int
    dish_shards: int = 8
    hot_words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    hot_pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    code_hashes: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    codes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    chance: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))  # by code: first guess of the unigrams, from all training tokens
    rare_chance: float = 1.0  # of a word without a code: their mean
    width: int = 1  # shards of a unit, and shares of the blocks, between which routers are; 1: no routers

    @property
    def buckets(self) -> np.uint64:
        return np.uint64(BUCKETS * self.shards)

    def dish_shard(self, h: np.ndarray) -> np.ndarray:
        return (mix64(h * _STIR) % np.uint64(self.dish_shards)).astype(np.int64)

    def pair(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return mix64(h2 * _STIR + h1)

    def shard(self, h, e1, e2, ed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard of entries, given as places in the hashes ``h``; whether their word, and their pair, is too frequent for one shard."""
        n = np.uint64(self.shards)
        to = (mix64(h) % n).astype(np.int64)[e2]
        hot, very = np.isin(h % self.buckets, self.hot_words)[e2], np.zeros(len(e2), bool)
        some = np.flatnonzero(hot)
        if len(some):
            pair = self.pair(h[e1[some]], h[e2[some]])
            very[some] = v = np.isin(pair % self.buckets, self.hot_pairs)
            pair[v] = mix64(pair[v] * _STIR + h[ed[some[v]]])
            to[some] = (pair % n).astype(np.int64)
        return to, hot, very

    def named(self) -> np.ndarray:
        """Hashes by code."""
        every = np.empty(len(self.codes), np.uint64)
        every[self.codes] = self.code_hashes
        return every

    def code(self, h: np.ndarray) -> np.ndarray:
        """Codes of words; CODES for those without."""
        if not len(self.code_hashes):
            return np.full(len(h), CODES)
        at = np.minimum(np.searchsorted(self.code_hashes, h), len(self.code_hashes) - 1)
        return np.where(self.code_hashes[at] == h, self.codes[at], CODES)


def _tally(batches, buckets: int):
    """(kind, bucket, tokens, training tokens): kind 0 by the last word of the context, 1 by both, 2 by word (its hash), the only kind with training tokens of its own."""
    plan, held = Plan(buckets // BUCKETS), {0: [], 1: [], 2: []}

    def merged(kind):
        k, n, t = (np.concatenate(x) for x in zip(*held[kind]))
        keys, at = np.unique(k, return_inverse=True)
        held[kind] = [(keys, np.bincount(at, n).astype(np.int64), np.bincount(at, t).astype(np.int64))]

    def hold(kind, *rows):
        held[kind].append(rows)
        if sum(len(r[0]) for r in held[kind]) > 2_000_000:
            merged(kind)

    for batch in batches:
        for payload in batch.column(0):
            b = Block(payload.as_py())
            h1, h2 = b.h[b.w1], b.h[b.w2]
            for kind, x in ((0, h2), (1, plan.pair(h1, h2))):
                x = (x % plan.buckets).astype(np.int64)
                if buckets <= 1 << 22:
                    n = np.bincount(x, minlength=buckets)
                    keys = np.flatnonzero(n)
                    n = n[keys]
                else:
                    keys, n = np.unique(x, return_counts=True)
                hold(kind, keys, n, np.zeros(len(n), np.int64))
            hold(2, b.h.view(np.int64), np.bincount(b.d, minlength=len(b.h)), np.bincount(b.d[np.repeat(b.train, b.size)], minlength=len(b.h)))
    for kind in (0, 1, 2):
        if held[kind]:
            merged(kind)
            k, n, t = held[kind][0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.astype(np.int64)), pa.array(n), pa.array(t)], ["kind", "bucket", "n", "train"])


def _messages(h, code, e2, e1, ed, count, edges) -> list[bytes]:
    """Sorted entries between the edges, as runs of last words, first words and dishes."""
    blobs = []
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
        x2, x1, xd = e2[a:z], e1[a:z], ed[a:z]
        new2 = np.append(True, x2[1:] != x2[:-1])
        pair = np.flatnonzero(new2 | np.append(True, x1[1:] != x1[:-1]))
        last = np.flatnonzero(new2)
        flat = np.concatenate([x2[last], x1[pair], xd])
        codes = code[flat]
        rare = flat[codes == CODES]
        names, ref = np.unique(rare, return_inverse=True) if len(rare) else (rare, rare)
        pairs = np.diff(np.append(np.searchsorted(pair, last), len(pair)))
        blobs.append(put(steps(h[names]), ref, np.array([len(last), len(pair)]), codes, pairs, np.diff(np.append(pair, z - a)), count[a:z]))
    return blobs


def _united(parts: list, every: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes of the words in messages, places of those with a code; entries of all messages by place (last word, first, dish), their counts, and how many a message has.

    ``parts`` is emptied: large arrays go as soon as they can.
    """
    met = np.zeros(CODES + 1, bool)
    for p in parts:
        met[p[3]] = True
    met[CODES] = False
    by_code = every[met[: len(every)]]
    for p in parts:
        p[0] = summed(p[0].astype(np.uint64))
    h = distinct(np.concatenate([by_code, *[p[0] for p in parts]]))
    coded = np.searchsorted(h, by_code)
    of_code = np.zeros(CODES, np.int64)
    of_code[np.flatnonzero(met)] = coded
    columns = [[], [], [], []]
    for names, ref, n, codes, pairs, dishes, count in parts:
        ids = np.empty(len(codes), np.int32)
        rare = codes == CODES
        ids[~rare] = of_code[codes[~rare]]
        ids[rare] = np.searchsorted(h, names)[ref]
        n2, n1 = n.tolist()
        first = ids[n2 : n2 + n1]
        for c, x in zip(columns, (np.repeat(np.repeat(ids[:n2], pairs), dishes), np.repeat(first, dishes), ids[n2 + n1 :], count.astype(np.int32))):
            c.append(x)
    parts.clear()
    sizes = np.array([len(x) for x in columns[3]])
    return h, coded, *(np.concatenate(columns.pop(0)) for _ in range(4)), sizes


def _entries(batches, plan: Plan, group: int | None = None):
    """(shard, block, blob): a block's entries for a shard, or for a unit of shards (of a group of units) if routers are between."""
    for batch in batches:
        for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
            b = Block(payload.as_py())
            b.entries(plan)
            code = plan.code(b.h)
            on = [k for k, s in enumerate(b.shards.tolist()) if group is None or s % GROUPS == group]
            blobs = [x for k in on for x in _messages(b.h, code, b.e2, b.e1, b.ed, b.count, b.edges[k : k + 2])]
            yield pa.RecordBatch.from_arrays([pa.array(b.shards[on], pa.int32()), pa.array(np.full(len(blobs), block), pa.int64()), pa.array(blobs, pa.binary())], ["shard", "block", "blob"])


def _route(batches, plan: Plan):
    """(shard, block, blob): all entries of the router's blocks for each shard of its unit, under the router's key; under shard -1 the way back."""
    every = plan.named()
    for key, rows in _by_key(batches, 0):
        parts, blocks = [get(r[2]) for r in rows], [r[1] for r in rows]
        rows.clear()
        h, _, e2, e1, ed, count, sizes = _united(parts, every)
        cut, code = np.cumsum(sizes)[:-1], plan.code(h)
        rare = code == CODES
        asked = [distinct(x[rare[x]]) for x in np.split(ed, cut)]
        w2, w1, d, at = triples(e2, e1, ed, len(h))
        del e2, e1, ed
        shard = plan.shard(h, w1, w2, d)[0]
        order = by_number(shard, plan.shards)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at, w2, w1, d = place[at], w2[order], w1[order], d[order]
        there, first = np.unique(shard[order], return_index=True)
        blobs = _messages(h, code, w2, w1, d, np.bincount(at, count, len(d)).astype(np.int64), np.append(first, len(d)))
        told = [distinct(x[rare[x]]) for x in np.split(d, first[1:])]
        back = put(np.array([len(h)]), np.array(blocks, np.int64).view(np.uint64), there, *[steps(x) for x in np.split(at, cut)], *[steps(x) for x in asked], *[steps(x) for x in told])
        yield pa.RecordBatch.from_arrays([pa.array([-1, *there.tolist()], pa.int32()), pa.array([key] * (1 + len(blobs)), pa.int64()), pa.array([back, *blobs], pa.binary())], ["shard", "block", "blob"])


def _returned(batches, plan: Plan):
    """(block, unit, payload): what the shards of a unit answer a router, dealt to its blocks as each block asked."""
    for key, rows in _by_key(batches, 0):
        by_shard = {r[1]: r[2] for r in rows}
        rows.clear()
        n, blocks, there, *rest = get(by_shard[-1])
        k, answers = len(blocks), [get(by_shard[s]) for s in there.tolist()]
        score, count = np.concatenate([a[0] for a in answers]), np.zeros(int(n[0]), np.int64)
        for x, a in zip(rest[2 * k :], answers):
            count[summed(x)] = a[1]
        for block, at, asked in zip(blocks.astype(np.uint64).view(np.int64).tolist(), rest[:k], rest[k : 2 * k]):
            blob = put(score[summed(at)], count[summed(asked)])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([key // plan.width], pa.int32()), pa.array([blob], pa.binary())], ["block", "shard", "payload"])


def _by_key(batches, column: int):
    """Lists of rows of equal key from batches sorted by it."""
    held, key = [], None
    for batch in batches:
        for i in range(batch.num_rows):
            k = batch.column(column)[i].as_py()
            if held and k != key:
                yield key, held
                held = []
                give_back()
            key = k
            held.append([c[i].as_py() for c in batch.columns])
    if held:
        yield key, held


# ------------------------------------------------------------------ context shards


def _merge(batches, plan: Plan, seed: int):
    """One row a shard: its restaurants after early sweeps, the type of each entry of its blocks, and the dishes it needs of the dish shards."""
    every = plan.named()
    for shard, rows in _by_key(batches, 0):
        parts, blocks = [get(r[2]) for r in rows], [r[1] for r in rows]
        rows.clear()  # large arrays go as soon as they can
        h, coded, e2, e1, ed, count, sizes = _united(parts, every)
        m = len(h)
        w2, w1, d, at = triples(e2, e1, ed, m)
        del e2, e1, ed
        c3 = np.bincount(at, count, len(w2)).astype(np.int64)
        pair = np.flatnonzero(np.append(True, (w2[1:] != w2[:-1]) | (w1[1:] != w1[:-1])))
        key2, up = np.unique(w2 * m + d, return_inverse=True)
        word2, dish2 = key2 // m, key2 % m
        _, hot, very = plan.shard(h, w1[pair], w2[pair], w2[pair])
        hot_word = np.zeros(m, bool)
        hot_word[w2[pair[hot]]] = True
        hot2 = hot_word[word2]
        # dishes of the dish shards: of the unigrams (0), or of a too frequent word (1 + word)
        cold = np.zeros(m, bool)
        cold[dish2[~hot2]] = True
        wanted, more = np.unique((word2[hot2] + 1) * m + dish2[hot2], return_inverse=True)
        wanted, key = np.append(np.flatnonzero(cold), wanted), (np.cumsum(cold) - 1)[dish2]
        key[hot2] = more + np.count_nonzero(cold)
        c2 = np.bincount(up, c3, len(key2)).astype(np.int64)
        train = np.bincount(key, c2, len(wanted)).astype(np.int64)
        group, names = np.unique(wanted // m, return_inverse=True)
        cut = np.cumsum(sizes)[:-1]
        # training counts go back to blocks by dish, for words without a code
        one = np.full(m, -1)
        one[(wanted % m)[::-1]] = np.arange(len(wanted))[::-1]  # the first of each dish
        dishes = np.flatnonzero(one >= 0)
        one = one[dishes]
        place = np.zeros(m, np.int64)
        place[dishes] = np.arange(len(dishes))
        rare_dish = np.ones(m, bool)
        rare_dish[coded] = False
        rare_dish = rare_dish[d]
        rare = [distinct(place[d[y[rare_dish[y]]]]) for y in np.split(at, cut)]
        word_runs = np.flatnonzero(np.append(True, word2[1:] != word2[:-1]))
        run = _starts(steps(word_runs), len(key2))
        of_word = run[up[pair]]  # the word that a pair ends with
        parts = [
            np.array([len(w2), len(key2), len(wanted)]), steps(pair), of_word, very.astype(np.uint8), plan.pair(h[w1[pair[very]]], h[w2[pair[very]]]), up - word_runs[run][up], c3, steps(word_runs), hot2[word_runs].astype(np.uint8), key, one, plan.dish_shard(h[wanted % m]),
            np.array(blocks, np.int64).view(np.uint64), *[steps(x) for x in np.split(at, cut)], *[steps(x) for x in rare],
        ]
        s = Shard(parts)
        code = plan.code(h[wanted % m])
        guess = np.where(code < CODES, np.append(plan.chance, 1.0)[np.minimum(code, len(plan.chance))], plan.rare_chance)
        s.alone(group[names], guess, EARLY, np.random.default_rng([seed, shard, 0]))
        keys = put(h[wanted % m], np.where(group > 0, h[group - 1], 0).astype(np.uint64), names, train, s.seats())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([put(s.pairs.t, s.words.t, *parts)], pa.binary()), pa.array([keys], pa.binary()), _pair_totals(s)], ["shard", "blob", "keys", "far"])


def _starts(first: np.ndarray, n: int) -> np.ndarray:
    """The run that each of n places is in, from the steps between the runs' first places."""
    starts = np.cumsum(first.astype(np.int64))
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


class Shard:
    """Restaurants of pairs (level 3) and of words (level 2); words too frequent for it have their own among the dish shards."""

    def __init__(self, parts: list[np.ndarray], t3: np.ndarray | None = None, t2: np.ndarray | None = None):
        n, pair, of_word, very, very_hash, up, c3, word, hot, key, one, to, blocks, *rest = parts
        n3, n2, self.n_keys = n.tolist()
        self.key, self.one = key.astype(np.int64), one.astype(np.int64)
        self.order = by_number(to, int(to.max(initial=0)) + 1)  # keys by dish shard, as they were asked for
        self.there, first = np.unique(to[self.order], return_index=True)
        self.cuts = first[1:]
        self.very_hash = very_hash.astype(np.uint64).view(np.int64)
        self.blocks, k = blocks.astype(np.uint64).view(np.int64), len(blocks)
        self.at, self.rare = rest[:k], rest[k:]
        d, s = DISCOUNT, STRENGTH
        self.pairs = Level(_starts(pair, n3), len(pair), d[2], s[2], c3.astype(np.int64))
        self.very = np.flatnonzero(very)
        where = _starts(word, n2)
        self.hot2 = hot.astype(bool)[where]
        self.words = Level(where, len(word), d[1], s[1], np.zeros(n2, np.int64))
        self.up = np.cumsum(word.astype(np.int64))[of_word.astype(np.int64)[self.pairs.where]] + up.astype(np.int64)
        if t3 is not None:
            self.pairs.t = t3.astype(np.int64)
        self._carry()
        self.words.t = (self.words.c > 0).astype(np.int64) if t2 is None else t2.astype(np.int64)

    def _carry(self) -> None:
        self.words.c = np.bincount(self.up, self.pairs.t, len(self.key)).astype(np.int64)

    def alone(self, group: np.ndarray, guess: np.ndarray, sweeps: int, rng: np.random.Generator) -> None:
        """First sweeps: ``guess`` is the unigram chance of each dish, and of a too frequent word this shard's part stands for all."""
        _, where = np.unique(group, return_inverse=True)
        for _ in range(sweeps):
            near = Level(where, int(where.max()) + 1, DISCOUNT[1], STRENGTH[1], self.seats()).predict(guess)
            self.sweep(np.where(group > 0, near, guess), rng)

    def parents(self, p: np.ndarray) -> np.ndarray:
        """Probability of each dish in the restaurant of its word, from what the dish shards say of their own."""
        far = p[self.key]
        return np.where(self.hot2, far, self.words.predict(far))

    def sweep(self, p: np.ndarray, rng: np.random.Generator) -> None:
        self.pairs.sweep(self.parents(p)[self.up], rng)
        self._carry()
        self.words.sweep(p[self.key], rng)

    def seats(self) -> np.ndarray:
        """Customers that this shard sends to each dish of the dish shards: its tables."""
        return np.bincount(self.key, np.where(self.hot2, self.words.c, self.words.t), self.n_keys).astype(np.int64)


def _asked(batches, plan: Plan):
    """(to, shard, payload): first message of a shard to the dish shards: dishes, their counts in training and its tables."""
    for batch in batches:
        for shard, keys in zip(batch.column(0).to_pylist(), batch.column(1)):
            h, groups, group, train, seats = get(keys.as_py())
            h = h.astype(np.uint64)
            to = plan.dish_shard(h)
            order = by_number(to, plan.dish_shards)
            there, first = np.unique(to[order], return_index=True)
            blobs = [put(h[on], groups, group[on], train[on], seats[on]) for on in np.split(order, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(np.full(len(there), shard), pa.int32()), pa.array(blobs, pa.binary())], ["to", "shard", "payload"])


FAR = pa.list_(pa.struct([("pair", pa.int64()), ("c", pa.float64()), ("t", pa.float64())]))


def _pair_totals(s: Shard) -> pa.Array:
    """A shard's part of the pairs that are dealt over shards."""
    c, t = s.pairs.part()
    return pa.array([[{"pair": p, "c": float(c[k]), "t": float(t[k])} for p, k in zip(s.very_hash.tolist(), s.very.tolist())]], FAR)


def _answers(batches, far: dict, seed: int):
    """Late sweeps; (block, shard, payload): log probabilities of a block's entries and training counts of its words without a code.

    Rows (shard, part, payload): the shard itself (-1), replies of dish shards (from 0 on).
    """
    for shard, rows in _by_key(batches, 0):
        by_part = {r[1]: r[2] for r in rows}
        t3, t2, *parts = get(by_part[-1])
        s = Shard(parts, t3, t2)
        replies = [get(by_part[k]) for k in s.there.tolist()]
        p, count = np.empty(s.n_keys), np.empty(s.n_keys, np.int64)
        p[s.order] = np.concatenate([r[0] for r in replies])
        count[s.order] = np.concatenate([r[1] for r in replies])
        count = count[s.one]
        if len(s.very):
            s.pairs.share(s.very, *(np.array(x) for x in zip(*[far[x] for x in s.very_hash.tolist()])))
        total = np.zeros(len(s.up))
        for k in range(LATE):
            s.sweep(p, np.random.default_rng([seed, shard, 1 + k]))
            if k >= LATE - AVERAGED:
                total += s.pairs.predict(s.parents(p)[s.up])
        score = np.rint(-GRAIN * np.log10(np.minimum(total / AVERAGED, 1.0))).astype(np.int64)
        for block, at, rare in zip(s.blocks.tolist(), s.at, s.rare):
            blob = put(score[summed(at)], count[summed(rare)])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], ["block", "shard", "payload"])


# ------------------------------------------------------------------ dish shards


class Dishes:
    """Seats of some dishes in the unigram restaurant and in those of words too frequent for one shard."""

    def __init__(self, h, group_hash, dish, group, train, sources, codes):
        self.h, self.group_hash, self.dish, self.group = h, group_hash, dish.astype(np.int64), group.astype(np.int64)
        self.train, self.sources, self.codes = train.astype(np.int64), sources, codes

    @classmethod
    def first(cls, rows) -> tuple[Dishes, np.ndarray, np.ndarray]:
        parts = [get(r[2]) for r in rows]
        h, at = np.unique(np.concatenate([p[0].astype(np.uint64) for p in parts]), return_inverse=True)
        named = np.concatenate([p[1].astype(np.uint64)[p[2]] for p in parts])
        train, seats = (np.concatenate([p[k].astype(np.int64) for p in parts]) for k in (3, 4))
        far = named > 0
        group_hash, g = np.unique(named[far], return_inverse=True)
        both, hot = np.unique(at[far] * max(1, len(group_hash)) + g, return_inverse=True)
        code = at.copy()
        code[far] = len(h) + hot
        sizes = np.array([len(p[0]) for p in parts])
        d = cls(h, group_hash, both // max(1, len(group_hash)), both % max(1, len(group_hash)), np.bincount(at, train, len(h)), np.array([r[1] for r in rows]), np.split(code, np.cumsum(sizes)[:-1]))
        d.levels(np.bincount(code, seats, len(h) + len(both)).astype(np.int64))
        return d

    def levels(self, seats: np.ndarray, t: tuple | None = None) -> None:
        """Customers from context shards; unigrams also get the tables of the restaurants here."""
        n, d, s = len(self.h), DISCOUNT, STRENGTH
        self.hot = Level(self.group, len(self.group_hash), d[1], s[1], seats[n:], None if t is None else t[1])
        self.root = Level(np.zeros(n, np.int64), 1, d[0], s[0], np.zeros(n, np.int64), None if t is None else t[0])
        self.seated(seats)
        if t is None:
            self.root.t = (self.root.c > 0).astype(np.int64)

    def seated(self, seats: np.ndarray) -> None:
        """Other customers; a dish keeps as many of its tables as they can sit at."""
        n = len(self.h)
        self.direct, self.hot.c = seats[:n], seats[n:]
        self.hot.t = np.clip(self.hot.t, self.hot.c > 0, self.hot.c)
        self._carry()
        self.root.t = np.clip(self.root.t, self.root.c > 0, self.root.c)

    def share(self, totals: Totals) -> None:
        self.root.share(*totals.root())
        self.hot.share(*totals.groups(self.group_hash))

    def _carry(self) -> None:
        self.root.c = self.direct + np.bincount(self.dish, self.hot.t, len(self.h)).astype(np.int64)

    def sweep(self, base: float, rng: np.random.Generator) -> None:
        flat = np.full(len(self.h), base)
        self.hot.sweep(self.root.predict(flat)[self.dish], rng)
        self._carry()
        self.root.sweep(flat, rng)

    def probabilities(self, totals: Totals) -> np.ndarray:
        """Of the unigrams, then of the dishes of restaurants here."""
        self.share(totals)
        p = self.root.predict(np.full(len(self.h), totals.base))
        return np.concatenate([p, self.hot.predict(p[self.dish])])

    def packed(self) -> bytes:
        return put(self.h, self.group_hash, self.dish, self.group, self.train, self.sources, self.direct, self.hot.c, self.hot.t, self.root.t, *self.codes)

    @classmethod
    def of(cls, data: bytes) -> Dishes:
        h, group_hash, dish, group, train, sources, direct, c1, t1, t0, *codes = get(data)
        d = cls(h.astype(np.uint64), group_hash.astype(np.uint64), dish, group, train, sources, codes)
        d.levels(np.concatenate([direct, c1]).astype(np.int64), (t0.astype(np.int64), t1.astype(np.int64)))
        return d

    def row(self, to: int) -> pa.RecordBatch:
        """(to, payload, totals): the totals of this shard's part of each restaurant, the unigrams' under 0."""
        (c0,), (t0,) = self.root.part()
        c1, t1 = self.hot.part()
        names = [0, *self.group_hash.view(np.int64).tolist()]
        totals = [{"name": n, "c": float(c), "t": float(t)} for n, c, t in zip(names, [c0, *c1], [t0, *t1])]
        kind = pa.list_(pa.struct([("name", pa.int64()), ("c", pa.float64()), ("t", pa.float64())]))
        return pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([self.packed()], pa.binary()), pa.array([totals], kind), pa.array([int((self.train > 0).sum())])], ["to", "payload", "totals", "known"])


@dataclass
class Totals:
    """(customers, tables) of the unigram restaurant and of each restaurant that dish shards share; the uniform base."""

    by_name: dict[int, tuple[float, float]]
    base: float

    def root(self):
        c, t = self.by_name.get(0, (0.0, 0.0))
        return np.array([0]), np.array([c]), np.array([t])

    def groups(self, names: np.ndarray):
        both = [self.by_name[int(x)] for x in names.view(np.int64)]
        return np.arange(len(both)), np.array([c for c, _ in both]), np.array([t for _, t in both])


def _dishes(batches):
    for to, rows in _by_key(batches, 0):
        yield Dishes.first(rows).row(to)


def _dish_sweep(batches, totals: Totals, seed: int, k: int):
    for batch in batches:
        for to, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            d = Dishes.of(data.as_py())
            d.share(totals)
            d.sweep(totals.base, np.random.default_rng([seed, to, k]))
            yield d.row(to)


def _replies(batches, totals: Totals, group: int):
    """(shard, part, payload): probabilities and training counts of the dishes that the context shards of a group asked for."""
    for batch in batches:
        for to, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            d = Dishes.of(data.as_py())
            p = d.probabilities(totals).astype(np.float32)
            count = np.concatenate([d.train, d.train[d.dish]])
            asked = [(s, c) for s, c in zip(d.sources.tolist(), d.codes) if s % GROUPS == group]
            blobs = [put(p[c], count[c]) for _, c in asked]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in asked], pa.int32()), pa.array(np.full(len(blobs), to), pa.int32()), pa.array(blobs, pa.binary())], ["shard", "part", "payload"])


def _coded_counts(batches, plan: Plan):
    """(code, n): training counts of the words that have a code."""
    for batch in batches:
        for data in batch.column(0):
            d = Dishes.of(data.as_py())
            code = plan.code(d.h)
            on = code < CODES
            yield pa.RecordBatch.from_arrays([pa.array(code[on]), pa.array(d.train[on])], ["code", "n"])


# ------------------------------------------------------------------ scores


def _scores(batches, plan: Plan, coded: np.ndarray, n: int, v: int):
    for _, rows in _by_key(batches, 0):
        b = Block(rows[0][2])
        b.entries(plan)
        answers = {r[1]: get(r[2]) for r in rows[1:]}
        code = plan.code(b.h)
        rare = code == CODES
        score, count = np.empty(len(b.e2)), np.where(rare, 0, coded[np.minimum(code, len(coded) - 1)] if len(coded) else 0)
        for shard, a, z in zip(b.shards.tolist(), b.edges[:-1].tolist(), b.edges[1:].tolist()):
            found, told = answers[shard]
            score[a:z] = found / -GRAIN
            yours = b.ed[a:z][rare[b.ed[a:z]]]
            count[distinct(yours)] = told
        c = count[b.d]
        base = np.log10((c + 1.0) / (n + 1.0 * (v + 1)))
        add = lambda x: np.add.reduceat(x, b.starts)
        yield pa.RecordBatch.from_arrays(
            [b.docs, pa.array(~b.train), pa.array(b.size), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(b.size), n)), pa.array(add(base)), pa.array(add(score[b.at]))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _far(rows: DataFrame) -> dict[int, tuple[float, float]]:
    """Totals of the pairs that are dealt over shards: at most two for every half shard of tokens."""
    got = rows.select(F.explode("far").alias("x")).groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.c").alias("c"), F.sum("x.t").alias("t"))
    return {r["pair"]: (r["c"], r["t"]) for r in got.toLocalIterator()}


def _dish_totals(dishes: DataFrame, base: float) -> Totals:
    got = dishes.select(F.explode("totals").alias("x")).groupBy(F.col("x.name").alias("name")).agg(F.sum("x.c").alias("c"), F.sum("x.t").alias("t"))
    return Totals({r["name"]: (r["c"], r["t"]) for r in got.toLocalIterator()}, base)


def _frequent(blocks: DataFrame, shards: int, total: int, train_tokens: int, work: WorkFolder) -> Plan:
    """The plan: contexts with more tokens than half a shard, codes of frequent words, and a first guess of the unigrams from all training tokens.

    Words of a count (by eighths of its logarithm) all have a code or all have none; those without share one guess.
    """
    buckets = BUCKETS * shards
    tally = blocks.select("payload").mapInArrow(lambda it: _tally(it, buckets), "kind int, bucket long, n long, train long")
    tally = work.put("tally", tally.groupBy("kind", "bucket").agg(F.sum("n").alias("n"), F.sum("train").alias("train")))
    hot = [(r["kind"], r["bucket"]) for r in tally.where((F.col("kind") < 2) & (F.col("n") > total / shards / 2)).toLocalIterator()]
    words = tally.where("kind = 2 AND n > 0").withColumn("level", F.floor(8 * F.log2("n")).cast("int"))
    levels = {r["level"]: (r["m"], r["train"]) for r in words.groupBy("level").agg(F.count("*").alias("m"), F.sum("train").alias("train")).collect()}
    least, coded = max(levels, default=0) + 1, 0
    for level in sorted(levels, reverse=True):
        if coded + levels[level][0] > CODES:
            break
        least, coded = level, coded + levels[level][0]
    rest = [levels[k] for k in levels if k < least]
    got = words.where(F.col("level") >= least).select("bucket", "n", "train").toArrow()
    h, n, train = (got.column(k).to_numpy() for k in ("bucket", "n", "train"))
    h = h.view(np.uint64)
    top = np.lexsort((h, -n))
    by_hash = np.argsort(h[top])
    of = lambda kind: np.array(sorted(b for k, b in hot if k == kind), np.uint64)
    guess = lambda t: np.maximum(t - 0.5, 0.25) / max(1, train_tokens)
    rare = float(guess(sum(t for _, t in rest) / max(1, sum(m for m, _ in rest))))
    work.drop("tally")
    return Plan(shards, max(8, -(-shards // CONTEXTS_A_DISH_SHARD)), of(0), of(1), h[top][by_hash], by_hash.astype(np.int64), guess(train[top]).astype(np.float32), rare)


def score(docs: DataFrame, train, seed: int = 2, shard_tokens: int = SHARD_TOKENS, routed: int = ROUTED) -> DataFrame:
    """Train on the rows for which the boolean column ``train`` holds and score all rows of (doc_id, text).

    Null, empty and blank texts are their end token alone; texts of any length are read whole;
    repeated rows count and are scored each, alike. Without a training row every word is
    unknown. An empty table gives an empty result; further columns are passed over. Perplexity
    of a text is 10 ** (-score / n_tokens).
    """
    spark = docs.sparkSession
    work = WorkFolder(spark, "pitman-yor")
    sent = spark.sparkContext.broadcast
    rows = long_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = work.put("blocks", rows.mapInArrow(_blocks, "payload binary, train_tokens long, tokens long").withColumn("block", F.monotonically_increasing_id()))
    n, total, n_blocks = (int(x or 0) for x in blocks.agg(F.sum("train_tokens"), F.sum("tokens"), F.count("*")).first())
    shards = max(8, -(-total // shard_tokens))
    plan = _frequent(blocks, shards, total, n, work)
    plan.width = math.isqrt(shards) if shards > routed else 1
    about = sent(plan)

    far_type, entry_type = "far array<struct<pair:long,c:double,t:double>>", "shard int, block long, blob binary"
    texts = blocks.select("block", "payload")

    def merge(entries: DataFrame, name: str, tasks: int) -> DataFrame:
        entries = entries.repartition(min(tasks, PARTITIONS), "shard").sortWithinPartitions("shard", "block")
        return work.put(name, entries.mapInArrow(lambda it: _merge(it, about.value, seed), f"shard int, blob binary, keys binary, {far_type}"))

    back = None  # ways back of the routers
    if plan.width == 1:
        merged = merge(texts.mapInArrow(lambda it: _entries(it, about.value), entry_type), "shards", shards)
    else:
        tasks, merged = -(-shards // GROUPS), None
        for group in range(GROUPS):  # one after another, so that not all messages lie on disk at once
            sent_on = texts.mapInArrow(lambda it, group=group: _entries(it, about.value, group), entry_type)
            key = F.col("shard").cast("long") * plan.width + F.pmod(F.xxhash64("block"), F.lit(plan.width))
            sent_on = sent_on.select(key.alias("key"), "block", "blob").repartition(min(tasks, PARTITIONS), "key").sortWithinPartitions("key", "block")
            routes = work.put(f"routes-{group}", sent_on.mapInArrow(lambda it: _route(it, about.value), entry_type))
            part = merge(routes.where("shard >= 0"), f"shards-{group}", tasks)
            ways = work.put(f"back-{group}", routes.where("shard < 0"))
            work.drop(f"routes-{group}")
            merged, back = (part, ways) if merged is None else (merged.unionAll(part), back.unionAll(ways))

    told = merged.select("shard", "keys").mapInArrow(lambda it: _asked(it, about.value), "to int, shard int, payload binary")
    told = told.repartition(min(plan.dish_shards, PARTITIONS), "to").sortWithinPartitions("to", "shard")
    dish_type = "to int, payload binary, totals array<struct<name:long,c:double,t:double>>, known long"
    dishes = work.put("dishes", told.mapInArrow(_dishes, dish_type))
    v = int(dishes.agg(F.sum("known")).first()[0] or 0)
    totals = sent(_dish_totals(dishes, 1.0 / (v + 1)))
    for k in range(DISH_SWEEPS):
        dishes = work.put(f"dishes-{k}", dishes.select("to", "payload").mapInArrow(lambda it, k=k, known=totals: _dish_sweep(it, known.value, seed, k), dish_type))
        totals = sent(_dish_totals(dishes, 1.0 / (v + 1)))
        work.drop("dishes" if k == 0 else f"dishes-{k - 1}")
    counts = dishes.select("payload").mapInArrow(lambda it: _coded_counts(it, about.value), "code long, n long").toArrow()
    coded = np.zeros(len(plan.codes), np.int64)
    coded[counts.column("code").to_numpy()] = counts.column("n").to_numpy()

    far = sent(_far(merged))
    answers, answer_type = None, "block long, shard int, payload binary"
    for group in range(GROUPS):
        replies = dishes.select("to", "payload").mapInArrow(lambda it, group=group: _replies(it, totals.value, group), "shard int, part int, payload binary")
        own = merged.where(F.col("shard") % GROUPS == group).select("shard", F.lit(-1).alias("part"), F.col("blob").alias("payload"))
        rows = own.unionAll(replies).repartition(min(-(-shards // GROUPS), PARTITIONS), "shard").sortWithinPartitions("shard", "part")
        part = work.put(f"answers-{group}", rows.mapInArrow(lambda it: _answers(it, far.value, seed), answer_type))
        answers = part if answers is None else answers.unionAll(part)
    work.drop(*(["shards"] if back is None else [f"shards-{k}" for k in range(GROUPS)]), f"dishes-{DISH_SWEEPS - 1}")
    if back is not None:
        rows = answers.unionByName(back.withColumnRenamed("blob", "payload")).repartition(min(shards, PARTITIONS), "block").sortWithinPartitions("block", "shard")
        answers = work.put("returned", rows.mapInArrow(lambda it: _returned(it, about.value), answer_type))
        work.drop(*[f"{name}-{k}" for name in ("answers", "back") for k in range(GROUPS)])
    both = blocks.select("block", F.lit(-1).alias("shard"), "payload").unionByName(answers)
    both = both.repartition(min(max(1, n_blocks // 2), PARTITIONS), "block").sortWithinPartitions("block", "shard")
    model = sent(coded)
    return both.mapInArrow(lambda it: _scores(it, about.value, model.value, n, v), OUT)


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
