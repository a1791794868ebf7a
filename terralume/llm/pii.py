"""Personal data: exact patterns, and a linear-chain CRF over word shapes that adds spans."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .common import Ids, long_rows, table, text_batches, with_fields

#: Kinds in the order of the digests; the patterns find the first four, the CRF any.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Patterns as the task fixes them, possessive where that changes no match, so each runs in linear time.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches, found from their only ``@``: the local part is the run of its characters before it."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        first = at
        while first > end and LOCAL.match(text, first - 1):
            first -= 1
        tail = DOMAIN.match(text, at + 1) if first < at else None
        if tail:
            yield first, tail.end()
            end = tail.end()
        else:
            end = max(end, at + 1)  # no match holds this @, nor anything before it
        at = max(at + 1, end)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; per kind leftmost and non-overlapping."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if m.group(1) and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() - (gaps := m.group().count(" ") + m.group().count("-")) <= 19 and gaps >= 0:
            digits = m.group().replace(" ", "").replace("-", "")
            if luhn(digits):
                out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


# ------------------------------------------------------------------ word shapes and the model


def shape(word: str) -> str:
    """Letters as a or A, digits as 9, other characters as they are; runs count up to four."""
    out, last, run = [], "", 0
    for c in word:
        s = ("A" if c.isupper() else "a") if c.isalpha() else "9" if c.isdigit() else c
        run = run + 1 if s == last else 1
        last = s
        if run <= 4:
            out.append(s)
    return "".join(out)


def shape_features(word: str) -> list[str]:
    core = word.strip("\"'.,;:!?*$%&#()<>[]")
    digits, letters = sum(c.isdigit() for c in core), sum(c.isalpha() for c in core)
    kinds = "".join(k for k, on in (("9", digits), ("A", any(c.isupper() for c in core)), ("a", any(c.islower() for c in core)), ("@", "@" in core), ("=", "=" in core), ("+", "+" in core), ("-", "-" in core), (".", "." in core), ("[", "[" in core)) if on)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:]))
    hexadecimal = len(core) >= 16 and all(c in "0123456789abcdef" for c in core)
    size = lambda n: str(min(n, 8)) if n < 12 else "12" if n < 16 else "16" if n < 20 else "20" if n < 32 else "32"
    return ["b", f"s:{shape(word)}", f"c:{shape(core)}", f"k:{kinds}", f"n:{size(len(core))}:{size(digits)}", f"m:{min(switches, 6)}:{bool(letters)}", f"h:{hexadecimal}", f"e:{core.split('=')[0].lower() if '=' in core else ''}",
            f"o:{'[at]' in core}:{'[dot]' in core}", f"p:{core[:4] if len(core) >= 16 and core[:4].isupper() else ''}"]


N_FEATURES = 10


class _Classes(dict):
    """Of a character, one that stands for it in all features: letters by case and digits; others stay."""

    def __missing__(self, c: int):
        x = chr(c)
        y = ("A" if x.isupper() else "a" if x.islower() else "\u4e2d") if x.isalpha() else "9" if x.isdigit() else x
        self[c] = ord(y)
        return self[c]


_CLASSES = _Classes()


def forms(text: str, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """For each word one of the same features that many words share; a word with more to it than classes stays."""
    like = text.translate(_CLASSES)
    return [text[a:b] if b - a >= 16 or "=" in (f := like[a:b]) or "[" in f else f for a, b in zip(starts.tolist(), ends.tolist())]


def labelled_table() -> list[list[tuple[str, str]]]:
    """The small labelled table: (word, label) rows of texts, built from a few forms with drawn digits."""
    rng = np.random.default_rng(8)
    number = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    letters = lambda n, low="abcdefghijklmnopqrstuvwxyz": "".join(low[x] for x in rng.integers(0, len(low), n))
    plain = lambda n: str.capitalize(letters(n)) if rng.random() < 0.2 else letters(n)
    rows: list[list[tuple[str, str]]] = []
    o = "O"
    for k in range(60):
        tail = ("", ".", ",", "!!", "***", '"')[k % 6]
        name, host = letters(5), letters(6)
        rows += [
            [(f"{name}.{number(2)}@{host}.example.com{tail}", "email")],
            [(f"{name}[at]{host}.example.com{tail}", "email")],
            [(f"{name}@{host}[dot]org{tail}", "email")],
            [(".".join(str(x) for x in rng.integers(1, 256, 4)) + tail, "ip")],
            [(number(16) + tail, "card")],
            [(number(4), "card"), (number(4), "card"), (number(4), "card"), (number(4) + tail, "card")],
            [("-".join(number(4) for _ in range(4)) + tail, "card")],
            [("+" + number(1), "phone"), (f"({number(3)})", "phone"), (f"{number(3)}-{number(4)}{tail}", "phone")],
            [(f"({number(3)})", "phone"), (f"{number(3)}-{number(4)}{tail}", "phone")],
            [(f"+{number(2)}-{number(3)}-{number(7)}{tail}", "phone")],
            [("password=" + letters(18, "0123456789abcdef") + tail, "secret")],
            [("secret=" + letters(24) + tail, "secret")],
            [("api_key=" + letters(20, "0123456789abcdefghij") + tail, "secret")],
            [('"' + letters(40, "0123456789abcdef") + '"' + tail, "secret")],
            [(letters(32, "0123456789abcdef") + tail, "secret")],
            [("AKIA" + letters(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") + tail, "secret")],
            # what looks a little like it and is not
            [(f"{number(1)}.{number(1)}.", o)], [(number(1) + ".", o)], [(number(4) + tail, o)], [(number(2) + tail, o)], [(number(3) + tail, o)],
            [(f"{number(2)}-{number(2)}-{number(4)}", o)], [(f"{number(4)}-{number(2)}-{number(2)}", o)], [(f"{number(2)}:{number(2)}", o)], [(f"{number(1)},{number(3)}", o)], [(f"${number(3)}.{number(2)}", o)],
            [(f"x={number(1)}", o)], [("=", o)], [(f"@{name}", o)], [(f"a{number(1)}", o)], [(f"{name}{number(2)}", o)], [("+", o)], [(f"+{number(2)}%", o)], [(f"{number(2)}%", o)], [(f"v{number(1)}.{number(1)}.{number(1)}", o)],
            [(f"lang={letters(2)}", o)], [("==", o)], [("C++", o)], [(f"{number(6)}", o)], [(f"#{number(4)}", o)], [(f"{number(4)}-{number(4)}", o)], [(f"{number(2)}", o), (f"{number(4)}", o)],
        ]
    # the same among words, and words of all lengths that are no personal data
    rows += [[(plain(1 + k % 12), o), *r, (plain(1 + k % 7), o)] for k, r in enumerate(rows)]
    for k in range(1, 61):
        tail = ("", ".", ",", "!!", "***", '"', "?", ":", ").", "...")[k % 10]
        name, host = letters(1 + k % 9), letters(6)
        forms = (
            letters(k) + tail, str.capitalize(letters(k)) + tail, letters(k).upper() + tail, letters(1 + k % 16) + tail, letters(1 + k % 16).upper() + tail, "\u4e2d" * (1 + k % 20) + tail,
            f"({name}", f'"{name}"{tail}', f"[{name}]{tail}", f"{name}'{letters(1)}", f"{name}-{host}{tail}", f"{letters(1)}.{letters(1)}.", f"{name}.{host}{tail}", f"{host}.example.com{tail}", f"www.{host}.example.com{tail}",
            f"https://{host}.example.com/{name}/{letters(k % 12)}", f"http://www.{host}.org/{name}.html", f"{name}/{host}", f"{name}_{host}", f"{name}({letters(1)})", f"{name}[{letters(2)}].{host}", f"{name}[{host}]", f"#{name}", f"<{name}>", f"{name}...{host}", "-" * (1 + k % 12), "*" * (1 + k % 12), "." * (1 + k % 6), "|", "&", "\u2014",
        )
        rows += [[(w, o)] if (j + k) % 2 else [(plain(1 + k % 11), o), (w, o), (plain(2 + k % 5), o)] for j, w in enumerate(forms)]
    return rows


@dataclass
class Tagger:
    chain: crf.Chain
    number: dict[str, int]

    def emissions(self, vocabulary: list[str]) -> np.ndarray:
        none = len(self.chain.emit) - 1
        f = np.array([[self.number.get(x, none) for x in shape_features(w)] for w in vocabulary], np.int64).reshape(-1, N_FEATURES)
        return self.chain.emissions(f)


@cache
def trained() -> Tagger:
    """The model of the labelled table."""
    return train()


def train(rows: list[list[tuple[str, str]]] | None = None) -> Tagger:
    """Maximum-likelihood chain from the labelled table; label 0 is no personal data."""
    rows = labelled_table() if rows is None else rows
    number, ids = Ids(), Ids()
    sequences = [np.array([ids[w] for w, _ in r]) for r in rows]
    truth = [np.array([0 if y == "O" else 1 + KINDS.index(y) for _, y in r]) for r in rows]
    features = np.array([[number[f] for f in shape_features(w)] for w in ids], np.int64)
    return Tagger(crf.train(features, sequences, truth, 1 + len(KINDS), len(number), steps=80, rate=0.2), dict(number))


_SPACE = np.zeros(128, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _SPACE[np.minimum(cp, 127)] & (cp < 128)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    return edge[::2], edge[1::2]


class Decoder:
    """Viterbi over all words of a batch of texts; remembers emissions of words' forms."""

    def __init__(self, tagger: Tagger, most: int = 100_000):
        self.tagger, self.most, self.ids, self.e = tagger, most, Ids(), np.empty((0, 1 + len(KINDS)))

    def spans(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """Spans of each text: words of one label in a row, without outer quotes and marks."""
        if len(self.ids) > self.most:
            self.ids, self.e = Ids(), self.e[:0]
        found = [word_places(t or "") for t in texts]
        flat = np.array([self.ids[f] for t, (s, e) in zip(texts, found) if t for f in forms(t, s, e)], np.int64)
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        if not len(flat):
            return out
        if len(self.e) < len(self.ids):
            self.e = np.concatenate([self.e, self.tagger.emissions(list(self.ids)[len(self.e) :])])
        size = np.array([len(s) for s, _ in found])
        doc = np.repeat(np.arange(len(texts)), size)
        starts, ends = (np.concatenate([f[k] for f in found]) for k in range(2))
        label = crf.viterbi(self.tagger.chain, self.e[flat], size)
        for k in np.flatnonzero(label).tolist():
            joined = k and label[k - 1] == label[k] and doc[k - 1] == doc[k] and label[k] in (3, 4)
            if joined and max(ends[j] - starts[j] for j in (k - 1, k)) < 13:  # parts of one number
                kind, a, _ = out[doc[k]][-1]
                out[doc[k]][-1] = (kind, a, int(ends[k]))
            else:
                out[doc[k]].append((KINDS[label[k] - 1], int(starts[k]), int(ends[k])))
        return [[s for s in map(lambda s, t=t: _trim(t, s), spans) if s] for t, spans in zip(texts, out)]


def _trim(text: str, span: tuple[str, int, int]) -> tuple[str, int, int] | None:
    kind, a, b = span
    outer = "\"'.,;:!?*$%&#<>[]|" + ("" if kind == "phone" else "()")
    while a < b and text[a] in outer:
        a += 1
    while a < b and text[b - 1] in outer:
        b -= 1
    return (kind, a, b) if a < b and _sound(kind, text[a:b]) else None


def _sound(kind: str, found: str) -> bool:
    """The exact check that follows the chain: numbers must be possible ones of their kind."""
    digits = "".join(c for c in found if c.isdecimal())
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "ip":
        return bool(re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", found)) and all(int(x) <= 255 for x in found.split("."))
    return True


def all_spans(base: list[tuple[str, int, int]], added: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and those added ones that touch none of them, by kind, then start."""
    held = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in held]
    top, far = [], 0
    for _, b in held:
        far = max(far, b)
        top.append(far)
    free = [s for s in added if not (i := bisect_left(starts, s[2])) or top[i - 1] <= s[1]]
    return sorted([*base, *free], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find(docs: DataFrame, tagger: Tagger | None = None, text: str = "text", out: str = "pii_spans", base: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``out``: array of (kind, start, end), code points, end exclusive.

    With ``base`` the exact patterns' spans come in a column of that name as well. Null and
    empty texts have none. One pass over whole texts, no shuffle.
    """
    docs = long_rows(docs).drop(out, *([base] if base else []))
    given, (text, spans, exact_spans) = docs.columns, (f"c{docs.columns.index(text)}", "s0", "s1")
    docs = docs.toDF(*[f"c{k}" for k in range(len(given))])  # Arrow functions know no names with dots
    sent = docs.sparkSession.sparkContext.broadcast(tagger or trained())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    struct = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def each(batches):
        decoder = Decoder(sent.value)
        for batch in text_batches(batches, text, 1_000_000):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            exact = [base_spans(t) if t else [] for t in texts]
            both = [all_spans(x, y) for x, y in zip(exact, decoder.spans(texts))]
            columns, names = [*batch.columns, pa.array(map(struct, both), kind)], [*batch.schema.names, spans]
            if base:
                columns.append(pa.array(map(struct, exact), kind))
                names.append(exact_spans)
            yield pa.RecordBatch.from_arrays(columns, names)

    ddl = "array<struct<kind:string,start:int,end:int>>"
    found = docs.mapInArrow(each, with_fields(docs, f"{spans} {ddl}" + (f", {exact_spans} {ddl}" if base else "")))
    return found.toDF(*given, out, *([base] if base else []))


def redact(docs: DataFrame, tagger: Tagger | None = None, text: str = "text") -> DataFrame:
    """The same rows and columns with every span of whole texts replaced by its kind in brackets.

    Overlapping spans (of different kinds) are replaced as one, by the kind that starts first.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tagger or trained())
    given, at = long_rows(docs).columns, docs.columns.index(text)
    text = f"c{at}"
    docs = docs.toDF(*[f"c{k}" for k in range(len(given))])  # Arrow functions know no names with dots

    def each(batches):
        decoder = Decoder(sent.value)
        for batch in text_batches(batches, text, 1_000_000):
            texts = batch.column(at).to_pylist()
            clean = []
            for t, added in zip(texts, decoder.spans(texts)):
                spans = all_spans(base_spans(t), added) if t else []
                if spans:
                    merged: list[list] = []
                    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                        if merged and a < merged[-1][2]:
                            merged[-1][2] = max(merged[-1][2], b)
                        else:
                            merged.append([k, a, b])
                    pieces, last = [], 0
                    for k, a, b in merged:
                        pieces += [t[last:a], f"<{k}>"]
                        last = b
                    t = "".join([*pieces, t[last:]])
                clean.append(t)
            columns = list(batch.columns)
            columns[at] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(each, docs.schema).toDF(*given)


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def op8_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    rows = find(docs, base="base_spans")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(line("base_spans"), 256).alias("base_sha256"), line("pii_spans").alias("spans"))
