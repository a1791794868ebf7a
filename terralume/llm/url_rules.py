"""URL filters: fixed host and path rules, then association rules mined by FP-growth.

DataFrame functions only; FP-growth is Spark's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WorkFolder, quoted, spread_join, table

#: (verdict, host, path): fixed values of the task, as text.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Mining:
    """Support is a share of the labelled rows, all of which are used; rules up to a number are broadcast."""

    support: float = 0.004
    confidence: float = 0.9
    broadcast_rules: int = 100_000


#: A url on more than this share of the rows is hot; there are at most 1 / HOT_SHARE such urls.
HOT_SHARE = 0.001
#: Characters from which a token is known by its digest.
LONG_TOKEN = 64


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; a null url or one without ``://`` has empty ones."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens: scheme, host labels, host end of two labels, path words, query keys.

    Digits become 0 in all tokens, so that page numbers are one token; a token of over
    LONG_TOKEN characters stands as its digest. Empty for a url without a host.
    """
    labels = F.split(host, r"\.")
    short = lambda c: F.when(F.length(c) > LONG_TOKEN, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c)
    digits = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    mark = lambda prefix, words: F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(prefix), short(digits(w))))
    found = F.concat(
        F.array(F.concat(F.lit("s:"), short(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([^:/?#]*)://", 1)))),
        mark("h:", labels),
        F.array(F.concat(F.lit("d:"), short(F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1)))),
        mark("p:", F.split(path, r"[/.]+")),
        mark("q:", F.transform(F.split(query, "&"), lambda kv: F.regexp_extract(kv, r"^([^=]*)", 1))),
        F.when(F.instr(F.coalesce(url, F.lit("")), "#") > 0, F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(found)))


def _collapsed(labelled: DataFrame, least: float, work: WorkFolder) -> tuple[DataFrame, DataFrame]:
    """(items, verdict) rows with one token for all that stand in the same rows, and (item, members, n) of those tokens.

    Tokens below the least count go; equal row sets are told by their size and 128 bits of hashes of their rows.
    """
    rows = work.put("labelled", labelled.select(F.array_distinct("tokens").alias("tokens"), "verdict").withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    each = rows.select("row", F.explode("tokens").alias("item"))
    mark = lambda k: F.bit_xor(F.xxhash64("row", F.lit(k)))
    often = each.groupBy("item").agg(F.count("*").alias("n"), mark(1).alias("m1"), mark(2).alias("m2")).where(F.col("n") >= least * total)
    # members of a class stand in one url, so a class is no longer than one
    classes = work.put("classes", often.groupBy("n", "m1", "m2").agg(F.array_sort(F.collect_list("item")).alias("members")).select(F.element_at("members", 1).alias("item"), "members", "n"))
    seen = spread_join(each, classes.select("item", "n"), "item", "n", total).groupBy("row").agg(F.collect_list("item").alias("items"))
    return rows.join(seen, "row", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("items"), "verdict"), classes


def mine(labelled: DataFrame, how: Mining = Mining()) -> DataFrame:
    """Rules (rule_id, items, verdict, confidence, support, rarest) from (tokens, verdict) rows.

    FP-growth finds the frequent token sets with and without a verdict; a rule's confidence
    is their ratio. A rule goes if a part of its items says the same with no less
    confidence. So no rule has two tokens that stand in the same rows: sets are mined with one token of
    each such class, which a url of many words of its own has one of, and rules are then
    written out for every token of the class. ``rarest`` is a rule's token of least count. No labelled row, no rule.
    """
    work = WorkFolder(labelled.sparkSession, "url-rules")
    rows, classes = _collapsed(labelled, how.support, work)
    baskets = work.put("baskets", rows.select(F.concat("items", F.array(F.concat(F.lit("="), "verdict"))).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=how.support, minConfidence=how.confidence).fit(baskets)
    sets = model.freqItemsets.select(F.array_sort(F.filter("items", lambda w: ~w.startswith("="))).alias("items"), F.element_at(F.concat(F.filter("items", lambda w: w.startswith("=")), F.array(F.lit("="))), 1).alias("says"), "freq")
    whole = sets.where("says = '='").select("items", F.col("freq").alias("n_items"))
    rules = sets.where("says <> '=' AND size(items) > 0").join(whole, "items")
    rules = rules.select("items", F.substring("says", 2, 10).alias("verdict"), (F.col("freq") / F.col("n_items")).alias("confidence"), F.col("freq").alias("support")).where(F.col("confidence") >= how.confidence)
    rules = work.put("all", rules.withColumn("no", F.monotonically_increasing_id()))
    drop_one = rules.withColumn("without", F.explode("items")).select("no", "verdict", "confidence", F.array_remove("items", F.col("without")).alias("items"))
    shorter = rules.select("items", "verdict", F.col("confidence").alias("c"))
    needless = drop_one.join(shorter, ["items", "verdict"]).where("c >= confidence").select("no").distinct()
    kept = rules.join(needless, "no", "left_anti")
    parts = kept.select("no", F.explode("items").alias("item")).join(classes, "item")
    parts = parts.groupBy("no").agg(F.collect_list(F.struct("n", "members")).alias("parts"))
    members = F.transform("parts", lambda p: F.transform(p["members"], lambda w: F.struct(p["n"].alias("n"), w.alias("item"))))
    none = F.array().cast("array<array<struct<n: bigint, item: string>>>")
    choices = F.aggregate(members, F.concat(none, F.array(F.array().cast("array<struct<n: bigint, item: string>>"))), lambda sofar, one: F.flatten(F.transform(sofar, lambda s: F.transform(one, lambda w: F.concat(s, F.array(w))))))
    out = kept.drop("items").join(parts.select("no", F.explode(choices).alias("choice")), "no")
    out = out.select(F.array_sort("choice.item").alias("items"), F.array_min("choice")["item"].alias("rarest"), "verdict", "confidence", "support")
    return out.withColumn("rule_id", F.md5(F.concat_ws(" ", F.array_join("items", " "), "verdict")))


def judge(pages: DataFrame, how: Mining = Mining(), rules=RULES, url: str = "url") -> DataFrame:
    """All columns of ``pages`` with host, path, rule, verdict and mined (rule id, else null).

    A url that a fixed rule fits takes its verdict and is a labelled row for mining; any
    other takes the verdict of the mined rule of highest confidence, then support, then
    most items, then allow before block, then smallest id; without one, or without a host, it
    is allowed. A null url has no host. Repeated rows come back as often as they came; an empty
    table gives an empty result. Columns of the added names are replaced, all others stay
    whatever their names.

    Mined rules stand in an inverted index under their rarest item; the others are then looked for in the url's set.
    A url of any length is read whole; its words of their own count as one in mining.
    Only rows without a fixed rule look their set up: hot ones, of which there are at most
    1 / HOT_SHARE, in a broadcast table, all others by a join on the set's key.
    """
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "mined")]
    rows = pages.select(F.struct(*[F.col(quoted(c)).alias(c) for c in columns]).alias("page"), F.col(quoted(url)).alias("url"))
    host, path = parts(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    found = mine(rows.where("verdict IS NOT NULL").select("tokens", "verdict"), how)
    asks = "verdict IS NULL AND size(tokens) > 0"
    open_rows = rows.where(asks).withColumn("key", F.xxhash64("tokens"))
    work = WorkFolder(pages.sparkSession, "url-verdicts")
    found = work.put("rules", found)
    sets = work.put("sets", open_rows.groupBy("key").agg(F.first("tokens").alias("tokens"), F.count("*").alias("copies")))
    index = found.groupBy(F.col("rarest").alias("item")).agg(F.collect_list(F.struct("items", "confidence", "support", "verdict", "rule_id")).alias("rules"))
    asked = sets.select("key", "copies", "tokens", F.explode("tokens").alias("item"))
    if found.count() <= how.broadcast_rules:
        hits = asked.join(F.broadcast(index), "item")
    else:
        often = asked.groupBy("item").agg(F.count("*").alias("sets"))
        hits = spread_join(asked, index.join(often, "item"), "item", "sets", sets.count())
    hits = hits.select("key", "copies", "tokens", F.explode("rules").alias("r")).where(F.size(F.array_except("r.items", "tokens")) == 0)
    order = F.struct(-F.col("r.confidence"), -F.col("r.support"), -F.size("r.items"), F.col("r.verdict").alias("verdict"), F.col("r.rule_id").alias("rule_id"))
    best = hits.groupBy("key").agg(F.min(order).alias("best"), F.first("copies").alias("copies"))
    best = best.select("key", F.col("best.verdict").alias("said"), F.col("best.rule_id").alias("mined"), "copies")
    best = work.put("best", best)
    bar = HOT_SHARE * pages.count()
    hot = F.broadcast(best.where(F.col("copies") > bar).drop("copies"))
    out = lambda df, said, mined: df.select("page", "host", "path", "rule", F.coalesce("verdict", said, F.lit("allow")).alias("verdict"), mined.alias("mined"))
    some = open_rows.join(hot, "key", "left")
    rest = some.where("said IS NULL").drop("said", "mined").join(best.where(F.col("copies") <= bar).drop("copies"), "key", "left")
    none = F.lit(None)
    all_ = out(rows.where(f"NOT ({asks})"), none.cast("string"), none.cast("string")).unionAll(out(some.where("said IS NOT NULL"), F.col("said"), F.col("mined"))).unionAll(out(rest, F.col("said"), F.col("mined")))
    return all_.select(*[F.col("page").getField(c).alias(c) for c in columns], "host", "path", "rule", "verdict", "mined")


def op7_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "mined")


_short = lambda c: f"CASE WHEN length({c}) > {LONG_TOKEN} THEN '#' || sha256({c}) ELSE {c} END"
_digits = lambda c: f"regexp_replace({c}, '[0-9]+', '0', 'g')"
_mark = lambda prefix, words: f"list_transform(list_filter({words}, lambda w: w <> ''), lambda w: '{prefix}' || {_short(_digits('w'))})"
_fixed = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(v, h, p)}'" for v, h, p in sorted(RULES, key=lambda r: (len(r[1] + r[2]), r), reverse=True)) + " END"

#: Item sets are enumerated for each labelled row, so this is for small tables.
OP7_SQL = f"""
WITH a AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages),
b AS (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM a),
c AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
d AS (SELECT *, {_fixed(lambda v, h, p: h + p)} AS rule, {_fixed(lambda v, h, p: v)} AS fixed, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(
    ['s:' || {_short("regexp_extract(url, '^([^:/?#]*)://', 1)")}] || {_mark('h:', "string_split(host, '.')")} || ['d:' || {_short("regexp_extract(host, '([^.]*[.][^.]*)$', 1)")}]
    || {_mark('p:', "regexp_split_to_array(path, '[/.]+')")} || {_mark('q:', "list_transform(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda kv: regexp_extract(kv, '^([^=]*)', 1))")}
    || CASE WHEN strpos(url, '#') > 0 THEN ['f:'] ELSE [] END)) END AS tokens FROM c),
least AS (SELECT ceil({Mining().support} * count(*)) AS n FROM d WHERE fixed IS NOT NULL),
w AS (SELECT r, fixed, unnest(tokens) AS item FROM d WHERE fixed IS NOT NULL),
often AS (SELECT item FROM w GROUP BY item HAVING count(*) >= (SELECT n FROM least)),
t AS (SELECT r, fixed, list(item ORDER BY item) AS items FROM w SEMI JOIN often USING (item) GROUP BY r, fixed),
g AS (SELECT items, fixed, count(*) AS n FROM t GROUP BY items, fixed),
s AS (SELECT fixed, n, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items FROM (SELECT *, unnest(range(1, 1 << len(items))) AS m FROM g)),
k AS (SELECT items, fixed AS verdict, sum(n) AS support, sum(sum(n)) OVER (PARTITION BY items) AS n_items FROM s GROUP BY items, fixed),
ru AS (SELECT items, verdict, CAST(support AS BIGINT) AS support, CAST(support AS DOUBLE) / n_items AS confidence, md5(array_to_string(items, ' ') || ' ' || verdict) AS rule_id
  FROM k WHERE support >= (SELECT n FROM least) AND CAST(support AS DOUBLE) / n_items >= {Mining().confidence}),
less AS (SELECT rule_id, verdict, confidence, list_filter(items, lambda x: x <> gone) AS items FROM (SELECT *, unnest(items) AS gone FROM ru)),
kept AS (SELECT * FROM ru ANTI JOIN (SELECT less.rule_id FROM less JOIN ru ON less.items = ru.items AND less.verdict = ru.verdict WHERE ru.confidence >= less.confidence) AS x USING (rule_id)),
sets AS (SELECT DISTINCT tokens FROM d WHERE fixed IS NULL),
hit AS (SELECT tokens, rule_id, any_value(verdict) AS verdict, any_value(confidence) AS confidence, any_value(support) AS support, any_value(len(items)) AS n
  FROM (SELECT tokens, unnest(tokens) AS item FROM sets) AS x JOIN (SELECT *, unnest(items) AS item FROM kept) AS y USING (item) GROUP BY tokens, rule_id HAVING count(*) = any_value(len(items))),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY tokens ORDER BY confidence DESC, support DESC, n DESC, verdict, rule_id) = 1)
SELECT d.page_id, d.host, d.path, d.rule, coalesce(d.fixed, best.verdict, 'allow') AS verdict, best.rule_id AS mined
FROM d LEFT JOIN best ON d.fixed IS NULL AND d.tokens = best.tokens
"""
