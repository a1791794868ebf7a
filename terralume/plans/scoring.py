"""Queries on accuracy, shares, embeddings, verdicts and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indices as ix
from ..functions import text as tx
from ..operators import evaluate, verdicts
from ..sources.readers import table
from ..streaming.composite import daily_composite
from . import fixtures as fx
from .registry import query, r6, sql6


@query("SELECT CAST(p_size % 4 AS INTEGER) AS code, count(*) AS pixels, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent, count(*) * 100.0 / 1e6 AS area_km2 FROM part GROUP BY 1")
def class_share(spark, sf_dir):
    return evaluate.class_share(table(spark, sf_dir, "part").select((F.col("p_size") % 4).cast("int").alias("code")), "code")


_CODE = "CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 250 ELSE 255 END"


def _codes(spark, sf_dir, shift: int = 0):
    k = (F.col("l_linenumber") + shift) % 4
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("image"), F.when(k == 0, 0).when(k == 1, 1).when(k == 2, 250).otherwise(255).alias("code"))


@query(f"WITH c AS (SELECT l_suppkey % 40 AS image, {_CODE} AS code FROM lineitem), n AS (SELECT image, count(*) AS t, sum(CASE WHEN code IN (250, 255) THEN 1 ELSE 0 END) AS b, sum(CASE WHEN code = 250 THEN 1 ELSE 0 END) AS r FROM c GROUP BY 1) SELECT image, {sql6('b / CAST(t AS DOUBLE)', 'bu_prop')}, CASE WHEN b > 0 THEN round(r / CAST(b AS DOUBLE), 6) END AS p250_in_bu, CASE WHEN b > 0 THEN round((b - r) / CAST(b AS DOUBLE), 6) END AS p255_in_bu FROM n")
def bu_proportions(spark, sf_dir):
    return evaluate.built_up(_codes(spark, sf_dir), "image", "code").select("image", r6("bu_prop"), r6("p250_in_bu"), r6("p255_in_bu"))


_prop = lambda k: f"(SELECT l_suppkey % 40 AS image, sum(CASE WHEN (l_linenumber + {k}) % 4 IN (2, 3) THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1)"


@query(f"WITH o AS {_prop(0)}, p AS {_prop(1)}, j AS (SELECT coalesce(o.image, p.image) AS image, coalesce(o.v, 0) AS a, coalesce(p.v, 0) AS b FROM o FULL JOIN p ON o.image = p.image) SELECT image, 'ORIG' AS type, round(a, 6) + 0.0 AS value FROM j UNION ALL SELECT image, 'PRED', round(b, 6) + 0.0 FROM j UNION ALL SELECT image, 'DIFF', round(abs(a - b), 6) + 0.0 FROM j")
def orig_pred_diff(spark, sf_dir):
    side = lambda k: evaluate.built_up(_codes(spark, sf_dir, k), "image", "code")
    return evaluate.compare_proportions(side(0), side(1), "image", "bu_prop").select("image", "type", r6("value"))


_CELLS = "ce AS (SELECT t.v AS t, p.v AS p, (SELECT count(*) FROM labels WHERE quality = t.v AND toxic = p.v) AS n FROM (VALUES (0), (1)) t(v), (VALUES (0), (1)) p(v))"


def _cells(spark, sf_dir):
    return evaluate.confusion(table(spark, sf_dir, "labels").select("quality", "toxic"), "quality", "toxic", 2)


@query(f"WITH {_CELLS} SELECT t, p, n FROM ce")
def confusion_matrix(spark, sf_dir):
    return _cells(spark, sf_dir)


_SCORES = f"""{_CELLS}, su AS (SELECT t, sum(n) AS support, sum(CASE WHEN t = p THEN n ELSE 0 END) AS hit FROM ce GROUP BY 1), fo AS (SELECT p, sum(n) AS found FROM ce GROUP BY 1),
cs AS (SELECT t AS class, CAST(support AS BIGINT) AS support, CASE WHEN support > 0 THEN hit / CAST(support AS DOUBLE) END AS accuracy, CASE WHEN found > 0 THEN hit / CAST(found AS DOUBLE) END AS precision, CASE WHEN support + found > 0 THEN 2.0 * hit / CAST(support + found AS DOUBLE) END AS dice FROM su JOIN fo ON t = p)"""


@query(f"WITH {_SCORES} SELECT class, support, {sql6('accuracy', 'accuracy')}, {sql6('precision', 'precision')}, {sql6('dice', 'dice')} FROM cs")
def class_scores(spark, sf_dir):
    return evaluate.class_scores(_cells(spark, sf_dir)).select("class", "support", r6("accuracy"), r6("precision"), r6("dice"))


@query(f"WITH {_SCORES} SELECT {sql6('avg(accuracy)', 'mean_accuracy')}, {sql6('sum(coalesce(dice, 0.0) * support) / CAST(sum(support) AS DOUBLE)', 'weighted_dice')}, CAST(sum(support) AS BIGINT) AS n FROM cs")
def segmentation_scores(spark, sf_dir):
    return evaluate.summary(evaluate.class_scores(_cells(spark, sf_dir))).select(r6("mean_accuracy"), r6("weighted_dice"), "n")


@query("WITH c AS (SELECT CAST(sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN quality <> 1 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN quality = 1 AND toxic <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM labels) SELECT tp, fp, fn, round(tp / CAST(greatest(tp + fp, 1) AS DOUBLE), 6) AS precision, round(tp / CAST(greatest(tp + fn, 1) AS DOUBLE), 6) AS recall FROM c")
def precision_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("t"), (F.col("toxic") == 1).alias("p"))
    return evaluate.precision_recall(rows, "t", "p").select("tp", "fp", "fn", r6("precision"), r6("recall"))


@query(f"WITH s AS (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY 1) SELECT event_type, n, {sql6('mean', 'mean')}, {sql6('mean - 1.96 * sd / sqrt(n)', 'low')}, {sql6('mean + 1.96 * sd / sqrt(n)', 'high')} FROM s")
def confidence_intervals(spark, sf_dir):
    return evaluate.intervals(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", "n", r6("mean"), r6("low"), r6("high"))


@query(f"WITH e AS (SELECT event_type, value, CAST(user_id AS DOUBLE) AS u FROM events), r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY event_type ORDER BY u) + (count(*) OVER (PARTITION BY event_type, u) - 1) / 2.0 AS ru FROM e) SELECT event_type, {sql6('corr(rv, ru)', 'spearman')}, {sql6('regr_slope(value, u)', 'slope')}, {sql6('regr_intercept(value, u)', 'intercept', 5)}, count(*) AS n FROM r GROUP BY 1")
def spearman_fit(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value", F.col("user_id").cast("double").alias("u"))
    return evaluate.rank_correlation(e, "u", "value", "event_type").select("event_type", r6("spearman"), r6("slope"), r6("intercept", digits=5), "n")


_LI = ("l_quantity", "l_extendedprice", "l_discount")


@query("WITH t AS (SELECT l_orderkey % 25 AS tile, " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _LI) + " FROM lineitem GROUP BY 1) " + " UNION ALL ".join(f"SELECT '{c}' AS band, {sql6(f'avg(m_{c})', 'mean', 5)}, {sql6(f'avg(s_{c})', 'std', 5)} FROM t" for c in _LI))
def band_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 25).alias("tile"), *_LI)
    return evaluate.band_stats(rows, "tile", list(_LI)).select("band", r6("mean", digits=5), r6("std", digits=5))


_P = (("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS band, '{b}' AS other, {sql6(f'avg(({a} - {b}) * ({a} - {b}))', 'mse')} FROM lineitem" for a, b in _P))
def band_similarity_mse(spark, sf_dir):
    return evaluate.band_mse(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).select("band", "other", r6("mse"))


@query(f"""WITH e AS (SELECT vec_id, label, embedding FROM embeddings), n AS (SELECT a.vec_id, a.label, greatest(0.0, least(2.0, 1.0 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))))) AS d FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, label, {sql6('d', 'distance', 5)} FROM n""")
def cosine_change(spark, sf_dir):
    """Distance of each patch token from that of the following date."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    return e.join(nxt, "vec_id").select("vec_id", "label", r6(ix.cosine_distance("embedding", "after"), "distance", 5))


_ANSWERS = r"""an AS (SELECT conv_id, '#' || (conv_id % 9 + 1) || ': ' || CASE WHEN max(turn) % 3 = 0 THEN 'new roof - CONFIRMED' WHEN max(turn) % 3 = 1 THEN 'cloud, REJECTED' ELSE 'no significant change CONFIRMED' END || chr(10) || count(*) || ') seen twice' || chr(10) || 'a line without a number' AS answer FROM conversations GROUP BY 1)"""


def _answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").groupBy("conv_id").agg(F.max("turn").alias("t"), F.count("*").alias("n"))
    word = F.when(F.col("t") % 3 == 0, "new roof - CONFIRMED").when(F.col("t") % 3 == 1, "cloud, REJECTED").otherwise("no significant change CONFIRMED")
    return c.select("conv_id", F.concat(F.lit("#"), (F.col("conv_id") % 9 + 1).cast("string"), F.lit(": "), word, F.lit("\n"), F.col("n").cast("string"), F.lit(") seen twice\na line without a number")).alias("answer"))


@query(rf"""WITH {_ANSWERS}, l AS (SELECT conv_id, unnest(string_split(answer, chr(10))) AS line, generate_subscripts(string_split(answer, chr(10)), 1) AS pos FROM an),
h AS (SELECT conv_id, pos, CAST(regexp_extract(line, '^\W*#?(\d+)\s*[:.)\-]\s*(.+)$', 1) AS INTEGER) AS region_id, trim(regexp_extract(line, '^\W*#?(\d+)\s*[:.)\-]\s*(.+)$', 2)) AS answer FROM l WHERE regexp_matches(line, '^\W*#?(\d+)\s*[:.)\-]\s*(.+)$'))
SELECT conv_id, region_id, max_by(answer, pos) AS answer, contains(upper(max_by(answer, pos)), 'CONFIRMED') AND NOT contains(replace(upper(max_by(answer, pos)), 'NO SIGNIFICANT CHANGE', ''), 'REJECTED') AS confirmed FROM h GROUP BY 1, 2""")
def vlm_line_parse(spark, sf_dir):
    return verdicts.numbered_lines(_answers(spark, sf_dir), "conv_id", "answer")


def _audit_text(spark, sf_dir):
    """Reviewer JSON of three kinds: clean, in need of repair, broken."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    i, k = F.col("event_id"), F.col("event_id") % 3
    real = F.when(i % 2 == 1, "true").otherwise("false")
    clean = F.concat(F.lit('{"regions":[{"id":'), i.cast("string"), F.lit(',"real_change":'), real, F.lit(',"category":"'), F.col("event_type"), F.lit('","reason":"clear"}]}'))
    mend = F.concat(F.lit('Here you are: {regions:[{id:"'), i.cast("string"), F.lit('",real_change:"'), F.when(i % 2 == 1, "Yes").otherwise("no"), F.lit('",category:"'), F.col("event_type"), F.lit('",},{"id":"x","real_change":true},]} bye'))
    return e.select("event_id", F.when(k == 0, clean).when(k == 1, mend).otherwise("no json {at all").alias("answer"))


@query("SELECT event_id, CAST(event_id AS INTEGER) AS id, event_id % 2 = 1 AS real_change, event_type AS category, CASE event_id % 3 WHEN 0 THEN 'clear' ELSE '' END AS reason FROM events WHERE event_id % 3 < 2")
def audit_json_parse(spark, sf_dir):
    return verdicts.parse_audit(_audit_text(spark, sf_dir), "event_id", "answer")


@query("WITH r AS (SELECT p_partkey AS id, p_size AS area_px FROM part), v AS (SELECT event_id AS id, event_id % 2 = 1 AS real_change FROM events WHERE event_id % 3 < 2) SELECT id, area_px, real_change, CASE WHEN real_change IS NULL THEN 'UNREVIEWED' WHEN real_change THEN 'REAL' ELSE 'FALSE POSITIVE' END AS status FROM r LEFT JOIN v USING (id)")
def verdict_join(spark, sf_dir):
    regions = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("area_px"))
    v = verdicts.parse_audit(_audit_text(spark, sf_dir), "event_id", "answer").select(F.col("event_id").alias("id"), "real_change")
    return verdicts.join_verdicts(regions, v).select("id", "area_px", "real_change", "status")


@query(r"""WITH r AS (SELECT p_partkey AS id, (['N', 'S', 'center'])[CAST(p_partkey % 3 + 1 AS INTEGER)] AS position, CAST(p_size AS BIGINT) AS area_px, round(p_size * 100.0 / 10000.0, 3) AS area_ha, (p_partkey % 100) / 100.0 - 0.5 AS dn, (p_partkey % 50) / 1000.0 AS db FROM part)
SELECT id, printf('#%d: position=%s, size=%d px (%.3f ha), dNDVI=%+.2f, dBrightness=%+.3f, sources=%s', id, position, area_px, area_ha, dn, db, CASE WHEN id % 3 = 0 THEN 'none' WHEN id % 2 = 0 THEN 'cc+sam' ELSE 'sam' END) AS line FROM r""")
def evidence_report(spark, sf_dir):
    k = F.col("p_partkey")
    r = table(spark, sf_dir, "part").select(
        k.alias("id"), F.element_at(F.array(F.lit("N"), F.lit("S"), F.lit("center")), (k % 3 + 1).cast("int")).alias("position"), F.col("p_size").cast("long").alias("area_px"), ix.area_ha("p_size").alias("area_ha"),
        (k % 100 / 100.0 - 0.5).alias("d_ndvi"), (k % 50 / 1000.0).alias("d_bright"), F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 2 == 0, F.array(F.lit("sam"), F.lit("cc"))).otherwise(F.array(F.lit("sam"))).alias("sources"),
    )
    return verdicts.evidence_lines(r)


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def chat_window(spark, sf_dir):
    return verdicts.last_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("SELECT CAST(floor((p_partkey - 1) / 8.0) AS BIGINT) AS batch, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1")
def review_batches(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").groupBy(F.floor((k - 1) / 8.0).alias("batch")).agg(F.count("*").alias("n"), F.min(k).alias("first_id"))


@query("SELECT l_returnflag AS truth, l_linestatus AS predicted, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM lineitem GROUP BY 1, 2")
def value_counts(spark, sf_dir):
    from pyspark.sql import Window as W

    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("truth"), F.col("l_linestatus").alias("predicted")).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 4))


@query("SELECT doc_id, replace(source, 'src', 's ') AS shown, regexp_extract(source, '(\\d+)$', 1) AS number, printf('https://maps.example/?q=%.5f,%.5f', doc_id / 1000.0, doc_id / 10000.0) AS link FROM documents")
def file_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.select("doc_id", F.replace("source", F.lit("src"), F.lit("s ")).alias("shown"), F.regexp_extract("source", r"(\d+)$", 1).alias("number"), F.format_string("https://maps.example/?q=%.5f,%.5f", F.col("doc_id") / 1000.0, F.col("doc_id") / 10000.0).alias("link"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, user_id, event_type, count(value) AS n, CASE WHEN count(value) >= 5 THEN round(avg(value), 6) END AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2, 3")
def stream_composite(spark, sf_dir):
    """The streaming daily composite on a batch; a test drives the same plan as a stream."""
    d = daily_composite(table(spark, sf_dir, "events"))
    return d.withColumn("day", F.col("day").cast("timestamp_ntz")).withColumn("mean", F.round("mean", 6))


@query(f"WITH {fx.SQL_PAIR} SELECT CAST(sum(CASE WHEN valid THEN 1 ELSE 0 END) AS BIGINT) AS valid_px, round(100.0 * avg(CASE WHEN valid AND dq > 20 THEN 1.0 ELSE 0.0 END), 4) AS changed_pct, round(sum(CASE WHEN valid AND dq > 20 THEN 1 ELSE 0 END) * 100.0 / 10000.0, 3) AS changed_ha FROM px")
def change_summary(spark, sf_dir):
    p = fx.pair(spark, sf_dir).join(fx.quantity_change(spark, sf_dir), ["x", "y"])
    hit = F.col("valid") & (F.col("dq") > 20)
    return p.agg(F.sum(F.col("valid").cast("long")).alias("valid_px"), F.round(100.0 * F.avg(hit.cast("double")), 4).alias("changed_pct"), ix.area_ha(F.sum(hit.cast("long"))).alias("changed_ha"))


@query("WITH m AS (SELECT DISTINCT l_partkey AS id FROM lineitem) SELECT 'both' AS side, count(*) AS n FROM part JOIN m ON p_partkey = id UNION ALL SELECT 'only_image', count(*) FROM part WHERE p_partkey NOT IN (SELECT id FROM m) UNION ALL SELECT 'only_mask', count(*) FROM m WHERE id NOT IN (SELECT p_partkey FROM part)")
def image_mask_pairs(spark, sf_dir):
    """Images and masks matched by the number at the end of their names."""
    img = table(spark, sf_dir, "part").select(tx.file_id(F.concat(F.lit("img_tile_"), F.col("p_partkey").cast("string"), F.lit(".tif"))).alias("id"))
    mask = table(spark, sf_dir, "lineitem").select(tx.file_id(F.concat(F.lit("mask_"), F.col("l_partkey").cast("string"), F.lit(".tif"))).alias("id")).distinct()
    n = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return n(img.join(mask, "id"), "both").unionAll(n(img.join(mask, "id", "left_anti"), "only_image")).unionAll(n(mask.join(img, "id", "left_anti"), "only_mask"))
