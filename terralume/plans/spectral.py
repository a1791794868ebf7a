"""Queries on pixels: pairing, indices, rules, statistics, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indices as ix
from ..functions import rules
from ..functions import significance as sg
from ..operators import focal
from ..operators import pixels as px
from ..sources.readers import table
from . import fixtures as fx
from .registry import query, r6, sql6

_bands = ", ".join(f"{p}{b}" for p in ("b_", "a_") for b in ix.BANDS)


@query(f"WITH {fx.SQL_PAIR} SELECT x, y, {_bands}, valid FROM px")
def pixel_pair(spark, sf_dir):
    return fx.pair(spark, sf_dir).select("x", "y", *[f"{p}{b}" for p in ("b_", "a_") for b in ix.BANDS], "valid")


@query(f"WITH {fx.SQL_SUMS} SELECT o_orderkey % 50 AS x, CAST(floor(o_orderkey / 50.0) AS BIGINT) AS y, " + ", ".join(f"CASE WHEN n_all > 0 THEN nullif({v}, 0) END AS {b}" for b, v in (("green", "300 + 90 * df"), ("nir", "3000 - 20 * qf + 40 * df"))) + ", n_all IS NULL OR 300 + 90 * df <= 0 OR 3000 - 20 * qf + 40 * df <= 0 AS nodata FROM orders LEFT JOIN s ON o_orderkey = k")
def band_stack(spark, sf_dir):
    """Long band rows pivoted to one row a pixel; a band of a pixel without lines is missing."""
    b, _ = fx.dates(spark, sf_dir)
    long = b.selectExpr("x", "y", "stack(2, 'green', green, 'nir', nir) AS (band, value)").withColumn("value", F.expr("nullif(value, 0)"))
    return px.stack_bands(long, ["x", "y"], "band", "value", ("green", "nir"))


_names = [n for n in ix.PAIRS if n not in ("ndsi",)]


@query(f"WITH {fx.SQL_PAIR}, r AS (SELECT x, y, {fx._refl} FROM px WHERE valid) SELECT x, y, " + ", ".join(sql6(fx.sql_nd("a_" + ix.PAIRS[n][0], "a_" + ix.PAIRS[n][1]), n) for n in _names) + ", " + sql6("(a_green + a_red + a_nir + a_swir16) / 4.0", "brightness") + " FROM r")
def spectral_indices(spark, sf_dir):
    rows = px.reflectance(fx.pair(spark, sf_dir).where("valid"))
    return rows.select("x", "y", *[r6(ix.index(n, "a_"), n) for n in _names], r6(ix.brightness(*["a_" + b for b in ix.BANDS]), "brightness"))


@query("""SELECT event_id, round(greatest(-1.0, least(1.0, (a - b) / greatest(a + b, 0.01))), 6) + 0.0 AS floored,
  round((a - b) / (a + b + 1e-6), 6) + 0.0 AS eps, CASE WHEN a + b <> 0 THEN round((a - b) / (a + b), 6) + 0.0 END AS raw,
  CASE WHEN abs(a + b) > 1e-6 THEN round((a - b) / (a + b), 6) + 0.0 ELSE 0.0 END AS finite,
  round(greatest(-1.0, least(1.0, (a - b) / greatest(a + b, 0.02))), 6) + 0.0 AS eight_bit
  FROM (SELECT event_id, value / 1000.0 AS a, (event_id % 7) / 10.0 AS b FROM events)""")
def index_variants(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 1000.0).alias("a"), (F.col("event_id") % 7 / 10.0).alias("b"))
    return e.select("event_id", r6(ix.nd_floor("a", "b"), "floored"), r6(ix.nd_epsilon("a", "b"), "eps"), r6(ix.nd_raw("a", "b"), "raw"), r6(ix.nd_finite("a", "b"), "finite"), r6(ix.nd_floor("a", "b", 0.02), "eight_bit"))


@query(f"WITH {fx.SQL_FEATURES} SELECT x, y, {sql6('sam', 'sam')}, {sql6('degrees(sam)', 'sam_deg', 5)}, " + sql6("sqrt(" + " + ".join(f"(a_{b} - b_{b}) * (a_{b} - b_{b})" for b in ix.BANDS) + ")", "magnitude") + ", " + sql6("(" + " + ".join(f"abs(a_{b} - b_{b})" for b in ix.BANDS) + ") / 4.0", "mean_abs") + " FROM f")
def spectral_angle(spark, sf_dir):
    before, after = (["b_" + b for b in ix.BANDS], ["a_" + b for b in ix.BANDS])
    return fx.features(spark, sf_dir).select("x", "y", r6("sam"), r6(F.degrees("sam"), "sam_deg", 5), r6(ix.magnitude(before, after), "magnitude"), r6(ix.mean_abs_difference(before, after), "mean_abs"))


_stretch = lambda c: f"CASE WHEN {c}_h > {c}_l THEN greatest(0.0, least(1.0, ({c} - {c}_l) / ({c}_h - {c}_l))) ELSE 0.0 END"


@query(f"""WITH {fx.SQL_FEATURES}, g AS (SELECT x, y, sam, abs(d_ndvi) AS change FROM f),
b AS (SELECT quantile_cont(sam, 0.02) AS sam_l, quantile_cont(sam, 0.98) AS sam_h, quantile_cont(change, 0.02) AS change_l, quantile_cont(change, 0.98) AS change_h FROM g)
SELECT x, y, {sql6(_stretch("sam"), "sam_01")}, {sql6(_stretch("change"), "change_01")} FROM g, b""")
def percentile_stretch(spark, sf_dir):
    rows = fx.features(spark, sf_dir).select("x", "y", "sam", F.abs("d_ndvi").alias("change"))
    return px.stretched(rows, ["sam", "change"]).select("x", "y", r6("sam_01"), r6("change_01"))


@query(f"WITH {fx.SQL_EVIDENCE} SELECT x, y, {', '.join(rules.RULES)}, landcover_evidence, class_code FROM e")
def evidence_masks(spark, sf_dir):
    return px.evidence(fx.features(spark, sf_dir)).select("x", "y", *rules.RULES, "landcover_evidence", F.col("class_code").cast("int").alias("class_code"))


def sql_t(evidence: bool = True) -> str:
    m = ", ".join(f"avg(a_{b} - b_{b}) AS m_{b}, var_pop(a_{b} - b_{b}) AS v_{b}" for b in ix.BANDS)
    t = " + ".join(f"power(a_{b} - b_{b} - m_{b}, 2) / greatest(v_{b}, 1e-12)" for b in ix.BANDS)
    return f"""{fx.SQL_EVIDENCE if evidence else fx.SQL_FEATURES}, mv AS (SELECT {m} FROM f), t0 AS (SELECT x, y, {t} AS t FROM f, mv),
  od AS (SELECT greatest(1.0, median(t) / {sg.MEDIAN!r}) AS o FROM t0), tt AS (SELECT x, y, t / o AS t FROM t0, od)"""


_SF = "(1.0 + t / 2.0) * exp(-t / 2.0)"


@query(f"WITH {sql_t(False)} SELECT x, y, {sql6('t', 't', 5)}, {sql6(_SF, 'p', 8)}, {sql6(f'least(-log10(greatest({_SF}, 1e-300)), 20.0)', 'neg_log10', 5)}, t > {sg.quantile_value(1e-5)!r} AS seed FROM tt")
def chi2_significance(spark, sf_dir):
    rows = px.standardised_t(fx.features(spark, sf_dir), F.lit(True))
    return rows.select("x", "y", r6("t", digits=5), r6(sg.survival("t"), "p", 8), r6(sg.neg_log10("t"), "neg_log10", 5), (F.col("t") > sg.quantile_value(1e-5)).alias("seed"))


_stages = (
    ("valid pixels", "true"), ("statistical candidate", "stat"), ("land-cover evidence", "landcover_evidence"), ("candidate", "cand"),
    ("after brightness-only veto", "cand AND NOT bo"), ("after water veto", "cand AND NOT bo AND NOT bw"),
)
_LO = sg.quantile_value(1e-3)


@query(f"""WITH {sql_t()}, j AS (SELECT e.*, t > {_LO!r} AS stat, t > {_LO!r} AND landcover_evidence AS cand,
  (sam < 0.05 AND abs(d_ndvi) < 0.05 AND abs(d_ndbi) < 0.05 AND abs(d_mndwi) < 0.05) AS bo,
  (mndwi_b > 0.10 AND mndwi_a > 0.10 AND NOT (w_gain OR w_loss)) AS bw FROM e JOIN tt USING (x, y))
""" + " UNION ALL ".join(f"SELECT {k} AS stage_no, '{n}' AS stage, CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS n FROM j" for k, (n, c) in enumerate(_stages, 1)))
def evidence_funnel(spark, sf_dir):
    """How many pixels each gate of the change test leaves, counted in one pass."""
    rows = px.evidence(px.standardised_t(fx.features(spark, sf_dir), F.lit(True)))
    stat = F.col("t") > _LO
    cand = stat & F.col("landcover_evidence")
    bo, bw = rules.brightness_only(F.col("sam")), rules.both_water()
    flags = (F.lit(True), stat, F.col("landcover_evidence"), cand, cand & ~bo, cand & ~bo & ~bw)
    return px.funnel(rows, [(n, c) for (n, _), c in zip(_stages, flags)])


@query(f"WITH {sql_t()}, j AS (SELECT e.*, t > {_LO!r} AS stat FROM e JOIN tt USING (x, y)) " + " UNION ALL ".join(f"SELECT '{r}' AS rule, CAST(sum(CASE WHEN {r} THEN 1 ELSE 0 END) AS BIGINT) AS n_valid, CAST(sum(CASE WHEN {r} AND stat THEN 1 ELSE 0 END) AS BIGINT) AS n_candidate FROM j" for r in (*rules.RULES, "landcover_evidence")))
def evidence_counts(spark, sf_dir):
    rows = px.evidence(px.standardised_t(fx.features(spark, sf_dir), F.lit(True))).withColumn("stat", F.col("t") > _LO)
    names = (*rules.RULES, "landcover_evidence")
    sums = rows.agg(*[F.sum(c.cast("long")).alias(a) for r in names for a, c in ((f"{r}_v", F.col(r)), (f"{r}_c", F.col(r) & F.col("stat")))])
    return sums.selectExpr(f"stack({len(names)}, " + ", ".join(f"'{r}', {r}_v, {r}_c" for r in names) + ") AS (rule, n_valid, n_candidate)")


_fit = "WITH " + fx.SQL_FEATURES + ", st AS (SELECT * FROM f WHERE abs(d_bright) < 0.05), ft AS (" + " UNION ALL ".join(f"SELECT '{b}' AS band, CASE WHEN count(*) < 50 OR stddev_pop(a_{b}) < 1e-4 THEN 1.0 ELSE regr_slope(b_{b}, a_{b}) END AS slope, avg(b_{b}) AS mb, avg(a_{b}) AS ma FROM st" for b in ix.BANDS) + ")"


@query(_fit + f" SELECT band, {sql6('slope', 'slope')}, {sql6('mb - slope * ma', 'intercept')} FROM ft")
def radiometric_fit(spark, sf_dir):
    fit = px.radiometric_fit(fx.features(spark, sf_dir), F.abs("d_bright") < 0.05)
    return spark.createDataFrame([(b, s, i) for b, (s, i) in fit.items()], "band string, slope double, intercept double").select("band", r6("slope"), r6("intercept"))


@query(_fit + ", sl AS (SELECT " + ", ".join(f"max(CASE WHEN band = '{b}' THEN slope END) AS s_{b}, max(CASE WHEN band = '{b}' THEN mb - slope * ma END) AS i_{b}" for b in ix.BANDS) + " FROM ft) SELECT x, y, " + ", ".join(sql6(f"greatest(0.0, least(1.0, a_{b} * s_{b} + i_{b}))", f"n_{b}") for b in ix.BANDS) + " FROM f, sl")
def normalised_after(spark, sf_dir):
    rows = fx.features(spark, sf_dir)
    fit = px.radiometric_fit(rows, F.abs("d_bright") < 0.05)
    return px.normalised(rows, fit).select("x", "y", *[r6(f"a_{b}", f"n_{b}") for b in ix.BANDS])


def _box_sql(k: int, what: str) -> str:
    return f"SELECT p.x, p.y, {what} FROM px p JOIN px q ON q.x BETWEEN p.x - {k} AND p.x + {k} AND q.y BETWEEN p.y - {k} AND p.y + {k} GROUP BY 1, 2"


@query(f"WITH {fx.SQL_PAIR} " + _box_sql(2, "CAST(sum(q.dq) AS BIGINT) AS dq_box, round(avg(q.dq), 6) + 0.0 AS dq_mean"))
def box_filter(spark, sf_dir):
    rows = fx.quantity_change(spark, sf_dir)
    return focal.box_sum(focal.box_sum(rows, "dq", 2), "dq", 2, "dq_mean", mean=True).select("x", "y", "dq_box", r6("dq_mean"))


@query(f"WITH {fx.SQL_PAIR} " + _box_sql(4, "max(CASE WHEN q.dq > 60 THEN 1 ELSE 0 END) = 1 AS grown"))
def dilate9(spark, sf_dir):
    rows = fx.quantity_change(spark, sf_dir).withColumn("m", F.col("dq") > 60)
    return focal.dilate(rows, "m", 4, "grown").select("x", "y", "grown")


_d = "d AS (SELECT p.x, p.y, max(q.m) AS v FROM m p JOIN m q ON q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY 1, 2)"
_e = "e AS (SELECT p.x, p.y, min(q.m) AS v FROM m p JOIN m q ON q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY 1, 2)"
_two = lambda src, f: f"SELECT p.x, p.y, {f}(q.v) AS v FROM {src} p JOIN {src} q ON q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY 1, 2"


@query(f"WITH {fx.SQL_PAIR}, m AS (SELECT x, y, CASE WHEN dq > 20 THEN 1 ELSE 0 END AS m FROM px), {_d}, {_e}, c AS ({_two('d', 'min')}), o AS ({_two('e', 'max')}) SELECT c.x, c.y, c.v = 1 AS closed, o.v = 1 AS opened FROM c JOIN o USING (x, y)")
def close_open(spark, sf_dir):
    rows = fx.quantity_change(spark, sf_dir).withColumn("m", F.col("dq") > 20)
    return focal.open_(focal.close(rows, "m", 1, "closed"), "m", 1, "opened").select("x", "y", "closed", "opened")


@query(f"""WITH {fx.SQL_PAIR}, o(dx, dy) AS (VALUES {", ".join(str(p) for p in focal.disk(2))}),
h AS (SELECT DISTINCT x + dx AS x, y + dy AS y FROM px, o WHERE dq > 60) SELECT px.x, px.y, h.x IS NOT NULL AS grown FROM px LEFT JOIN h USING (x, y)""")
def disk_dilate(spark, sf_dir):
    rows = fx.quantity_change(spark, sf_dir).withColumn("m", F.col("dq") > 60)
    return focal.dilate_offsets(rows, "m", focal.disk(2), "grown").select("x", "y", "grown")


_K = focal.gaussian_kernel(1.0)
_reflect = lambda c, n: f"CASE WHEN {n} = 1 THEN 0 ELSE {n} - 1 - abs(({c} % (2 * ({n} - 1)) + 2 * ({n} - 1)) % (2 * ({n} - 1)) - ({n} - 1)) END"


@query(f"""WITH {fx.SQL_PAIR}, g AS (SELECT x, y, CAST(dq AS DOUBLE) AS v FROM px), k(o, w) AS (VALUES {", ".join(f"({i - len(_K) // 2}, {w!r})" for i, w in enumerate(_K))}),
nn AS (SELECT max(x) + 1 AS nx, max(y) + 1 AS ny FROM g), a AS (SELECT g.x, g.y, sum(w * q.v) AS v FROM g, k, nn JOIN g q ON q.y = g.y AND q.x = {_reflect("(g.x + k.o)", "nx")} GROUP BY 1, 2),
b AS (SELECT a.x, a.y, sum(w * q.v) AS v FROM a, k, nn JOIN a q ON q.x = a.x AND q.y = {_reflect("(a.y + k.o)", "ny")} GROUP BY 1, 2) SELECT x, y, {sql6("v", "blurred")} FROM b""")
def gaussian_blur(spark, sf_dir):
    """Gaussian of width 1 with mirrored borders."""
    rows = fx.quantity_change(spark, sf_dir).withColumn("v", F.col("dq").cast("double"))
    return focal.convolve(rows.select("x", "y", "v"), ["v"], _K).select("x", "y", r6("v", "blurred"))


@query(f"""WITH {fx.SQL_PAIR}, g AS (SELECT x, y, dq FROM px),
l AS (SELECT x, y, dq, coalesce(lag(dq) OVER (PARTITION BY y ORDER BY x), dq) AS l, coalesce(lead(dq) OVER (PARTITION BY y ORDER BY x), dq) AS r FROM g),
h AS (SELECT x, y, r - l AS dx, l + 2 * dq + r AS sx FROM l),
gr AS (SELECT x, y, coalesce(lag(dx) OVER v, dx) + 2 * dx + coalesce(lead(dx) OVER v, dx) AS gx, coalesce(lead(sx) OVER v, sx) - coalesce(lag(sx) OVER v, sx) AS gy FROM h WINDOW v AS (PARTITION BY x ORDER BY y)),
t AS (SELECT x, y, CASE WHEN sqrt(gx * gx + gy * gy) > 60 THEN 1.0 ELSE 0.0 END AS edge FROM gr)
SELECT p.x, p.y, round(avg(q.edge), 6) + 0.0 AS edge_density FROM t p JOIN t q ON q.x BETWEEN p.x - 7 AND p.x + 7 AND q.y BETWEEN p.y - 7 AND p.y + 7 GROUP BY 1, 2""")
def edge_density(spark, sf_dir):
    return focal.edge_density(fx.quantity_change(spark, sf_dir), "dq").select("x", "y", r6("edge_density"))


@query(f"""WITH {fx.SQL_PAIR}, sa AS (SELECT a_nir AS v, count(*) AS n FROM px WHERE valid GROUP BY 1), sb AS (SELECT b_nir AS v, count(*) AS n FROM px WHERE valid GROUP BY 1),
ca AS (SELECT v, sum(n) OVER (ORDER BY v) / CAST(sum(n) OVER () AS DOUBLE) AS q FROM sa), cb AS (SELECT v, sum(n) OVER (ORDER BY v) / CAST(sum(n) OVER () AS DOUBLE) AS q FROM sb),
mp AS (SELECT ca.v, ca.q, max(cb.q) FILTER (WHERE cb.q <= ca.q) AS ql, max(cb.v) FILTER (WHERE cb.q <= ca.q) AS vl, min(cb.q) FILTER (WHERE cb.q >= ca.q) AS qh, min(cb.v) FILTER (WHERE cb.q >= ca.q) AS vh FROM ca, cb GROUP BY 1, 2)
SELECT x, y, a_nir AS nir, {sql6("CASE WHEN vl IS NULL THEN vh WHEN vh IS NULL OR qh = ql THEN vl ELSE vl + (vh - vl) * ((q - ql) / (qh - ql)) END", "matched")} FROM px JOIN mp ON a_nir = v WHERE valid""")
def histogram_match(spark, sf_dir):
    rows = fx.pair(spark, sf_dir).where("valid")
    return focal.histogram_match(rows.select("x", "y", F.col("a_nir").alias("nir")), rows.select(F.col("b_nir").alias("nir")), "nir").select("x", "y", "nir", r6("matched"))


@query(f"""WITH {fx.SQL_FEATURES}, dk AS (SELECT {", ".join(f"quantile_cont(a_{b}, 0.005) AS q_{b}" for b in ix.BANDS)} FROM f),
z AS (SELECT x, y, {", ".join(f"greatest(0.0, least(1.0, a_{b} - q_{b})) AS {b}" for b in ix.BANDS)} FROM f, dk)
SELECT x, y, ({fx.sql_nd("green", "swir16")}) > 0.40 AND green > 0.25 AND nir > 0.11 AS snow,
  green > 0.30 AND nir > 0.28 AND swir16 > 0.22 AND NOT (({fx.sql_nd("green", "swir16")}) > 0.40 AND green > 0.25 AND nir > 0.11) AS cloud,
  green > 0.05 AND nir > 0.1 AS bright FROM z""")
def cloud_snow_masks(spark, sf_dir):
    rows = fx.features(spark, sf_dir)
    dark = px.quantiles(rows, ["a_" + b for b in ix.BANDS], [0.005])
    z = {b: ix.clip(F.col("a_" + b) - dark["a_" + b][0], 0.0, 1.0) for b in ix.BANDS}
    snow, cloud = rules.snow_cloud(z["green"], z["nir"], z["swir16"])
    return rows.select("x", "y", snow.alias("snow"), cloud.alias("cloud"), ((z["green"] > 0.05) & (z["nir"] > 0.1)).alias("bright"))


_old = "0.5 * (abs(d_ndvi) + abs(d_ndbi) + abs(d_mndwi)) / 3.0 + 0.25 * abs(d_bright)"


@query(f"WITH {fx.SQL_FEATURES}, o AS (SELECT x, y, {_old} AS score FROM f), q AS (SELECT greatest(0.12, quantile_cont(score, 0.9)) AS thr FROM o) SELECT x, y, {sql6('score', 'score')}, score > thr AS changed FROM o, q")
def baseline_change(spark, sf_dir):
    """The index-difference baseline: above its 90th percentile, and above 0.12."""
    score = 0.5 * (F.abs("d_ndvi") + F.abs("d_ndbi") + F.abs("d_mndwi")) / 3.0 + 0.25 * F.abs("d_bright")
    rows = fx.features(spark, sf_dir).select("x", "y", score.alias("score"))
    least = max(0.12, px.quantiles(rows, ["score"], [0.9])["score"][0] or 0.0)
    return rows.select("x", "y", r6("score"), (F.col("score") > least).alias("changed"))


@query(f"""WITH {fx.SQL_PAIR}, p AS (SELECT quantile_cont(a_nir, 0.99) AS p99 FROM px), c AS (SELECT x, y, greatest(0.0, least(1.0, CASE WHEN p99 > 2.0 THEN a_nir / 10000.0 ELSE a_nir END)) AS nir, greatest(0.0, least(1.0, a_red * 0.0001 - 0.1)) AS tagged FROM px, p)
SELECT x, y, {sql6("nir", "nir")}, {sql6("tagged", "red_tagged")}, CASE WHEN a_is > 0 THEN false ELSE true END AS nodata FROM c JOIN (SELECT x, y, a_nir AS a_is FROM px) USING (x, y)""")
def calibration(spark, sf_dir):
    _, a = fx.dates(spark, sf_dir)
    p99 = px.quantiles(a, ["nir"], [0.99])["nir"][0]
    return a.select("x", "y", r6(ix.calibrate("nir", F.lit(float(p99))), "nir"), r6(ix.calibrate("red", None, 0.0001, -0.1), "red_tagged"), (F.col("nir") <= 0).alias("nodata"))


_eight = ", ".join(f"least(255, {p}_{b} / 20.0) AS {c}{p}" for p in "ab" for c, b in (("r", "red"), ("g", "green"), ("b", "nir")))
_greenness = lambda p: f"greatest(-1.0, least(1.0, (g{p} / 255.0 - r{p} / 255.0) / greatest(g{p} / 255.0 + r{p} / 255.0, 0.02)))"


@query(f"""WITH {fx.SQL_PAIR}, v AS (SELECT x, y, {_eight} FROM px WHERE valid)
SELECT x, y, {sql6("0.299 * ra + 0.587 * ga + 0.114 * ba", "grey")}, 0.299 * abs(ra - rb) + 0.587 * abs(ga - gb) + 0.114 * abs(ba - bb) > 30 AS differs,
{sql6(f"greatest(0.0, least(1.0, 0.5 * abs((rb + gb + bb) / 3.0 - (ra + ga + ba) / 3.0) / 255.0 + 0.5 * abs({_greenness('b')} - {_greenness('a')})))", "proxy")} FROM v""")
def rgb_proxies(spark, sf_dir):
    """Grey, thresholded grey difference, and the score of brightness and green change of 8-bit display colours."""
    eight = lambda c: F.least(F.lit(255.0), F.col(c) / 20.0)
    v = fx.pair(spark, sf_dir).where("valid").select("x", "y", *[eight(f"{p}_{b}").alias(f"{c}{p}") for p in "ab" for c, b in (("r", "red"), ("g", "green"), ("b", "nir"))])
    differs = ix.gray(*[F.abs(F.col(f"{c}a") - F.col(f"{c}b")) for c in "rgb"]) > 30
    return v.select("x", "y", r6(ix.gray("ra", "ga", "ba"), "grey"), differs.alias("differs"), r6(ix.rgb_proxy(("rb", "gb", "bb"), ("ra", "ga", "ba")), "proxy"))


_COARSE = "c AS (SELECT CAST(floor(x / 2.0) AS BIGINT) AS x, CAST(floor(y / 2.0) AS BIGINT) AS y, avg(a_swir16) AS v FROM px GROUP BY 1, 2)"


def _coarse(after):
    """Means of 2 x 2 pixels: a band of half the resolution."""
    return after.groupBy(F.floor(F.col("x") / 2.0).alias("x"), F.floor(F.col("y") / 2.0).alias("y")).agg(F.avg("swir16").alias("swir"))


@query(f"WITH {fx.SQL_PAIR}, {_COARSE} SELECT px.x, px.y, a_green AS green, {sql6('c.v', 'swir')} FROM px JOIN c ON c.x = floor(px.x / 2.0) AND c.y = floor(px.y / 2.0)")
def nearest_20m(spark, sf_dir):
    """A band of half the resolution on the fine grid, by nearest neighbour."""
    _, a = fx.dates(spark, sf_dir)
    return focal.nearest(_coarse(a), a.select("x", "y", "green"), 2, ["swir"]).select("x", "y", "green", r6("swir"))


@query(f"""WITH {fx.SQL_PAIR}, {_COARSE}, n AS (SELECT max(x) AS mx, max(y) AS my FROM c), gg AS (SELECT x, y, (x + 0.5) / 2 - 0.5 AS fx, (y + 0.5) / 2 - 0.5 AS fy FROM px),
k(i, j) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)), w AS (SELECT gg.x, gg.y, (CASE WHEN i = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) * (CASE WHEN j = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) AS w, greatest(0, least(mx, floor(fx) + i)) AS cx, greatest(0, least(my, floor(fy) + j)) AS cy FROM gg, k, n)
SELECT w.x, w.y, {sql6("sum(w * v)", "swir")} FROM w JOIN c ON c.x = cx AND c.y = cy GROUP BY 1, 2""")
def bilinear_20m(spark, sf_dir):
    """The same by bilinear interpolation between pixel centres."""
    _, a = fx.dates(spark, sf_dir)
    coarse = _coarse(a)
    w, h = (-(-v // 2) for v in fx.extent(spark, sf_dir))
    return focal.bilinear(coarse, a.select("x", "y"), 2, "swir", w, h).select("x", "y", r6("swir"))


@query()
def irmad(spark, sf_dir):
    """Iteratively reweighted change statistic of every valid pixel."""
    rows = px.reflectance(fx.pair(spark, sf_dir))
    t, _ = px.irmad(rows, F.col("valid"))
    return t.where("valid").select("x", "y", r6("t"))
