"""Queries on gates, sinks, resampling, logs, streams and interfaces."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from ..functions import indices as ix
from ..functions import rules
from ..functions import significance as sg
from ..functions import text as tx
from ..operators import composite, evaluate, focal, inference, scenes, verdicts
from ..operators import pixels as px
from ..sources import readers, tiff
from ..sources.readers import table
from ..sources.work import WorkFolder
from ..streaming import composite as streaming
from . import fixtures as fx
from .objects import _ZONAL, _zonal
from .registry import query, r6, sql6
from .spectral import _COARSE, _coarse, sql_t

# ------------------------------------------------------------------ gates


@query(f"WITH {fx.SQL_PAIR} SELECT count(*) AS pixels, CAST(sum(CAST(valid AS INTEGER)) AS BIGINT) AS n_valid, sum(CAST(valid AS INTEGER)) >= 100 AS enough FROM px")
def valid_gate(spark, sf_dir):
    """Whether enough pixels are valid on both dates for a test."""
    return px.valid_gate(fx.pair(spark, sf_dir), F.col("valid"))


@query(f"WITH {fx.SQL_FEATURES} SELECT x, y, sam > 0.3 OR greatest(abs(d_ndvi), abs(d_ndbi)) > 0.2 AS candidate FROM f")
def symmetric_candidate(spark, sf_dir):
    """A pixel where either the semantic or the index signal is large, whatever its sign."""
    f = fx.features(spark, sf_dir)
    hit = (F.col("sam") > 0.3) | (F.greatest(F.abs("d_ndvi"), F.abs("d_ndbi")) > 0.2)
    return f.select("x", "y", rules.two_valued(hit).alias("candidate"))


@query(f"WITH RECURSIVE {fx.SQL_COMPONENTS}, {_ZONAL} SELECT region, {sql6('mean_dq / 100.0', 'score')}, mean_dq / 100.0 >= 0.5 * 0.6 AS kept FROM z")
def merged_score_gate(spark, sf_dir):
    """Merged regions stay with half the least score of a single one."""
    z = _zonal(spark, sf_dir).withColumn("score", F.col("mean_dq") / 100.0)
    return z.select("region", r6("score"), (F.col("score") >= 0.5 * 0.6).alias("kept"))


@query(f"WITH {fx.SQL_PAIR} SELECT CAST(floor(x / 10.0) AS BIGINT) AS tx, CAST(floor(y / 10.0) AS BIGINT) AS ty, count(*) AS pixels, sum(abs(b_green) + abs(b_red) + abs(b_nir)) = 0 AS skipped, false AS bands_ok FROM px GROUP BY 1, 2")
def tile_gate(spark, sf_dir):
    """Tiles whose first three bands hold nothing are skipped; eleven bands are expected and four are there."""
    b, _ = fx.dates(spark, sf_dir)
    return readers.tile_gate(b, ix.BANDS, 10, expected=11)


@query(f"WITH {fx.SQL_PAIR}, t AS (SELECT CAST(floor(x / 10.0) AS BIGINT) AS tx, CAST(floor(y / 10.0) AS BIGINT) AS ty, count(*) AS pixels, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px GROUP BY 1, 2) SELECT *, pixels = 100 AND x0 = tx * 10 AND x1 = tx * 10 + 9 AND y0 = ty * 10 AND y1 = ty * 10 + 9 AS whole FROM t")
def chunk_check(spark, sf_dir):
    """Whether each downloaded chunk has its size and extent."""
    b, _ = fx.dates(spark, sf_dir)
    return readers.chunk_check(b, 10)


@query("SELECT p_partkey AS id, round(p_size * 16 * (p_partkey % 4 + 1) * 10 / 1000.0, 2) AS buffer_km FROM part")
def tile_buffer(spark, sf_dir):
    """Kilometres that a number of whole tiles takes at 10 m a pixel."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), scenes.buffer_km(F.col("p_size") * 16, k % 4 + 1).alias("buffer_km"))


_GRIDS = "g AS (SELECT p_partkey AS id, 32600 + p_partkey % 2 AS crs_b, 32600 + p_partkey % 3 AS crs_a, 100 + p_partkey % 2 AS w_b, 100 + p_partkey % 5 AS w_a, 10.0 AS size_b, 10.0 + CASE WHEN p_partkey % 7 = 0 THEN 0.1 ELSE 0.0 END AS size_a, 500000.0 AS x_b, 500000.0 + CASE p_partkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 10.0 WHEN 2 THEN 2.5 ELSE 0.001 END AS x_a FROM part)"


@query(f"""WITH {_GRIDS}, t AS (SELECT *, abs(x_a - x_b) / size_b AS o FROM g)
SELECT id, array_to_string(list_filter([CASE WHEN crs_b <> crs_a THEN 'different coordinate systems' END, CASE WHEN w_b <> w_a THEN 'different shapes' END, CASE WHEN abs(size_b - size_a) > 1e-6 * greatest(1.0, abs(size_b)) THEN 'different pixel sizes' END,
 CASE WHEN o > 1e-3 THEN 'different origins' END, CASE WHEN least(o - floor(o), 1 - (o - floor(o))) > 1e-3 THEN 'grids are shifted by a part of a pixel' END], lambda s: s IS NOT NULL), '; ') AS problems FROM t""")
def alignment_check(spark, sf_dir):
    """All problems of each pair of grids."""
    k = F.col("p_partkey")
    off = F.when(k % 4 == 0, 0.0).when(k % 4 == 1, 10.0).when(k % 4 == 2, 2.5).otherwise(0.001)
    g = table(spark, sf_dir, "part").select(k.alias("id"), (32600 + k % 2).alias("crs_b"), (32600 + k % 3).alias("crs_a"), (100 + k % 2).alias("w_b"), (100 + k % 5).alias("w_a"), F.lit(10.0).alias("size_b"), (10.0 + F.when(k % 7 == 0, 0.1).otherwise(0.0)).alias("size_a"), F.lit(500000.0).alias("x_b"), (500000.0 + off).alias("x_a"))
    return g.select("id", F.array_join(scenes.alignment_columns(), "; ").alias("problems"))


@query("""SELECT c_custkey AS id, array_to_string(list_filter([CASE WHEN NOT (c_custkey * 37 % 200 - 100 BETWEEN -80 AND 84) THEN 'latitude outside the UTM range' END, CASE WHEN NOT (c_custkey * 53 % 400 - 200 BETWEEN -180 AND 180) THEN 'longitude outside -180..180' END,
 CASE WHEN 2015 + c_custkey % 5 > 2017 + c_custkey % 3 THEN 'the years run backwards' END, CASE WHEN NOT (c_custkey % 14 BETWEEN 1 AND 12) THEN 'the months run backwards or do not exist' END, CASE WHEN NOT (c_custkey % 120 BETWEEN 0 AND 100) THEN 'cloud cover outside 0..100' END], lambda s: s IS NOT NULL), '; ') AS problems FROM customer""")
def argument_check(spark, sf_dir):
    """All problems of each request for a seasonal composite."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), (k * 37 % 200 - 100).alias("lat"), (k * 53 % 400 - 200).alias("lon"), (2015 + k % 5).alias("first_year"), (2017 + k % 3).alias("last_year"), (k % 14).alias("first_month"), F.lit(12).alias("last_month"), (k % 120).alias("max_cloud"))
    return rows.select("id", F.array_join(scenes.argument_columns(), "; ").alias("problems"))


# ------------------------------------------------------------------ expressions


@query(f"WITH {sql_t(False)} SELECT x, y, {sql6('-log10(greatest((1.0 + t / 2.0) * exp(-t / 2.0), 1e-300))', 'neg_log10', 4)} FROM tt")
def uncapped_significance(spark, sf_dir):
    rows = px.standardised_t(fx.features(spark, sf_dir), F.lit(True))
    return rows.select("x", "y", r6(sg.neg_log10("t", None), "neg_log10", 4))


@query(f"WITH {fx.SQL_FEATURES} SELECT x, y, " + sql6("(" + " + ".join(f"abs(a_{b} - b_{b})" for b in ix.BANDS) + ") / 4.0", "difference") + " FROM f")
def band_difference(spark, sf_dir):
    """Mean absolute difference of all bands."""
    f = fx.features(spark, sf_dir)
    return f.select("x", "y", r6(ix.mean_abs_difference(["b_" + b for b in ix.BANDS], ["a_" + b for b in ix.BANDS]), "difference"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m') ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS day FROM orders")
def dashed_dates(spark, sf_dir):
    """Eight digits become a dashed date, other texts stay."""
    d = F.to_date("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy-MM")).otherwise(F.date_format(d, "yyyyMMdd"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), tx.dashed_date(raw).alias("day"))


_byte = lambda v: f"CAST(floor(greatest(0.0, least(1.0, {v})) * 255) AS BIGINT)"


@query(f"WITH {fx.SQL_FEATURES} SELECT x, y, {_byte('-d_ndvi / 0.4')} AS loss, {_byte('d_ndvi / 0.4')} AS gain, {_byte('d_ndbi / 0.4')} AS built, {_byte('power(greatest(0.0, least(1.0, a_green / 0.3)), 0.7)')} AS green FROM f")
def index_composite(spark, sf_dir):
    """Index differences as display colours: vegetation loss, gain and built-up; and the fixed stretch."""
    f = fx.features(spark, sf_dir)
    byte = lambda c: F.floor(ix.clip(c, 0.0, 1.0) * 255)
    green = F.pow(ix.clip(F.col("a_green") / 0.3, 0.0, 1.0), F.lit(0.7))
    return f.select("x", "y", byte(-F.col("d_ndvi") / 0.4).alias("loss"), byte(F.col("d_ndvi") / 0.4).alias("gain"), byte(F.col("d_ndbi") / 0.4).alias("built"), byte(green).alias("green"))


@query(f"WITH {fx.SQL_PAIR}, q AS (SELECT quantile_cont(a_nir, 0.99) AS top, max(a_nir) AS most FROM px) SELECT x, y, {sql6('CASE WHEN most > 255 OR most <= 1 THEN greatest(0.0, least(1.0, a_nir / greatest(top, 1e-6))) * 255 ELSE a_nir END', 'grey')} FROM px, q")
def rgb_stretch(spark, sf_dir):
    """A band as 8-bit grey: stretched to its 99th percentile unless it is in range already."""
    _, a = fx.dates(spark, sf_dir)
    top, most = px.quantiles(a, ["nir"], [0.99, 1.0])["nir"]
    grey = ix.clip(F.col("nir") / max(top, 1e-6), 0.0, 1.0) * 255 if most > 255 or most <= 1 else F.col("nir").cast("double")
    return a.select("x", "y", r6(grey, "grey"))


@query(f"WITH {fx.SQL_PAIR}, m AS (SELECT avg(a_red) AS m, stddev_pop(a_red) AS s FROM px) SELECT x, y, {sql6('(a_red - m) / greatest(s, 1e-9)', 'red')} FROM px, m")
def zscore_band(spark, sf_dir):
    _, a = fx.dates(spark, sf_dir)
    return ix.zscore(a, "red").select("x", "y", r6("red"))


_E2 = 0.00669437999014
_E1 = (1 - (1 - _E2) ** 0.5) / (1 + (1 - _E2) ** 0.5)
_M = f"(y / 0.9996 / (6378137.0 * (1 - {_E2} / 4 - 3 * {_E2**2} / 64 - 5 * {_E2**3} / 256)))"


@query(f"""WITH p AS (SELECT o_orderkey AS id, 500000.0 + 10 * (o_orderkey % 50) AS e, 4000000.0 - 10 * floor(o_orderkey / 50.0) AS y FROM orders),
f AS (SELECT id, e - 500000.0 AS x, {_M} + (3 * {_E1} / 2 - 27 * {_E1**3} / 32) * sin(2 * {_M}) + (21 * {_E1**2} / 16 - 55 * {_E1**4} / 32) * sin(4 * {_M}) + 151 * {_E1**3} / 96 * sin(6 * {_M}) + 1097 * {_E1**4} / 512 * sin(8 * {_M}) AS f FROM p),
g AS (SELECT id, f, power(tan(f), 2) AS t, {_E2 / (1 - _E2)} * power(cos(f), 2) AS c, 6378137.0 / sqrt(1 - {_E2} * power(sin(f), 2)) AS n, 6378137.0 * (1 - {_E2}) / power(1 - {_E2} * power(sin(f), 2), 1.5) AS r, x FROM f),
h AS (SELECT *, x / (n * 0.9996) AS d FROM g)
SELECT id, {sql6(f"degrees(f - n * tan(f) / r * (power(d, 2) / 2 - (5 + 3 * t + 10 * c - 4 * power(c, 2) - 9 * {_E2 / (1 - _E2)}) * power(d, 4) / 24))", "lat", 7)},
 {sql6("15.0 + degrees((d - (1 + 2 * t + c) * power(d, 3) / 6) / cos(f))", "lon", 7)} FROM h""")
def pixel_lonlat(spark, sf_dir):
    """Latitude and longitude of pixels in UTM zone 33 by the series of the inverse projection."""
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), *fx.place())
    e, n = ix.affine("x", "y", fx.TRANSFORM)
    lat, lon = ix.utm_inverse(e, n, 33)
    return p.select("id", r6(lat, "lat", 7), r6(lon, "lon", 7))


#: The raster of zone 33 as seen from zone 34: the same number of pixels of 10 m from the place of its upper left one.
_NEXT = (10.0, 0.0, -40150.0, 0.0, -10.0, 4016720.0)
_EP = _E2 / (1 - _E2)
_ARC = f"6378137.0 * (f * (1 - {_E2} / 4 - 3 * {_E2**2} / 64 - 5 * {_E2**3} / 256) - sin(f * 2) * (3 * {_E2} / 8 + 3 * {_E2**2} / 32 + 45 * {_E2**3} / 1024) + sin(f * 4) * (15 * {_E2**2} / 256 + 45 * {_E2**3} / 1024) - sin(f * 6) * (35 * {_E2**3} / 3072))"
_WARP = f"""{fx.SQL_PAIR}, gr AS (SELECT x, y, {_NEXT[2]} + 10 * x - 500000.0 AS e, {_NEXT[5]} - 10 * y AS nn FROM px),
mu AS MATERIALIZED (SELECT x, y, e, {_M.replace("y", "nn", 1)} AS m FROM gr),
ft AS MATERIALIZED (SELECT x AS gx, y AS gy, e, m + (3 * {_E1} / 2 - 27 * {_E1**3} / 32) * sin(2 * m) + (21 * {_E1**2} / 16 - 55 * {_E1**4} / 32) * sin(4 * m) + 151 * {_E1**3} / 96 * sin(6 * m) + 1097 * {_E1**4} / 512 * sin(8 * m) AS f FROM mu),
s1 AS MATERIALIZED (SELECT *, power(tan(f), 2) AS t, {_EP} * power(cos(f), 2) AS c, 6378137.0 / sqrt(1 - {_E2} * power(sin(f), 2)) AS n, 6378137.0 * (1 - {_E2}) / power(1 - {_E2} * power(sin(f), 2), 1.5) AS r FROM ft),
s2 AS (SELECT *, e / (n * 0.9996) AS d FROM s1),
ll AS MATERIALIZED (SELECT gx, gy, f - n * tan(f) / r * (power(d, 2) / 2 - (5 + 3 * t + 10 * c - 4 * power(c, 2) - 9 * {_EP}) * power(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * power(t, 2) - 252 * {_EP} - 3 * power(c, 2)) * power(d, 6) / 720) AS f,
  radians(6.0) + (d - (1 + 2 * t + c) * power(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * power(c, 2) + 8 * {_EP} + 24 * power(t, 2)) * power(d, 5) / 120) / cos(f) AS l FROM s2),
s3 AS MATERIALIZED (SELECT gx, gy, f, power(tan(f), 2) AS t, {_EP} * power(cos(f), 2) AS c, 6378137.0 / sqrt(1 - {_E2} * power(sin(f), 2)) AS n, l * cos(f) AS d, {_ARC} AS a FROM ll),
s4 AS MATERIALIZED (SELECT gx, gy, 0.9996 * n * (d + (1 - t + c) * power(d, 3) / 6 + (5 - 18 * t + power(t, 2) + 72 * c - 58 * {_EP}) * power(d, 5) / 120) / 10 AS cc,
  (4000000.0 - 0.9996 * (a + n * tan(f) * (power(d, 2) / 2 + (5 - t + 9 * c + 4 * power(c, 2)) * power(d, 4) / 24 + (61 - 58 * t + power(t, 2) + 600 * c - 330 * {_EP}) * power(d, 6) / 720))) / 10 AS ll FROM s3)"""


def _warped(spark, sf_dir, smooth: bool):
    q = fx.quantity_change(spark, sf_dir)
    return focal.warp_utm(q, q.select("x", "y"), ["dq"], (33, fx.TRANSFORM), (34, _NEXT), smooth)


@query(f"WITH {_WARP} SELECT gx AS x, gy AS y, dq FROM s4 JOIN px ON px.x = CAST(floor(cc + 0.5) AS BIGINT) AND px.y = CAST(floor(ll + 0.5) AS BIGINT)")
def warp_nearest(spark, sf_dir):
    """The raster of quantity changes on a grid of the next UTM zone, nearest pixels."""
    return _warped(spark, sf_dir, False)


@query(f"""WITH {_WARP}, k AS (SELECT gx, gy, CAST(floor(cc) AS BIGINT) + i AS x, CAST(floor(ll) AS BIGINT) + j AS y, (CASE WHEN i = 1 THEN cc - floor(cc) ELSE 1 - (cc - floor(cc)) END) * (CASE WHEN j = 1 THEN ll - floor(ll) ELSE 1 - (ll - floor(ll)) END) AS w
  FROM s4, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT gx AS x, gy AS y, round(sum(w * dq) / sum(w), 3) + 0.0 AS dq FROM k JOIN px USING (x, y) WHERE w > 0.0001 GROUP BY 1, 2""")
def warp_bilinear(spark, sf_dir):
    """The same by the four pixels around each place."""
    return _warped(spark, sf_dir, True).select("x", "y", r6("dq", digits=3))


# ------------------------------------------------------------------ resampling and patches


@query(f"WITH {fx.SQL_PAIR}, {_COARSE} SELECT x, y, {sql6('v', 'swir')} FROM c")
def area_resize(spark, sf_dir):
    """Half the resolution by the mean of the pixels that a coarse one covers."""
    _, a = fx.dates(spark, sf_dir)
    return focal.area(a, 2, ["swir16"]).select("x", "y", r6("swir16", "swir"))


_cubic = lambda t: f"CASE WHEN abs({t}) <= 1 THEN 1.25 * power(abs({t}), 3) - 2.25 * power({t}, 2) + 1 WHEN abs({t}) < 2 THEN -0.75 * power(abs({t}), 3) + 3.75 * power({t}, 2) - 6 * abs({t}) + 3 ELSE 0 END"


@query(f"""WITH {fx.SQL_PAIR}, {_COARSE}, n AS (SELECT max(x) AS mx, max(y) AS my FROM c), gg AS (SELECT x, y, (x + 0.5) / 2 - 0.5 AS fx, (y + 0.5) / 2 - 0.5 AS fy FROM px),
k AS (SELECT i, j FROM (VALUES (-1), (0), (1), (2)) a(i), (VALUES (-1), (0), (1), (2)) b(j)), w AS (SELECT gg.x, gg.y, ({_cubic('(fx - floor(fx) - i)')}) * ({_cubic('(fy - floor(fy) - j)')}) AS w, greatest(0, least(mx, floor(fx) + i)) AS cx, greatest(0, least(my, floor(fy) + j)) AS cy FROM gg, k, n)
SELECT w.x, w.y, {sql6("sum(w * v)", "swir", 4)} FROM w JOIN c ON c.x = cx AND c.y = cy GROUP BY 1, 2""")
def bicubic_20m(spark, sf_dir):
    """A band of half the resolution on the fine grid by sixteen weighted neighbours."""
    _, a = fx.dates(spark, sf_dir)
    coarse = _coarse(a)
    w, h = (-(-v // 2) for v in fx.extent(spark, sf_dir))
    return focal.bicubic(coarse, a.select("x", "y"), 2, "swir", w, h).select("x", "y", r6("swir", digits=4))


@query(f"WITH {fx.SQL_PAIR}, g AS (SELECT i AS x, j AS y FROM (SELECT unnest(range(24)) AS i), (SELECT unnest(range(19)) AS j)) SELECT g.x, g.y, coalesce(px.dq, 0) AS dq FROM g LEFT JOIN px ON px.x = g.x - 2 + 10 AND px.y = g.y - 2 + 5 AND g.x BETWEEN 2 AND 21 AND g.y BETWEEN 2 AND 16")
def crop_pad(spark, sf_dir):
    """A window of 20 x 15 pixels with a border of two zeros."""
    return composite.crop_pad(fx.quantity_change(spark, sf_dir), 10, 5, 20, 15, 2, ["dq"])


@query("SELECT 0 AS scene, CAST(count(*) % 7 - 3 AS INTEGER) AS dx, CAST(count(*) % 5 - 2 AS INTEGER) AS dy FROM orders")
def phase_shift(spark, sf_dir):
    """The shift, found by blocks, between the green band of the before date and its copy moved by as many pixels as the number of orders tells.

    The copy carries the noise of the other date's quantities, and pixels moved over an edge are lost.
    """
    b, a = fx.dates(spark, sf_dir)
    n = table(spark, sf_dir, "orders").count()
    green = b.select("x", "y", F.col("green").cast("double").alias("v"))
    moved = green.select((F.col("x") + (n % 7 - 3)).alias("x"), (F.col("y") + (n % 5 - 2)).alias("y"), F.col("v").alias("w"))
    moved = moved.join(a.select("x", "y", "q"), ["x", "y"]).select("x", "y", (F.col("w") + F.col("q") / 10.0).alias("w"))
    found = focal.phase_shift(green.join(moved, ["x", "y"]).withColumn("scene", F.lit(0)), "v", "w", ("scene",), block=24)
    return found.select("scene", "dx", "dy")


# ------------------------------------------------------------------ scores and samples


@query("WITH p AS (SELECT event_type, count(*) AS n, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS p FROM events GROUP BY 1) SELECT event_type, n, " + ", ".join(sql6(f"p {s} 1.96 * sqrt(p * (1 - p) / n)", a) for s, a in (("-", "low"), ("+", "high"))) + " FROM p")
def binomial_intervals(spark, sf_dir):
    p = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg((F.col("value") > 50).cast("double")).alias("p"))
    low, high = evaluate.binomial_interval(F.col("p"), F.col("n"))
    return p.select("event_type", "n", r6(low, "low"), r6(high, "high"))


@query("WITH s AS (SELECT p_brand AS band, p_partkey AS other, p_retailprice % 100 / 100.0 AS score FROM part) SELECT band, other, " + sql6("score", "score") + ", CAST(row_number() OVER (PARTITION BY band ORDER BY score DESC, other) AS INTEGER) AS k FROM s WHERE score > 0.5 QUALIFY k <= 3")
def top_similar_bands(spark, sf_dir):
    """The three most similar others of each band, above a least similarity."""
    s = table(spark, sf_dir, "part").select(F.col("p_brand").alias("band"), F.col("p_partkey").alias("other"), (F.col("p_retailprice") % 100 / 100.0).alias("score"))
    return composite.top_similar(s, "band", "score").select("band", "other", r6("score"), "k")


@query("SELECT o_orderkey AS id FROM orders ORDER BY md5('0|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 200")
def hash_sample(spark, sf_dir):
    """A sample that every run repeats: the least digests of seed and key."""
    return px.hash_sample(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), ["id"], 200, 0)


@query("SELECT CAST(user_id % 2 AS BIGINT) AS run, event_type AS model, " + ", ".join(sql6(f"avg({v})", a, 4) for v, a in (("value", "loss"), ("value * value", "square"))) + ", count(*) AS steps FROM events GROUP BY 1, 2")
def experiment_log(spark, sf_dir):
    """Summary rows of two runs, each appended to one log."""
    log = WorkFolder(spark, "experiments")
    e = table(spark, sf_dir, "events")
    for run in (0, 1):
        rows = e.where(F.col("user_id") % 2 == run).groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("loss"), F.avg(F.col("value") * F.col("value")).alias("square"), F.count("*").alias("steps"))
        readers.append_log(rows.withColumn("run", F.lit(run).cast("long")), f"{log.path}/log")
    return readers.read_log(spark, f"{log.path}/log", "model string, loss double, square double, steps long, run long").select("run", "model", r6("loss", digits=4), r6("square", digits=4), "steps")


_MOMENT_BANDS = [f"{p}{b}" for p in ("b_", "a_") for b in ("green", "nir")]


@query(f"WITH {fx.SQL_FEATURES}, w AS (SELECT exp(-10 * sam) AS w, {', '.join(_MOMENT_BANDS)} FROM f), m AS (SELECT sum(w) AS n, " + ", ".join(f"sum(w * {c}) / sum(w) AS m_{c}" for c in _MOMENT_BANDS) + " FROM w) "
       + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(any_value(n), 3) + 0.0 AS weight, round(1e4 * (sum(w * {a} * {b}) / any_value(n) - any_value(m_{a}) * any_value(m_{b})), 5) + 0.0 AS covariance FROM w, m" for i, a in enumerate(_MOMENT_BANDS) for b in _MOMENT_BANDS[i:]))
def weighted_moments(spark, sf_dir):
    """Weighted covariances of both dates' bands, in 10 000ths, from one aggregation."""
    total, _, cov = px.weighted_moments(fx.features(spark, sf_dir), _MOMENT_BANDS, F.exp(-10 * F.col("sam")))
    rows = [(a, b, total, 1e4 * float(cov[i, j])) for i, a in enumerate(_MOMENT_BANDS) for j, b in enumerate(_MOMENT_BANDS) if j >= i]
    return spark.createDataFrame(rows, "a string, b string, weight double, covariance double").select("a", "b", r6("weight", digits=3), r6("covariance", digits=5))


@query(f"""WITH {fx.SQL_FEATURES}, g AS (SELECT CAST(floor(y / 10.0) AS BIGINT) AS zone, sam AS v FROM f), e AS (SELECT zone, min(v) AS lo, (max(v) - min(v)) / 256.0 AS step FROM g GROUP BY 1 HAVING max(v) > min(v)),
h AS (SELECT zone, least(floor((v - lo) / step), 255) AS k, CAST(count(*) AS DOUBLE) AS n, any_value(lo + (least(floor((v - lo) / step), 255) + 0.5) * step) AS mid FROM g JOIN e USING (zone) GROUP BY 1, 2),
c AS (SELECT zone, k, mid, sum(n) OVER p AS w, sum(n * mid) OVER p AS s, sum(n) OVER (PARTITION BY zone) AS a, sum(n * mid) OVER (PARTITION BY zone) AS t FROM h WINDOW p AS (PARTITION BY zone ORDER BY k ROWS UNBOUNDED PRECEDING)),
rr AS (SELECT zone, k, mid, round(w * (a - w) * power(s / w - (t - s) / (a - w), 2), 9) AS v FROM c WHERE a > w)
SELECT zone, {sql6("mid", "threshold")} FROM rr QUALIFY row_number() OVER (PARTITION BY zone ORDER BY v DESC, k) = 1""")
def otsu_threshold(spark, sf_dir):
    """The threshold between the two sides of each zone's histogram of angles."""
    f = fx.features(spark, sf_dir).select(F.floor(F.col("y") / 10.0).alias("zone"), "sam")
    return evaluate.otsu(f, "zone", "sam").select("zone", r6("threshold"))


_ROUND_T = " + ".join(f"power(b_{b} - a_{b}, 2) / 0.0005" for b in ix.BANDS)
_ROUND = [f"{p}{b}" for p in ("b_", "a_") for b in ix.BANDS]


@query(f"WITH {fx.SQL_FEATURES}, t AS (SELECT {_ROUND_T} AS t, {', '.join(_ROUND)} FROM f), w AS (SELECT (1 + t / 2) * exp(-t / 2) AS w, * FROM t), m AS (SELECT sum(w) AS n, " + ", ".join(f"sum(w * {c}) / sum(w) AS m_{c}" for c in _ROUND) + " FROM w) "
       + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(any_value(n), 3) + 0.0 AS weight, round(1e4 * (sum(w * {a} * {b}) / any_value(n) - any_value(m_{a}) * any_value(m_{b})), 5) + 0.0 AS covariance FROM w, m" for i, a in enumerate(_ROUND) for b in _ROUND[i:]))
def irmad_round(spark, sf_dir):
    """Covariances under the weights of one round whose projections are given: each band by itself, at a variance of 0.0005."""
    n = len(ix.BANDS)
    fit = px.Variates(np.zeros(2 * n), np.eye(n), np.eye(n), np.full(n, 1 - 0.00025))
    total, _, cov = px.reweighted_moments(fx.features(spark, sf_dir), _ROUND, fit)
    rows = [(a, b, total, 1e4 * float(cov[i, j])) for i, a in enumerate(_ROUND) for j, b in enumerate(_ROUND) if j >= i]
    return spark.createDataFrame(rows, "a string, b string, weight double, covariance double").select("a", "b", r6("weight", digits=3), r6("covariance", digits=5))


# ------------------------------------------------------------------ sinks and sources


def _bucketed_sides(spark, sf_dir, work):
    for name, side in zip(("before", "after"), fx.dates(spark, sf_dir)):
        yield readers.write_bucketed(side.select("x", "y", *ix.BANDS), f"scene_{name}_{work.path[-32:]}", f"{work.path}/{name}", 32, 8)


@query(f"WITH {fx.SQL_PAIR} SELECT x, y, {', '.join(p + b for p in ('b_', 'a_') for b in ix.BANDS)}, valid FROM px")
def bucketed_pair(spark, sf_dir):
    """The pair of two dates stored by tile: joined without an exchange."""
    work = WorkFolder(spark, "bucketed")
    before, after = _bucketed_sides(spark, sf_dir, work)
    with readers.co_located(spark):
        return work.put("pair", px.pair(before, after, ("ty", "tx", "y", "x")).drop("ty", "tx"))


@query(f"WITH {fx.SQL_PAIR} SELECT x, y, CAST(dq AS INTEGER) AS dq FROM px WHERE x BETWEEN 10 AND 39 AND y BETWEEN 5 AND 24")
def tiff_window(spark, sf_dir):
    """A window of the raster of quantity changes, from a folder of TIFF tiles that the query writes."""
    path = WorkFolder(spark, "tiff").path
    tiff.write_tiff(fx.quantity_change(spark, sf_dir).withColumn("dq", F.col("dq").cast("int")), path, ["dq"], 16)
    return tiff.read_tiff(spark, path, (10, 5, 30, 20))


@query("SELECT nation.n_nationkey AS tile, max(struct_pack(d := strftime(CAST(o_orderdate AS DATE), '%Y%m%d'), p := 'S2A_' || strftime(CAST(o_orderdate AS DATE), '%Y%m%d') || '_' || o_orderkey)).p AS path FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def latest_scene(spark, sf_dir):
    """The newest file of each tile's folder, ties to the later path."""
    day = F.date_format("acq_date", "yyyyMMdd")
    files = fx.scenes(spark, sf_dir).select("tile", day.alias("acq_date"), F.concat(F.lit("S2A_"), day, F.lit("_"), F.col("scene_id").cast("string")).alias("path"))
    return files.groupBy("tile").agg(readers.latest().alias("path"))


@query(f"WITH RECURSIVE {fx.SQL_COMPONENTS}, {_ZONAL} SELECT region, area_px, x, y, w, h, {sql6('mean_dq', 'mean_dq', 4)} FROM z")
def regions_csv(spark, sf_dir):
    """Regions written as CSV with a header, and read again."""
    path = f"{WorkFolder(spark, 'regions').path}/regions.csv"
    readers.write_regions_csv(_zonal(spark, sf_dir).select("region", "area_px", "x", "y", "w", "h", "mean_dq"), path)
    return spark.read.csv(path, header=True, schema="region long, area_px long, x long, y long, w long, h long, mean_dq double").withColumn("mean_dq", r6("mean_dq", digits=4))


@query(f"WITH {fx.SQL_PAIR} SELECT x, y, a_nir AS nir FROM px WHERE x BETWEEN 8 AND 27 AND y BETWEEN 4 AND 18")
def tile_window(spark, sf_dir):
    """A window of a raster written as tiles; only its tiles' files are read."""
    path = f"{WorkFolder(spark, 'tiles').path}/tiles"
    _, a = fx.dates(spark, sf_dir)
    readers.write_tiles(a.select("x", "y", "nir"), path, 16)
    return readers.tile_window(spark, path, 8, 4, 20, 15, 16).select("x", "y", "nir")


@query(f"WITH {fx.SQL_PAIR} SELECT count(*) AS pixels, CAST(sum(CAST(valid AS INTEGER)) AS BIGINT) AS n_valid, true AS same FROM px")
def run_marker(spark, sf_dir):
    """Statistics written last beside the configuration; a later run with the same one reads them."""
    path = f"{WorkFolder(spark, 'run').path}/stats"
    config = {"bands": list(ix.BANDS), "width": fx.WIDTH}
    pair = fx.pair(spark, sf_dir)
    readers.write_stats(pair.agg(F.count("*").alias("pixels"), F.sum(F.col("valid").cast("long")).alias("n_valid"), F.lit(json.dumps(config)).alias("config")), path)
    found = spark.read.schema("pixels long, n_valid long, config string").json(path)
    readers.same_config(found.first()["config"], config)
    return found.select("pixels", "n_valid", F.lit(True).alias("same"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE n_name END AS place, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE n_nationkey * 3.0 - 30 END AS lat, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE n_regionkey * 40.0 - 80 END AS lon FROM customer JOIN nation ON c_nationkey = n_nationkey")
def place_lookup(spark, sf_dir):
    """Coordinates of place names, without regard to case and blanks; unknown names have none."""
    n = table(spark, sf_dir, "nation")
    places = n.select(F.col("n_name").alias("place"), (F.col("n_nationkey") * 3.0 - 30).alias("lat"), (F.col("n_regionkey") * 40.0 - 80).alias("lon"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    asked = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.lit("nowhere")).otherwise(F.concat(F.lit("  "), F.lower("n_name"))).alias("asked"))
    return scenes.lookup(asked, places).select("id", "place", "lat", "lon")


# ------------------------------------------------------------------ streams and interfaces


@query("SELECT conv_id, turn, coalesce(text, '') AS content, turn % 2 = 0 AS done FROM conversations")
def stream_answers(spark, sf_dir):
    """Chunks of answers as newline-delimited JSON through a stream; the second run finds nothing new."""
    work = WorkFolder(spark, "answers")
    c = table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message"), (F.col("turn") % 2 == 0).alias("done"), "conv_id", "turn"))
    c.select(line.alias("value")).write.text(f"{work.path}/in")
    for _ in range(2):
        lines = spark.readStream.text(f"{work.path}/in")
        rows = streaming.answers(lines, "conv_id long, turn long")
        streaming.run_once(rows, f"{work.path}/out", f"{work.path}/mark")
    return spark.read.schema("content string, done boolean, error string, conv_id long, turn long").parquet(f"{work.path}/out").select("conv_id", "turn", "content", "done")


@query(f"""WITH {fx.SQL_SCENES}, b AS (SELECT (CAST(epoch(CAST(acq_date AS TIMESTAMP)) AS BIGINT) // 604800) * 7 AS d, tile, min(struct_pack(c := cloud_pct, s := scene_id)) AS best FROM sc GROUP BY 1, 2)
SELECT strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS start, tile, best.s AS scene_id, best.c AS cloud_pct FROM b""")
def stream_best_scene(spark, sf_dir):
    """Each tile's clearest scene of a week, from a stream of scenes and one of cloud records, in three runs.

    The second run brings repeated rows and clear scenes that are too late, the third closes the last weeks.
    """
    work = WorkFolder(spark, "arrivals")
    sc = fx.scenes(spark, sf_dir).select("scene_id", "tile", F.col("acq_date").cast("timestamp").alias("ts"), "cloud_pct")
    sc = work.put("scenes", sc.withColumn("seen", F.expr("ts + make_interval(0, 0, 0, 0, CAST(scene_id % 24 AS INT))")))
    far = lambda year: sc.limit(1).select(F.lit(-1).cast("long").alias("scene_id"), F.lit(-1).alias("tile"), F.to_timestamp(F.lit(f"{year}-01-01")).alias("ts"), F.lit(0).cast("long").alias("cloud_pct"), F.to_timestamp(F.lit(f"{year}-01-01")).alias("seen"))
    clear = sc.withColumn("cloud_pct", F.lit(-1).cast("long"))
    kinds = {"s": "scene_id long, tile int, ts timestamp", "q": "q_scene long, cloud_pct long, seen timestamp"}
    for rows in (sc.unionByName(far(2100)), sc.where("scene_id % 3 = 0").unionByName(clear).unionByName(far(2101)), far(2102)):
        rows.select(F.col("scene_id"), F.col("tile").cast("int").alias("tile"), "ts").write.mode("append").parquet(f"{work.path}/s")
        rows.select(F.col("scene_id").alias("q_scene"), F.col("cloud_pct").cast("long").alias("cloud_pct"), "seen").write.mode("append").parquet(f"{work.path}/q")
        scenes, quality = (spark.readStream.schema(kinds[k]).parquet(f"{work.path}/{k}") for k in "sq")
        streaming.run_once(streaming.best_scene(scenes, quality), f"{work.path}/out", f"{work.path}/mark")
    found = spark.read.schema("start timestamp, tile int, scene_id long, cloud_pct long").parquet(f"{work.path}/out")
    return found.where("tile >= 0").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "tile", "scene_id", "cloud_pct")


@query("""WITH t AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(value) AS n, avg(value) AS m, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2)
SELECT strftime(day, '%Y-%m-%d') AS day, event_type, n, CASE WHEN n >= 5 THEN round(m, 6) + 0.0 END AS mean, round(lo, 6) + 0.0 AS low, round(hi, 6) + 0.0 AS high FROM t""")
def daily_composites(spark, sf_dir):
    """Composites by day; the same plan runs on a stream with a watermark."""
    got = streaming.daily_composite(table(spark, sf_dir, "events"), keys=("event_type",))
    return got.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", r6("mean"), r6("low"), r6("high"))


@query("WITH t AS (SELECT CAST(floor((p_partkey - 1) / 8.0) AS BIGINT) AS batch, count(*) AS n, min(p_partkey) AS first FROM part WHERE p_partkey > 0 GROUP BY 1) SELECT batch, n || ' regions from ' || first AS answer FROM t")
def mock_audit(spark, sf_dir):
    """Regions in batches through the reviewer interface, with a client that only counts."""
    regions = table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("id"))
    return verdicts.audit(regions, lambda rows: f"{len(rows)} regions from {rows[0]['id']}")


@query(f"WITH {fx.SQL_PAIR}, t AS (SELECT CAST(floor(x / 16.0) AS BIGINT) AS tx, CAST(floor(y / 16.0) AS BIGINT) AS ty, avg(abs(a_nir - b_nir)) / 1000.0 AS d FROM px GROUP BY 1, 2) SELECT tx, ty, {sql6('1 / (1 + exp(-(d - 1)))', 'probability', 5)} FROM t")
def stub_detector(spark, sf_dir):
    """Change probability of tiles from the detector interface, with a model of one feature in place of a network."""
    pair = fx.pair(spark, sf_dir).select("x", "y", "b_nir", "a_nir")

    def model(bands: dict[str, np.ndarray]) -> float:
        d = np.nanmean(np.abs(bands["a_nir"] - bands["b_nir"])) / 1000.0
        return float(1 / (1 + np.exp(-(d - 1))))

    return inference.tile_scores(pair, ["b_nir", "a_nir"], 16, model).select("tx", "ty", r6("probability", digits=5))
