"""Queries on candidate rules, segments, similarity, windows and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indices as ix
from ..functions import rules
from ..operators import focal, fusion
from ..operators import pixels as px
from ..operators import regions as rg
from ..sources import readers
from . import fixtures as fx
from .registry import query, r6, sql6


@query(f"WITH {fx.SQL_FEATURES} SELECT x, y, d_ndbi > 0.20 OR abs(d_ndvi) > 0.15 OR sam > 0.15 AS candidate FROM f")
def directional_candidate(spark, sf_dir):
    return fx.features(spark, sf_dir).select("x", "y", fusion.directional(F.col("d_ndbi"), F.col("d_ndvi"), F.col("sam")).alias("candidate"))


@query(f"WITH {fx.SQL_FEATURES}, q AS (SELECT CASE WHEN max(sam) <= 0 THEN 1e300 ELSE quantile_cont(sam, 0.97) END AS thr FROM f) SELECT x, y, sam >= thr AS candidate FROM f, q")
def percentile_candidate(spark, sf_dir):
    """The top three percent; nothing where no score is above zero."""
    f = fx.features(spark, sf_dir).select("x", "y", "sam")
    low, high = px.quantiles(f, ["sam"], [0.97, 1.0])["sam"]
    return f.select("x", "y", (F.col("sam") >= (low if high and high > 0 else 1e300)).alias("candidate"))


@query(f"""WITH RECURSIVE {fx.SQL_COMPONENTS}, {fx.SQL_FEATURES.split(fx.SQL_PAIR + ",")[1]}, j AS (SELECT region, count(*) AS area_px, avg(CASE WHEN sam > 0.1 THEN 1.0 ELSE 0.0 END) AS o, avg(sam) AS s FROM lab JOIN f USING (x, y) GROUP BY 1)
SELECT region, area_px, {sql6("o", "overlap", 9)}, {sql6("s", "score", 9)} FROM j WHERE area_px >= 5 AND o >= 0.1 AND s >= 0.05 AND area_px <= 0.35 * (SELECT count(*) FROM f)""")
def segment_filter(spark, sf_dir):
    f = fx.features(spark, sf_dir).select("x", "y", "sam")
    seg = rg.label(fx.quantity_change(spark, sf_dir), F.col("dq") > 20, fx.WIDTH).join(f, ["x", "y"])
    rows = seg.select("region", (F.col("sam") > 0.1).alias("candidate"), F.col("sam").alias("score"))
    return fusion.segments(rows, 0.10, 0.05, 5, 0.35, f.count(), ("region",)).select("region", "area_px", r6("overlap", digits=9), r6("score", digits=9))


_near = "q.x BETWEEN p.x - 3 AND p.x + 3 AND q.y BETWEEN p.y - 3 AND p.y + 3"


@query(f"""WITH {fx.SQL_PAIR}, g AS (SELECT x, y, CAST(b_nir AS DOUBLE) AS a, CAST(a_nir AS DOUBLE) AS b FROM px),
w AS (SELECT p.x, p.y, count(*) AS n, avg(q.a) AS ma, avg(q.b) AS mb, avg(q.a * q.a) AS aa, avg(q.b * q.b) AS bb, avg(q.a * q.b) AS ab FROM g p JOIN g q ON {_near} GROUP BY 1, 2),
v AS (SELECT *, n / CAST(greatest(n - 1, 1) AS DOUBLE) AS u FROM w)
SELECT x, y, round((2 * ma * mb + 10000.0) * (2 * (ab - ma * mb) * u + 90000.0) / ((ma * ma + mb * mb + 10000.0) * ((aa - ma * ma) * u + (bb - mb * mb) * u + 90000.0)), 5) + 0.0 AS ssim FROM v""")
def band_ssim(spark, sf_dir):
    """Structural similarity of the near-infrared band of both dates in 7 x 7 windows."""
    rows = fx.pair(spark, sf_dir).select("x", "y", F.col("b_nir").alias("a"), F.col("a_nir").alias("b"))
    return focal.ssim(rows, "a", "b", 10000.0).select("x", "y", r6("ssim", digits=5))


@query(f"""WITH {fx.SQL_FEATURES}, q AS (SELECT quantile_cont(abs(d_ndvi), 0.99) AS top FROM f) SELECT x, y, {sql6("power(greatest(0.0, least(1.0, a_red / 0.3)), 0.7)", "red")}, {sql6("greatest(-1.0, least(1.0, d_ndvi / greatest(top, 1e-6)))", "signed_change")} FROM f, q""")
def display_stretch(spark, sf_dir):
    """Display values: a fixed stretch with gamma, and a signed change over its 99th percentile."""
    f = fx.features(spark, sf_dir).withColumn("size", F.abs("d_ndvi"))
    top = max(px.quantiles(f, ["size"], [0.99])["size"][0] or 0.0, 1e-6)
    return f.select("x", "y", r6(F.pow(ix.clip(F.col("a_red") / 0.3, 0.0, 1.0), F.lit(0.7)), "red"), r6(ix.clip(F.col("d_ndvi") / top, -1.0, 1.0), "signed_change"))


@query(f"""WITH RECURSIVE {fx.SQL_COMPONENTS}, j AS (SELECT region, avg(CASE WHEN (least(255, b_green / 20.0) - least(255, b_red / 20.0)) / 255.0 < 0.02 THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN (least(255, a_green / 20.0) - least(255, a_red / 20.0)) / 255.0 < 0.02 THEN 1.0 ELSE 0.0 END) AS a FROM lab JOIN px USING (x, y) GROUP BY 1)
SELECT region, {sql6("b", "bare_before", 9)}, {sql6("a", "bare_after", 9)}, least(a, b) >= 0.65 AS bare_context FROM j""")
def bare_soil_context(spark, sf_dir):
    eight = lambda c: F.least(F.lit(255.0), F.col(c) / 20.0)
    p = fx.pair(spark, sf_dir)
    rgb = p.select("x", "y", *[eight(f"{s}_{n}").alias(f"{c}_{s}") for s in "ba" for c, n in (("g", "green"), ("r", "red"))])
    lab = rg.label(fx.quantity_change(spark, sf_dir), F.col("dq") > 20, fx.WIDTH)
    return fusion.bare_soil(lab.join(rgb, ["x", "y"])).select("region", r6("bare_before", digits=9), r6("bare_after", digits=9), "bare_context")


@query(f"""WITH {fx.SQL_EVIDENCE}, st AS (SELECT x, y FROM e WHERE sam > 0.1), sp AS (SELECT x, y FROM e WHERE landcover_evidence)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM st UNION SELECT * FROM sp) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM st INTERSECT SELECT * FROM sp) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM st EXCEPT SELECT * FROM sp)""")
def mask_sets(spark, sf_dir):
    """Union, intersection and difference of the statistical and the spectral mask as sets of pixels."""
    e = px.evidence(fx.features(spark, sf_dir))
    s, v = e.where("sam > 0.1").select("x", "y"), e.where("landcover_evidence").select("x", "y")
    n = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n(s.union(v).distinct(), "union").unionAll(n(s.intersect(v), "intersect")).unionAll(n(s.subtract(v), "except"))


@query(f"WITH {fx.SQL_PAIR} SELECT x - 10 AS x, y - 5 AS y, b_nir, a_nir, valid FROM px WHERE x >= 10 AND x < 40 AND y >= 5 AND y < 25")
def aoi_window(spark, sf_dir):
    """A window of the scene on both dates, places counted from its corner."""
    w = readers.aoi(fx.pair(spark, sf_dir), 10, 5, 30, 20)
    return w.select((F.col("x") - 10).alias("x"), (F.col("y") - 5).alias("y"), "b_nir", "a_nir", "valid")


@query("WITH b AS (SELECT p_partkey AS band_no, p_name || ' ' || p_type AS description FROM part) SELECT band_no, description FROM b WHERE contains(lower(description), 'economy') QUALIFY row_number() OVER (ORDER BY band_no) = 1")
def band_lookup(spark, sf_dir):
    """The first band whose description holds a word."""
    p = readers.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("band_no"), F.concat_ws(" ", "p_name", "p_type").alias("description"))
    return readers.band_like(p, "economy")


@query(f"WITH {fx.SQL_EVIDENCE}, d AS (SELECT * FROM (VALUES {', '.join(str(c) for c in rules.CLASSES)}) t(code, name)) SELECT CAST(class_code AS INTEGER) AS class_code, name, count(*) AS n, {sql6('avg(d_ndvi)', 'd_ndvi', 9)} FROM e JOIN d ON class_code = code GROUP BY ROLLUP (class_code, name) HAVING grouping(name) = 0 OR grouping(class_code) = 1")
def class_names(spark, sf_dir):
    """Pixels and mean change of each named class, and of all."""
    e = px.evidence(fx.features(spark, sf_dir)).select(F.col("class_code").cast("int").alias("class_code"), "d_ndvi")
    names = spark.createDataFrame([(c, n) for c, n in rules.CLASSES], "class_code int, name string")
    r = e.join(F.broadcast(names), "class_code").rollup("class_code", "name").agg(F.count("*").alias("n"), F.avg("d_ndvi").alias("d"), F.grouping_id().alias("g"))
    return r.where("g IN (0, 3)").select("class_code", "name", "n", r6("d", "d_ndvi", 9))
