"""Queries on regions, fusion, shapes and merging."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import indices as ix
from ..functions import rules
from ..functions import significance as sg
from ..operators import composite, fusion
from ..operators import pixels as px
from ..operators import regions as rg
from ..sources.readers import geojson, table
from ..sources.work import WorkFolder
from . import fixtures as fx
from .registry import query, r6, sql6
from .spectral import sql_t


def _labelled(spark, sf_dir):
    return rg.label(fx.quantity_change(spark, sf_dir), F.col("dq") > 20, fx.WIDTH)


@query(f"WITH RECURSIVE {fx.SQL_COMPONENTS} SELECT x, y, region FROM lab")
def connected_components(spark, sf_dir):
    return _labelled(spark, sf_dir).select("x", "y", "region")


@query(f"WITH RECURSIVE {fx.SQL_COMPONENTS}, ok AS (SELECT region FROM lab JOIN px USING (x, y) GROUP BY 1 HAVING max(dq) > 60) SELECT x, y, region FROM lab WHERE region IN (SELECT region FROM ok)")
def hysteresis(spark, sf_dir):
    return rg.hysteresis(fx.quantity_change(spark, sf_dir), "dq", 20, 60, fx.WIDTH).select("x", "y", "region")


_ZONAL = """z AS (SELECT region, count(*) AS area_px, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, avg(x) AS cx, avg(y) AS cy, avg(dq) AS mean_dq
  FROM lab JOIN (SELECT x, y, dq FROM px) USING (x, y) GROUP BY 1)"""


def _zonal(spark, sf_dir):
    q = fx.quantity_change(spark, sf_dir)
    return rg.zonal(rg.label(q, F.col("dq") > 20, fx.WIDTH).join(q, ["x", "y"]), ["dq"])


@query(f"""WITH RECURSIVE {fx.SQL_COMPONENTS}, {_ZONAL}, n AS (SELECT max(y) + 1 AS hh FROM px), p AS (SELECT z.*, cx / 50.0 AS px_, cy / hh AS py_ FROM z, n)
SELECT region, area_px, x, y, w, h, {sql6("cx", "cx")}, {sql6("cy", "cy")}, {sql6("mean_dq", "mean_dq")}, round(area_px * 100.0 / 10000.0, 3) AS area_ha,
CASE WHEN py_ < 0.33 THEN CASE WHEN px_ < 0.33 THEN 'NW' WHEN px_ > 0.66 THEN 'NE' ELSE 'N' END WHEN py_ > 0.66 THEN CASE WHEN px_ < 0.33 THEN 'SW' WHEN px_ > 0.66 THEN 'SE' ELSE 'S' END
     WHEN px_ < 0.33 THEN 'W' WHEN px_ > 0.66 THEN 'E' ELSE 'center' END AS position FROM p""")
def region_stats(spark, sf_dir):
    height = fx.quantity_change(spark, sf_dir).agg(F.max("y") + 1).first()[0]
    z = rg.position(_zonal(spark, sf_dir), fx.WIDTH, height)
    return z.select("region", "area_px", "x", "y", "w", "h", r6("cx"), r6("cy"), r6("mean_dq"), ix.area_ha("area_px").alias("area_ha"), "position")


@query(f"WITH RECURSIVE {fx.SQL_COMPONENTS}, {_ZONAL} SELECT CAST(row_number() OVER (ORDER BY area_px * round(mean_dq, 1) DESC, region) AS INTEGER) AS id, region, area_px, round(mean_dq, 1) + 0.0 AS significance FROM z QUALIFY id <= 30")
def region_topk(spark, sf_dir):
    """The thirty regions of largest area times significance, renumbered."""
    z = _zonal(spark, sf_dir).withColumn("significance", F.round("mean_dq", 1) + 0.0)
    order = z.withColumn("rank_value", F.col("area_px") * F.col("significance"))
    return rg.ranked(rg.top(order, "rank_value", 30)).select("id", "region", "area_px", "significance")


@query(f"""WITH RECURSIVE {fx.SQL_COMPONENTS}, {fx.SQL_EVIDENCE.split(fx.SQL_PAIR + ",")[1]}, n AS (SELECT region, class_code, count(*) AS n FROM lab JOIN e USING (x, y) GROUP BY 1, 2)
SELECT region, CAST(class_code AS INTEGER) AS class_code FROM n QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, class_code) = 1""")
def class_majority(spark, sf_dir):
    e = px.evidence(fx.features(spark, sf_dir)).select("x", "y", F.col("class_code").cast("int").alias("class_code"))
    return rg.majority(_labelled(spark, sf_dir).join(e, ["x", "y"]))


@query(f"""WITH RECURSIVE {fx.SQL_COMPONENTS}, t AS (SELECT l.region, l.x, l.y, (SELECT count(*) FROM lab m WHERE m.region = l.region AND abs(m.x - l.x) + abs(m.y - l.y) = 1) = 4 AS core FROM lab l),
k AS (SELECT region FROM t GROUP BY 1 HAVING count(*) >= 5 AND (bool_or(core) OR count(*) >= 12)) SELECT x, y, region FROM lab WHERE region IN (SELECT region FROM k)""")
def sliver_filter(spark, sf_dir):
    return rg.without_slivers(_labelled(spark, sf_dir)).select("x", "y", "region")


_SIG = "least(1.0, t / 20.0)"
_signals = f"""{fx.SQL_EVIDENCE}, sg AS (SELECT x, y, least(1.0, abs(d_ndvi) * 2.0) AS spectral, least(1.0, sam * 4.0) AS structure, CASE WHEN d_bright > 0 THEN least(1.0, d_bright * 5.0) END AS irmad FROM e),
fu AS (SELECT *, (coalesce(irmad * 0.3, 0.0) + coalesce(spectral * 0.2, 0.0) + coalesce(structure * 0.15, 0.0)) / ((CASE WHEN irmad IS NOT NULL THEN 0.3 ELSE 0.0 END) + 0.2 + 0.15) AS fused FROM sg)"""


def _signal_rows(spark, sf_dir):
    e = px.evidence(fx.features(spark, sf_dir))
    rows = e.select("x", "y", F.least(F.lit(1.0), F.abs("d_ndvi") * 2.0).alias("spectral"), F.least(F.lit(1.0), F.col("sam") * 4.0).alias("structure"), F.when(F.col("d_bright") > 0, F.least(F.lit(1.0), F.col("d_bright") * 5.0)).alias("irmad"))
    return fusion.fuse(rows, fusion.UNIFIED_WEIGHTS)


@query(f"WITH {_signals} SELECT x, y, {sql6('spectral', 'spectral')}, {sql6('structure', 'structure')}, {sql6('irmad', 'irmad')}, {sql6('fused', 'fused')} FROM fu")
def signal_fusion(spark, sf_dir):
    """Weighted mean of the signals that exist and are not null; the missing one's weight drops out."""
    return _signal_rows(spark, sf_dir).select("x", "y", r6("spectral"), r6("structure"), r6("irmad"), r6("fused"))


@query(f"WITH {_signals} SELECT x, y, (coalesce(irmad >= 0.35, false) OR spectral >= 0.35 OR structure >= 0.25 OR fused >= 0.45) AS candidate FROM fu")
def candidate_union(spark, sf_dir):
    return fusion.candidate(_signal_rows(spark, sf_dir), fusion.UNIFIED_THRESHOLDS, opened=False).select("x", "y", "candidate")


@query(f"""WITH RECURSIVE {fx.SQL_COMPONENTS}, {_signals.split(fx.SQL_PAIR + ",")[1]}, mm AS (SELECT region, avg(irmad) AS i, avg(spectral) AS s, avg(structure) AS st, avg(fused) AS fu_ FROM lab JOIN fu USING (x, y) GROUP BY 1),
ss AS (SELECT region, i, s, list_filter([CASE WHEN fu_ >= 0.45 THEN 'fused' END, CASE WHEN i >= 0.35 THEN 'irmad' END, CASE WHEN s >= 0.35 THEN 'spectral' END, CASE WHEN st >= 0.25 THEN 'structure' END], lambda z: z IS NOT NULL) AS l FROM mm)
SELECT region, {sql6("i", "mean_irmad", 9)}, {sql6("s", "mean_spectral", 9)}, CASE WHEN len(l) > 0 THEN array_to_string(l, '+') ELSE 'none' END AS sources FROM ss""")
def signal_support(spark, sf_dir):
    from ..functions.text import source_list

    rows = _labelled(spark, sf_dir).join(_signal_rows(spark, sf_dir), ["x", "y"])
    return fusion.support(rows, fusion.UNIFIED_THRESHOLDS).select("region", r6("mean_irmad", digits=9), r6("mean_spectral", digits=9), source_list(F.col("sources")).alias("sources"))


def _boxes(spark, sf_dir):
    """Boxes from parts: 100 x 100 scenes of 20 parts each."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    return p.select(F.floor(k / 20.0).alias("scene"), k.alias("id"), (k * 37 % 80).alias("x"), (k * 53 % 80).alias("y"), (F.col("p_size") % 20 + 5).cast("long").alias("w"), (k % 15 + 5).alias("h"), F.round("p_retailprice", 2).alias("score"), F.array(F.when(k % 2 == 0, "sam").otherwise("cc")).alias("sources"))


_BOXES = "bx AS (SELECT CAST(floor(p_partkey / 20.0) AS BIGINT) AS scene, p_partkey AS id, p_partkey * 37 % 80 AS x, p_partkey * 53 % 80 AS y, CAST(p_size % 20 + 5 AS BIGINT) AS w, p_partkey % 15 + 5 AS h FROM part)"


@query(f"""WITH {_BOXES}, pr AS (SELECT a.scene, a.id AS a, b.id AS b, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS iw, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS ih, least(a.w * a.h, b.w * b.h) AS m FROM bx a JOIN bx b ON a.scene = b.scene AND a.id < b.id)
SELECT scene, a, b, round(iw * ih / CAST(m AS DOUBLE), 6) AS overlap FROM pr WHERE iw > 0 AND ih > 0 AND iw * ih / CAST(m AS DOUBLE) >= 0.4""")
def box_overlap_pairs(spark, sf_dir):
    return rg.overlapping(_boxes(spark, sf_dir), 0.4, cell=16, keys=("scene",)).select("scene", "a", "b", r6("overlap"))


_OVER = "least(e.x + e.w, x + w) - greatest(e.x, x) > 0 AND least(e.y + e.h, y + h) - greatest(e.y, y) > 0 AND (least(e.x + e.w, x + w) - greatest(e.x, x)) * (least(e.y + e.h, y + h) - greatest(e.y, y)) / CAST(least(e.w * e.h, w * h) AS DOUBLE) >= 0.4"


@query(f"""WITH RECURSIVE {_BOXES.replace(" FROM part)", ", round(p_retailprice, 2) AS score, CASE WHEN p_partkey % 2 = 0 THEN 'sam' ELSE 'cc' END AS src FROM part)")},
o AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY score DESC, id) AS k, count(*) OVER (PARTITION BY scene) AS n FROM bx),
st(scene, k, kept) AS (SELECT DISTINCT scene, CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, x BIGINT, y BIGINT, w BIGINT, h BIGINT, score DOUBLE, src VARCHAR[])[]) FROM o
 UNION ALL SELECT scene, k, CASE WHEN hit = 0 THEN list_append(kept, {{'id': id, 'x': x, 'y': y, 'w': w, 'h': h, 'score': score, 'src': [src]}})
  ELSE list_transform(kept, lambda e, i: CASE WHEN i = hit THEN {{'id': e.id, 'x': e.x, 'y': e.y, 'w': e.w, 'h': e.h, 'score': greatest(e.score, score), 'src': list_sort(list_distinct(list_append(e.src, src)))}} ELSE e END) END
  FROM (SELECT st.scene, o.k, kept, id, x, y, w, h, score, src, coalesce(list_position(list_transform(kept, lambda e: {_OVER}), true), 0) AS hit FROM st JOIN o ON o.scene = st.scene AND o.k = st.k + 1) AS t),
f AS (SELECT st.scene, unnest(kept) AS e FROM st JOIN (SELECT DISTINCT scene, n FROM o) AS z ON z.scene = st.scene AND z.n = st.k)
SELECT scene, e.id AS id, e.x AS x, e.y AS y, e.w AS w, e.h AS h, e.score AS score, array_to_string(e.src, '+') AS sources FROM f""")
def merge_regions(spark, sf_dir):
    """Greedy merging by score: SAM-like and component-like boxes of each scene."""
    return rg.greedy_merge(_boxes(spark, sf_dir), 30, 0.4).withColumn("sources", F.array_join("sources", "+"))


_METRICS = """m AS (SELECT p_partkey AS id, p_size * 7 AS area, round((p_partkey % 41) / 41.0, 2) AS rectangularity, round((p_partkey % 31) / 30.0, 2) AS solidity, round(1 + (p_partkey % 50) / 10.0, 1) AS aspect, p_partkey % 60 AS skeleton_px,
  CAST(1 + p_partkey % 8 AS INTEGER) AS class_code, round((p_partkey % 200) / 10.0, 1) AS significance, round((p_partkey % 45) / 100.0, 2) AS ndvi_after, round((p_partkey % 37) / 100.0, 2) AS ndvi_after_p25 FROM part),
k AS (SELECT *, CASE WHEN area < 16 THEN 'tiny' WHEN skeleton_px >= 12 AND area / CAST(greatest(skeleton_px, 1) AS DOUBLE) <= 6 AND aspect >= 3.5 THEN 'road-like'
  WHEN rectangularity >= 0.8 AND solidity >= 0.88 AND aspect <= 4 THEN CASE WHEN area <= 150 THEN 'building-like' ELSE 'large rectangle (field-like)' END ELSE 'irregular' END AS kind FROM m),
g AS (SELECT *, CASE WHEN kind = 'road-like' THEN ndvi_after_p25 ELSE ndvi_after END AS nv FROM k)"""


@query(f"""WITH {_METRICS}, v AS (SELECT *, CASE WHEN nv > 0.3 THEN printf('still vegetated afterwards (NDVI %.2f)', CAST(nv AS DOUBLE))
 WHEN kind = 'tiny' THEN CASE WHEN class_code IN (1, 7, 8) AND significance >= 12 THEN '' ELSE 'too small to confirm a structure' END
 WHEN kind = 'road-like' THEN CASE WHEN class_code IN (1, 2, 6, 7, 8) THEN '' ELSE 'thin line but spectral type is not road-like' END
 WHEN kind = 'building-like' THEN CASE WHEN class_code = 6 THEN 'dark compact patch - wet ground / shadow, not a roof (dark = road only if linear)' WHEN class_code IN (1, 2, 7, 8) THEN '' ELSE 'rectangular but water/vegetation change' END
 WHEN kind LIKE 'large%' THEN CASE WHEN class_code = 8 THEN '' ELSE 'rectangle larger than 150 px - looks like a farm plot' END
 WHEN class_code = 8 THEN CASE WHEN significance >= 7 THEN '' ELSE 'construction candidate but low statistical significance' END
 ELSE 'irregular outline (rectangularity ' || CAST(rectangularity AS DOUBLE) || ', solidity ' || CAST(solidity AS DOUBLE) || ') - not a building or road' END AS reason FROM g)
SELECT id, kind, reason, reason = '' AS accept FROM v""")
def structure_verdict(spark, sf_dir):
    k = F.col("p_partkey")
    m = table(spark, sf_dir, "part").select(
        k.alias("id"), (F.col("p_size") * 7).alias("area"), F.round(k % 41 / 41.0, 2).alias("rectangularity"), F.round(k % 31 / 30.0, 2).alias("solidity"), F.round(1 + k % 50 / 10.0, 1).alias("aspect"), (k % 60).alias("skeleton_px"),
        (1 + k % 8).cast("int").alias("class_code"), F.round(k % 200 / 10.0, 1).alias("significance"), F.round(k % 45 / 100.0, 2).alias("ndvi_after"), F.round(k % 37 / 100.0, 2).alias("ndvi_after_p25"),
    )
    m = m.withColumn("kind", rules.shape_kind())
    accept, reason = rules.structure_verdict()
    return m.select("id", "kind", reason.alias("reason"), accept.alias("accept"))


@query(f"""WITH RECURSIVE {fx.SQL_COMPONENTS}, {fx.SQL_EVIDENCE.split(fx.SQL_PAIR + ",")[1]}, j AS (SELECT region, avg(CASE WHEN construction_candidate THEN 1.0 ELSE 0.0 END) + 0.5 * avg(CASE WHEN built_candidate THEN 1.0 ELSE 0.0 END) + 0.3 * avg(CASE WHEN veg_loss THEN 1.0 ELSE 0.0 END) AS s, avg(sam) AS st FROM lab JOIN e USING (x, y) GROUP BY 1)
SELECT region, {sql6("s", "score")}, CASE WHEN s > 0.22 AND st > 0.15 THEN 8 ELSE 7 END AS code FROM j""")
def construction_score(spark, sf_dir):
    e = px.evidence(fx.features(spark, sf_dir))
    share = lambda c: F.avg(F.col(c).cast("double"))
    j = _labelled(spark, sf_dir).join(e.drop("dq"), ["x", "y"]).groupBy("region").agg(share("construction_candidate").alias("construction_frac"), share("built_candidate").alias("built_frac"), share("veg_loss").alias("veg_loss_frac"), F.avg("sam").alias("structure_mean"))
    score = F.col("construction_frac") + 0.5 * F.col("built_frac") + 0.3 * F.col("veg_loss_frac")
    return j.select("region", r6(score, "score"), rules.construction_code(F.lit(7)).alias("code"))


@query(f"""WITH RECURSIVE {fx.SQL_COMPONENTS}, tt AS (SELECT quantile_cont(dq, 0.6) AS thr FROM px WHERE valid), mm AS (SELECT region, avg(dq) AS m FROM lab JOIN (SELECT x, y, dq FROM px) USING (x, y) GROUP BY 1)
SELECT region, {sql6("m", "mean_score")}, m >= thr AS kept FROM mm, tt""")
def semantic_filter(spark, sf_dir):
    """Regions whose mean score is at a percentile of all valid pixels."""
    valid = fx.pair(spark, sf_dir).where("valid").select("x", "y", F.lit(True).alias("valid"))
    # written once: percentile, labels and zones read it
    q = WorkFolder(spark, "semantic").put("rows", fx.quantity_change(spark, sf_dir).join(valid, ["x", "y"], "left"))
    least = px.quantiles(q.where("valid"), ["dq"], [0.6])["dq"][0]
    z = rg.zonal(rg.label(q, F.col("dq") > 20, fx.WIDTH).join(q.select("x", "y", "dq"), ["x", "y"]), ["dq"])
    return z.select("region", r6("mean_dq", "mean_score"), (F.col("mean_dq") >= least).alias("kept"))


_SIG = "least(-log10(greatest((1.0 + t / 2.0) * exp(-t / 2.0), 1e-300)), 20.0)"


@query(f"""WITH RECURSIVE {fx.SQL_COMPONENTS}, {sql_t().split(fx.SQL_PAIR + ",")[1]},
gg AS (SELECT region, avg({_SIG}) AS sig, avg(sam) AS sam_, avg(d_ndvi) AS dv, avg(d_ndbi) AS db FROM lab JOIN e USING (x, y) JOIN tt USING (x, y) GROUP BY 1),
n AS (SELECT region, class_code, count(*) AS n FROM lab JOIN e USING (x, y) GROUP BY 1, 2), mj AS (SELECT region, class_code FROM n QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, class_code) = 1),
o AS (SELECT region, class_code, sig >= 0.5 AS significant, (sam_ < 0.05 AND abs(dv) < 0.05 AND abs(db) < 0.05 AND class_code NOT IN (4, 5)) AS brightness_only FROM gg JOIN mj USING (region))
SELECT region, CAST(class_code AS INTEGER) AS class_code, significant, brightness_only, significant AND NOT brightness_only AS kept FROM o""")
def region_gates(spark, sf_dir):
    """Regions of enough mean significance (here 0.5) that aren't a change of brightness alone; water changes are spared."""
    f = px.evidence(px.standardised_t(fx.features(spark, sf_dir), F.lit(True))).withColumn("sig", sg.neg_log10("t"))
    rows = _labelled(spark, sf_dir).join(f.drop("dq"), ["x", "y"])
    z = rg.zonal(rows, ["sig", "sam", "d_ndvi", "d_ndbi"])
    z = z.join(rg.majority(rows.select("region", F.col("class_code").cast("int").alias("class_code"))), "region")
    only = (F.col("mean_sam") < 0.05) & (F.abs("mean_d_ndvi") < 0.05) & (F.abs("mean_d_ndbi") < 0.05) & ~F.col("class_code").isin(4, 5)
    return z.select("region", "class_code", (F.col("mean_sig") >= 0.5).alias("significant"), only.alias("brightness_only")).withColumn("kept", F.col("significant") & ~F.col("brightness_only"))


@query()
def shape_metrics(spark, sf_dir):
    """Area, rectangularity, solidity, aspect, skeleton and kind of each region."""
    return rg.shapes(_labelled(spark, sf_dir)).withColumn("kind", rules.shape_kind())


#: Closed by a 3x3 square, then background that reaches no frame around the box; the hull's side on a line is the outermost of all segments between line ends.
_FILLED = """dil AS (SELECT DISTINCT region, x + i AS x, y + j AS y FROM lab, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
clo AS (SELECT region, x, y FROM (SELECT region, x + i AS x, y + j AS y FROM dil, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) GROUP BY 1, 2, 3 HAVING count(*) = 9),
bx AS (SELECT region, min(x) - 1 AS x0, max(x) + 1 AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1 FROM clo GROUP BY 1),
bg AS (SELECT * FROM (SELECT region, x0, y0, unnest(range(x0, x1 + 1)) AS x, yy AS y FROM (SELECT *, unnest(range(y0, y1 + 1)) AS yy FROM bx)) AS b ANTI JOIN clo USING (region, x, y)),
out_(region, x, y) AS (SELECT region, x, y FROM bg WHERE x = x0 AND y = y0 UNION SELECT bg.region, bg.x, bg.y FROM out_ JOIN bg ON bg.region = out_.region AND abs(bg.x - out_.x) + abs(bg.y - out_.y) = 1),
full_ AS (SELECT region, x, y FROM clo UNION ALL SELECT region, x, y FROM bg ANTI JOIN out_ USING (region, x, y))"""


@query(f"""WITH RECURSIVE {fx.SQL_COMPONENTS}, {_FILLED},
li AS (SELECT region, y, min(x) AS a, max(x) AS b FROM full_ GROUP BY 1, 2),
side AS (SELECT q.region, l.y, min(CASE WHEN q.y = p.y THEN p.a ELSE CAST(ceil(CAST(p.a * (q.y - l.y) + q.a * (l.y - p.y) AS DOUBLE) / (q.y - p.y)) AS BIGINT) END) AS lo,
    max(CASE WHEN q.y = p.y THEN p.b ELSE CAST(floor(CAST(p.b * (q.y - l.y) + q.b * (l.y - p.y) AS DOUBLE) / (q.y - p.y)) AS BIGINT) END) AS hi
  FROM li l JOIN li p ON p.region = l.region AND p.y <= l.y JOIN li q ON q.region = l.region AND q.y >= l.y AND (q.y > p.y OR p.y = l.y) GROUP BY 1, 2),
ar AS (SELECT region, CAST(count(*) AS BIGINT) AS area FROM full_ GROUP BY 1), hu AS (SELECT region, CAST(sum(hi - lo + 1) AS BIGINT) AS hull_px FROM side GROUP BY 1)
SELECT region, area, hull_px FROM ar JOIN hu USING (region)""")
def region_hulls(spark, sf_dir):
    """Pixels of each region, closed and filled, and of its convex hull; tiles of 8 pixels, so that larger regions go over tiles."""
    return rg.hulls(_labelled(spark, sf_dir), tile=8)


@query(f"""WITH RECURSIVE {fx.SQL_COMPONENTS}, st AS (SELECT unnest([-2, -1, 0, 1, 2]) AS i), nr AS (SELECT DISTINCT region, x + a.i AS x, y + b.i AS y FROM lab, st a, st b WHERE abs(a.i) + abs(b.i) <= 2),
ne AS (SELECT region, x, y, CAST(abs(dq) AS DOUBLE) AS v FROM nr JOIN px USING (x, y)),
e AS (SELECT region, min(v) AS lo, (max(v) - min(v)) / 256.0 AS step FROM ne GROUP BY 1 HAVING count(*) >= 12 AND max(v) - min(v) >= 1e-4),
h AS (SELECT region, least(floor((v - lo) / step), 255) AS k, CAST(count(*) AS DOUBLE) AS n, any_value(lo + (least(floor((v - lo) / step), 255) + 0.5) * step) AS mid FROM ne JOIN e USING (region) GROUP BY 1, 2),
c AS (SELECT region, k, mid, sum(n) OVER p AS w, sum(n * mid) OVER p AS s, sum(n) OVER (PARTITION BY region) AS a, sum(n * mid) OVER (PARTITION BY region) AS t FROM h WINDOW p AS (PARTITION BY region ORDER BY k ROWS UNBOUNDED PRECEDING)),
th AS (SELECT region, mid FROM (SELECT region, k, mid, round(w * (a - w) * power(s / w - (t - s) / (a - w), 2), 9) AS v FROM c WHERE a > w) QUALIFY row_number() OVER (PARTITION BY region ORDER BY v DESC, k) = 1),
so AS (SELECT region, x, y, y * {fx.WIDTH} + x AS p FROM ne JOIN th USING (region) WHERE v >= mid),
pc(region, p, l) AS (SELECT region, p, p FROM so UNION SELECT o.region, o.p, pc.l FROM pc JOIN so o ON o.region = pc.region AND abs(o.p % {fx.WIDTH} - pc.p % {fx.WIDTH}) <= 1 AND abs(o.p // {fx.WIDTH} - pc.p // {fx.WIDTH}) <= 1 WHERE pc.l < o.p),
pl AS (SELECT region, p, min(l) AS piece FROM pc GROUP BY 1, 2), sz AS (SELECT region, piece, count(*) AS n FROM pl GROUP BY 1, 2),
kp AS (SELECT region, piece, n FROM (SELECT *, max(n) OVER (PARTITION BY region) AS most FROM sz) WHERE n >= 6 AND n >= 0.08 * most),
gd AS (SELECT region FROM kp GROUP BY 1 HAVING sum(n) >= 4)
SELECT region, x, y FROM so SEMI JOIN (SELECT region, p FROM pl SEMI JOIN kp USING (region, piece)) USING (region, p) UNION ALL SELECT region, x, y FROM lab ANTI JOIN gd USING (region)""")
def footprint_refine(spark, sf_dir):
    """Each region's footprint from the unsmoothed quantity change around it."""
    q = fx.quantity_change(spark, sf_dir).withColumn("m", F.abs("dq").cast("double"))
    return rg.footprints(_labelled(spark, sf_dir), q, "m", width=fx.WIDTH)


@query(f"""WITH RECURSIVE {fx.SQL_COMPONENTS}, {_ZONAL} SELECT region AS id, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[' ||
 array_to_string(list_transform([[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]], lambda c: '[' || (500000 + 10 * c[1]) || '.0,' || (4000000 - 10 * c[2]) || '.0]'), ',') || ']]}},"properties":{{"id":' || region || ',"area_px":' || area_px || '}}}}' AS feature FROM z""")
def geojson_export(spark, sf_dir):
    return geojson(_zonal(spark, sf_dir).withColumnRenamed("region", "id"), fx.TRANSFORM)


_WORLD = f"SELECT region, {sql6('500000 + 10 * cx', 'easting', 4)}, {sql6('4000000 - 10 * cy', 'northing', 4)}, {sql6('cx', 'back_x', 4)}, {sql6('cy', 'back_y', 4)} FROM z"


@query(f"WITH RECURSIVE {fx.SQL_COMPONENTS}, {_ZONAL} {_WORLD}")
def affine_transform(spark, sf_dir):
    """Centroids in world coordinates, and back."""
    z = _zonal(spark, sf_dir)
    e, n = ix.affine("cx", "cy", fx.TRANSFORM)
    z = z.withColumn("e", e).withColumn("n", n)
    bx, by = ix.affine("e", "n", ix.inverse_affine(fx.TRANSFORM))
    return z.select("region", r6("e", "easting", 4), r6("n", "northing", 4), r6(bx, "back_x", 4), r6(by, "back_y", 4))


def _patches(size, stride):
    return f"""{fx.SQL_PAIR}, n AS (SELECT 50 AS w, max(y) + 1 AS h FROM px),
xs AS (SELECT DISTINCT unnest(list_concat(range(0, greatest(w - {size}, 0) + 1, {stride}), [greatest(w - {size}, 0)])) AS px_ FROM n), ys AS (SELECT DISTINCT unnest(list_concat(range(0, greatest(h - {size}, 0) + 1, {stride}), [greatest(h - {size}, 0)])) AS py_ FROM n),
pp AS (SELECT x, y, dq, px_, py_ FROM px JOIN xs ON x >= px_ AND x < px_ + {size} JOIN ys ON y >= py_ AND y < py_ + {size})"""


def _in_patches(spark, sf_dir, size=16, stride=10):
    q = fx.quantity_change(spark, sf_dir)
    return composite.in_patches(q, fx.WIDTH, fx.extent(spark, sf_dir)[1], size, stride)


@query(f"WITH {_patches(16, 10)} SELECT px_ AS px, py_ AS py, count(*) AS pixels, CAST(sum(dq) AS BIGINT) AS total FROM pp GROUP BY 1, 2")
def patch_grid(spark, sf_dir):
    """Overlapping patches; the last of each axis ends at the edge."""
    return _in_patches(spark, sf_dir).groupBy("px", "py").agg(F.count("*").alias("pixels"), F.sum("dq").alias("total"))


def _patch_means(spark, sf_dir):
    """Each pixel once for every patch that holds it, with the patch's mean; one exchange by patch, whose pixels are bounded by its size."""
    return _in_patches(spark, sf_dir).withColumn("value", F.avg("dq").over(W.partitionBy("px", "py")))


_PATCH_MEAN = "pm AS (SELECT px_, py_, avg(dq) AS m FROM pp GROUP BY 1, 2)"


@query(f"WITH {_patches(16, 10)}, {_PATCH_MEAN} SELECT x, y, {sql6('avg(m)', 'value')}, count(*) AS weight FROM pp JOIN pm USING (px_, py_) GROUP BY 1, 2")
def sliding_average(spark, sf_dir):
    """Every pixel's mean over the scores of the patches that hold it."""
    p = _patch_means(spark, sf_dir)
    return composite.overlap_mean(p, "value").select("x", "y", r6("value"), "weight")


@query(f"WITH {_patches(16, 10)}, {_PATCH_MEAN} SELECT x, y, {sql6('max_by(m, py_ * 1000 + px_)', 'value')} FROM pp JOIN pm USING (px_, py_) GROUP BY 1, 2")
def patch_last_write(spark, sf_dir):
    p = _patch_means(spark, sf_dir)
    return composite.last_wins(p, "value", "patch").select("x", "y", r6("value"))


@query(f"WITH {_patches(16, 10)}, v AS (SELECT x, y, py_ * 1000 + px_ AS seq, CASE WHEN dq > 0 THEN CAST((px_ + py_) % 200 AS INTEGER) ELSE 255 END AS v FROM pp) SELECT x, y, coalesce(min_by(v, seq) FILTER (WHERE v <> 255), 255) AS class_code FROM v GROUP BY 1, 2")
def mosaic_first(spark, sf_dir):
    """The first tile with data decides; 255 where none has any."""
    p = _in_patches(spark, sf_dir).withColumn("class_code", F.when(F.col("dq") > 0, ((F.col("px") + F.col("py")) % 200).cast("int")).otherwise(255))
    return composite.first_wins(p, "class_code", "patch").select("x", "y", "class_code")


@query(f"WITH {fx.SQL_PAIR}, n AS (SELECT max(y) + 1 AS h FROM px) SELECT h - 1 - y AS x, x AS y, dq FROM px, n")
def rotate90(spark, sf_dir):
    q = fx.quantity_change(spark, sf_dir)
    return composite.rotate90(q, q.agg(F.max("y") + 1).first()[0]).select("x", "y", "dq")


_t = sg.quantile_value


@query(f"""WITH {fx.SQL_EVIDENCE}, p(preset, lo) AS (VALUES {", ".join(f"('{k}', {_t(v[1])!r})" for k, v in rules.PRESETS.items())}), tt AS (SELECT class_code, sam * 100 AS t FROM e)
SELECT preset, CAST(class_code AS INTEGER) AS class_code, count(*) AS n, CAST(grouping(preset) * 2 + grouping(class_code) AS BIGINT) AS level FROM tt JOIN p ON t > lo GROUP BY CUBE (preset, class_code)""")
def preset_sweep(spark, sf_dir):
    """Pixels beyond each preset's growth threshold by class, with all sub-totals."""
    e = px.evidence(fx.features(spark, sf_dir)).select(F.col("class_code").cast("int").alias("class_code"), (F.col("sam") * 100).alias("t"))
    presets = F.explode(F.array(*[F.struct(F.lit(k).alias("preset"), F.lit(_t(v[1])).alias("lo")) for k, v in rules.PRESETS.items()]))
    hit = e.withColumn("p", presets).where("t > p.lo").select("p.preset", "class_code")
    return hit.cube("preset", "class_code").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query(f"""WITH RECURSIVE {fx.SQL_PAIR}, m AS (SELECT x, y FROM px WHERE dq > -60),
n AS (SELECT max(x) AS w, max(y) AS h FROM m),
bg AS (SELECT * FROM (SELECT xx AS x, unnest(range(-1, h + 2)) AS y FROM (SELECT h, unnest(range(-1, w + 2)) AS xx FROM n)) AS g ANTI JOIN m USING (x, y)),
ou(x, y) AS (SELECT x, y FROM bg WHERE x = -1 AND y = -1 UNION SELECT bg.x, bg.y FROM ou JOIN bg ON abs(bg.x - ou.x) + abs(bg.y - ou.y) = 1 AND bg.x BETWEEN ou.x - 1 AND ou.x + 1)
SELECT x, y FROM m UNION ALL SELECT x, y FROM bg ANTI JOIN ou USING (x, y)""")
def fill_holes(spark, sf_dir):
    """A mask of most pixels and its holes; tiles of 16 pixels, so that holes cross borders."""
    return rg.fill_holes(fx.quantity_change(spark, sf_dir), F.col("dq") > -60, tile=16)


#: Planted in every 300 lines of the pair of the query: two roofs, a road, a clearing and a field that turned green.
PLANTED = ((40, 40, 5, 5, None, "roof"), (60, 150, 4, 6, None, "roof"), (150, 30, 2, 90, None, "asphalt"), (200, 150, 25, 25, "vegetation", "soil"), (240, 60, 20, 20, "soil", "vegetation"))
PLANTED_LINES, PLANTED_WIDTH = 300, 200


@query()
def detect_changes(spark, sf_dir):
    """The whole change test with its default parameters on a raster of four pixels an order: all regions with their verdicts.

    Ground and noise come from the orders' prices, changes are planted in every 300 lines; the
    fixture pair has too few regions to tell the verdicts apart.
    """
    from .detect import detect_changes as detect
    from .detect import planted_pair

    spot = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.col("o_orderkey") * 4 + k))
    places = table(spark, sf_dir, "orders").select(spot.alias("at"), F.col("o_totalprice").alias("salt"))
    places = places.select((F.col("at") % PLANTED_WIDTH).cast("int").alias("x"), F.floor(F.col("at") / float(PLANTED_WIDTH)).cast("int").alias("y"), "salt")
    pair = planted_pair(places, PLANTED, clouds=((10, 140, 20, 30),), lines=PLANTED_LINES)
    found = detect(pair.drop("truth"), PLANTED_WIDTH, (places.agg(F.max("y")).first()[0] or 0) + 1)
    shown = ("region", "area_px", "x", "y", "w", "h", "class_code", "kind", "significance", "ndvi_after")
    yes = found.regions.select(*shown, F.lit(True).alias("accept"), F.lit("").alias("reason"))
    return yes.unionAll(found.rejected.select(*shown, "accept", "reason"))
