"""Queries on scene catalogs, composites and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indices as ix
from ..functions import rules
from ..functions import text as tx
from ..operators import composite, focal, scenes
from ..sources.readers import table
from . import fixtures as fx
from .registry import query, r6, sql6

_S = f"WITH {fx.SQL_SCENES}"


def _shown(df, *dates):
    """Dates as text, which every engine and file format shows alike."""
    return df.withColumns({d: F.date_format(d, "yyyy-MM-dd") for d in dates})


def _files(spark, sf_dir):
    """File names of products, as a catalog scan finds them: one band of each order line."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    band = F.element_at(F.array(*[F.lit(b) for b in (*ix.BANDS, "visual")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    name = F.concat(F.lit("S2A_"), F.lpad((F.col("l_orderkey") % 90 + 10).cast("string"), 2, "0"), F.lit("SXV_"), F.date_format("l_shipdate", "yyyyMMdd"), F.lit("_0_L2A_"), band, F.lit(".tif"))
    return li.select(name.alias("name"))


_FILES = "fi AS (SELECT 'S2A_' || lpad(CAST(l_orderkey % 90 + 10 AS VARCHAR), 2, '0') || 'SXV_' || strftime(l_shipdate, '%Y%m%d') || '_0_L2A_' || (['green','red','nir','swir16','visual'])[CAST(l_linenumber % 5 + 1 AS INTEGER)] || '.tif' AS name FROM lineitem)"


@query(f"""WITH {_FILES}, p AS (SELECT regexp_extract(name, '^(S2[ABC]_\\w{{5}}_(\\d{{8}})_\\d+)_L2A_(\\w+)\\.tif$', 1) AS product, regexp_extract(name, '_(\\d{{8}})_', 1) AS d, regexp_extract(name, '_L2A_(\\w+)\\.tif$', 1) AS band FROM fi)
SELECT d AS acq_date, substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) AS shown, CAST(count(DISTINCT band) AS BIGINT) AS bands, count(*) AS files FROM p WHERE product <> '' GROUP BY 1, 2 HAVING count(DISTINCT band) = 5""")
def scene_catalog(spark, sf_dir):
    """Dates with a file of every band, from file names."""
    f = _files(spark, sf_dir)
    p = f.select(*[F.regexp_extract("name", tx.PRODUCT, k).alias(c) for k, c in ((1, "product"), (3, "band"))], tx.file_date(F.col("name")).alias("acq_date")).where("product <> ''")
    return p.groupBy("acq_date").agg(F.count_distinct("band").alias("bands"), F.count("*").alias("files")).where("bands = 5").select("acq_date", tx.dashed_date(F.col("acq_date")).alias("shown"), "bands", "files")


@query(f"{_S}, e AS (SELECT a.tile, a.scene_id, strftime(a.acq_date, '%Y-%m-%d') AS acq_date, b.scene_id AS partner_id, abs(date_diff('day', a.acq_date, b.acq_date)) AS days FROM sc a JOIN (SELECT tile, scene_id, acq_date FROM sc QUALIFY acq_date = min(acq_date) OVER (PARTITION BY tile) OR acq_date = max(acq_date) OVER (PARTITION BY tile)) b ON a.tile = b.tile), n AS (SELECT tile FROM sc GROUP BY 1 HAVING count(*) > 1) SELECT tile, scene_id, acq_date, partner_id, CAST(days AS INTEGER) AS days FROM e WHERE tile IN (SELECT tile FROM n) QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY days DESC, partner_id) = 1")
def scene_pair_farthest(spark, sf_dir):
    return _shown(scenes.farthest_partner(fx.scenes(spark, sf_dir)), "acq_date")


@query(f"{_S}, d AS (SELECT median(epoch_us(CAST(acq_date AS TIMESTAMP))) AS m FROM sc), h AS (SELECT sc.*, epoch_us(CAST(acq_date AS TIMESTAMP)) < m AS early FROM sc, d), r AS (SELECT *, row_number() OVER (PARTITION BY tile, early ORDER BY cloud_pct, scene_id) AS k FROM h) SELECT a.tile, a.scene_id AS before_id, a.cloud_pct AS before_cloud, b.scene_id AS after_id, b.cloud_pct AS after_cloud FROM r a JOIN r b ON a.tile = b.tile WHERE a.early AND NOT b.early AND a.k = 1 AND b.k = 1")
def best_scene_pair(spark, sf_dir):
    """The clearest scene of each tile in the earlier and in the later half of the archive."""
    s = fx.scenes(spark, sf_dir).withColumn("at", F.unix_micros(F.col("acq_date").cast("timestamp")))
    middle = s.agg(F.median("at")).first()[0]
    return scenes.best_pair(s.where(F.col("at") < middle), s.where(F.col("at") >= middle))


@query(f"{_S} SELECT tile, scene_id, strftime(acq_date, '%Y-%m-%d') AS acq_date, cloud_pct FROM sc WHERE cloud_pct <= 80 QUALIFY row_number() OVER (PARTITION BY tile ORDER BY cloud_pct, scene_id) = 1")
def best_scene(spark, sf_dir):
    return _shown(scenes.best(fx.scenes(spark, sf_dir).where("cloud_pct <= 80"), ["tile"], [F.col("cloud_pct"), F.col("scene_id")]), "acq_date")


@query(f"{_S} SELECT tile, strftime(min(acq_date), '%Y-%m-%d') AS oldest, strftime(max(acq_date), '%Y-%m-%d') AS newest, min_by(scene_id, (acq_date, scene_id)) AS oldest_id, max_by(scene_id, (acq_date, scene_id)) AS newest_id, count(*) AS n FROM sc GROUP BY 1")
def oldest_newest(spark, sf_dir):
    at = F.struct("acq_date", "scene_id")
    ends = fx.scenes(spark, sf_dir).groupBy("tile").agg(F.min("acq_date").alias("oldest"), F.max("acq_date").alias("newest"), F.min_by("scene_id", at).alias("oldest_id"), F.max_by("scene_id", at).alias("newest_id"), F.count("*").alias("n"))
    return _shown(ends, "oldest", "newest")


def _quality(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene_id"))


@query(f"{_S}, q AS (SELECT DISTINCT l_orderkey AS scene_id FROM lineitem) SELECT tile, count(*) AS total, CAST(sum(CASE WHEN q.scene_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS matched FROM sc LEFT JOIN q USING (scene_id) GROUP BY 1")
def scene_qa_join(spark, sf_dir):
    """Scenes of each tile, and those that an inner join with their first quality record keeps."""
    s, q = fx.scenes(spark, sf_dir), _quality(spark, sf_dir)
    kept = scenes.with_quality(s, q).groupBy("tile").agg(F.count("*").alias("matched"))
    return s.groupBy("tile").agg(F.count("*").alias("total")).join(kept, "tile", "left").select("tile", "total", F.coalesce("matched", F.lit(0)).alias("matched"))


@query(f"{_S} SELECT scene_id, tile FROM sc WHERE scene_id NOT IN (SELECT l_orderkey FROM lineitem)")
def scene_without_qa(spark, sf_dir):
    return scenes.without_quality(fx.scenes(spark, sf_dir), _quality(spark, sf_dir)).select("scene_id", "tile")


@query(f"{_S}, l AS (SELECT l_orderkey AS scene_id, count(*) AS n, avg(l_quantity) AS prob FROM lineitem GROUP BY 1 HAVING avg(l_quantity) < 20) SELECT scene_id, {sql6('prob', 'prob')}, n FROM sc JOIN l USING (scene_id) WHERE cloud_pct < 5")
def cloud_probability_join(spark, sf_dir):
    """Clear scenes with their mean cloud probability below 20."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("scene_id")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("prob")).where("prob < 20")
    return fx.scenes(spark, sf_dir).where("cloud_pct < 5").join(p, "scene_id").select("scene_id", r6("prob"), "n")


@query(f"{_S} SELECT scene_id, strftime(acq_date, '%Y%m%d') AS d, CASE WHEN strftime(acq_date, '%Y%m%d') >= '20220125' THEN -0.1 ELSE 0.0 END AS offset_value FROM sc")
def radiometry_offset(spark, sf_dir):
    d = F.date_format("acq_date", "yyyyMMdd")
    return fx.scenes(spark, sf_dir).select("scene_id", d.alias("d"), ix.baseline_offset(d).alias("offset_value"))


@query(f"{_S} SELECT substr(sha1(concat_ws('_', CAST(scene_id AS VARCHAR), CAST(tile AS VARCHAR), strftime(acq_date, '%Y%m%d'))), 1, 16) AS sha_key, substr(md5(concat_ws('_', CAST(scene_id AS VARCHAR), CAST(tile AS VARCHAR))), 1, 16) AS md5_key, scene_id FROM sc")
def cache_key(spark, sf_dir):
    s, t, d = F.col("scene_id").cast("string"), F.col("tile").cast("string"), F.date_format("acq_date", "yyyyMMdd")
    return fx.scenes(spark, sf_dir).select(tx.cache_key(s, t, d).alias("sha_key"), tx.cache_key(s, t, kind="md5").alias("md5_key"), "scene_id")


_EV = "ev AS (SELECT user_id, event_type, value, CAST(event_id % 12 AS INTEGER) AS scl, ts FROM events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type", "value", (F.col("event_id") % 12).cast("int").alias("scl"), "ts")


@query(f"WITH {_EV} SELECT user_id, event_type, count(*) AS clear_observations, CASE WHEN count(*) >= 5 THEN median(value) END AS value FROM ev WHERE scl NOT IN (0, 1, 3, 8, 9, 10, 11) AND value IS NOT NULL GROUP BY 1, 2")
def seasonal_composite(spark, sf_dir):
    return composite.seasonal(_events(spark, sf_dir), ["user_id", "event_type"], ["value"], rules.clear_scl(F.col("scl")))


@query(f"WITH {_EV} SELECT user_id, event_type, count(*) AS n, {sql6('avg(value)', 'value')} FROM ev WHERE scl NOT IN (3, 8, 9, 10) GROUP BY 1, 2")
def mean_composite(spark, sf_dir):
    return composite.mean(_events(spark, sf_dir), ["user_id", "event_type"], ["value"], rules.clear_scl(F.col("scl"), "cloud")).select("user_id", "event_type", "n", r6("value"))


@query(f"WITH {_EV}, c AS (SELECT user_id, event_type, CASE WHEN count(*) >= 5 THEN median(value) END AS value FROM ev WHERE scl NOT IN (0, 1, 3, 8, 9, 10, 11) GROUP BY 1, 2) SELECT round(100.0 * avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END), 2) AS coverage_pct, count(*) AS n FROM c")
def valid_coverage(spark, sf_dir):
    return composite.coverage(seasonal_composite(spark, sf_dir), "value")


@query("WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders), w AS (SELECT year, make_date(year, 6, 1) AS s, make_date(year, 10, 1) AS e, make_date(year, 12, 1) AS ws, make_date(year + 1, 1, 1) AS we FROM y) SELECT w.year, strftime(s, '%Y-%m-%d') AS summer_start, strftime(e, '%Y-%m-%d') AS summer_end, strftime(ws, '%Y-%m-%d') AS winter_start, strftime(we, '%Y-%m-%d') AS winter_end, CAST(sum(CASE WHEN o_orderdate >= s AND o_orderdate < e THEN 1 ELSE 0 END) AS BIGINT) AS summer, CAST(sum(CASE WHEN o_orderdate >= ws AND o_orderdate < we THEN 1 ELSE 0 END) AS BIGINT) AS winter FROM orders JOIN w ON w.year = year(o_orderdate) GROUP BY 1, 2, 3, 4, 5")
def season_windows(spark, sf_dir):
    """Half-open season windows of each year (December ends with the year) and their scenes."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", F.year("o_orderdate").alias("year"))
    (s, e), (ws, we) = scenes.season(F.col("year"), 6, 9), scenes.season(F.col("year"), 12, 12)
    o = o.withColumns({"summer_start": s, "summer_end": e, "winter_start": ws, "winter_end": we})
    inside = lambda a, b: F.sum(((F.col("o_orderdate") >= F.col(a)) & (F.col("o_orderdate") < F.col(b))).cast("long"))
    found = o.groupBy("year", "summer_start", "summer_end", "winter_start", "winter_end").agg(inside("summer_start", "summer_end").alias("summer"), inside("winter_start", "winter_end").alias("winter"))
    return _shown(found, "summer_start", "summer_end", "winter_start", "winter_end")


@query("SELECT c_custkey, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(60, CAST(floor((lon + 180.0) / 6.0) AS INTEGER) + 1) AS INTEGER) AS epsg, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180.0) / 6.0) AS INTEGER) + 1 AS INTEGER) AS epsg_open, round(sqrt(power((lat - 35.25) * 111320.0, 2) + power((lon - 52.5) * 111320.0 * cos(radians(35.25)), 2)), 3) AS metres FROM (SELECT c_custkey, (c_custkey % 160) - 80.0 AS lat, (c_custkey % 361) - 180.0 AS lon FROM customer)")
def utm_zones(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 160 - 80.0).alias("lat"), (F.col("c_custkey") % 361 - 180.0).alias("lon"))
    return c.select("c_custkey", ix.utm_epsg("lat", "lon").alias("epsg"), ix.utm_epsg("lat", "lon", cap=False).alias("epsg_open"), F.round(ix.ground_distance_m(F.lit(35.25), F.lit(52.5), "lat", "lon"), 3).alias("metres"))


_RASTERS = "ra AS (SELECT s_suppkey AS raster_id, (s_suppkey * 37 % 900) * 1.0 AS x0, (s_suppkey * 53 % 900) * 1.0 AS y0, (s_suppkey * 37 % 900) + 120.0 AS x1, (s_suppkey * 53 % 900) + 90.0 AS y1 FROM supplier)"


def _rasters(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("raster_id"), (k * 37 % 900 * 1.0).alias("x0"), (k * 53 % 900 * 1.0).alias("y0"), (k * 37 % 900 + 120.0).alias("x1"), (k * 53 % 900 + 90.0).alias("y1"))


@query(f"WITH {_RASTERS}, pt AS (SELECT c_custkey AS point_id, (c_custkey * 71 % 1000) + 0.5 AS px, (c_custkey * 29 % 1000) + 0.5 AS py FROM customer), h AS (SELECT point_id, min(raster_id) AS r FROM pt JOIN ra ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 GROUP BY 1) SELECT point_id, coalesce(r, (SELECT min(raster_id) FROM ra)) AS raster_id, r IS NOT NULL AS inside FROM pt LEFT JOIN h USING (point_id)")
def point_in_bounds(spark, sf_dir):
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(k.alias("point_id"), (k * 71 % 1000 + 0.5).alias("px"), (k * 29 % 1000 + 0.5).alias("py"))
    r = _rasters(spark, sf_dir)
    return scenes.containing(points, r)


@query(f"WITH {_RASTERS}, c AS (SELECT raster_id, greatest(x0, 200.0) AS cx0, greatest(y0, 150.0) AS cy0, least(x1, 700.0) AS cx1, least(y1, 650.0) AS cy1 FROM ra) SELECT * FROM c WHERE cx0 < cx1 AND cy0 < cy1")
def aoi_clip(spark, sf_dir):
    return scenes.clip_bounds(_rasters(spark, sf_dir), 200.0, 150.0, 700.0, 650.0).select("raster_id", "cx0", "cy0", "cx1", "cy1")


@query("""WITH b AS (SELECT p_partkey AS id, p_partkey * 37 % 200 AS x, p_partkey * 53 % 200 AS y, p_size AS w, p_partkey % 25 + 1 AS h FROM part), s AS (SELECT *, greatest(CAST(floor(greatest(w, h) * 2.6) AS BIGINT), 24) AS side FROM b),
c AS (SELECT id, side, greatest(0, CAST(x + floor(w / 2.0) - floor(side / 2.0) AS BIGINT)) AS x0, greatest(0, CAST(y + floor(h / 2.0) - floor(side / 2.0) AS BIGINT)) AS y0 FROM s) SELECT id, x0, y0, least(225, x0 + side) AS x1, least(225, y0 + side) AS y1 FROM c""")
def crop_boxes(spark, sf_dir):
    k = F.col("p_partkey")
    b = table(spark, sf_dir, "part").select(k.alias("id"), (k * 37 % 200).alias("x"), (k * 53 % 200).alias("y"), F.col("p_size").alias("w"), (k % 25 + 1).alias("h"))
    return b.select("id", *[c.cast("long").alias(n) for c, n in zip(ix.crop_box("x", "y", "w", "h", 225, 225), ("x0", "y0", "x1", "y1"))])


_LI = ("l_quantity", "l_extendedprice", "l_discount")


def _tiles(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 25).alias("tile"), *_LI)


@query("WITH t AS (SELECT l_orderkey % 25 AS tile, l_quantity, l_extendedprice, l_discount FROM lineitem), s AS (SELECT tile, " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _LI) + " FROM t GROUP BY 1) SELECT tile, " + ", ".join(sql6(f"({c} - lo_{c}) / (hi_{c} - lo_{c})", c) for c in _LI) + " FROM t JOIN s USING (tile)")
def band_minmax_scale(spark, sf_dir):
    return composite.minmax(_tiles(spark, sf_dir), ["tile"], list(_LI)).select("tile", *[r6(c) for c in _LI])


@query("SELECT r.x, r.y, round(max(q.v), 6) + 0.0 AS peak FROM (SELECT o_orderkey % 50 AS x, CAST(floor(o_orderkey / 50.0) AS BIGINT) AS y FROM orders) r JOIN (SELECT o_orderkey % 50 AS x, CAST(floor(o_orderkey / 50.0) AS BIGINT) AS y, o_totalprice AS v FROM orders) q ON q.x BETWEEN r.x - 1 AND r.x + 1 AND q.y BETWEEN r.y - 1 AND r.y + 1 WHERE q.v > 100000 GROUP BY 1, 2")
def cloud_neighbourhood(spark, sf_dir):
    """Pixels within one of a bright one, with the brightest value there: a dilated mask that keeps its values."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").select(*fx.place(), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("v"))
    line = focal._line((), "x", "y", 1, 1)
    o = o.withColumn("r", F.max("v").over(line))
    return o.withColumn("peak", F.max("r").over(focal._line((), "y", "x", 1, 1))).where("peak IS NOT NULL").select("x", "y", r6("peak"))


@query("SELECT t.id AS tx, u.id AS ty, t.id * 3000.0 AS x0, u.id * 3000.0 AS y0 FROM (SELECT unnest(range(4)) AS id) t, (SELECT unnest(range(4)) AS id) u")
def tile_grid(spark, sf_dir):
    return scenes.tiles(10_000, 3000.0, spark)
