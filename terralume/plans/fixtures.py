"""Raster, catalog and region tables derived from the driver's tables, in DataFrame and SQL form.

A pixel is an order (x = key % 50, y = key div 50); the bands of the before date come from
its F lines, those of the after date from its O lines. See FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indices as ix
from ..operators import pixels as px
from ..sources.readers import table

WIDTH = 50
#: Numbers of the affine transform of the pixel raster: 10 m pixels from (500000, 4000000) down.
TRANSFORM = (10.0, 0.0, 500000.0, 0.0, -10.0, 4000000.0)


def place(key: str = "o_orderkey") -> list:
    return [(F.col(key) % WIDTH).alias("x"), F.floor(F.col(key) / float(WIDTH)).alias("y")]


def extent(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Width and height of the pixel raster, from the orders alone; 0 where there is none."""
    most = table(spark, sf_dir, "orders").select(*place()).agg(F.max("x"), F.max("y")).first()
    return tuple(0 if v is None else v + 1 for v in most)


def dates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(before, after): every pixel's bands, 0 where an order has no line of that date's status.

    Lines are summed once by order and status; nothing but five columns is read.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_quantity", "l_discount")
    sums = lines.groupBy("l_orderkey").agg(
        F.count("*").alias("lines"),
        *[F.coalesce(F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity"))).cast("long"), F.lit(0)).alias(f"q{s}") for s in "FO"],
        *[F.coalesce(F.sum((F.col("l_linestatus") == s).cast("long")), F.lit(0)).alias(f"n{s}") for s in "FO"],
        *[F.coalesce(F.sum(F.when(F.col("l_linestatus") == s, F.round(100 * F.col("l_discount")))).cast("long"), F.lit(0)).alias(f"d{s}") for s in "FO"],
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    all_ = orders.join(sums, orders["o_orderkey"] == sums["l_orderkey"], "left")

    def side(s: str) -> DataFrame:
        q, n, d = (F.col(k + s) for k in "qnd")
        formula = {"green": 300 + 90 * d, "red": 500 + 25 * d + 15 * q, "nir": 3000 - 20 * q + 40 * d, "swir16": 900 + 30 * q + 20 * n}
        return all_.select(*place(), *[F.when(F.col("lines") > 0, v).otherwise(F.lit(0)).cast("long").alias(b) for b, v in formula.items()], F.coalesce(q, F.lit(0)).alias("q"))

    return side("F"), side("O")


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, b_*, a_*, valid and dq (quantity after less before)."""
    b, a = dates(spark, sf_dir)
    both = px.pair(b.withColumnRenamed("q", "q_b"), a.withColumnRenamed("q", "q_a"), bands=(*ix.BANDS,))
    return both


def quantity_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, dq: quantity of O lines less that of F lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_quantity")
    q = lambda s: F.coalesce(F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity"))).cast("long"), F.lit(0))
    sums = lines.groupBy("l_orderkey").agg((q("O") - q("F")).alias("dq"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.join(sums, orders["o_orderkey"] == sums["l_orderkey"], "left").select(*place(), F.coalesce("dq", F.lit(0)).alias("dq"))


def features(spark: SparkSession, sf_dir: str, valid_only: bool = True) -> DataFrame:
    rows = pair(spark, sf_dir)
    return px.features(px.reflectance(rows.where("valid") if valid_only else rows))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene catalog: tile is the customer's nation, cloud cover comes from the price."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("scene_id"), F.col("c_nationkey").alias("tile"), F.to_date("o_orderdate").alias("acq_date"), (F.floor("o_totalprice") % 100).alias("cloud_pct"))


# ------------------------------------------------------------------ the same in SQL

SQL_SUMS = """
s AS (SELECT l_orderkey AS k, count(*) AS n_all,
  CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS BIGINT) AS qf, CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS BIGINT) AS qo,
  CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS nf, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS no_,
  CAST(sum(CASE WHEN l_linestatus = 'F' THEN round(100 * l_discount) ELSE 0 END) AS BIGINT) AS df, CAST(sum(CASE WHEN l_linestatus = 'O' THEN round(100 * l_discount) ELSE 0 END) AS BIGINT) AS do_
  FROM lineitem GROUP BY 1)"""


def _sql_bands(p: str, q: str, n: str, d: str) -> str:
    formula = {"green": f"300 + 90 * {d}", "red": f"500 + 25 * {d} + 15 * {q}", "nir": f"3000 - 20 * {q} + 40 * {d}", "swir16": f"900 + 30 * {q} + 20 * {n}"}
    return ", ".join(f"CASE WHEN n_all > 0 THEN {v} ELSE 0 END AS {p}{b}" for b, v in formula.items())


SQL_PAIR = f"""{SQL_SUMS},
px0 AS (SELECT CAST(o_orderkey % {WIDTH} AS BIGINT) AS x, CAST(floor(o_orderkey / {WIDTH}.0) AS BIGINT) AS y, {_sql_bands("b_", "qf", "nf", "df")}, {_sql_bands("a_", "qo", "no_", "do_")},
  coalesce(qo - qf, 0) AS dq FROM orders LEFT JOIN s ON o_orderkey = k),
px AS (SELECT *, ({" AND ".join(f"{p}{b} > 0" for p in ("b_", "a_") for b in ix.BANDS)}) AS valid FROM px0)"""

_refl = ", ".join(f"{p}{b} / 10000.0 AS {p}{b}" for p in ("b_", "a_") for b in ix.BANDS)


def sql_nd(a: str, b: str) -> str:
    return f"CASE WHEN abs({a} + {b}) > 1e-6 THEN greatest(-1.0, least(1.0, ({a} - {b}) / ({a} + {b}))) ELSE 0.0 END"


_indices = ", ".join(f"{sql_nd(p + ix.PAIRS[n][0], p + ix.PAIRS[n][1])} AS {n}{s}" for p, s in (("b_", "_b"), ("a_", "_a")) for n in ("ndvi", "ndbi", "mndwi"))
_bright = ", ".join(f"({p}green + {p}red + {p}nir + {p}swir16) / 4.0 AS bright{s}" for p, s in (("b_", "_b"), ("a_", "_a")))
_dot = " + ".join(f"b_{b} * a_{b}" for b in ix.BANDS)
_norm = lambda p: "sqrt(" + " + ".join(f"{p}{b} * {p}{b}" for b in ix.BANDS) + ")"

SQL_FEATURES = f"""{SQL_PAIR},
r AS (SELECT x, y, valid, dq, {_refl} FROM px WHERE valid),
f0 AS (SELECT *, {_indices}, {_bright}, acos(greatest(-1.0, least(1.0, ({_dot}) / ({_norm("b_")} * {_norm("a_")} + 1e-9)))) AS sam FROM r),
f AS (SELECT *, ndvi_a - ndvi_b AS d_ndvi, ndbi_a - ndbi_b AS d_ndbi, mndwi_a - mndwi_b AS d_mndwi, bright_a - bright_b AS d_bright FROM f0)"""


def sql_rules(sam: bool = True) -> str:
    turned = lambda least: f"AND sam > {least}" if sam else ""
    return f"""(ndvi_b > 0.20 AND ndvi_a < 0.15 AND d_ndvi < -0.12) AS veg_loss, (ndvi_a > 0.25 AND d_ndvi > 0.12) AS veg_gain,
  (mndwi_a > 0.10 AND d_mndwi > 0.20) AS w_gain, (mndwi_b > 0.10 AND d_mndwi < -0.20) AS w_loss,
  (ndvi_a < 0.25 AND d_ndbi > 0.08 AND d_bright > 0.02 {turned(0.05)}) AS built_candidate, (ndvi_a < 0.40 AND d_ndbi > 0.04 AND d_bright > 0.01 {turned(0.08)}) AS construction_candidate"""


SQL_EVIDENCE = f"""{SQL_FEATURES},
e0 AS (SELECT *, {sql_rules()} FROM f),
e AS (SELECT *, (veg_loss OR veg_gain OR w_gain OR w_loss OR built_candidate OR construction_candidate) AS landcover_evidence,
  CASE WHEN construction_candidate THEN 8 WHEN w_gain THEN 4 WHEN w_loss THEN 5 WHEN built_candidate THEN 1 WHEN veg_loss THEN 2 WHEN veg_gain THEN 3
       WHEN ndvi_a < 0.20 AND ndvi_b < 0.20 AND d_bright < -0.02 THEN 6 ELSE 7 END AS class_code FROM e0)"""

SQL_SCENES = """sc AS (SELECT o_orderkey AS scene_id, c_nationkey AS tile, CAST(o_orderdate AS DATE) AS acq_date, CAST(floor(o_totalprice) AS BIGINT) % 100 AS cloud_pct
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

#: 8-connected components of pixels with dq > 20 by recursion; the label is the least y * width + x.
SQL_COMPONENTS = f"""{SQL_PAIR},
m AS (SELECT x, y, y * {WIDTH} + x AS p FROM px WHERE dq > 20),
nb AS (SELECT a.p AS u, b.p AS v FROM m a JOIN m b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1),
cc(p, l) AS (SELECT p, p FROM m UNION SELECT nb.v, cc.l FROM cc JOIN nb ON nb.u = cc.p WHERE cc.l < nb.v),
lab AS (SELECT x, y, l AS region FROM m JOIN (SELECT p, min(l) AS l FROM cc GROUP BY p) USING (p))"""
