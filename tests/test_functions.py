"""Expressions with values worked out by hand."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from terralume.functions import indices as ix
from terralume.functions import rules
from terralume.functions import significance as sg
from terralume.functions import text as tx


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)] if values else [Row(z=0)]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("a, b, want", [(0.0, 0.0, 0.0), (1.0, 0.0, 1.0), (0.3, 0.1, 0.5), (-0.1, 0.1, 0.0)])
def test_nd(spark, a, b, want):
    assert one(spark, ix.nd("a", "b"), a=a, b=b) == pytest.approx(want)


def test_nd_variants(spark):
    assert one(spark, ix.nd_raw("a", "b"), a=0.0, b=0.0) is None
    assert one(spark, ix.nd_finite("a", "b"), a=float("nan"), b=0.1) == 0.0
    assert one(spark, ix.nd_floor("a", "b"), a=0.002, b=0.0) == pytest.approx(0.2)


@pytest.mark.parametrize("t, p", [(0.0, 1.0), (3.356694, 0.5), (28.473255, 1e-5)])
def test_chi_squared(spark, t, p):
    assert sg.survival_value(t) == pytest.approx(p, rel=1e-5)
    assert one(spark, sg.survival("t"), t=t) == pytest.approx(p, rel=1e-5)


@pytest.mark.parametrize("p", [1e-7, 1e-5, 1e-4, 1e-3, 1e-2, 0.5])
def test_quantiles_invert(p):
    assert sg.survival_value(sg.quantile_value(p)) == pytest.approx(p, rel=1e-10)


def test_neg_log_cap(spark):
    assert one(spark, sg.neg_log10(F.lit(1e4))) == 20.0
    assert one(spark, sg.neg_log10(F.lit(1e4), None)) == 300.0


@pytest.mark.parametrize("x, y, word", [(0.1, 0.1, "NW"), (0.5, 0.5, "center"), (0.9, 0.5, "E"), (0.5, 0.9, "S")])
def test_position(spark, x, y, word):
    assert one(spark, ix.position_word("x", "y"), x=x, y=y) == word


@pytest.mark.parametrize("text, want", [("a roof, CONFIRMED but REJECTED", False), ("no significant change CONFIRMED", True), ("x CONFIRMED", True), ("nothing", False)])
def test_confirmed(spark, text, want):
    assert one(spark, tx.is_confirmed(F.col("t")), t=text) is want


def test_class_paint(spark):
    flags = dict.fromkeys(rules.RULES, False) | {"built_candidate": True, "construction_candidate": True, "ndvi_a": 0.1, "ndvi_b": 0.1, "d_bright": -0.5}
    assert one(spark, rules.class_code(), **flags) == 8
    assert one(spark, rules.class_code(), **(flags | {"construction_candidate": False})) == 1
    assert one(spark, rules.class_code(), **(flags | {"construction_candidate": False, "built_candidate": False})) == 6


def test_null_bands_are_no_evidence(spark):
    names = ("ndvi_b", "ndvi_a", "mndwi_b", "mndwi_a", "d_ndvi", "d_ndbi", "d_mndwi", "d_bright", "sam")
    df = spark.createDataFrame([(None,) * 9], ", ".join(f"{n} double" for n in names))
    got = df.select(*[c.alias(k) for k, c in rules.evidence(F.col("sam")).items()]).first()
    assert not any(got)


def test_utm(spark):
    assert one(spark, ix.utm_epsg("a", "b"), a=35.236864, b=52.336017) == 32639
    assert one(spark, ix.utm_epsg("a", "b"), a=-1.0, b=180.0) == 32760


def test_affine_inverts():
    t = (10.0, 1.0, 5.0, -2.0, -10.0, 7.0)
    a, b, c, d, e, f = ix.inverse_affine(t)
    x, y = 10 * 3 + 4 + 5.0, -2 * 3 - 10 * 4 + 7.0
    assert (a * x + b * y + c, d * x + e * y + f) == pytest.approx((3, 4))


def test_json_repair(spark):
    broken = 'So: {regions:[{id:"3",real_change:"Yes",category:"roof",},]} done'
    assert one(spark, F.from_json(tx.repaired_json(F.col("t")), tx.AUDIT), t=broken)["regions"][0]["id"] == "3"


def test_stretch_of_a_constant(spark):
    assert one(spark, ix.stretch("x", F.lit(2.0), F.lit(2.0)), x=2.0) == 0.0


def test_weighted_mean_drops_missing(spark):
    df = spark.createDataFrame([(0.5, None), (None, None)], "a double, b double")
    got = [r["v"] for r in df.select(ix.weighted_mean({"a": 0.3, "b": 0.7, "c": 9.0}, {"a", "b"}).alias("v")).collect()]
    assert got == pytest.approx([0.5, 0.0])


def test_angle(spark):
    v = one(spark, ix.spectral_angle(["a", "b"], ["c", "d"]), a=1.0, b=0.0, c=0.0, d=2.0)
    assert v == pytest.approx(math.pi / 2, abs=1e-6)
