"""Findings of FINDINGS_r03.md on rasters."""

from __future__ import annotations

import numpy as np

from terralume.operators import regions, shapes


def test_hulls_make_no_call_a_region(spark):
    rows = spark.createDataFrame([(k, 4 * k + x, y) for k in range(50) for x in range(3) for y in range(3)], "region long, x long, y long")
    got = regions.hulls(rows)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(k, 9, 9) for k in range(50)]


def test_groups_that_cross_batches_and_null_keys_stay_whole(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k if k else None, i) for k in range(6) for i in range(1 + 10 * k)]
        df = spark.createDataFrame(rows, "k long, v long")
        got = shapes.by_group(df, ["k"], lambda g: {"n": np.array([len(g["v"])]), "s": np.array([g["v"].sum()])}, "n long, s long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert {tuple(r) for r in got} == {(k or None, 1 + 10 * k, sum(range(1 + 10 * k))) for k in range(6)} and len(got) == 6
