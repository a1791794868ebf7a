"""Every query against its SQL, on the smallest tables."""

import pytest
from conftest import plain

from terralume.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(name, spark, duck):
    got = plain(QUERIES[name](spark, SF).toPandas())
    want = plain(duck(SF).execute(ORACLE[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark):
    df = QUERIES[name](spark, SF)
    assert df.count() >= 0 and df.columns


def test_entry(spark):
    import __spark_entry__ as e

    assert [r["stage_no"] for r in e.entry(spark).orderBy("stage_no").collect()] == [1, 2, 3, 4, 5, 6]
    assert set(e.oracle_sql()) <= set(e.queries())
