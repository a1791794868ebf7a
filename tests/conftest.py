import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(rows):
    """Rows of a pandas frame in a form that compares across engines, sorted, columns by name."""
    import pandas as pd

    def one(v):
        if hasattr(v, "tolist") and getattr(v, "ndim", 0):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return str([one(x) for x in v])
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0) if v != int(v) or abs(v) > 1e15 else str(int(v))
        return str(v)

    rows = rows.reindex(sorted(rows.columns), axis=1)
    return list(rows.columns), sorted(tuple(one(v) for v in r) for r in rows.itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def connect(sf_dir):
        c = duckdb.connect()
        for f in os.listdir(sf_dir):
            c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
        return c

    return connect
