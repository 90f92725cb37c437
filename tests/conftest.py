import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """Run SQL over the small driver tables with DuckDB."""
    import duckdb

    base = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        if os.path.exists(f"{base}/{name}.parquet"):
            con.execute(f"create view {name} as select * from '{base}/{name}.parquet'")

    def run(sql):
        return con.execute(sql).fetchdf()

    run.base = base
    return run


def same(a, b):
    """Both frames hold the same rows, in any order."""
    a, b = a[sorted(a.columns)], b[sorted(b.columns)]
    assert list(a.columns) == list(b.columns)

    def rows(df):
        clean = lambda x: None if x is None or x != x else round(x, 9) if isinstance(x, float) else x.item() if hasattr(x, "item") else x
        return sorted(repr(tuple(clean(x) for x in r)) for r in df.itertuples(index=False))

    assert rows(a) == rows(b)
