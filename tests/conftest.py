import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH")]))
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    session = builder.config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def cell(v):
    import pandas as pd

    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "-"
    return repr(round(float(v), 6)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def agree(spark, sf, duck):
    """Fails unless a query's rows are those of its SQL."""

    def check(query, sql):
        ours, theirs = query(spark, sf).toPandas(), duck.execute(sql).fetchdf()
        assert sorted(ours.columns) == sorted(theirs.columns)
        rows = [sorted(tuple(map(cell, r)) for r in x[sorted(x.columns)].itertuples(index=False)) for x in (ours, theirs)]
        assert rows[0] == rows[1]

    return check
