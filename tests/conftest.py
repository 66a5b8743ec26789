import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(data):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return con


@pytest.fixture(scope="session")
def same(spark, data, duck):
    """Whether a query and its SQL give the same rows."""

    def rows(frame, columns):
        values = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
        return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in row) for row in values)

    def compare(name, query, sql):
        got, want = query(spark, data).toPandas(), duck.sql(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows(got, columns) == rows(want, columns), name

    return compare
