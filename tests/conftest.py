import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.local.dir", "/tmp/spark-local")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    return con


def _plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or str(v) in ("nan", "<NA>"):
        return "~"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, int) and not isinstance(v, bool):
        return repr(float(v))
    return str(v)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query against its SQL on the smallest tables."""

    def check(query, sql):
        a, b = query(spark, SMALL).toPandas(), duck.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        rows = [sorted(tuple(map(_plain, r)) for r in x[sorted(x.columns)].itertuples(index=False)) for x in (a, b)]
        assert rows[0] == rows[1]

    return check
