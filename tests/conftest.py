import datetime
import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, sf_dir):
    """Holds a query against its SQL: names, number of rows and every value."""

    def check(f, sql):
        df = f(spark, sf_dir)
        got = rows_of(df.columns, df.collect())
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        want = rows_of(names, cur.fetchall())
        assert sorted(df.columns) == sorted(names)
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert close(g, w), (g, w)

    return check


def close(g, w):
    if isinstance(g, tuple) and isinstance(w, tuple):
        return len(g) == len(w) and all(map(close, g, w))
    if isinstance(g, float) and isinstance(w, (float, int)) or isinstance(w, float) and isinstance(g, int):
        return math.isclose(g, w, rel_tol=1e-6, abs_tol=1e-9)
    return g == w
