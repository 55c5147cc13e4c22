import math
import random

from pyspark.sql import functions as F

from ensolith.operators.contrasts import group_quantiles
from ensolith.operators.ranks import kth_smallest, values_at


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_of_groups_with_ties_outliers_and_infinities(spark):
    r = random.Random(3)
    groups = {
        "ties": [5.0] * 3000 + [1.0, 9.0],
        "outlier": [r.random() for _ in range(500)] + [1e300, -1e300],
        "infinite": [-math.inf, math.inf, math.inf, 0.5, 0.25, 0.125],
        "widest": [-1.7e308, 1.7e308, 0.0, 1.0],
        "one": [7.0],
    }
    df = spark.createDataFrame([(g, x) for g, values in groups.items() for x in [*values, None]], "g string, x double")
    places = {"first": F.lit(1), "second": F.lit(2), "middle": F.floor((F.col("n") + 1) / 2), "last": F.col("n")}
    got = {r["g"]: r for r in values_at(df, ["g"], "x", places).collect()}
    for g, values in groups.items():
        s = sorted(values)
        assert (got[g]["n"], got[g]["first"], got[g]["middle"], got[g]["last"]) == (len(s), s[0], s[(len(s) + 1) // 2 - 1], s[-1])
        assert got[g]["second"] == (s[1] if len(s) > 1 else None)
    q = {r["g"]: r for r in group_quantiles(df.where("g != 'infinite'"), ["g"], "x", {"low": 0.25, "high": 0.75}).collect()}
    assert (q["ties"]["low"], q["one"]["high"], q["widest"]["high"]) == (5.0, 7.0, 1.0 + 0.25 * (1.7e308 - 1.0))


def test_no_task_orders_a_group(spark):
    df = spark.range(2000).selectExpr("'a' AS g", "cast(id AS double) AS x")
    seen = []
    from ensolith.operators import ranks

    plain = ranks.cut
    try:
        ranks.cut = lambda d: (seen.append(plan(d)), plain(d))[1]
        found = kth_smallest(df, ["g"], "x", F.lit(1000)).first()
    finally:
        ranks.cut = plain
    assert found["kth"] == 999.0
    # a group's rows meet its state by broadcast and are counted where they are read
    assert any("BroadcastHashJoin" in p for p in seen) and not any("row_number" in p or "SortMergeJoin [g" in p and "id#" in p for p in seen)


def test_boundary_profile_holds_no_column_whole(spark):
    from ensolith.operators.validation import boundary_profile

    rows = [(float(k), float(k * k % 17)) for k in range(40)] + [(None, 1.0), (1.0, None)]
    df = spark.createDataFrame(rows, "d double, e double")
    got = boundary_profile(df, "d", "e", 4)
    assert "percentile(" not in plan(got) and "median(" not in plan(got)
    known = sorted(r for r in rows if None not in r)
    b = sorted(map(tuple, got.collect()))
    assert [r[:4] for r in b] == [(0, 0.0, 9.75, 10), (1, 9.75, 19.5, 10), (2, 19.5, 29.25, 10), (3, 29.25, 39.0, 10)]
    for k, row in enumerate(b):
        e = sorted(x for _, x in known[10 * k : 10 * k + 10])
        assert math.isclose(row[4], sum(e) / 10) and math.isclose(row[5], (e[4] + e[5]) / 2)
