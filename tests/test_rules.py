"""Hand-worked cases of rules that a query over random rows hardly reaches."""

import math

import pytest
from pyspark.sql import functions as F

from ensolith.functions import student
from ensolith.operators import budgets as B
from ensolith.operators import checks as K
from ensolith.operators import evaluation as E
from ensolith.operators import events as V
from ensolith.operators import reducers as R
from ensolith.operators import screening as S


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_a_year_that_begins_late_is_no_year(spark):
    days = spark.sql("SELECT 1 AS case_id, explode(sequence(TIMESTAMP '2000-06-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS ts, 1.0D AS value")
    assert rows(R.complete_years(days, ["case_id"]).select("year", "complete").distinct(), "year") == [(2000, False), (2001, True)]
    got = R.annual_integral(days, ["case_id"]).first()
    assert (got["value"], got["n_years"]) == (365 * 24, 1)
    whole = spark.sql("SELECT 1 AS case_id, explode(sequence(TIMESTAMP '2000-01-01 23:00:00', TIMESTAMP '2000-12-31 23:00:00', INTERVAL 1 DAY)) AS ts, 1.0D AS value")
    assert R.complete_years(whole, ["case_id"]).where("not complete").count() == 0


def test_deficit_is_cumulative_and_no_crossover_is_no_sign(spark):
    def balance(gain, loss):
        df = spark.createDataFrame([(1, d, g, x) for d, (g, x) in enumerate(zip(gain, loss), 1)], "id int, doy int, gain double, loss double")
        return tuple(V.carbon_balance(df, ["id"], "doy", "gain", "loss", 3).first())[1:]

    # 4 a day behind: 12 on day 3, although no day alone is 10 behind
    assert balance([1.0] * 5, [5.0] * 5) == (12.0, 20.0, None, True)
    assert balance([1.0] * 5, [2.0] * 5) == (3.0, 5.0, None, False)
    late = [0.0] * 39 + [100.0]
    assert balance(late, [1.0] * 40) == (3.0, 39.0, 40, True)


def test_closure_per_year_and_without_inflow(spark):
    months = [(1, m, 2.0, "in", 10.0 + m) for m in range(24)] + [(1, m, 1.0, "out", None) for m in range(24)]
    got = B.closure(B.budget(spark.createDataFrame(months, "id int, m int, flow double, kind string, pool double"), ["id"], "m", "flow", "kind", "pool")).first()
    # the pool's mean rises by 12 from the first year to the second: 6 a year
    assert (got["inflow"], got["outflow"], got["change"], got["residual"], got["relative"], got["closed"]) == (24.0, 12.0, 6.0, 6.0, 0.25, False)
    b = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 10.0, 9.5, 0.0), (4, 10.0, 10.5, 0.0)], "id int, inflow double, outflow double, change double")
    assert [(r["relative"], r["closed"]) for r in B.closure(b).orderBy("id").collect()] == [(0.0, True), (math.inf, False), (0.05, True), (-0.05, True)]
    short = spark.createDataFrame([(1, m, 1.0, "in", float(m)) for m in range(6)], "id int, m int, flow double, kind string, pool double")
    assert B.budget(short, ["id"], "m", "flow", "kind", "pool").first()["change"] == 0.0


def test_the_smaller_ratio_limits(spark):
    df = spark.createDataFrame([(1, 0.9, 0.94), (2, 0.94, 0.9), (3, 0.9, 0.9), (4, 0.96, 0.97), (5, None, 0.5), (6, 0.94, 0.99), (7, 1.0, 1.0)], "id int, n double, p double").withColumn("v", F.lit(1.0))
    assert [r["limitation"] for r in B.allocation(df, ["id"], "v", "n", "p").orderBy("id").collect()] == ["N", "P", "co-limited", "none", "P", "N", "none"]


def test_student_and_small_samples(spark):
    for t, n, p in [(2.306, 8, 0.05), (12.706, 1, 0.05), (1.96, 1e7, 0.05), (4.032, 5, 0.01), (0.0, 4, 1.0), (2.228, 10, 0.05)]:
        assert student.two_sided(t, n) == pytest.approx(p, abs=2e-5)
    assert student.two_sided(50, 8) < 1e-9 and student.two_sided(-2.306, 8) == student.two_sided(2.306, 8)
    # ten pairs with r = 0.62: |t| is above 1.96, but p is 0.057
    x = list(range(10))
    y = [0, 3, 1, 7, 2, 6, 3, 4, 9, 5]
    got = B.correlation_test(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), "x", "y").first()
    assert got["n"] == 10 and 1.96 < got["t"] < 2.306 and 0.05 < got["p"] < 0.06 and abs(got["r"]) > 0.3 and not got["supported"]
    line = B.correlation_test(spark.createDataFrame([(float(a), 2.0 * a) for a in x], "x double, y double"), "x", "y").first()
    assert line["r"] == pytest.approx(1) and line["p"] == pytest.approx(0, abs=1e-12) and line["supported"]
    flat = B.correlation_test(spark.createDataFrame([(float(a), 1.0) for a in x], "x double, y double"), "x", "y").first()
    assert flat["r"] is None and flat["p"] is None and not flat["supported"]


def test_evidence_over_cycles(spark):
    ledger = [("a", 1, 1.0, True), ("b", 1, 5.0, False), ("a", 2, 1.0, False), ("a", 3, 2.0, True), ("c", 3, None, False), ("b", 4, 5.0, True), ("c", 4, None, None)]
    df = spark.createDataFrame(ledger, "parameter string, cycle long, value double, supported boolean")
    assert rows(K.evidence(df), "parameter") == [
        ("a", 1, 3, 3, 2, "dropped", "proposed@1>kept@2>refined@3>dropped@4"),
        ("b", 1, 4, 2, 1, "active", "proposed@1>dropped@2>kept@4"),
        ("c", 3, 4, 2, 0, "active", "proposed@3>kept@4"),
    ]
    assert rows(K.evidence(df, cap=2), "parameter")[0][-1] == "refined@3>dropped@4"


def test_tiers_of_a_bump(spark):
    df = spark.createDataFrame([(0, True), (0, False), (1, True), (100, False)], "d int, same boolean")
    assert [r["t"] for r in df.select(K.bump_tier(F.col("d"), F.col("same")).alias("t")).collect()] == ["T1", "T2", "T3", "T3"]


def test_coverage_bands(spark):
    known = spark.createDataFrame([(k,) for k in range(7)], "name int")
    mentions = spark.createDataFrame([("seven", k) for k in range(10)] + [("six", k) for k in range(1, 11)] + [("nine", k % 7) for k in range(9)], "doc string, name int")
    assert {r["doc"]: r["status"] for r in K.mention_coverage(mentions, known, ["doc"], "name").collect()} == {"seven": "warning", "six": "failed", "nine": "ok"}


def test_short_names_are_found(spark):
    entries = spark.createDataFrame([(1, "pH", "t", 0.5, True), (2, "vcmax", "t", 0.5, True), (3, "c", "t", 0.5, True), (4, "", "t", 0.5, True), (5, "soil depth", "t", 0.5, True)], "entry int, name string, text string, confidence double, verified boolean")
    found = lambda *w: {r["entry"] for r in K.relevant(entries, spark.createDataFrame([(x,) for x in w], "word string"), 9, 9).collect()}
    assert found("soil pH low") == {1}
    assert found("vcmax25top") == {2, 3} and found("max") == {2} and found("x") == {2} and found("Il") == {5} and found("") == set()


def test_outcomes_behind_the_gate(spark):
    e = [(1, 0, "extracted", None, 3), (2, 4, "extracted", "", 3), (3, 6, "failed", None, 3), (4, 6, "extracted", None, 0), (5, 9, "skipped", None, 3), (6, None, "extracted", "broken", 1)]
    df = spark.createDataFrame(e, "experiment long, met long, status string, error string, n_metrics long")
    got = {r["experiment"]: (r["outcome"], r["reliable"], r["best"]) for r in E.experiment_outcomes(df, 6).collect()}
    assert got == {1: ("FAILED", True, False), 2: ("MARGINAL", True, False), 3: ("SUCCESS", False, True), 4: ("SUCCESS", False, False), 6: ("FAILED", False, False)}
    assert not any(r["best"] for r in E.experiment_outcomes(df.where("experiment = 1"), 6).collect())


def test_mean_daily_deficit_within_a_run(spark):
    df = spark.createDataFrame([(1, d, x) for d, x in enumerate([-1.0, 2.0, 5.0, 11.0, -3.0, 4.0])], "id int, d int, x double")
    got = rows(V.deficit_periods(df, ["id"], ["d"], "d", F.col("x"), 1).select("start", "end", "n", "largest", "mean_daily", "ongoing"), "start")
    assert got == [(1, 3, 3, 11.0, 4.5, False), (5, 5, 1, 4.0, None, True)]


def test_comparison_needs_more_than_a_tenth(spark):
    split = spark.createDataFrame([(1, 111.0, 100.0), (2, 110.0, 100.0), (3, 80.0, 100.0), (4, 5.0, 0.0), (5, None, 1.0), (6, 500.0, 100.0)], "id int, above double, below double")
    up = {r["id"]: (r["supported"], r["confidence"]) for r in S.compared_cases(split, "increase").collect()}
    assert up == {1: (True, pytest.approx(0.11)), 2: (False, 0.0), 3: (False, 0.0), 4: (False, 0.0), 5: (False, 0.0), 6: (True, 0.9)}
    assert [r["id"] for r in S.compared_cases(split, "decrease").where("supported").collect()] == [3]
    with pytest.raises(ValueError):
        S.compared_cases(split, "change")
