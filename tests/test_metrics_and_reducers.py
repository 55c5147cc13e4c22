"""Values worked out by hand for the metrics, the verdict bands, the calendar reducers and the alignment of series."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from ensolith.functions import columns as C
from ensolith.functions import metrics as M
from ensolith.operators import events as E
from ensolith.operators import reducers as R


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (100.0, None), (None, 7.0), (float("nan"), 1.0)], "s double, o double")


def one(df, *columns):
    return tuple(df.agg(*columns).first())


def test_metrics_count_whole_pairs_only(pairs):
    s, o = F.col("s"), F.col("o")
    r, kge, nse, rmse, rel = one(pairs, M.correlation(s, o), M.kge(s, o), M.nse(s, o), M.rmse(s, o), M.relative_error(s, o))
    assert r == pytest.approx(1.0) and rel == pytest.approx(0.5)
    assert kge == pytest.approx(1 - math.sqrt(0.25 + 0.25)) and nse == pytest.approx(1 - 14 / 8) and rmse == pytest.approx(math.sqrt(14 / 3))


def test_correlation_keeps_its_digits_far_from_zero(spark):
    far = spark.range(1000).select((F.col("id") + 1e9).alias("s"))
    assert one(far, M.correlation(F.col("s"), F.col("s")))[0] == pytest.approx(1.0, abs=1e-9)


def test_skills_of_constant_sides(spark):
    flat = spark.createDataFrame([(1.0, 2.0, 0.0), (3.0, 2.0, 0.0)], "s double, o double, z double")
    s, o, z = F.col("s"), F.col("o"), F.col("z")
    assert one(flat, M.correlation(s, o), M.nse(o, o), M.nse(s, o)) == (0.0, 1.0, float("-inf"))
    assert one(flat, M.kge(s, z))[0] == float("-inf") and one(flat, M.kge(z, z))[0] == 0.0
    assert one(flat, M.nrmse(s, o, "range"), M.nrmse(s, z, "range")) == (pytest.approx(0.5), None)
    assert one(flat.where("false"), M.correlation(s, o), M.kge(s, o), M.nse(s, o)) == (None, None, None)


def test_costs_and_composites(spark):
    c = spark.createDataFrame([(0.1, 1.0), (0.2, 1.0), (0.15, 1.0), (0.3, 1.0), (0.1, 1.0), (0.25, 3.0)], "c double, w double")
    e = F.col("c")
    assert one(c, M.composite(e)) == (pytest.approx(math.sqrt((0.01 + 0.04 + 0.0225 + 0.09 + 0.01 + 0.0625) / 6)),)
    assert one(c, M.composite(e, "weighted_mean", F.col("w")), M.composite(e, "max"), M.composite_unless_missing(e, 7)) == (pytest.approx(1.6 / 8), 0.3, None)
    assert spark.range(1).select(M.to_cost(F.lit(0.75), "nse"), M.to_cost(F.lit(-0.2), "bias")).first()[:] == (0.25, -0.2)
    with pytest.raises(ValueError):
        M.composite(e, "weighted_mean")


@pytest.mark.parametrize(
    "kind, upper, verdicts",
    [("above", None, {16: "CONFIRMED", 12: "PARTIAL", 9: "PARTIAL", 8: "REJECTED"}), ("below", None, {4: "CONFIRMED", 8: "PARTIAL", 11: "PARTIAL", 12: "REJECTED"}), ("between", 20, {10: "CONFIRMED", 20: "CONFIRMED", 8: "PARTIAL", 24: "PARTIAL", 25: "REJECTED"})],
)
def test_verdict_bands(spark, kind, upper, verdicts):
    rows = spark.createDataFrame([(float(v),) for v in verdicts], "v double")
    got = rows.select("v", C.threshold_verdict(F.col("v"), F.lit(10.0), kind, None if upper is None else F.lit(float(upper))).alias("x")).collect()
    assert {r["v"]: r["x"] for r in got} == verdicts


def daily(spark, first, days, value):
    start = datetime.datetime.fromisoformat(first)
    return spark.createDataFrame([(1, start + datetime.timedelta(days=k), float(value(k))) for k in range(days)], "case_id int, ts timestamp_ntz, value double")


def test_a_broken_last_year_is_left_out(spark):
    h = daily(spark, "2003-01-01", 365 + 366 + 100, lambda k: 0.5 if k < 731 else 99.0)
    got = R.annual_integral(h, ["case_id"]).first()
    assert (got["value"], got["n_years"], got["status"]) == (0.5 * 24 * 365.5, 2, "OK")
    assert R.year_end(h, ["case_id"], ["ts"]).first()["value"] == 0.5
    assert R.season_mean_abs(h, ["case_id"]).first()["value"] == 0.5
    years = R.by_year(h, ["case_id"], F.sum("value"))
    assert R.mean_over_years(years, ["case_id"], 2003, 2005).first()["status"] == "PARTIAL"
    sums = R.season_sums(h, ["case_id"]).agg(F.sum("value")).first()[0]
    assert sums == 0.5 * 365.5


def test_group_peaks_over_years(spark):
    """Two years, two groups of one fill group's neighbours: the yearly peaks of their sum are 11 and 21."""
    a = daily(spark, "2001-01-01", 730, lambda k: 10.0 if k == 100 else 20.0 if k == 500 else 0.0)
    b = daily(spark, "2001-01-01", 730, lambda k: 1.0)
    assert R.peak_of_group_sum(a.unionByName(b), ["case_id"], F.dayofyear("ts")).first()["value"] == 16.0


def test_calendar_blocks(spark):
    got = R.year_blocks(spark.range(365 + 366 + 365 + 10), "id", 2003).orderBy("year").collect()
    assert [tuple(r) for r in got] == [(2003, 0, 365), (2004, 365, 731), (2005, 731, 1096)]
    assert R.year_blocks(spark.range(100), "id", 2003).count() == 0
    days = {r["year"]: (r["first_day"], r["end_day"]) for r in R.season_days(spark.createDataFrame([(2003,), (2004,)], "year int"), "year").collect()}
    assert days == {2003: (120, 273), 2004: (121, 274)}
    tags = R.hourly_tags(spark.range(24 * 60, 24 * 60 + 1), "id", 2004).first()
    assert (tags["year"], tags["month"], tags["hour"]) == (2004, 3, 0)


def test_window_reductions_refuse_unknown_kinds(spark):
    h = R.numbered(daily(spark, "2003-01-01", 10, lambda k: k), ["case_id"], ["ts"])
    assert R.window_reductions(h, ["case_id"], "record", 2, 4, {"a": "last", "b": "mean"}).first()[1:] == (4.0, 3.0)
    with pytest.raises(ValueError):
        R.window_reductions(h, ["case_id"], "record", 2, 4, {"a": "median"})


def test_interpolation_is_null_outside_the_series(spark):
    sim = spark.createDataFrame([(1, 0.0, 10.0), (1, 1.0, 20.0)], "k int, t double, v double")
    asked = spark.createDataFrame([(1, t) for t in (-5.0, 0.0, 0.25, 1.0, 9.0)], "k int, t double")
    got = {r["t"]: r["v"] for r in E.interpolate_at(sim, asked, ["k"], "t", "v").collect()}
    assert got == {-5.0: None, 0.0: 10.0, 0.25: 12.5, 1.0: 20.0, 9.0: None}
