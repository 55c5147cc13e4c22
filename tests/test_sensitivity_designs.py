"""Sobol points, crossed designs and given-data sensitivity against their defining properties and plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensolith.operators import given_data as G
from ensolith.operators import sobol as S


@pytest.fixture(scope="module")
def eight(spark):
    bounds = spark.createDataFrame([(f"x{k}", 0.0, 1.0) for k in range(8)], "name string, lower double, upper double")
    return S.sobol_design(spark, bounds, 1024)


def test_primitive_polynomials():
    assert S.primitive_polynomials(9) == [0b11, 0b111, 0b1011, 0b1101, 0b10011, 0b11001, 0b100101, 0b101001, 0b101111]


def test_every_dyadic_interval_is_hit_once(spark, eight):
    shifted = S.sobol_design(spark, spark.createDataFrame([(f"x{k}", 0.0, 1.0) for k in range(8)], "name string, lower double, upper double"), 1024, seed=5)
    for design in (eight, shifted):
        x = np.array([r[1:] for r in design.orderBy("point").collect()])
        for size in (2, 64, 1024):
            for d in range(8):
                assert sorted(np.floor(x[:size, d] * size).astype(int)) == list(range(size))
        cells = np.floor(x[:256, :2] * 16).astype(int)
        assert len(set(map(tuple, cells))) == 256  # the first two dimensions fill a square evenly
    assert x.max() < 1 and x.min() >= 0


def test_first_points_and_extension(spark, eight):
    rows = [r[1:4] for r in eight.orderBy("point").limit(4).collect()]
    assert rows == [(0, 0, 0), (0.5, 0.5, 0.5), (0.75, 0.25, 0.25), (0.25, 0.75, 0.75)]
    numbers = spark.createDataFrame([(3,), (1,)], "k long")
    bounds = spark.createDataFrame([("b", 10.0, 20.0), ("a", -1.0, 1.0)], "name string, lower double, upper double")
    got = {r["k"]: (r["a"], r["b"]) for r in S.sequence_points(numbers, "k", bounds).collect()}
    assert got == {1: (0.0, 15.0), 3: (-0.5, 17.5)}


@pytest.mark.parametrize("rows", [[], [("a", 1.0, 1.0)], [("a", 2.0, 1.0)], [("a", None, 1.0)], [("a", 0.0, 1.0), ("a", 0.0, 2.0)], [(f"x{k}", 0.0, 1.0) for k in range(17)]])
def test_bad_bounds_are_refused(spark, rows):
    with pytest.raises(ValueError):
        S.box(spark.createDataFrame(rows, "name string, lower double, upper double"))


def test_sizes_are_refused(spark):
    bounds = spark.createDataFrame([(f"x{k}", 0.0, 1.0) for k in range(9)], "name string, lower double, upper double")
    with pytest.raises(ValueError):
        S.sobol_design(spark, bounds, 100)
    with pytest.raises(ValueError):
        S.crossed_design(spark, bounds, 64)


def test_shares_of_a_known_function(spark):
    bounds = spark.createDataFrame([(x, -math.pi, math.pi) for x in "abc"], "name string, lower double, upper double")
    design = S.crossed_design(spark, bounds, 4096, second_order=True, seed=3)
    assert design.count() == 4096 * 8
    y = F.sin("a") + 7 * F.sin("b") ** 2 + 0.1 * F.col("c") ** 4 * F.sin("a")
    made = design.withColumn("y", y)
    got = {r["input"]: (r["first"], r["total"]) for r in S.first_and_total(made, list("abc"), "y").collect()}
    for x, first, total in (("a", 0.3139, 0.5576), ("b", 0.4424, 0.4424), ("c", 0.0, 0.2437)):
        assert got[x] == (pytest.approx(first, abs=0.02), pytest.approx(total, abs=0.02))
    second = {(r["input"], r["other"]): r["second"] for r in S.second_order(made, list("abc"), "y").collect()}
    assert second["a", "c"] == pytest.approx(0.2437, abs=0.03) and abs(second["a", "b"]) < 0.03 and abs(second["b", "c"]) < 0.03
    assert S.first_and_total(design.withColumn("y", F.lit(1.0)), ["a"], "y").first()["first"] is None


def test_each_crossed_row_differs_in_its_column(spark):
    bounds = spark.createDataFrame([("a", 0.0, 2.0), ("b", 5.0, 6.0)], "name string, lower double, upper double")
    for r in [S.crossed_design(spark, bounds, 16, True).where(F.col("sample") == k).collect() for k in range(1, 16)]:
        m = {x["matrix"]: (x["a"], x["b"]) for x in r}
        assert m["A:a"] == (m["B"][0], m["A"][1]) and m["A:b"] == (m["A"][0], m["B"][1])
        assert m["B:a"] == (m["A"][0], m["B"][1]) and m["B:b"] == (m["B"][0], m["A"][1])


def test_local_candidates(spark):
    rows = [(k, [0.01 + 0.1 * k, 0.99], float(k) if k != 2 else None, k != 1) for k in range(8)] + [(8, [0.5, 0.5], float("nan"), True)]
    seen = spark.createDataFrame(rows, "id long, u array<double>, v double, viable boolean")
    got = S.local_candidates(seen, 100, k=3, scales=(0.01, 0.5), seed=1).collect()
    assert {r["centre"] for r in got} == {0, 3, 4} and len(got) == 3 * 2 * 17
    assert all(0 <= x <= 1 for r in got for x in r["u"])
    near = [r["u"][0] - (0.01 + 0.1 * r["centre"]) for r in got if r["scale"] == 0.01 and r["centre"]]
    assert 0.005 < np.std(near) < 0.015 and len(set(near)) == len(near)
    assert sorted(map(str, got)) == sorted(map(str, S.local_candidates(seen.repartition(3), 100, k=3, scales=(0.01, 0.5), seed=1).collect()))
    assert S.local_candidates(seen.where("false"), 5).count() == 0
    with pytest.raises(ValueError):
        S.local_candidates(seen, 5, scales=())


def cloud(spark, y, n=512):
    bounds = spark.createDataFrame([(f"x{k}", 0.0, 1.0) for k in range(8)], "name string, lower double, upper double")
    return S.sobol_design(spark, bounds, n, seed=0).withColumn("y", y)


X = [f"x{k}" for k in range(8)]


def test_measures_against_plain_versions(spark):
    df = cloud(spark, F.col("x0") + 0.35 * F.col("x3"), 256)
    ranked = G.ranked_inputs(df, X, "y", "point")
    rows = df.orderBy("point").collect()
    y = np.array([r["y"] for r in rows])
    first = {r["input"]: r["first"] for r in G.spectral_share(ranked).collect()}
    delta = {r["input"]: r["delta"] for r in G.density_distance(ranked).collect()}
    kernel = lambda v, at: np.exp(-(((at[:, None] - v) / (v.std(ddof=1) * (len(v) * 0.75) ** -0.2)) ** 2) / 2).sum(1) / (len(v) * v.std(ddof=1) * (len(v) * 0.75) ** -0.2 * math.sqrt(2 * math.pi))
    at = np.linspace(y.min(), y.max(), 100)
    for x in ("x0", "x3", "x5"):
        order = np.argsort([r[x] for r in rows], kind="stable")
        course = y[np.concatenate([order[::2], order[1::2][::-1]])]
        power = np.abs(np.fft.rfft(course - course.mean())) ** 2
        power[1:-1] *= 2
        share, noise = power[1:11].sum() / power[1:].sum(), 20 / len(y)
        assert first[x] == pytest.approx(share - noise / (1 - noise) * (1 - share), abs=1e-9)
        m = G.slices_for(len(y))
        want = 0.0
        for s in range(m):
            part = y[order[(np.arange(len(y)) * m // len(y)) == s]]
            gap = np.abs(kernel(y, at) - kernel(part, at))
            want += len(part) / (2 * len(y)) * ((gap[1:] + gap[:-1]) / 2 * np.diff(at)).sum()
        assert delta[x] == pytest.approx(want, rel=0.01)


def test_influential_inputs_are_kept_and_noise_is_rejected(spark):
    got = {r["input"]: r for r in G.given_data_sensitivity(cloud(spark, F.col("x0") + 0.35 * F.col("x3")), X, "y", "point").collect()}
    assert sorted(got, key=lambda x: got[x]["rank"])[:2] == ["x0", "x3"] and got["x0"]["distinguishable"]
    assert sum(r["distinguishable"] for r in got.values()) <= 3 and got["x0"]["n"] == 512
    both = {r["input"]: r for r in G.given_data_sensitivity(cloud(spark, 0.8 * F.col("x0") + 1.2 * F.col("x0") * F.col("x2")), X, "y", "point").collect()}
    assert set(sorted(both, key=lambda x: both[x]["rank"])[:2]) == {"x0", "x2"}
    noise = G.given_data_sensitivity(cloud(spark, F.pmod(F.xxhash64("point"), F.lit(1009)) / 1009.0), X, "y", "point").collect()
    assert sum(r["distinguishable"] for r in noise) <= 1


def test_outputs_that_do_not_vary_and_missing_rows(spark):
    still = G.given_data_sensitivity(cloud(spark, F.lit(2.0), 64), X[:2], "y", "point").collect()
    assert all(r["delta"] == 0 and r["first"] is None and not r["distinguishable"] for r in still)
    gaps = cloud(spark, F.when(F.col("point") % 2 == 0, F.col("x0")), 64)
    assert {r["n"] for r in G.given_data_sensitivity(gaps, X[:2], "y", "point").collect()} == {32}
    assert G.density_distance(G.ranked_inputs(gaps.where("false"), X[:2], "y", "point")).count() == 0
