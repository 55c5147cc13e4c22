"""Expected improvement, scores, batches and neighbours against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensolith.functions import normal
from ensolith.operators import acquisition as A
from ensolith.operators import neighbours as N
from ensolith.operators import ranks
from ensolith.plans import search

R = random.Random(11)
B = A.Band


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def chance(a, b):
    if not b > a:
        return 0.0
    if a > 0:
        return tail(a) - tail(b)
    return tail(-b) - tail(-a) if b < 0 else 1 - tail(b) - tail(-a)


def edge(x, kind):
    if kind == "identity":
        return x
    if x <= 0:
        return -math.inf
    if kind == "log":
        return math.log(x)
    return math.inf if x >= 1 else math.log(x / (1 - x))


def dense(mu, sd, targets, best):
    """The integral by very many trapezoids, thick around every place where a posterior crosses a band and before best."""
    inverse = {"identity": lambda y: y, "log": math.exp, "logit": lambda y: 1 / (1 + math.exp(-y))}
    at = {0.0, best, *(best * k / 4000 for k in range(4000)), *(best * (1 - 2 ** (-k / 20)) for k in range(900))}
    for m, s, t in zip(mu, sd, targets):
        for k in range(-1500, 1501):
            at.add(abs(inverse[t.transform](m + s * k / 150) - t.observed) / (t.uncertainty * t.observed))
        for kink in (1 / t.uncertainty, abs(1 / t.observed - 1) / t.uncertainty):
            at |= {kink * (1 + sign * 2 ** (-k / 10)) for k in range(400) for sign in (-1, 1)} | {kink}
    at = sorted(x for x in at if 0 <= x <= best)

    def f(t):
        return math.prod(chance((edge(x.observed * (1 - t * x.uncertainty), x.transform) - m) / s, (edge(x.observed * (1 + t * x.uncertainty), x.transform) - m) / s) for m, s, x in zip(mu, sd, targets))

    total = 0.0
    for a, b in zip(at, at[1:]):  # three-point Gauss
        h, c = (b - a) / 2, (a + b) / 2
        total += h * (5 * f(c - h * math.sqrt(0.6)) + 8 * f(c) + 5 * f(c + h * math.sqrt(0.6))) / 9
    return total


def test_complementary_error_function():
    x = np.concatenate([np.linspace(-6, 26, 4001), [0.0, 1e-300, 5.0]])
    want = np.array([math.erfc(v) for v in x])
    assert np.max(np.abs(normal.erfc(x) / want - 1)) < 2e-14


def test_narrow_and_far_intervals_keep_their_digits():
    assert normal.between(9.0, 10.0) == pytest.approx(tail(9) - tail(10), rel=1e-12)
    assert normal.between(-10.0, -9.0) == normal.between(9.0, 10.0)
    for m in (0.0, 3.0, -12.0, 30.0):
        h = 1e-9
        assert normal.between(m - h / 2, m + h / 2) == pytest.approx(h * math.exp(-m * m / 2) / math.sqrt(2 * math.pi), rel=1e-5)
    assert normal.between(1.0, 1.0) == 0 and normal.between(2.0, 1.0) == 0 and normal.between(-np.inf, np.inf) == 1


def test_one_target_in_closed_form():
    def closed(m, s, best):  # E[max(0, best - |X|)], X of mean m
        phi = lambda z: math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        part = lambda c, a, b: c * chance((a - m) / s, (b - m) / s)
        mean = lambda a, b: m * chance((a - m) / s, (b - m) / s) + s * (phi((a - m) / s) - phi((b - m) / s))
        return part(best, -best, best) + mean(-best, 0) - mean(0, best)

    for y, s, best in [(10.0, 1.0, 0.5), (12.0, 0.4, 3.0), (9.0, 3.0, 1.0), (13.0, 0.5, 1.0), (10.0, 1e-4, 2.0), (7.0, 2.0, 0.01)]:
        got = A.improvement(np.array([[y]]), np.array([[s]]), [B("a", 10.0, 0.2)], best)[0]
        assert got == pytest.approx(closed((y - 10) / 2, s / 2, best), rel=1e-8)


@pytest.mark.parametrize("kind", ["identity", "log", "logit"])
def test_integral_against_dense_sums(kind):
    worst = 0.0
    for _ in range(12):
        targets = [B(f"t{k}", R.uniform(0.2, 0.95) if kind == "logit" else R.uniform(0.5, 5), R.uniform(0.1, 1.4), kind) for k in range(R.randint(1, 3))]
        at = {"identity": lambda x: x, "log": math.log, "logit": lambda x: math.log(x / (1 - x))}[kind]
        mu = [at(t.observed * R.uniform(0.4, 1.04)) * R.choice([1, 1, 1.05]) for t in targets]
        sd = [10 ** R.uniform(-3, 0.3) for _ in targets]
        best = 10 ** R.uniform(-1.2, 0.5)
        want = dense(mu, sd, targets, best)
        got = A.improvement(np.array([mu]), np.array([sd]), targets, best)[0]
        if want > 1e-250:
            worst = max(worst, abs(got / want - 1))
        else:
            assert got <= 1e-240
    assert worst < 1e-8


def test_mixed_targets_observed_beyond_one_and_certain_posteriors():
    targets = [B("a", 3.0, 0.3), B("b", 0.8, 0.9, "log"), B("c", 1.3, 0.6, "logit")]
    mu, sd = [3.2, -0.1, 2.5], [0.5, 0.3, 1.0]
    assert A.improvement(np.array([mu]), np.array([sd]), targets, 2.0)[0] == pytest.approx(dense(mu, sd, targets, 2.0), rel=1e-8)
    certain = A.improvement(np.array([[11.0], [14.0]]), np.zeros((2, 1)), [B("a", 10.0, 0.2)], 1.5)
    assert certain == pytest.approx([1.0, 0.0], abs=1e-9)  # V is 0.5 and 2
    assert A.improvement(np.array([[10.0]]), np.array([[1.0]]), [B("a", 10.0, 0.2)], 0.0)[0] == 0
    rising = [A.improvement(np.array([[30.0]]), np.array([[1.0]]), [B("a", 10.0, 0.2)], v)[0] for v in (0.5, 1, 2, 5, 9, 20)]
    assert rising == sorted(rising) and 0 < rising[0] < 1e-60


def test_columns_nulls_and_refusals(spark):
    rows = [(1, 10.0, 1.0), (2, None, 1.0), (3, 10.0, -1.0), (4, float("nan"), 1.0), (5, 10.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, m double, s double").repartition(2)
    t = [B("a", 10.0, 0.2)]
    got = {r["id"]: r["e"] for r in df.select("id", A.expected_improvement([F.col("m")], [F.col("s")], t, 1.0).alias("e")).collect()}
    assert got[1] == pytest.approx(A.improvement(np.array([[10.0]]), np.array([[1.0]]), t, 1.0)[0]) and got[5] == pytest.approx(1.0)
    assert got[2] is None and got[3] is None and got[4] is None
    p = {r["id"]: r["p"] for r in df.select("id", A.band_probability(F.col("m"), F.col("s"), F.lit(19.0), F.lit(20.0)).alias("p")).collect()}
    assert p[1] == pytest.approx(tail(9) - tail(10), rel=1e-12) and p[2] is None and p[3] is None and p[5] is None
    edges = df.where("id = 1").select(*(A.band_probability(F.lit(0.0), F.lit(1.0), F.lit(a), F.lit(b), kind).alias(f"p{k}") for k, (a, b, kind) in enumerate([(-1.0, 1.0, "log"), (-2.0, 0.0, "log"), (0.5, 7.0, "logit"), (1.0, 2.0, "logit")]))).first()
    assert tuple(edges) == pytest.approx((0.5, 0.0, 0.5, 0.0))
    for bad in ([], [B("a", -1.0, 0.2)], [B("a", 1.0, 0.0)], [B("a", 1.0, 0.1, "cube")]):
        with pytest.raises(ValueError):
            A.expected_improvement([F.col("m")] * len(bad), [F.col("s")] * len(bad), bad, 1.0)
    with pytest.raises(ValueError):
        A.expected_improvement([F.col("m")], [F.col("s")], t, float("nan"))


def test_scores_name_the_binding_target(spark):
    df = spark.createDataFrame([(1, 11.0, 1.0, math.log(2.0), 0.5, 0.25), (2, 10.0, 1.0, math.log(2.0), 0.1, 1.0)], "id long, m1 double, s1 double, m2 double, s2 double, p double")
    t = [B("a", 10.0, 0.1), B("b", 2.0, 0.5, "log")]
    a, b = A.score_candidates(df, ["m1", "m2"], ["s1", "s2"], "p", t, 1.0, [2.0, None]).orderBy("id").collect()
    assert a["v_mean"] == pytest.approx(1.0) and a["binding"] == "a" and a["predicted"]["b"] == pytest.approx(2.0)
    assert a["alpha"] == pytest.approx(0.25 * a["ei"]) and a["sd_ratio"] == {"a": 0.5, "b": None}
    assert b["v_mean"] == pytest.approx(0.0, abs=1e-12) and b["binding"] in "ab"


def greedy(rows, anchors, q):
    near = {i: min((math.dist(u, a) for a in anchors), default=math.inf) for i, u, _, _ in rows}
    picks, left = [], {i for i, _, _, ok in rows if ok}
    place, weight = {i: u for i, u, _, _ in rows}, {i: w for i, _, w, _ in rows}
    while left and len(picks) < q:
        best = max(left, key=lambda i: (weight[i] if not picks and not anchors else weight[i] * near[i], -i))
        picks.append(best)
        left.discard(best)
        near = {i: min(d, math.dist(place[i], place[best])) for i, d in near.items()}
    return picks


@pytest.mark.parametrize("n_anchors", [0, 7])
def test_maximin_batch_is_the_greedy_rule(spark, n_anchors):
    rows = [(i, [R.randint(0, 6) / 4, R.randint(0, 6) / 4], R.choice([0.0, 1.0, 2.0]), R.random() < 0.8) for i in range(60)]
    anchors = [(i, [R.randint(0, 6) / 4, R.randint(0, 6) / 4]) for i in range(n_anchors)]
    c = spark.createDataFrame(rows, "id long, u array<double>, weight double, admissible boolean").repartition(4)
    a = spark.createDataFrame(anchors, "id long, u array<double>")
    assert [r["id"] for r in A.maximin_batch(c, a, 6).orderBy("pick").collect()] == greedy(rows, [u for _, u in anchors], 6)


def test_maximin_batch_stops_and_refuses(spark):
    c = spark.createDataFrame([(2, [0.0], 1.0, None), (1, [0.0], 1.0, True), (3, [5.0], 1.0, False), (4, None, 1.0, True)], "id long, u array<double>, weight double, admissible boolean")
    none = spark.createDataFrame([], "id long, u array<double>")
    assert [(r["pick"], r["id"], r["distance"]) for r in A.maximin_batch(c, none, 9).orderBy("pick").collect()] == [(1, 1, None), (2, 2, 0.0)]
    assert A.maximin_batch(c.where("false"), none, 3).count() == 0
    with pytest.raises(ValueError):
        A.maximin_batch(c.withColumn("weight", F.lit(-1.0)), none, 1)


def test_penalised_batch(spark):
    rows = [(i, [R.randint(0, 9) / 3, R.randint(0, 9) / 3], None if R.random() < 0.1 else R.random()) for i in range(50)]
    alpha, picks = {i: a for i, _, a in rows if a is not None}, []
    place = {i: u for i, u, _ in rows}
    for _ in range(4):
        best = max(alpha, key=lambda i: (alpha[i], -i))
        picks.append(best)
        d = {i: math.dist(place[i], place[best]) for i in place}
        m = max(float(np.median(list(d.values()))), 1e-9)
        alpha = {i: a * (1 - math.exp(-0.5 * (d[i] / m) ** 2)) for i, a in alpha.items() if d[i] > 0.5 and i != best}
    df = spark.createDataFrame(rows, "id long, u array<double>, alpha double").repartition(3)
    assert [r["id"] for r in A.penalised_batch(df, 4, 0.5).orderBy("pick").collect()] == picks
    assert A.penalised_batch(df, 3, 100.0).count() == 1


@pytest.mark.parametrize(("metric", "apart", "share"), [("euclidean", False, 20_000), ("largest", True, 13), ("euclidean", True, 13)])
def test_neighbours_equal_all_pairs(spark, metric, apart, share):
    rows = [(i, [float(R.randint(0, 12)), float(R.randint(0, 12))] if i % 5 else [50.0 + i % 3, 9.0]) for i in range(400)]
    odd = [(900, None), (901, [float("nan"), 1.0]), (902, [None, 1.0])]
    items = spark.createDataFrame(rows + odd, "item_id long, v array<double>").repartition(4)
    queries = items.select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))
    dist = (lambda a, b: max(abs(x - y) for x, y in zip(a, b))) if metric == "largest" else math.dist
    want = {}
    for i, u in rows:
        for rank, (d, j) in enumerate(sorted((dist(u, v), j) for j, v in rows if not (apart and i == j))[:6], 1):
            want[i, rank] = (j, d)
    got = {(r["query_id"], r["rank"]): (r["item_id"], r["distance"]) for r in N.nearest(queries, items, 6, metric, apart, pivots=24, share=share).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-12) for k in want)


def test_cells_spare_visits():
    rng = np.random.default_rng(3)
    pivots = rng.uniform(0, 100, (64, 2))
    items = np.concatenate([p + rng.normal(0, 0.5, (50, 2)) for p in pivots])
    cell = N.distances(items, pivots, "euclidean").argmin(axis=1)
    held = np.bincount(cell, minlength=64)
    radius = np.array([np.max(np.sqrt(((items[cell == c] - pivots[c]) ** 2).sum(axis=1)), initial=0) for c in range(64)])
    to = N.distances(items, pivots, "euclidean")
    first = N.first_cells(to, held, 5)
    bound = np.sort(np.where(first[:, cell], N.distances(items, items, "euclidean"), np.inf), axis=1)[:, 4]
    further = N.further_cells(to, held, radius, 5, bound)
    assert (first.sum() + further.sum()) < 0.06 * first.size
    true = np.sort(N.distances(items, items, "euclidean"), axis=1)[:, 4]
    seen = np.where((first | further)[:, cell], N.distances(items, items, "euclidean"), np.inf)
    assert np.allclose(np.sort(seen, axis=1)[:, 4], true)


def test_few_or_no_items(spark):
    items = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "item_id long, v array<double>")
    asked = spark.createDataFrame([(7, [1.0]), (8, None)], "query_id long, q array<double>")
    assert [tuple(r) for r in N.nearest(asked, items, 5).orderBy("rank").collect()] == [(7, 1, 1.0, 1), (7, 2, 2.0, 2)]
    assert N.nearest(asked, items.where("false"), 5).count() == 0
    assert N.nearest(asked.where("false"), items, 5).count() == 0


def test_gate_standardises_its_axes(spark):
    rows = [(i, [R.random(), R.random() * 1e4]) for i in range(300)]
    training = spark.createDataFrame(rows, "item_id long, v array<double>")
    asked = spark.createDataFrame([(1, [5.0, 5000.0]), (2, [0.5, 5000.0]), (3, None)], "query_id long, q array<double>")
    got = {r["query_id"]: (r["distance"], r["inside"]) for r in N.hull_gate(training, asked).collect()}
    x = np.array([v for _, v in rows])
    z, q = (x - x.mean(0)) / x.std(0), (np.array([[5.0, 5000.0], [0.5, 5000.0]]) - x.mean(0)) / x.std(0)
    own = np.sort(N.distances(z, z, "euclidean"), axis=1)[:, 5]
    far = np.sort(N.distances(q, z, "euclidean"), axis=1)[:, 4]
    assert got == {1: (pytest.approx(far[0]), False), 2: (pytest.approx(far[1]), True)}
    assert far[0] > 13 and np.quantile(own, 0.99) < 1
    assert tuple(N.share_inside(training, asked).first()) == (0.5, 2)
    assert tuple(N.share_inside(training.limit(1), asked).first()) == (None, 2)


def test_density_radius(spark):
    rows = [(i, [R.random(), R.random(), R.random()]) for i in range(151)]
    x = np.array([v for _, v in rows])
    kth = np.sort(N.distances(x, x, "largest"), axis=1)[:, 10]
    df = spark.createDataFrame(rows, "item_id long, v array<double>")
    assert N.density_radius(df).first()["radius"] == pytest.approx(np.median(kth))
    assert N.density_radius(df.limit(3), 10).first()["radius"] > 0
    with pytest.raises(ValueError):
        N.density_radius(df.limit(1))


def test_quantiles_with_outliers(spark):
    values = [R.random() for _ in range(500)] + [1e300, -1e300, 7.0, 7.0, 7.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    for level in (0.0, 0.31, 0.5, 0.99, 1.0):
        assert ranks.quantile(df, "v", level) == pytest.approx(float(np.quantile(values, level)))
    assert ranks.quantile(df.where("false"), "v", 0.5) is None


def test_band_query_against_the_normal_distribution(spark, sf_dir):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").collect():
        spread = r["l_linenumber"] / 4
        want.setdefault((r["l_orderkey"], r["l_linenumber"]), []).append(chance((20 - r["l_quantity"]) / spread, (30 - r["l_quantity"]) / spread))
    got = {}
    for r in search.m24_band_probability(spark, sf_dir).collect():
        got.setdefault((r["l_orderkey"], r["l_linenumber"]), []).append(r["p"])
    assert got.keys() == want.keys()
    assert all(sorted(got[k]) == pytest.approx(sorted(want[k]), rel=1e-9, abs=1e-300) for k in want)


def test_score_query_against_dense_sums(spark, sf_dir):
    rows = search.m28_scored_candidates(spark, sf_dir).collect()
    given = {r["p_partkey"]: r for r in search.candidates(spark, sf_dir).collect()}
    assert len(rows) == len(given) and any(r["ei"] > 1e-3 for r in rows)
    for r in rows[:: len(rows) // 12]:
        g = given[r["p_partkey"]]
        assert r["ei"] == pytest.approx(dense([g["m1"], g["m2"]], [g["s1"], g["s2"]], search.TARGETS, search.BEST), rel=1e-8)
    for r in rows:
        g = given[r["p_partkey"]]
        off = [abs(y - t.observed) / (t.uncertainty * t.observed) for y, t in zip((g["m1"], math.exp(g["m2"])), search.TARGETS)]
        assert r["v_mean"] == pytest.approx(max(off)) and r["binding"] == search.TARGETS[off.index(max(off))].name
        assert r["alpha"] == pytest.approx(r["ei"] * g["viable"])
