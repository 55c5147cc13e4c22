"""Contrasts between the ends of a parameter: hand-worked values, numpy's quantiles and plain ranks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensolith.operators import contrasts as N


def plain_ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    made = [("a", k, float(r.randrange(12)), 0.0) for k in range(60)] + [("b", k, r.random(), r.random()) for k in range(45)] + [("c", k, 1.0 * k, 2.0) for k in range(5)]
    made = [(g, k, x, 100 - 7 * x + r.random() if g == "a" else y) for g, k, x, y in made]
    return made + [("a", 98, None, 1.0), ("a", 99, float("nan"), 1.0), ("b", 99, 1.0, None)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "g string, id int, x double, y double")


def known(rows, g):
    return [(k, x, y) for h, k, x, y in rows if h == g and x is not None and y is not None and x == x]


def test_quartiles_and_ranks(table, rows):
    got = {r["g"]: r for r in N.quartile_contrast(table, ["g"], "x", "y", ["id"]).collect()}
    assert sorted(got) == ["a", "b"]
    for g, r in got.items():
        _, x, y = (np.array(c) for c in zip(*known(rows, g)))
        low, high = y[x <= np.percentile(x, 25)].mean(), y[x >= np.percentile(x, 75)].mean()
        rho = np.corrcoef(plain_ranks(list(x)), plain_ranks(list(y)))[0, 1]
        assert (r["n"], r["low"], r["high"], r["ratio"], r["rho"]) == (len(x), *(pytest.approx(v) for v in (low, high, low / high, rho)))
    assert got["a"]["link"] == "strong" and got["a"]["p"] < 1e-6
    assert got["b"]["link"] != "strong"


def test_tails(table, rows):
    got = {r["g"]: r for r in N.tail_contrast(table, ["g"], "x", "y", ["id"]).collect()}
    for g, r in got.items():
        own = sorted(known(rows, g), key=lambda v: (v[1], v[0]))
        size = max(1, int(len(own) * 0.1))
        low, high = (np.mean([v[2] for v in part]) for part in (own[:size], own[-size:]))
        assert (r["low"], r["high"], r["ratio"]) == tuple(pytest.approx(v) for v in (low, high, high / low))
        assert r["r"] == pytest.approx(np.corrcoef([v[1] for v in own], [v[2] for v in own])[0, 1])
    assert sorted(got) == ["a", "b"]


def test_failures(spark):
    df = spark.createDataFrame([("a", k, float(k), k < 2) for k in range(8)] + [("b", 0, 1.0, None), ("b", 1, None, True)], "g string, id int, y double, f boolean")
    got = {r["g"]: tuple(r)[1:] for r in N.failure_rates(df, ["g"], F.col("f"), "y", 0.5).collect()}
    assert got == {"a": (8, 2, 1.0, pytest.approx(2 / 6), True), "b": (1, 0, 0.0, 0.0, False)}


def test_verdicts(spark):
    tails = lambda *v: spark.createDataFrame(list(v), "r double, ratio double")
    signs = lambda *v: spark.createDataFrame(list(v), "rho double, p double")
    ask = lambda t, s: tuple(N.cascade_verdict(t, s).first())
    assert ask(tails((0.4, 8.0), (0.4, 4.0)), signs((0.1, 0.01))) == (pytest.approx(0.4), 6.0, False, True)
    assert ask(tails((0.4, 3.0)), signs((-0.5, 0.2))) == (0.4, 3.0, False, False)
    assert ask(tails((0.0, 1.0)), signs((-0.5, 0.01))) == (0.0, 1.0, True, True)
    assert ask(tails(), signs()) == (0.0, 1.0, False, False)
