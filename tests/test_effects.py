"""Confidence of elementary effects against resampling."""

import numpy as np
import pytest

from ensolith.operators import sensitivity as V


def test_confidence_is_what_resampling_tends_to(spark):
    rng = np.random.default_rng(2)
    effects = rng.normal(0.5, 2.0, 40)
    rows = [(k, s, "p", float(s), float(s * effects[k])) for k in range(40) for s in (0, 1)]
    got = V.elementary_effects(spark.createDataFrame(rows, "t int, s int, p string, x double, y double"), "t", "s", "p", "x", "y").first()
    drawn = np.abs(effects)[rng.integers(0, 40, (20_000, 40))].mean(axis=1)
    assert (got["n"], got["mu_star"]) == (40, pytest.approx(np.abs(effects).mean()))
    assert got["mu_star_conf"] == pytest.approx(1.959964 * drawn.std(), rel=0.03)
