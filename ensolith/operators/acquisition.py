"""Search for better parameter sets: expected improvement of candidates, scores and batches.

A case's violation V is the largest of |y - observed| / (uncertainty * observed) over its
targets. Every candidate has an independent normal posterior for each target, in the space of the
target's transform.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ensolith.functions import normal
from ensolith.functions.columns import untransformed
from ensolith.lineage import cut
from ensolith.operators.neighbours import nearest
from ensolith.operators.ranks import quantile

#: Relative error at which a segment of the integral is accepted, and rows integrated at once.
TOLERANCE = 1e-11
ROWS = 256
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)


class Band(NamedTuple):
    """A target: its values within observed * (1 -/+ uncertainty) satisfy it."""

    name: str
    observed: float
    uncertainty: float
    transform: str = "identity"


def _checked(targets: list[Band]) -> list[Band]:
    if not targets:
        raise ValueError("no targets: there is no largest violation")
    for t in targets:
        if t.transform not in ("identity", "log", "logit"):
            raise ValueError(f"{t.name}: unknown transform {t.transform!r}")
        if not (np.isfinite(t.observed) and t.observed > 0 and np.isfinite(t.uncertainty) and t.uncertainty > 0):
            raise ValueError(f"{t.name}: a band needs a positive observed value and uncertainty")
    return targets


def _first_cuts(mu: np.ndarray, sd: np.ndarray, targets: list[Band], best: float) -> np.ndarray:
    """(rows, cuts) of [0, best]: where the posterior of any target crosses its band, where a band leaves the domain, and ever nearer to best."""
    n = len(mu)
    cuts = [np.zeros(n), np.full(n, best)] + [np.full(n, best * (1 - 8.0**-j)) for j in range(1, 13)]
    for k, t in enumerate(targets):
        scale = t.uncertainty * t.observed
        with np.errstate(over="ignore", invalid="ignore"):
            cuts += [np.abs(normal.native(mu[:, k] + c * sd[:, k], t.transform) - t.observed) / scale for c in (-8, -2, 0, 2, 8)]
        if t.transform != "identity":
            cuts.append(np.full(n, 1 / t.uncertainty))
        if t.transform == "logit":
            cuts.append(np.full(n, abs(1 / t.observed - 1) / t.uncertainty))
    at = np.stack(cuts, axis=1)
    return np.sort(np.clip(np.where(np.isfinite(at), at, best), 0, best), axis=1)


def improvement(mu: np.ndarray, sd: np.ndarray, targets: list[Band], best: float) -> np.ndarray:
    """E[max(0, best - V)] of each row (n, targets): the integral of P(V <= t) over t from 0 to best.

    Gauss-Legendre sums over the segments between the first cuts; a segment whose two halves
    say something else than it does, as against the row's whole, is cut in two, until none is. The
    integrand never falls, so a segment's area lies between its width times the values before and
    behind it; where these leave less than the tolerance open, its halves are not asked.
    """
    out = np.zeros(len(mu))
    if best <= 0:
        return out
    floor = np.array([1e-12 * t.uncertainty * t.observed if t.transform == "identity" else 1e-12 for t in targets])
    sd = np.maximum(sd, floor)
    for first in range(0, len(mu), ROWS):
        m, s = mu[first : first + ROWS], sd[first : first + ROWS]

        def values(row, a, b, m=m, s=s):
            half = (b - a) / 2
            t = (a + b)[:, None] / 2 + half[:, None] * _NODES
            p = np.ones_like(t)
            for k, x in enumerate(targets):
                p *= normal.band(m[row, k, None], s[row, k, None], x.observed * (1 - t * x.uncertainty), x.observed * (1 + t * x.uncertainty), x.transform)
            return p, (p * _WEIGHTS).sum(axis=1) * half

        def area(row, a, b):
            return values(row, a, b)[1]

        cuts = _first_cuts(m, s, targets, best)
        row, at = np.nonzero(cuts[:, 1:] > cuts[:, :-1])
        a, b = cuts[row, at], cuts[row, at + 1]
        p, whole = values(row, a, b)
        follows = row[1:] == row[:-1]
        before = np.concatenate([[0.0], np.where(follows, p[:-1, -1], 0.0)])[: len(row)]
        behind = np.concatenate([np.where(follows, p[1:, 0], 1.0), [1.0]])[: len(row)]
        settled = (b - a) * (behind - before) <= TOLERANCE * np.bincount(row, whole, len(m))[row]
        done = np.bincount(row[settled], whole[settled], len(m))
        row, a, b, whole = (x[~settled] for x in (row, a, b, whole))
        for _ in range(60):
            middle = (a + b) / 2
            left, right = area(row, a, middle), area(row, middle, b)
            sure = done + np.bincount(row, left + right, len(m))
            open_ = (np.abs(left + right - whole) > TOLERANCE * sure[row]) & (middle > a) & (middle < b)
            done += np.bincount(row[~open_], (left + right)[~open_], len(m))
            row, a, b, whole = (np.concatenate([x[open_], y[open_]]) for x, y in ((row, row), (a, middle), (middle, b), (left, right)))
            if not len(row):
                break
        done += np.bincount(row, whole, len(m))
        out[first : first + ROWS] = done
    return out


def band_probability(mu: Column, sd: Column, low: Column, high: Column, transform: str = "identity") -> Column:
    """P(low < value < high) for a value normal in the space of the transform, the limits native.

    Null where anything is null or sd is not positive. Far tails keep their digits.
    """
    normal.fitted_edge(0.5, transform)  # refuses unknown transforms

    @F.pandas_udf("double")
    def of(m: pd.Series, s: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        m, s, a, b = (x.to_numpy(float, na_value=np.nan) for x in (m, s, a, b))
        ok = (s > 0) & ~np.isnan(m + s) & ~np.isnan(a) & ~np.isnan(b)
        p = normal.band(np.where(ok, m, 0), np.where(ok, s, 1), np.where(ok, a, 0), np.where(ok, b, 0), transform)
        return pd.Series(p).where(ok)

    return of(*(c.cast("double") for c in (mu, sd, low, high)))


def expected_improvement(mu: list[Column], sd: list[Column], targets: list[Band], best: float) -> Column:
    """E[max(0, best - V)] of a candidate's posterior, a mean and deviation for each target.

    Deviations are at least 1e-12 (of the band, for identity targets). best must be finite and is
    what has been reached; from 0 down nothing improves on it. Null where a mean or deviation is
    null, not finite, or a deviation is negative.
    """
    targets = _checked(list(targets))
    if len(mu) != len(targets) or len(sd) != len(targets):
        raise ValueError("a mean and a deviation for each target, in their order")
    if best is None or not np.isfinite(best):
        raise ValueError("nothing has been reached that could be improved on: start without expected improvement")
    many = len(targets)

    @F.pandas_udf("double")
    def of(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float, na_value=np.nan) for c in columns], axis=1)
        ok = np.isfinite(x).all(axis=1) & (x[:, many:] >= 0).all(axis=1)
        got = np.full(len(x), np.nan)
        got[ok] = improvement(x[ok, :many], x[ok, many:], targets, float(best))
        return pd.Series(got).where(ok)

    return of(*(c.cast("double") for c in [*mu, *sd]))


def score_candidates(candidates: DataFrame, mu: list[str], sd: list[str], viable: str, targets: list[Band], best: float, spreads: list[float] | None = None) -> DataFrame:
    """candidates with ei, alpha (chance of being viable times ei), predicted (native means by name), v_mean, binding and sd_ratio.

    v_mean is V at the posterior means and binding the first target that sets it; sd_ratio is by
    name the deviation over that of the target's training values, null without a positive one.
    """
    targets = _checked(list(targets))
    scored = candidates.withColumn("ei", expected_improvement([F.col(c) for c in mu], [F.col(c) for c in sd], targets, best))
    native = [untransformed(F.col(c), t.transform) for c, t in zip(mu, targets)]
    off = [F.abs(y - t.observed) / (t.uncertainty * t.observed) for y, t in zip(native, targets)]
    v = F.greatest(*off) if len(off) > 1 else off[0]
    binding = F.coalesce(*(F.when(o == v, F.lit(t.name)) for o, t in zip(off, targets)))
    ratios = [F.when(F.lit(bool(x and x > 0)), F.col(c) / F.lit(float(x or 1))) for c, x in zip(sd, spreads or [None] * len(targets))]
    by_name = lambda values: F.create_map(*(x for t, y in zip(targets, values) for x in (F.lit(t.name), y)))
    return scored.select("*", (F.col(viable) * F.col("ei")).alias("alpha"), by_name(native).alias("predicted"), v.alias("v_mean"), binding.alias("binding"), by_name(ratios).alias("sd_ratio"))


def _apart(u: Column, v: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(u, v, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def maximin_batch(candidates: DataFrame, anchors: DataFrame, q: int) -> DataFrame:
    """(pick, id, distance): q candidates (id, u, weight, admissible) one after the other, each as far from all before as can be.

    A pick has the largest weight * distance to the nearest anchor (id, u) or earlier pick, the
    smallest id of equal ones; the first one without any anchor has the largest weight. Fewer
    picks where fewer candidates are admissible. Every round is one pass that lowers the distances,
    a maximum of partial maxima, and a checkpoint; a pick is a row that goes to all tasks,
    and no candidate comes to the driver. ids must be distinct; rows with a null id, point or weight are left out.
    """
    if q < 0:
        raise ValueError(f"no number of picks: {q}")
    spark = candidates.sparkSession
    known = candidates.where("id is not null and u is not null and weight is not null").select(F.col("id").cast("long").alias("id"), F.col("u").cast("array<double>").alias("u"), F.col("weight").cast("double").alias("weight"), F.coalesce("admissible", F.lit(True)).alias("admissible"))
    if known.where("weight < 0 or isnan(weight) or weight = double('inf')").limit(1).count():
        raise ValueError("weights must be finite and not negative")
    anchored = anchors.limit(1).count() > 0
    if anchored:
        near = nearest(known.select(F.col("id").alias("query_id"), F.col("u").alias("q")), anchors.select(F.col("id").alias("item_id"), F.col("u").alias("v")), 1)
        state = known.join(near.select(F.col("query_id").alias("id"), F.col("distance").alias("near")), "id", "left")
    else:
        state = known.withColumn("near", F.lit(float("inf")))
    state = cut(state)
    picks = []
    for k in range(1, min(q, state.where("admissible").count()) + 1):
        score = F.col("weight") if k == 1 and not anchored else F.col("weight") * F.col("near")
        best = cut(state.where("admissible").agg(F.max_by(F.struct("id", "u", "near"), F.struct(score, -F.col("id"))).alias("p")).select(F.lit(k).alias("pick"), "p.*"))
        picks.append(best.select("pick", "id", F.when(F.col("near") < float("inf"), F.col("near")).alias("distance")))
        one = F.broadcast(best.select(F.col("id").alias("_id"), F.col("u").alias("_u")))  # one row
        state = cut(state.crossJoin(one).select("id", "u", "weight", (F.col("admissible") & (F.col("id") != F.col("_id"))).alias("admissible"), F.least("near", _apart(F.col("u"), F.col("_u"))).alias("near")))
    out = spark.createDataFrame([], "pick int, id long, distance double")
    for p in picks:
        out = out.unionByName(p)
    return out


def penalised_batch(candidates: DataFrame, q: int, separation: float = 0.0) -> DataFrame:
    """(pick, id, alpha): the largest alpha of candidates (id, u, alpha), then that of what is left, damped around each pick.

    Every alpha is multiplied by 1 - exp(-(d / m)^2 / 2), d being the distance to the pick and m the
    median d of all candidates; candidates within ``separation`` of a pick are out. Null alphas
    are inadmissible but count for m. Fewer picks where none is left.
    """
    if q < 0 or not separation >= 0 or separation == float("inf"):
        raise ValueError("no number of picks or no separation")
    spark = candidates.sparkSession
    state = cut(candidates.select(F.col("id").cast("long").alias("id"), F.col("u").cast("array<double>").alias("u"), F.col("alpha").cast("double").alias("alpha")))
    if state.where("u is null or exists(u, x -> x is null or isnan(x)) or isnan(alpha) or alpha = double('inf')").limit(1).count():
        raise ValueError("candidates need finite places and values")
    out = spark.createDataFrame([], "pick int, id long, alpha double")
    for k in range(1, q + 1):
        best = cut(state.where("alpha is not null").agg(F.max_by(F.struct("id", "u", "alpha"), F.struct("alpha", -F.col("id"))).alias("p")).where("p is not null").select(F.lit(k).alias("pick"), "p.*"))
        if not best.count():
            break
        out = out.unionByName(best.select("pick", "id", "alpha"))
        one = F.broadcast(best.select(F.col("id").alias("_id"), F.col("u").alias("_u")))  # one row
        apart = cut(state.crossJoin(one).withColumn("d", _apart(F.col("u"), F.col("_u"))))
        middle = max(quantile(apart, "d", 0.5), 1e-9)
        damped = F.col("alpha") * (1 - F.exp(-0.5 * (F.col("d") / middle) ** 2))
        state = cut(apart.select("id", "u", F.when((F.col("d") > separation) & (F.col("id") != F.col("_id")), damped).alias("alpha")))
    return out
