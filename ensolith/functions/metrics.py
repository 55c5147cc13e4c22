"""Error and skill metrics of simulated against observed values, as aggregate expressions.

Every metric is a Column over a group's rows, so many of them cost one aggregation. Missing
values are nulls (NaN is turned into null); a metric that the data cannot define is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column, fill: float = 1e29) -> Column:
    """NaN and fill values as null."""
    return F.when(~F.isnan(c) & (F.abs(c) < fill), c)


def _paired(s: Column, o: Column) -> tuple[Column, Column]:
    """Both sides, null wherever either is missing."""
    s, o = clean(s), clean(o)
    both = s.isNotNull() & o.isNotNull()
    return F.when(both, s), F.when(both, o)


def weighted(x: Column, w: Column | None = None) -> Column:
    """Mean over the rows, weighted if there is a weight."""
    return F.avg(x) if w is None else F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def relative_error(s: Column, o: Column, w: Column | None = None) -> Column:
    s, o = _paired(s, o)
    return weighted(F.try_divide(F.abs(s - o), F.abs(o)), w)


def relative_bias(s: Column, o: Column, w: Column | None = None) -> Column:
    s, o = _paired(s, o)
    return weighted(F.try_divide(s - o, o), w)


def rmse(s: Column, o: Column, w: Column | None = None) -> Column:
    s, o = _paired(s, o)
    return F.sqrt(weighted((s - o) * (s - o), w))


def mae(s: Column, o: Column, w: Column | None = None) -> Column:
    s, o = _paired(s, o)
    return weighted(F.abs(s - o), w)


def bias(s: Column, o: Column, w: Column | None = None) -> Column:
    s, o = _paired(s, o)
    return weighted(s - o, w)


def nrmse(s: Column, o: Column, by: str = "range") -> Column:
    """RMSE over the range, mean or standard deviation of the observations, or over one observed value.

    A spread of zero falls back to the mean; with a mean of zero too there is no scale, and the result is null.
    """
    _, o = _paired(s, o)
    scale = {"range": F.max(o) - F.min(o), "mean": F.abs(F.avg(o)), "std": F.stddev_pop(o), "observed": F.abs(F.max(o))}[by]
    return F.try_divide(rmse(s, o), F.when(scale != 0, scale).otherwise(F.abs(F.avg(o))))


def nse(s: Column, o: Column) -> Column:
    """1 - SSres / SStot; constant observations give 1 if met exactly, else minus infinity."""
    s, o = _paired(s, o)
    total = F.var_pop(o) * F.count(o)
    left = F.sum((s - o) * (s - o))
    return F.when(total > 0, 1 - F.try_divide(left, total)).when(left == 0, 1.0).when(left > 0, float("-inf"))


def correlation(s: Column, o: Column) -> Column:
    """Pearson; zero where either side is constant, null without any pair."""
    s, o = _paired(s, o)
    spread = F.stddev_pop(s) * F.stddev_pop(o)
    return F.when(spread > 0, F.try_divide(F.covar_pop(s, o), spread)).when(F.count(o) > 0, 0.0)


def _ratio(a: Column, b: Column) -> Column:
    """a / b; over zero 1 if a is zero too, else infinite."""
    return F.when(b != 0, F.try_divide(a, b)).when(a == 0, 1.0).otherwise(F.lit(float("inf")))


def kge(s: Column, o: Column) -> Column:
    """Kling-Gupta efficiency from correlation, spread ratio and mean ratio."""
    r = correlation(s, o)
    s, o = _paired(s, o)
    alpha, beta = _ratio(F.stddev_pop(s), F.stddev_pop(o)), _ratio(F.avg(s), F.avg(o))
    return F.when(F.count(o) > 0, 1 - F.sqrt((r - 1) * (r - 1) + (alpha - 1) * (alpha - 1) + (beta - 1) * (beta - 1)))


SKILLS = {"nse": nse, "kge": kge, "correlation": correlation}
ERRORS = {"relative_error": relative_error, "relative_bias": relative_bias, "rmse": rmse, "mae": mae, "bias": bias, "nrmse": nrmse}


def metric(name: str, s: Column, o: Column) -> Column:
    return {**ERRORS, **SKILLS}[name](s, o)


def to_cost(value: Column, name: str) -> Column:
    """Skills turn into costs as 1 - value; errors are costs already."""
    return 1 - value if name in SKILLS else value


def composite(cost: Column, how: str = "rmsre", weight: Column | None = None) -> Column:
    """A case's composite of its targets' costs: rmsre (also rms), mean, weighted_mean, max or sum."""
    if how == "weighted_mean" and weight is None:
        raise ValueError("a weighted mean needs weights")
    w = F.lit(1.0) if weight is None else weight
    kinds = {"rmsre": F.sqrt(weighted(cost * cost, weight)), "mean": weighted(cost, weight), "max": F.max(cost), "sum": F.sum(w * cost)}
    kinds |= {"rms": kinds["rmsre"], "weighted_mean": kinds["mean"]}
    if how not in kinds:
        raise ValueError(f"no such composite: {how}")
    return kinds[how]


def composite_unless_missing(cost: Column, n_targets: int) -> Column:
    """The root mean square of a case's costs, null unless all of its targets have one."""
    return F.when(F.count(clean(cost)) == n_targets, F.sqrt(F.avg(cost * cost)))


def within_tolerance(s: Column, o: Column, tolerance: float, kind: str = "relative") -> Column:
    if kind == "absolute":
        return F.coalesce(F.abs(s - o) <= tolerance, F.lit(False))
    return F.coalesce(F.when(o == 0, F.abs(s) <= tolerance).otherwise(F.abs(s - o) <= tolerance * F.abs(o)), F.lit(False))
