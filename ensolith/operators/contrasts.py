"""Contrasts of an outcome between the ends of a parameter, within groups: tails, quartiles, failures, rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ensolith.operators.budgets import correlation_test
from ensolith.lineage import cut
from ensolith.operators.ranks import numbered, per_group, values_at

_TINY = 1e-10


def _known(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def group_quantiles(df: DataFrame, keys: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """(keys, n, and a column for each name): exact quantiles of each group's values, between their two nearest order statistics."""
    at = {name: (F.col("n") - 1) * F.lit(level) for name, level in levels.items()}
    places = {f"_{side}_{name}": F.least(F.floor(x) + step, F.col("n")) for name, x in at.items() for side, step in (("a", 1), ("b", 2))}
    found = values_at(df, keys, value, places)
    return found.select(*keys, "n", *((F.col(f"_a_{name}") + (x - F.floor(x)) * (F.col(f"_b_{name}") - F.col(f"_a_{name}"))).alias(name) for name, x in at.items()))


def group_quantile(df: DataFrame, keys: list[str], value: str, level: float, out: str) -> DataFrame:
    """(keys, out): one exact quantile of each group's values."""
    return group_quantiles(df, keys, value, {out: level}).select(*keys, out)


def group_places(df: DataFrame, keys: list[str], value: str, tie: list[str], out: str) -> DataFrame:
    """df with places from 1 by value within each group; ``tie`` makes rows distinct. No task has to hold a group."""
    order = [F.col(c).asc_nulls_last() for c in (*keys, value, *tie)]
    rows = numbered(df, order, "_place")
    first = cut(rows.groupBy(*keys).agg((F.min("_place") - 1).alias("_before")))
    return per_group(rows, first, keys).withColumn(out, F.col("_place") - F.col("_before")).drop("_place", "_before")


def group_ranks(df: DataFrame, keys: list[str], value: str, tie: list[str], out: str) -> DataFrame:
    """df with ranks by value within each group, equal values sharing their mean rank."""
    rows = group_places(df, keys, value, tie, "_own")
    shared = cut(rows.groupBy(*keys, value).agg(((F.min("_own") + F.max("_own")) / 2).alias(out)))
    return per_group(rows, shared, [*keys, value]).drop("_own")


def rank_correlation(df: DataFrame, keys: list[str], x: str, y: str, tie: list[str], least: int = 20) -> DataFrame:
    """(keys, n, rho, p): Spearman's correlation and its two-sided p; groups of fewer than ``least`` known pairs give no row."""
    known = _known(df.select(*dict.fromkeys([*keys, x, y, *tie])), x, y)
    ranked = group_ranks(group_ranks(known, keys, x, tie, "_x"), keys, y, tie, "_y")
    return correlation_test(ranked, "_x", "_y", keys).where(F.col("n") >= least).select(*keys, "n", F.col("r").alias("rho"), "p")


def quartile_contrast(df: DataFrame, keys: list[str], parameter: str, outcome: str, tie: list[str], least: int = 20) -> DataFrame:
    """(keys, n, rho, p, low, high, ratio, link): mean outcome up to the parameter's first quartile against that from its third.

    ratio is low over high. link is strong where it exceeds 1.5 at p below 0.05, else weak where |rho| is below 0.1, else null.
    Groups of fewer than ``least`` known pairs give no row.
    """
    known = _known(df, parameter, outcome)
    ends = cut(group_quantiles(known, keys, parameter, {"_q1": 0.25, "_q3": 0.75}).drop("n"))
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col(outcome))), F.lit(0.0))
    g = per_group(known, ends, keys).groupBy(*keys).agg(mean(F.col(parameter) <= F.col("_q1")).alias("low"), mean(F.col(parameter) >= F.col("_q3")).alias("high"))
    both = g.join(rank_correlation(df, keys, parameter, outcome, tie, least), keys).withColumn("ratio", F.try_divide(F.col("low"), F.col("high") + _TINY))
    link = F.when((F.col("ratio") > 1.5) & (F.col("p") < 0.05), "strong").when(F.abs("rho") < 0.1, "weak")
    return both.select(*keys, "n", "rho", "p", "low", "high", "ratio", link.alias("link"))


def tail_contrast(df: DataFrame, keys: list[str], parameter: str, outcome: str, tie: list[str], share: float = 0.1, least: int = 20) -> DataFrame:
    """(keys, n, r, low, high, ratio): Pearson's r and the mean outcome of the ``share`` smallest and largest parameters.

    Each end has the share of the group's known pairs, rounded down, one at least; ties go by ``tie``. ratio is high over
    low. Groups of fewer than ``least`` known pairs give no row.
    """
    known = _known(df, parameter, outcome)
    linked = correlation_test(known, parameter, outcome, keys).where(F.col("n") >= least).select(*keys, "n", "r")
    rows = per_group(group_places(known, keys, parameter, tie, "_at"), cut(linked.select(*keys, "n")), keys)
    size = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share)))
    ends = rows.groupBy(*keys).agg(F.avg(F.when(F.col("_at") <= size, F.col(outcome))).alias("low"), F.avg(F.when(F.col("_at") > F.col("n") - size, F.col(outcome))).alias("high"))
    return linked.join(ends, keys).withColumn("ratio", F.try_divide(F.col("high"), F.col("low") + _TINY))


def failure_rates(df: DataFrame, keys: list[str], flagged: Column, outcome: str, level: float = 0.25, times: float = 1.5) -> DataFrame:
    """(keys, n, n_flagged, rate_flagged, rate_rest, raised): shares of flagged and other rows below the outcome's quantile.

    A side without rows has the rate 0. raised: the rest fails at times, and flagged rows more than ``times`` as often.
    Rows without outcome are left out; a null flag counts as none.
    """
    known = _known(df.withColumn("_f", F.coalesce(flagged, F.lit(False))), outcome)
    failed = F.when(F.col(outcome) < F.col("_q"), 1.0).otherwise(0.0)
    rate = lambda c: F.coalesce(F.avg(F.when(c, failed)), F.lit(0.0))
    g = per_group(known, cut(group_quantile(known, keys, outcome, level, "_q")), keys).groupBy(*keys)
    out = g.agg(F.count("*").alias("n"), F.count_if("_f").alias("n_flagged"), rate(F.col("_f")).alias("rate_flagged"), rate(~F.col("_f")).alias("rate_rest"))
    return out.withColumn("raised", (F.col("rate_rest") > 0) & (F.col("rate_flagged") > times * F.col("rate_rest")))


def cascade_verdict(tails: DataFrame, signature: DataFrame) -> DataFrame:
    """One row (mean_r, mean_ratio, cascade, supported) of tail_contrast's groups and rank_correlation's of the signature.

    cascade: a group's rho below -0.3 at p below 0.05. Supported: mean r above 0.3 with a mean ratio above 5, or a cascade.
    """
    means = tails.agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("mean_r"), F.coalesce(F.avg("ratio"), F.lit(1.0)).alias("mean_ratio"))
    seen = signature.agg(F.coalesce(F.bool_or((F.col("rho") < -0.3) & (F.col("p") < 0.05)), F.lit(False)).alias("cascade"))
    held = ((F.col("mean_r") > 0.3) & (F.col("mean_ratio") > 5)) | F.col("cascade")
    return means.join(seen, F.lit(True)).withColumn("supported", held)  # one row each
