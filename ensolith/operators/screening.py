"""Ranking and screening of cases against targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ensolith.functions import metrics as M
from ensolith.functions.columns import steady
from ensolith.operators import ranks as K


def score_targets(simulated: DataFrame, targets: DataFrame, method: str = "relative_error", tolerance: float = 0.2) -> DataFrame:
    """(case_id, target, cost, satisfied) of long (case_id, target, sim) against (target, observed)."""
    both = simulated.join(F.broadcast(targets), "target")  # targets: the calibration's own short list
    s, o = F.col("sim"), F.col("observed")
    cost = {"relative_error": F.try_divide(F.abs(s - o), F.abs(o)), "absolute": F.abs(s - o), "relative_bias": F.try_divide(s - o, o)}[method]
    return both.select("case_id", "target", cost.alias("cost"), M.within_tolerance(s, o, tolerance).alias("satisfied"))


def rank_cases(scored: DataFrame, how: str = "rmsre", digits: int = 9) -> DataFrame:
    """(case_id, composite, n_satisfied, rank): ascending composite, rounded to ``digits`` decimals, then case_id."""
    c = scored.groupBy("case_id").agg(M.composite(F.col("cost"), how).alias("composite"), F.count_if("satisfied").alias("n_satisfied"))
    return K.numbered(c, [F.round("composite", digits).asc_nulls_last(), F.col("case_id").asc()])


def best_cases(ranked: DataFrame, within: int = 10) -> DataFrame:
    """The case that satisfies most targets among the ``within`` cheapest, then the cheapest of them to 12 digits, then the smallest; and the cheapest itself."""
    top = ranked.where(F.col("rank") <= within)
    best = F.max_by("case_id", F.struct("n_satisfied", -steady(F.col("composite")), -F.col("case_id")))
    return top.agg(best.alias("best_case"), F.min_by("case_id", "rank").alias("lowest_cost_case"))


def satisfied_distribution(ranked: DataFrame, n_targets: int) -> DataFrame:
    """Cases by number of satisfied targets, empty bins included."""
    bins = ranked.sparkSession.range(0, n_targets + 1).select(F.col("id").alias("n_satisfied"))
    return bins.join(ranked.groupBy("n_satisfied").agg(F.count("*").alias("n")), "n_satisfied", "left").select("n_satisfied", F.coalesce("n", F.lit(0)).alias("n_cases"))


def violation(simulated: DataFrame, targets: DataFrame, n_targets: int) -> DataFrame:
    """V = largest |sim - observed| / (uncertainty * |observed|) of a case and the target that binds; null unless complete."""
    r = simulated.join(F.broadcast(targets), "target").withColumn("v", F.try_divide(F.abs(F.col("sim") - F.col("observed")), F.col("uncertainty") * F.abs("observed")))
    out = r.groupBy("case_id").agg(F.max("v").alias("v"), F.max_by("target", F.struct("v", "target")).alias("binding"), F.count("v").alias("n"))
    full = F.col("n") == n_targets
    return out.select("case_id", F.when(full, F.col("v")).alias("v"), F.when(full, F.col("binding")).alias("binding"))


def compare_rankings(cases: DataFrame, a: str, b: str, top: int) -> DataFrame:
    """Overlap of the two top lists, Spearman correlation (null below three cases), and whether both name the same best case."""
    r = K.average_ranks(K.average_ranks(cases, a, "case_id", "ra"), b, "case_id", "rb")
    first = lambda v: F.struct(F.col(v), F.col("case_id"))
    lists = [cases.orderBy(F.col(v).asc_nulls_last(), "case_id").limit(top).select("case_id") for v in (a, b)]
    shared = lists[0].join(lists[1], "case_id").agg(F.count("*").alias("overlap"))
    spearman = F.when(F.count("*") >= 3, M.correlation(F.col("ra"), F.col("rb")))
    whole = r.agg(spearman.alias("spearman"), (F.min_by("case_id", first(a)) == F.min_by("case_id", first(b))).alias("same_best"))
    return shared.join(whole, F.lit(True))  # one row each


def complete_blocks(df: DataFrame, index: str, size: int, value: str) -> DataFrame:
    """Rows of the blocks of ``size`` consecutive indices that are whole and hold no null."""
    block = F.floor(F.col(index) / size)
    good = df.groupBy(block.alias("block")).agg(F.count("*").alias("n"), F.every(F.col(value).isNotNull()).alias("full")).where((F.col("n") == size) & F.col("full"))
    return df.withColumn("block", block).join(good.select("block"), "block", "left_semi")


def labelled(df: DataFrame, rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """First rule that holds names the row."""
    out = F.lit(otherwise)
    for condition, label in reversed(rules):
        out = F.when(condition, label).otherwise(out)
    return out


def top_cases(ranked: DataFrame, scored: DataFrame, simulated: DataFrame, n: int) -> DataFrame:
    """(case_id, rank, composite, n_satisfied, target, cost, sim): the n best cases, a row for each of their targets."""
    best = F.broadcast(ranked.where(F.col("rank") <= n).select("case_id", "rank", "composite", "n_satisfied"))  # n rows
    values = scored.join(best, "case_id").join(simulated.select("case_id", "target", "sim"), ["case_id", "target"])
    return values.select("case_id", F.col("rank").cast("long").alias("rank"), "composite", "n_satisfied", "target", "cost", "sim")


def split_at_median(df: DataFrame, parameter: str, outcome: Column, keys: list[str]) -> DataFrame:
    """(keys, above, below, n): mean outcome of the rows above the parameter's exact median over all rows, and of the others."""
    middle = K.quantile(df, parameter, 0.5)
    high = F.col(parameter) > F.lit(middle)
    return df.groupBy(*keys).agg(F.avg(F.when(high, outcome)).alias("above"), F.avg(F.when(~high, outcome)).alias("below"), F.count("*").alias("n"))


def compared_cases(split: DataFrame, expected: str, bar: float = 10.0) -> DataFrame:
    """split with difference_pct, supported and confidence: an increase (or decrease) of more than ``bar`` percent of the lower group's mean.

    Confidence is the difference over 100, 0.9 at most, and 0 without support. A lower group of mean zero differs by nothing.
    """
    if expected not in ("increase", "decrease"):
        raise ValueError(f"expected neither increase nor decrease: {expected!r}")
    off = F.when(F.col("below") == 0, 0.0).otherwise((F.col("above") - F.col("below")) / F.col("below") * 100)
    held = F.coalesce(off > bar if expected == "increase" else off < -bar, F.lit(False))
    return split.withColumn("difference_pct", off).withColumn("supported", held).withColumn("confidence", F.when(held, F.least(F.lit(0.9), F.abs(off) / 100)).otherwise(0.0))
