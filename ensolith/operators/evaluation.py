"""Evaluation of cases against observed targets: from monthly series to points, costs, composites and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ensolith.functions import metrics as M


def monthly_indices(observations: DataFrame, first_year: int) -> DataFrame:
    """(target, point, index) of observations (target, point, year, months): months since the start of first_year, from 0."""
    each = observations.select("target", "point", "year", F.explode("months").alias("month"))
    return each.select("target", "point", ((F.col("year") - first_year) * 12 + F.col("month") - 1).cast("long").alias("index"))


def resolved(targets: DataFrame, registry: DataFrame) -> DataFrame:
    """targets (target, key) with variable, level and factor of a registry of aliases; unknown keys drop out."""
    # a registry is written by hand: it goes to the tasks, so that no task gets all rows of a frequent key
    return targets.join(F.broadcast(registry.select(F.col("alias").alias("key"), "variable", "level", "factor")), "key")


def group_series(history: DataFrame, keys: list[str], group: Column | None = None, value: str = "value") -> DataFrame:
    """One value for each step: the sum over the groups that are meant (all without a choice)."""
    return (history if group is None else history.where(group)).groupBy(*keys).agg(F.sum(value).alias(value))


def window_points(series: DataFrame, windows: DataFrame, factor: float = 1.0) -> DataFrame:
    """(case_id, target, point, sim): mean over each point's window of a series (case_id, target, index, value).

    A case's target that lacks any step of any of its windows is left out as a whole.
    """
    need = windows.groupBy("target").agg(F.count("*").alias("_need"))
    per_point = F.broadcast(windows).join(series, ["target", "index"]).groupBy("case_id", "target", "point").agg((F.avg("value") * factor).alias("sim"), F.count("value").alias("_n"))
    whole = per_point.groupBy("case_id", "target").agg(F.sum("_n").alias("_n")).join(need, "target").where("_n = _need").select("case_id", "target")
    return per_point.join(whole, ["case_id", "target"]).drop("_n")


def first_level(*levels: DataFrame) -> DataFrame:
    """Rows (case_id, target, point, sim) of several levels in one; where two have a row, the later level's stays."""
    both = None
    for k, level in enumerate(levels):
        own = level.select("case_id", "target", "point", F.struct(F.lit(k).alias("level"), F.col("sim").alias("sim")).alias("_v"))
        both = own if both is None else both.unionByName(own)
    return both.groupBy("case_id", "target", "point").agg(F.max("_v").alias("_v")).select("case_id", "target", "point", F.col("_v.sim").alias("sim"))


def profile_layer(profile: DataFrame, keys: list[str], layer: str, depth: str, value: str, how: str, at: float | None = None) -> DataFrame:
    """One value of each profile: that of the layer numbered ``at``, nearest to the depth ``at``, the first known or the last layer."""
    v, rank = F.col(value), F.struct(F.abs(F.col(depth) - (at or 0.0)), F.col(layer))
    picks = {"index": F.max(F.when(F.col(layer) == at, v)), "nearest": F.min_by(v, rank), "first": F.min_by(v, F.when(M.clean(v).isNotNull(), F.col(layer))), "last": F.max_by(v, F.col(layer))}
    if how not in picks:
        raise ValueError(f"no such choice of a layer: {how}")
    return profile.groupBy(*keys).agg(picks[how].alias("value"))


def target_scores(points: DataFrame, observed: DataFrame, targets: DataFrame, method: str = "relative_error", tolerance: float = 0.2) -> DataFrame:
    """(case_id, target, cost, relative_error, satisfied, weight, scored) of points against (target, point, obs).

    targets (target, method, weight, scored) may leave its columns null: the default method, a
    weight of 1, scored. A case whose points and observed points do not match in number is left out for that target.
    """
    n_obs = observed.groupBy("target").agg(F.count("*").alias("_need"))
    both = points.join(observed, ["target", "point"]).join(targets, "target")
    s, o = F.col("sim"), F.col("obs")
    known = F.coalesce(F.col("method"), F.lit(method))
    cost = None
    for name in (*M.ERRORS, *M.SKILLS):
        value = M.to_cost(M.metric(name, s, o), name)
        cost = F.when(F.first(known) == name, value) if cost is None else cost.when(F.first(known) == name, value)
    g = both.groupBy("case_id", "target").agg(cost.alias("cost"), M.relative_error(s, o).alias("relative_error"), F.first(F.coalesce("weight", F.lit(1.0))).alias("weight"), F.first(F.coalesce("scored", F.lit(True))).alias("scored"), F.count("*").alias("_n"))
    g = g.join(n_obs, "target").where("_n = _need").drop("_n", "_need")
    return g.withColumn("satisfied", F.coalesce(F.col("relative_error") <= tolerance, F.lit(False)))


def case_scores(cases: DataFrame, scores: DataFrame, how: str = "rmsre") -> DataFrame:
    """(case_id, composite, n_met, n_targets) of every case; only scored targets count, a case without any costs infinity."""
    own = scores.where("scored")
    g = own.groupBy("case_id").agg(M.composite(F.col("cost"), how, F.col("weight") if how == "weighted_mean" else None).alias("composite"), F.count_if("satisfied").alias("n_met"), F.count("*").alias("n_targets"))
    zero = F.lit(0).cast("long")
    return cases.select("case_id").distinct().join(g, "case_id", "left").select("case_id", F.coalesce("composite", F.lit(float("inf"))).alias("composite"), F.coalesce("n_met", zero).alias("n_met"), F.coalesce("n_targets", zero).alias("n_targets"))


def in_band(value: Column, low: Column, high: Column) -> Column:
    """Inside a band, edges included; missing and non-finite values are outside."""
    return F.coalesce(M.clean(value).between(low, high), F.lit(False))


def band_gate(values: DataFrame, bands: DataFrame, n_targets: int) -> DataFrame:
    """One row over (case_id, target, value, completed) and (target, low, high).

    k_max: most targets any completed case has in band; unreachable: targets that none has;
    open: some completed case has all of them.
    """
    held = values.where("completed").join(bands, "target").withColumn("_in", in_band(F.col("value"), F.col("low"), F.col("high")))
    most = held.groupBy("case_id").agg(F.count_if("_in").alias("k")).agg(F.coalesce(F.max("k"), F.lit(0)).alias("k_max"))
    reached = bands.select("target").join(held.where("_in").select("target"), "target", "left_anti").agg(F.count("*").alias("unreachable"))
    return most.join(reached, F.lit(True)).withColumn("open", F.col("k_max") == n_targets)  # one row each


def band_reachable(low: Column, high: Column, band_low: Column, band_high: Column) -> Column:
    """The interval meets the band."""
    return (low <= band_high) & (high >= band_low)


def deviation_status(sim: Column, obs: Column, uncertainty: Column) -> Column:
    """within, above or below an observation's relative uncertainty; unknown where either is missing."""
    apart = F.try_divide(sim - obs, F.abs(obs))
    return F.when(apart.isNull(), "unknown").when(F.abs(apart) <= uncertainty, "within").when(apart > 0, "above").otherwise("below")


def refinement_action(met: Column, total: Column, before: Column) -> Column:
    """converge once all targets are met, iterate while more are met than before, else revise."""
    return F.when(met >= total, "converge").when(met > F.coalesce(before, F.lit(-1)), "iterate").otherwise("revise")


def pooled(design: DataFrame, results: DataFrame, baseline: int = 0) -> DataFrame:
    """results joined to the design on case_id - 1 = row; the baseline is left out, a case beyond the design is refused when read."""
    r = results.where(F.col("case_id") != baseline).withColumn("row", F.col("case_id") - 1)
    both = r.join(design, "row", "left")
    marker = next(c for c in design.columns if c != "row")
    refused = F.raise_error(F.concat(F.lit("no design row for case "), F.col("case_id").cast("string"))).cast(design.schema[marker].dataType)
    return both.withColumn(marker, F.when(F.col(marker).isNull(), refused).otherwise(F.col(marker)))


def complete_for(rows: DataFrame, target: str, status: str = "status") -> DataFrame:
    """The rows one target can be fitted on: completed and finite; other targets' gaps do not matter."""
    return rows.where((F.col(status) == "COMPLETED") & M.clean(F.col(target)).isNotNull())


def strict(df: DataFrame, keys: list[str], ranges: dict[str, tuple[float, float]], tolerance: float = 1e-9) -> DataFrame:
    """df, refused when read if a key repeats or a column is missing, not finite or outside its range."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    out = df.join(repeated, keys)
    for c, (low, high) in ranges.items():
        bad = F.raise_error(F.concat(F.lit(f"{c} out of range or missing at "), F.concat_ws(",", *keys))).cast("double")
        out = out.withColumn(c, F.when((F.col("_n") == 1) & M.clean(F.col(c)).between(low - tolerance, high + tolerance), F.col(c)).otherwise(bad))
    return out.drop("_n")


def experiment_outcomes(experiments: DataFrame, total: int) -> DataFrame:
    """Outcome of each experiment (experiment, met, status, error, n_metrics) that was not skipped, whether its data can be relied on, and whether it is the best.

    Reliable: it was extracted, without an error, and has metrics. The best is the first of those that meet
    most targets, one at least; no other experiment is.
    """
    from ensolith.functions.columns import outcome

    ran = experiments.where(F.coalesce(F.col("status") != "skipped", F.lit(True))).withColumn("met", F.coalesce("met", F.lit(0)))
    reliable = (F.col("status") == "extracted") & (F.coalesce("error", F.lit("")) == "") & (F.col("n_metrics") > 0)
    own = ran.withColumn("outcome", outcome(F.col("met"), F.lit(total))).withColumn("reliable", F.coalesce(reliable, F.lit(False)))
    best = own.where("met > 0").agg(F.max_by("experiment", F.struct(F.col("met"), -F.col("experiment"))).alias("_best"))
    return own.join(F.broadcast(best), F.lit(True), "left").withColumn("best", F.coalesce(F.col("experiment") == F.col("_best"), F.lit(False))).drop("_best")  # one row
