"""Comparisons between rounds, cases, inventories and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired_rounds(source: DataFrame, target: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, source and target values, their difference and a status: ok, src_missing or tgt_missing."""
    s, t = source.select(*keys, F.col(value).alias("source")), target.select(*keys, F.col(value).alias("target"))
    status = F.when(F.col("source").isNull(), "src_missing").when(F.col("target").isNull(), "tgt_missing").otherwise("ok")
    return s.join(t, keys, "full_outer").withColumn("delta", F.col("target") - F.col("source")).withColumn("status", status)


def round_changes(pairs: DataFrame, keys: list[str], met: Column, met_before: Column) -> DataFrame:
    """Statistics of the differences of complete pairs, cases that became better or worse, targets gained and lost."""
    d = F.col("delta")
    return pairs.where("status = 'ok'").groupBy(*keys).agg(
        F.avg(d).alias("mean"), F.median(d).alias("median"), F.stddev_pop(d).alias("sd"), F.min(d).alias("low"), F.max(d).alias("high"),
        F.count_if(d < 0).alias("improved"), F.count_if(d > 0).alias("degraded"), F.count_if(met & ~met_before).alias("gained"), F.count_if(~met & met_before).alias("lost"),
    )


def case_differences(design: DataFrame, spec: DataFrame, reference: Column) -> DataFrame:
    """Each case's parameters against those of a reference case: (case_id, parameter, value, base, diff, pct of the parameter's range)."""
    base = design.where(reference).select("parameter", F.col("value").alias("base"))
    both = design.where(~reference).join(base, "parameter").join(spec, "parameter")
    pct = F.try_divide(100 * (F.col("value") - F.col("base")), F.col("high") - F.col("low"))
    return both.select("case_id", "parameter", "value", "base", (F.col("value") - F.col("base")).alias("diff"), pct.alias("pct"))


def largest_differences(differences: DataFrame, top: int, least_pct: float) -> DataFrame:
    """The ``top`` parameters of each case that differ by least_pct or more, the largest first; ties by name."""
    w = Window.partitionBy("case_id").orderBy(F.abs("pct").desc(), "parameter")
    return differences.where(F.abs("pct") >= least_pct).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def consistent_differences(differences: DataFrame, least_pct: float) -> DataFrame:
    """How many cases differ by least_pct or more in a parameter, and their mean difference in percent."""
    return differences.where(F.abs("pct") >= least_pct).groupBy("parameter").agg(F.count("*").alias("n"), F.avg("pct").alias("mean_pct"))


def combined_rankings(rankings: DataFrame, groups: list[str], value: str) -> DataFrame:
    """One row for each parameter that every group ranks: its value in each, and their mean."""
    wide = rankings.groupBy("parameter").agg(*(F.max(F.when(F.col("grp") == g, F.col(value))).alias(g) for g in groups))
    whole = wide.dropna(subset=groups)
    return whole.withColumn("mean", sum((F.col(g) for g in groups), F.lit(0.0)) / len(groups))


def consensus_ranks(scores: DataFrame, names: list[str]) -> DataFrame:
    """Mean rank of each input over estimators (estimator, input, value), 1 the largest; ties by input."""
    w = Window.partitionBy("estimator").orderBy(F.desc("value"), "input")
    return scores.where(F.col("estimator").isin(names)).withColumn("r", F.row_number().over(w)).groupBy("input").agg(F.avg("r").alias("rank"))


def _grams(c: Column) -> Column:
    """Distinct runs of three characters of a padded lower-cased name."""
    padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def similar_names(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ratio) of names (column name) whose ratio 1 - edits / longer length reaches the threshold and that share three characters in a row."""
    a = left.select(F.col("name").alias("a"), F.explode(_grams(F.col("name"))).alias("_g"))
    b = right.select(F.col("name").alias("b"), F.explode(_grams(F.col("name"))).alias("_g"))
    ratio = 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))
    return a.join(b, "_g").select("a", "b").distinct().withColumn("ratio", ratio).where(F.col("ratio") >= threshold)


def renames(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of names that are each other's best match; ties by name."""
    m = similar_names(left, right, threshold)
    best = lambda by, other: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ratio"), other))
    return m.withColumns({"_x": best("a", "b"), "_y": best("b", "a")}).where("_x = 1 and _y = 1").drop("_x", "_y")


def suggestions(missing: DataFrame, known: DataFrame, n: int, cutoff: float) -> DataFrame:
    """The n closest known names of each missing one."""
    w = Window.partitionBy("a").orderBy(F.desc("ratio"), "b")
    return similar_names(missing, known, cutoff).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def tag_drift(profiles: DataFrame) -> DataFrame:
    """Entries (profile, name, tags) whose normalised tags differ between profiles, or that some profile lacks."""
    n = profiles.agg(F.count_distinct("profile").alias("_all"))
    tags = F.array_join(F.array_sort(F.array_distinct(F.transform("tags", lambda t: F.lower(F.trim(t))))), ",")
    g = profiles.withColumn("_t", tags).groupBy("name").agg(F.count_distinct("_t").alias("n_kinds"), F.count_distinct("profile").alias("n_profiles"))
    j = g.join(F.broadcast(n), F.lit(True))  # one row
    return j.withColumn("status", F.when(F.col("n_profiles") < F.col("_all"), "missing").when(F.col("n_kinds") > 1, "drift")).where("status is not null").drop("_all")


def phases_joined(phases: list[tuple[str, DataFrame]], time: str) -> DataFrame:
    """One series of several phases: each phase's times follow the last of those before."""
    both = None
    for k, (name, df) in enumerate(phases):
        own = df.withColumns({"phase": F.lit(name), "_k": F.lit(k)})
        both = own if both is None else both.unionByName(own)
    spans = both.groupBy("_k").agg((F.max(time) + 1).alias("_n"))
    offset = spans.withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row for each phase
    return both.join(F.broadcast(offset), "_k").withColumn(time, F.col(time) + F.col("_offset")).drop("_k", "_offset")


def resolved_rounds(rounds: DataFrame) -> DataFrame:
    """Which round's results to use: its own, else those of its source round; with that provenance (round, source_round, has_results)."""
    s = rounds.select(F.col("round").alias("source_round"), F.col("has_results").alias("_source_has"))
    use = F.when(F.col("has_results"), F.col("round")).when(F.col("_source_has"), F.col("source_round"))
    origin = F.when(F.col("has_results"), "own").when(F.col("_source_has"), "source").otherwise("none")
    return rounds.join(s, "source_round", "left").select("round", use.alias("use_round"), origin.alias("origin"))


def merged_maps(base: Column, updates: Column, overwrite: bool = True) -> Column:
    """Two maps in one; keys of both take the update's value, or keep the base's."""
    return F.map_zip_with(base, updates, lambda _, a, b: F.coalesce(b, a) if overwrite else F.coalesce(a, b))


def dropped_parameters(previous: DataFrame, current: DataFrame, ledger: DataFrame, least: int = 2) -> DataFrame:
    """Parameters of the previous hypothesis that the current one lacks though they were proposed ``least`` times or more."""
    return previous.join(current, "parameter", "left_anti").join(ledger.where(F.col("n_proposed") >= least), "parameter")
