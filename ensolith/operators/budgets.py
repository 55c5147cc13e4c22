"""Budgets, limits and competition between groups; cascades of a knowledge store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ensolith.functions.student import two_sided_p
from ensolith.operators.ranks import average_ranks


def budget(history: DataFrame, keys: list[str], month: str, flow: str, kind: str, pool: str, ends: int = 12) -> DataFrame:
    """Per year: inflow and outflow (kind in or out; twelve times the mean of the months) and change of the pool.

    The change is from the mean of the first ``ends`` months to that of the last, over the years of the
    record; a record of twelve months or less gives its whole change. A month without flows counts as zero.
    """
    of = lambda k: F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(flow))), F.lit(0.0))
    months = history.groupBy(*keys, month).agg(of("in").alias("_in"), of("out").alias("_out"), F.avg(pool).alias("_pool"))
    w = Window.partitionBy(*keys)  # the months of one record
    placed = months.withColumn("_a", F.row_number().over(w.orderBy(month))).withColumn("_n", F.count("*").over(w))
    early, late = F.col("_a") <= ends, F.col("_a") > F.col("_n") - ends
    g = placed.groupBy(*keys).agg(F.count("*").alias("_n"), (F.avg("_in") * 12).alias("inflow"), (F.avg("_out") * 12).alias("outflow"), (F.avg(F.when(late, F.col("_pool"))) - F.avg(F.when(early, F.col("_pool")))).alias("_change"))
    return g.select(*keys, "inflow", "outflow", F.coalesce(F.col("_change") / F.greatest(F.lit(1.0), F.col("_n") / 12), F.lit(0.0)).alias("change"))


def closure(budgets: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """budgets with what inflow less outflow leaves of the change, relative to the inflow, and whether it closes; without inflow, only nothing left closes."""
    rest = F.col("inflow") - F.col("outflow") - F.col("change")
    relative = F.when(F.col("inflow") > 0, F.try_divide(rest, F.col("inflow"))).when(F.abs(rest) < 1e-10, 0.0).otherwise(float("inf"))
    return budgets.withColumns({"residual": rest, "relative": relative, "closed": F.abs(relative) < tolerance})


def competition(supply: DataFrame, keys: list[str], group: str, uptake: str, demand: str) -> DataFrame:
    """Each group's share of the uptake and supply of its demand; the dominant group has the largest share, the most limited the smallest supply."""
    g = supply.groupBy(*keys, group).agg(F.sum(uptake).alias("uptake"), F.sum(demand).alias("demand"))
    w = Window.partitionBy(*keys)  # a few groups each
    g = g.withColumn("share", F.try_divide(F.col("uptake"), F.sum("uptake").over(w))).withColumn("met", F.try_divide(F.col("uptake"), F.col("demand")))
    first = lambda order: F.row_number().over(w.orderBy(*order)) == 1
    return g.withColumn("dominant", first([F.desc_nulls_last("share"), group])).withColumn("most_limited", first([F.asc_nulls_last("met"), group]) & F.col("met").isNotNull())


def allocation(df: DataFrame, keys: list[str], value: str, n_ratio: str, p_ratio: str) -> DataFrame:
    """Mean and variation of an allocation, fixed below a variation of 0.1, and what limits it.

    The supply of the smaller mean ratio to its demand, N or P, if below 0.95; both if they are equal and
    below; else none. A nutrient that nothing is known of is met.
    """
    g = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.try_divide(F.stddev_pop(value), F.abs(F.avg(value))).alias("cv"), F.coalesce(F.avg(n_ratio), F.lit(1.0)).alias("_n"), F.coalesce(F.avg(p_ratio), F.lit(1.0)).alias("_p"))
    n, p = F.col("_n"), F.col("_p")
    limit = F.when((n < p) & (n < 0.95), "N").when((p < n) & (p < 0.95), "P").when((n < 0.95) & (p < 0.95), "co-limited").otherwise("none")
    return g.select(*keys, "mean", "cv", (F.col("cv") < 0.1).alias("fixed"), limit.alias("limitation"))


def correlation_test(df: DataFrame, x: str, y: str, keys: list[str] | None = None, least: int = 10, bar: float = 0.3, level: float = 0.05) -> DataFrame:
    """(keys, n, r, t, p, supported): Pearson's r, its t value, the two-sided p of Student's distribution and whether a link is supported.

    Supported: ``least`` pairs or more, |r| above the bar and p below the level. Without spread r is null.
    """
    keys = keys or []
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    g = known.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop(x, y), spread).alias("_r"))
    g = g.withColumn("r", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "_r"))).withColumn("_r", F.when(F.col("_r").isNotNull(), F.col("r")))
    freedom = F.col("n") - 2.0
    t = F.when(F.col("_r") * F.col("_r") < 1, F.col("_r") * F.sqrt(freedom / (1 - F.col("_r") * F.col("_r")))).when(F.col("_r").isNotNull() & (freedom > 0), F.col("_r") * float("inf"))
    g = g.withColumn("t", F.when(freedom > 0, t)).withColumn("p", two_sided_p(F.col("t"), freedom))
    supported = (F.col("n") >= least) & (F.abs("_r") > bar) & (F.col("p") < level)
    return g.select(*keys, "n", F.col("_r").alias("r"), "t", "p", F.coalesce(supported, F.lit(False)).alias("supported"))


def ranking_fidelity(df: DataFrame, key: str, truth: str, predicted: str, k: int, lower_is_better: bool = True) -> DataFrame:
    """Spearman's correlation of two scores and the share of the truly best k that are among the predicted best k; null below three rows."""
    from ensolith.functions.metrics import correlation

    known = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    order = (lambda c: [F.col(c).asc(), F.col(key)]) if lower_is_better else (lambda c: [F.col(c).desc(), F.col(key)])
    tops = [known.orderBy(*order(c)).limit(k).select(key) for c in (truth, predicted)]
    hits = tops[0].join(tops[1], key).agg(F.count("*").alias("_h"))
    r = average_ranks(average_ranks(known.select(key, truth, predicted), truth, key, "_a"), predicted, key, "_b").agg(correlation(F.col("_a"), F.col("_b")).alias("_r"), F.count("*").alias("n"))
    enough = F.col("n") >= 3
    return r.join(hits, F.lit(True)).select("n", F.when(enough, F.col("_r")).alias("spearman"), F.when(enough, F.try_divide(F.col("_h"), F.least(F.lit(k), F.col("n")))).alias("recall"))  # one row each


def cascaded(experiments: DataFrame, failed: DataFrame) -> DataFrame:
    """failed (approach, experiment_id, why) with an entry for each catastrophic experiment (experiment_id, approach, outcome, lesson) that it lacks."""
    new = experiments.where("outcome = 'CATASTROPHIC'").select("approach", "experiment_id", F.col("lesson").alias("why"))
    return failed.unionByName(new.join(failed.select("approach", "experiment_id"), ["approach", "experiment_id"], "left_anti"))


def appended(store: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """store (key, notes array) with new notes (key, note) behind its own, in order and each once; keys it lacks are added."""
    g = notes.groupBy(key).agg(F.array_sort(F.collect_set("note")).alias("_new"))
    none = F.array().cast("array<string>")
    both = store.join(g, key, "full_outer")
    return both.select(key, F.array_distinct(F.concat(F.coalesce("notes", none), F.coalesce("_new", none))).alias("notes"))


def flattened(c: Column, schema, prefix: str = "") -> dict[str, Column]:
    """Scalar columns by dotted names of a struct of that type: arrays comma-joined; nulls are left to the reader."""
    out = {}
    for f in schema.fields:
        own, name = c[f.name], f"{prefix}{f.name}"
        kind = f.dataType.typeName()
        if kind == "struct":
            out |= flattened(own, f.dataType, f"{name}.")
        else:
            out[name] = F.array_join(own.cast("array<string>"), ",") if kind == "array" else own
    return out


def described(catalog: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """One text for each catalog entry (key, units, low, high): its facts, then a curated note if there is one."""
    j = catalog.join(notes.select(key, "note"), key, "left")
    facts = F.concat_ws("; ", F.concat(F.lit("name: "), F.col(key).cast("string")), F.concat(F.lit("units: "), "units"), F.concat(F.lit("range: "), F.col("low").cast("string"), F.lit(" to "), F.col("high").cast("string")), F.concat(F.lit("note: "), "note"))
    return j.select(key, facts.alias("text"))
