"""Sensitivity measures, calibration of intervals and validation of surrogates."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ensolith.lineage import cut
from ensolith.operators.ranks import kth_smallest, numbered


def elementary_effects(steps: DataFrame, trajectory: str, step: str, changed: str, x: str, y: str, level: float = 0.95) -> DataFrame:
    """mu, mu_star, sigma, mu_star_conf and n of each input from trajectories in which one input changes at a time.

    mu_star_conf is the half width of the normal interval of mu_star at ``level``. Its deviation is the one that
    resampling the effects with replacement tends to, sd / sqrt(n), so that nothing is drawn.
    """
    z = NormalDist().inv_cdf((1 + level) / 2)
    w = Window.partitionBy(trajectory).orderBy(step)
    ee = steps.withColumn("_e", F.try_divide(F.col(y) - F.lag(y).over(w), F.col(x) - F.lag(x).over(w))).where(F.col("_e").isNotNull())
    return ee.groupBy(changed).agg(F.avg("_e").alias("mu"), F.avg(F.abs("_e")).alias("mu_star"), F.stddev_samp("_e").alias("sigma"), (z * F.stddev_pop(F.abs("_e")) / F.sqrt(F.count("*"))).alias("mu_star_conf"), F.count("*").alias("n"))


def conformal_radius(scores: DataFrame, score: str, alpha: float, keys: list[str]) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score of each group; infinite where there are too few."""
    found = kth_smallest(scores, keys, score, F.ceil((F.col("n") + 1) * (1 - alpha)))
    return found.select(*keys, F.coalesce("kth", F.lit(float("inf"))).alias("radius"), "n")


def pawn(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Median over slices of x of the largest distance between the slice's and the overall distribution of y.

    Slices hold equally many rows (the first ones a row more). Both distributions are counted at
    the distinct values of y, so tied values move together; the counts are summed along y in
    the ranges that they are dealt by.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    n = known.count()
    rows = numbered(known.withColumn("_id", F.monotonically_increasing_id()), [F.col("_x"), F.col("_y"), F.col("_id")], "_r")
    small, more = n // bins, n % bins
    wide = more * (small + 1)
    place = F.col("_r") - 1
    slice_ = F.when(place < wide, F.floor(place / (small + 1))).otherwise(more + F.floor((place - wide) / max(1, small))).cast("int")
    counts = rows.withColumn("_s", slice_).groupBy("_y").pivot("_s", list(range(bins))).count().na.fill(0)
    names = [str(k) for k in range(bins)]
    totals = {name: small + (1 if k < more else 0) for k, name in enumerate(names)}
    parts = cut(counts.repartitionByRange("_y").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sums = parts.groupBy("_part").agg(*(F.sum(c).alias(f"_t{c}") for c in names))
    sums = sums.select("_part", *(F.coalesce(F.sum(f"_t{c}").over(before), F.lit(0)).alias(f"_o{c}") for c in names))
    within = Window.partitionBy("_part").orderBy("_y").rowsBetween(Window.unboundedPreceding, 0)
    upto = parts.join(F.broadcast(sums), "_part").select(*((F.sum(c).over(within) + F.col(f"_o{c}")).alias(c) for c in names))
    every = sum((F.col(c) for c in names), F.lit(0)) / max(1, n)
    largest = upto.agg(*(F.max(F.abs(F.col(c) / totals[c] - every)).alias(c) for c in names if totals[c]))
    return largest.select(F.explode(F.array(*largest.columns)).alias("ks")).agg(F.median("ks").alias("pawn"))


def coverage(df: DataFrame, truth: Column, low: Column, high: Column) -> DataFrame:
    return df.agg(F.avg(truth.between(low, high).cast("double")).alias("coverage"), F.avg(high - low).alias("width"))


def r2(df: DataFrame, truth: str, predicted: str, keys: list[str]) -> DataFrame:
    """1 - SSres / SStot by group, null where the truth does not vary."""
    return df.groupBy(*keys).agg((1 - F.try_divide(F.sum((F.col(truth) - F.col(predicted)) ** 2), F.nullif(F.var_pop(truth) * F.count(truth), F.lit(0.0)))).alias("r2"), F.count("*").alias("n"))


def latin_hypercube(spark, n: int, names: list[str], seed: int) -> DataFrame:
    """n points in the unit box, each of the n slices of every side hit once: (sample, one column for each name)."""
    out = spark.range(n).withColumnRenamed("id", "sample")
    for k, name in enumerate(names):
        order = F.xxhash64(F.col("sample"), F.lit(seed), F.lit(k))
        jitter = F.pmod(F.xxhash64(F.col("sample"), F.lit(seed), F.lit(k + 1000)), F.lit(1 << 20)) / float(1 << 20)
        out = numbered(out, [order, F.col("sample")], "_r").withColumn(name, (F.col("_r") - 1 + jitter) / n).drop("_r")
    return out


def mixed(key: Column, salt: Column | int, buckets: int) -> Column:
    """A repeatable pseudo-random number below ``buckets`` of an integer key, by plain arithmetic."""
    salt = F.lit(salt) if isinstance(salt, int) else salt
    x = F.pmod(key.cast("long") * 48271 + salt.cast("long") * 30269 + 12345, F.lit(2147483647))
    return F.pmod(F.pmod(x * 16807, F.lit(2147483647)), F.lit(buckets))


def binned_effect(df: DataFrame, bin_: Column, y: str, keys: list[str] | None = None) -> DataFrame:
    """Share of the variance of y that the means of the bins explain (a first-order index)."""
    keys = keys or []
    g = df.where(F.col(y).isNotNull()).groupBy(*keys, bin_.alias("_bin")).agg(F.count("*").alias("_n"), F.sum(y).alias("_s"), F.sum(F.col(y) * F.col(y)).alias("_q"))
    n, total = F.sum("_n"), F.sum("_s")
    between = F.sum(F.col("_s") * F.col("_s") / F.col("_n")) / n - (total / n) * (total / n)
    return g.groupBy(*keys).agg(F.try_divide(between, F.sum("_q") / n - (total / n) * (total / n)).alias("effect"))


def noise_floor(df: DataFrame, key: Column, y: str, bins: int, turns: int) -> DataFrame:
    """Largest effect that ``turns`` random dealings of the rows into bins show: effects below it cannot be told from none."""
    dealt = df.select(y, key.alias("_key"), F.explode(F.sequence(F.lit(1), F.lit(turns))).alias("turn"))
    return binned_effect(dealt, mixed(F.col("_key"), F.col("turn"), bins), y, ["turn"]).agg(F.max("effect").alias("floor"))


def boundary_report(df: DataFrame, probability: str, truth: Column, band: float = 0.25) -> DataFrame:
    """Accuracy of a classifier at 0.5, over all rows and over those whose probability is within ``band`` of it."""
    p = F.col(probability)
    right, near = ((p >= 0.5) == truth).cast("double"), F.abs(p - 0.5) <= band
    return df.where(p.isNotNull() & truth.isNotNull()).agg(F.avg(right).alias("accuracy"), F.count("*").alias("n"), F.avg(F.when(near, right)).alias("boundary_accuracy"), F.count_if(near).alias("n_boundary"))


def case_r2_summary(df: DataFrame, case: str, truth: str, predicted: str, least_pairs: int = 8, least_r2: float = 0.5) -> DataFrame:
    """Quantiles over cases of R2 within the case, for cases of enough pairs whose truth varies, and the share that reaches least_r2."""
    known = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    per = r2(known, truth, predicted, [case]).where((F.col("n") >= least_pairs) & F.col("r2").isNotNull())
    q = F.percentile("r2", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return per.agg(F.count("*").alias("n_cases"), q[0].alias("p10"), q[1].alias("p50"), q[2].alias("p90"), F.avg((F.col("r2") >= least_r2).cast("double")).alias("share"))


def confirmed(predictions: DataFrame, keys: list[str], observed: Column, low: Column, high: Column) -> DataFrame:
    """How often observations later fell into the predicted interval."""
    return predictions.where(observed.isNotNull()).groupBy(*keys).agg(F.avg(observed.between(low, high).cast("double")).alias("hit_rate"), F.count("*").alias("n"))


def bootstrap_r2(df: DataFrame, key: Column, truth: str, predicted: str, turns: int, least: float) -> DataFrame:
    """Pass rate and quantiles of R2 over Poisson bootstrap turns: each row counts 0, 1, 2 or more times in each turn.

    Turns are summed side by side, so the rows are dealt out but their exchange is one partial sum for each turn.
    """
    t, p = F.col(truth), F.col(predicted)
    rows = df.select(t.alias("_t"), p.alias("_p"), key.alias("_key"), F.explode(F.sequence(F.lit(1), F.lit(turns))).alias("turn"))
    u = mixed(F.col("_key"), F.col("turn"), 1_000_000) / 1e6
    # chances that a Poisson number of mean one is 0, at most 1, 2, 3, 4
    w = sum((F.when(u >= c, 1).otherwise(0) for c in (0.367879, 0.735759, 0.919699, 0.981012, 0.996340)), F.lit(0))
    g = rows.withColumn("_w", w).groupBy("turn").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_t")).alias("s"), F.sum(F.col("_w") * F.col("_t") ** 2).alias("q"), F.sum(F.col("_w") * (F.col("_t") - F.col("_p")) ** 2).alias("e"))
    r = g.select((1 - F.try_divide(F.col("e"), F.col("q") - F.col("s") * F.col("s") / F.col("n"))).alias("r2"))
    return r.agg(F.avg((F.col("r2") >= least).cast("double")).alias("pass_rate"), F.min("r2").alias("low"), F.median("r2").alias("middle"), F.max("r2").alias("high"))
