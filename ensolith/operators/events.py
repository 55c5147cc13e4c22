"""Runs, deficits, collapses and alignment of sequences, by windows over each entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ensolith.functions.columns import steady


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def islands(df: DataFrame, keys: list[str], order: list[str], holds: Column) -> DataFrame:
    """Rows where the condition holds, with the number of their run (column island)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("_on", F.coalesce(holds, F.lit(False)))
    begins = F.when(F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False)), 1).otherwise(0)
    runs = flagged.withColumn("_begin", begins).withColumn("island", F.sum("_begin").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(o).desc() for o in order))) == 1
    return runs.withColumn("_last", last).where("_on").drop("_on", "_begin")


def deficit_periods(df: DataFrame, keys: list[str], order: list[str], at: str, deficit: Column, least: int) -> DataFrame:
    """Runs of positive deficit of ``least`` records or more: start, end, length, largest, mean daily growth; open ones are marked ongoing.

    The mean daily growth is that of the deficit from the run's first record to its last; a run of one record has none.
    """
    runs = islands(df.withColumn("_d", deficit), keys, order, F.col("_d") > 0)
    out = runs.groupBy(*keys, "island").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"), F.max("_d").alias("largest"), F.try_divide(F.max_by("_d", F.struct(*order)) - F.min_by("_d", F.struct(*order)), F.count("*") - 1).alias("mean_daily"), F.bool_or("_last").alias("ongoing"))
    return out.where(F.col("n") >= least).drop("island")


def collapse(df: DataFrame, keys: list[str], order: list[str], value: str, back: int) -> DataFrame:
    """Loss in percent against the largest of the ``back`` records before and the current one."""
    return _fallen(df, keys, order, value, back).drop("_peak")


def _fallen(df: DataFrame, keys: list[str], order: list[str], value: str, back: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-back, 0)
    peaks = df.withColumn("_peak", F.max(value).over(w))
    return peaks.withColumn("loss_pct", F.when(F.col("_peak") > 0, 100 * (F.col("_peak") - F.col(value)) / F.col("_peak")).otherwise(0.0))


def collapse_events(df: DataFrame, keys: list[str], order: list[str], at: str, value: str, back: int, limit: float) -> DataFrame:
    """Runs of a loss above ``limit`` percent: start, end, n, loss_pct (the largest), ongoing, start_value, end_value, least_value, recovery.

    start_value is the peak that the first record fell from. ongoing: the run reaches the last record. recovery: it does
    not, and its last value is more than a tenth above its least. A record without value ends a run.
    """
    runs = islands(_fallen(df, keys, order, value, back), keys, order, F.col("loss_pct") > limit)
    place = F.struct(*order)
    values = [F.min_by("_peak", place).alias("start_value"), F.max_by(value, place).alias("end_value"), F.min(value).alias("least_value")]
    g = runs.groupBy(*keys, "island").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"), F.max("loss_pct").alias("loss_pct"), F.bool_or("_last").alias("ongoing"), *values)
    return g.withColumn("recovery", ~F.col("ongoing") & (F.col("end_value") > 1.1 * F.col("least_value"))).drop("island")


def exceedances(df: DataFrame, keys: list[str], order: list[str], at: str, value: str, spreads: float = 2.0) -> DataFrame:
    """Runs above the mean plus ``spreads`` population standard deviations: start, end, n, peak, mean and peak over the deviation."""
    limits = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    runs = islands(df.join(limits, keys), keys, order, F.col(value) > F.col("_m") + spreads * F.col("_s"))
    severity = F.coalesce(F.try_divide(F.max(value), F.nullif(F.max("_s"), F.lit(0.0))), F.lit(0.0))
    return runs.groupBy(*keys, "island").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"), F.max(value).alias("peak"), F.avg(value).alias("mean"), severity.alias("severity")).drop("island")


def crossover(df: DataFrame, keys: list[str], order: list[str], at: Column, a: Column, b: Column) -> DataFrame:
    """The first place at which the running sum of a exceeds that of b; null if it never does."""
    r = running(running(df, keys, order, a, "_a"), keys, order, b, "_b")
    return r.groupBy(*keys).agg(F.min(F.when(F.col("_a") > F.col("_b"), at)).alias("crossover"))


def first_hit(df: DataFrame, keys: list[str], index: str, best: str, bar: Column) -> DataFrame:
    """The smallest index at which a curve is at the bar or below; null if it never is."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(best) <= bar, F.col(index))).alias("hit"))


def carbon_balance(df: DataFrame, keys: list[str], doy: str, gain: str, loss: str, reference: int, late: int = 30, deficit: float = 10.0) -> DataFrame:
    """Running loss less running gain on the day nearest to a reference day, the largest of the year, day of crossover, and whether growth is held up.

    Held up: the running loss is ahead by more than ``deficit`` on that day, or the running gain
    overtakes it only more than ``late`` days after; a crossover that never comes is no sign.
    """
    w = Window.partitionBy(*keys).orderBy(doy).rowsBetween(Window.unboundedPreceding, 0)
    r = df.withColumns({"_g": F.sum(gain).over(w), "_l": F.sum(loss).over(w)})
    near = F.struct(F.abs(F.col(doy) - reference), F.col(doy))
    behind = F.col("_l") - F.col("_g")
    out = r.groupBy(*keys).agg(F.min_by(behind, near).alias("deficit"), F.max(behind).alias("largest"), F.min(F.when(F.col("_g") > F.col("_l"), F.col(doy))).alias("crossover"))
    held = (F.col("deficit") > deficit) | (F.col("crossover") > reference + late)
    return out.withColumn("bottleneck", F.coalesce(held, F.lit(False)))


def within_days(df: DataFrame, keys: list[str], doy: str, first: int, last: int, values: list[str]) -> DataFrame:
    """Means of the values over a slice of days of the year, and the rows in it."""
    return df.where(F.col(doy).between(first, last)).groupBy(*keys).agg(*(F.avg(v).alias(f"mean_{v}") for v in values), F.count("*").alias("n"))


def causes_within(df: DataFrame, intervals: DataFrame, keys: list[str], at: str, cause: str, value: str) -> DataFrame:
    """Statistics by cause of the rows inside each entity's intervals (start, end); a row in several counts in each."""
    j = df.join(intervals.select(*keys, "start", "end"), keys).where(F.col(at).between(F.col("start"), F.col("end")))
    return j.groupBy(*keys, "start", cause).agg(F.avg(value).alias("mean"), F.max(value).alias("high"), F.count("*").alias("n"))


def cause_shares(df: DataFrame, keys: list[str], cause: str, value: str) -> DataFrame:
    """Mean, largest, spread, total, share and rank of each cause, the dominant one marked; totals equal to 12 digits are ties, by cause."""
    g = df.groupBy(*keys, cause).agg(F.avg(value).alias("mean"), F.max(value).alias("high"), F.stddev_pop(value).alias("sd"), F.sum(value).alias("total"))
    w = Window.partitionBy(*keys)  # a few causes each
    rank = F.row_number().over(w.orderBy(steady(F.col("total").cast("double")).desc_nulls_last(), cause))
    return g.withColumn("share", F.try_divide(F.col("total"), F.sum("total").over(w))).withColumn("rank", rank).withColumn("dominant", F.col("rank") == 1)


def warnings(df: DataFrame, signs: list[Column], critical: int = 3, least: int = 2) -> DataFrame:
    """df with the number of signs that hold and a level: critical, warning or none."""
    n = sum((F.when(s, 1).otherwise(0) for s in signs), F.lit(0))
    return df.withColumn("n_signs", n).withColumn("level", F.when(n >= critical, "critical").when(n >= least, "warning").otherwise("none"))


def depletion(df: DataFrame, keys: list[str], order: list[str], value: str, ends: int = 12) -> DataFrame:
    """Means of the first and the last ``ends`` records and the change in percent."""
    w = Window.partitionBy(*keys)
    n = df.withColumn("_a", F.row_number().over(w.orderBy(*order))).withColumn("_z", F.row_number().over(w.orderBy(*(F.col(o).desc() for o in order))))
    g = n.groupBy(*keys).agg(F.avg(F.when(F.col("_a") <= ends, F.col(value))).alias("first"), F.avg(F.when(F.col("_z") <= ends, F.col(value))).alias("last"))
    return g.withColumn("change_pct", F.try_divide(100 * (F.col("last") - F.col("first")), F.col("first")))


def supply_band(ratio: Column) -> Column:
    """severe below 0.5 of the demand, moderate below 0.8, mild below 0.95, else met."""
    return F.when(ratio < 0.5, "severe").when(ratio < 0.8, "moderate").when(ratio < 0.95, "mild").when(ratio.isNotNull(), "met")


def interpolate_at(simulated: DataFrame, observed: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Simulated series interpolated linearly at the observed times; null outside its own span."""
    both = observed.select(*keys, F.col(time).alias("_t"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_ask"))
    both = both.unionByName(simulated.groupBy(*keys, F.col(time).alias("_t")).agg(F.avg(value).alias("_v")).withColumn("_ask", F.lit(0)))
    w = Window.partitionBy(*keys).orderBy("_t", "_ask")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))
    r = both.withColumn("_a", F.last(point, True).over(before)).withColumn("_b", F.first(point, True).over(after)).where("_ask = 1")
    part = F.try_divide(F.col("_t") - F.col("_a._t"), F.col("_b._t") - F.col("_a._t"))
    exact = F.when(F.col("_a._t") == F.col("_t"), F.col("_a._v"))
    inner = F.col("_a._v") + (F.col("_b._v") - F.col("_a._v")) * part
    return r.select(*keys, F.col("_t").alias(time), F.coalesce(exact, inner).alias(value))
