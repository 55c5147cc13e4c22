"""Calendar-aware reductions of long histories (case, group, variable, time, value).

Each reducer is two levels of grouping, case and year and then case, so the first combines in
the scan's tasks. Years that are not complete are left out, and the row says which case had one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_years(history: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    """History with columns year and complete: a year is complete unless the case's record begins in it after its first day or ends in it before its last."""
    return _with_complete(history.withColumn("year", F.year(time)), history, keys, time)


def _with_complete(rows: DataFrame, history: DataFrame, keys: list[str], time: str) -> DataFrame:
    span = history.groupBy(*keys).agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    begins = (F.year("_first") < F.col("year")) | (F.dayofyear("_first") == 1)
    ends = (F.year("_last") > F.col("year")) | ((F.month("_last") == 12) & (F.dayofmonth("_last") == 31))
    return rows.join(span, keys).withColumn("complete", begins & ends).drop("_first", "_last")


def of_complete_years(rows: DataFrame, history: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    """Rows (keys, year, ...) grouped from the history, those of its complete years: so only grouped rows are joined."""
    return _with_complete(rows, history, keys, time).where("complete").drop("complete")


def by_year(history: DataFrame, keys: list[str], reduce: Column, time: str = "ts", where: Column | None = None) -> DataFrame:
    """One value for each case and complete year, over the rows that ``where`` picks."""
    annual = (history if where is None else history.where(where)).groupBy(*keys, F.year(time).alias("year")).agg(reduce.alias("annual"))
    return of_complete_years(annual, history, keys, time)


def mean_over_years(annual: DataFrame, keys: list[str], first: int | None = None, last: int | None = None) -> DataFrame:
    """Mean over the years of a window; status PARTIAL tells a case that lacks a year of it."""
    rows = annual if first is None else annual.where(F.col("year").between(first, last))
    out = rows.groupBy(*keys).agg(F.avg("annual").alias("value"), F.count("annual").alias("n_years"))
    want = None if first is None else last - first + 1
    return out.withColumn("status", F.lit("OK") if want is None else F.when(F.col("n_years") == want, "OK").otherwise("PARTIAL"))


def peak_of_group_sum(history: DataFrame, keys: list[str], step: Column, value: str = "value", time: str = "ts") -> DataFrame:
    """Sum over groups at each step, the year's largest, its mean over years."""
    at_step = of_complete_years(history.groupBy(*keys, F.year(time).alias("year"), step.alias("step")).agg(F.sum(value).alias("v")), history, keys, time)
    return mean_over_years(at_step.groupBy(*keys, "year").agg(F.max("v").alias("annual")), keys)


def season_mean_abs(history: DataFrame, keys: list[str], months: tuple[int, int] = (5, 9), value: str = "value", time: str = "ts") -> DataFrame:
    return mean_over_years(by_year(history, keys, F.avg(F.abs(value)), time, F.month(time).between(*months)), keys)


def daytime_season_mean_abs(history: DataFrame, keys: list[str], hours: list[int], months: tuple[int, int] = (5, 9), value: str = "value", time: str = "ts") -> DataFrame:
    """Mean of absolute values at some hours of the day in season months, per year, then over years; hours must be named."""
    if not hours:
        raise ValueError("name the hours of the day")
    return mean_over_years(by_year(history, keys, F.avg(F.abs(value)), time, F.month(time).between(*months) & F.hour(time).isin(hours)), keys)


def annual_integral(history: DataFrame, keys: list[str], step_hours: float = 24.0, value: str = "value", time: str = "ts") -> DataFrame:
    return mean_over_years(by_year(history, keys, F.sum(value) * step_hours, time), keys)


def year_end(history: DataFrame, keys: list[str], order: list[str], value: str = "value", time: str = "ts") -> DataFrame:
    """Value of each year's last record, ties by ``order``, mean over years."""
    return mean_over_years(by_year(history, keys, F.max_by(F.col(value), F.struct(*order)), time), keys)


def decumulate(history: DataFrame, keys: list[str], order: list[str], value: str = "value", time: str = "ts") -> DataFrame:
    """First differences within each year; a year's first record is kept as it is."""
    w = Window.partitionBy(*keys, F.year(time)).orderBy(*order)
    return history.withColumn("step", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0)))


def season_sums(history: DataFrame, keys: list[str], step: str = "value", time: str = "ts") -> DataFrame:
    """Seasonal sums; December counts to the winter of its own year."""
    season = F.element_at(F.array(*map(F.lit, ["DJF", "DJF", "MAM", "MAM", "MAM", "JJA", "JJA", "JJA", "SON", "SON", "SON", "DJF"])), F.month(time))
    per = of_complete_years(history.groupBy(*keys, F.year(time).alias("year"), season.alias("season")).agg(F.sum(step).alias("s")), history, keys, time)
    return per.groupBy(*keys, "season").agg(F.avg("s").alias("value"))


def numbered(history: DataFrame, keys: list[str], order: list[str], out: str = "record") -> DataFrame:
    """history with each case's record number, from 0."""
    return history.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def hourly_tags(records: DataFrame, index: str, start_year: int) -> DataFrame:
    """records with year, month and hour of an hourly record number that counts from the start of a year, leap years included."""
    ts = F.make_timestamp_ntz(F.lit(start_year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(F.floor(F.col(index) / 24).cast("int"), F.pmod(F.col(index), F.lit(24)).cast("int"))
    return records.withColumn("_t", ts).withColumns({"year": F.year("_t"), "month": F.month("_t"), "hour": F.hour("_t")}).drop("_t")


def season_days(years: DataFrame, year: str, months: tuple[int, int] = (5, 9)) -> DataFrame:
    """years with the first day of the season (from 0) and the day after its last, leap years included."""
    day = lambda m: F.dayofyear(F.make_date(F.col(year), F.lit(m), F.lit(1))) - 1
    end = day(months[1] + 1) if months[1] < 12 else F.dayofyear(F.make_date(F.col(year), F.lit(12), F.lit(31)))
    return years.withColumns({"first_day": day(months[0]), "end_day": end})


def year_blocks(records: DataFrame, index: str, start_year: int, per_day: int = 1) -> DataFrame:
    """(year, lo, hi) of each whole calendar year of records numbered from 0; hi is the number after the last."""
    n = records.agg((F.max(index) + 1).alias("n"))
    first = F.make_date(F.lit(start_year), F.lit(1), F.lit(1))
    days = n.select("n", F.explode(F.sequence(F.lit(start_year), F.lit(start_year) + F.ceil(F.col("n") / (365 * per_day)).cast("int"))).alias("year"))
    place = lambda y: F.date_diff(F.make_date(y, F.lit(1), F.lit(1)), first).cast("long") * per_day
    return days.withColumns({"lo": place(F.col("year")), "hi": place(F.col("year") + 1)}).where("hi <= n").select("year", "lo", "hi")


def window_reductions(history: DataFrame, keys: list[str], index: str, low: int, high: int, how: dict[str, str], value: str = "value") -> DataFrame:
    """Columns ``how`` (name: last, mean, max, min or sum) over record numbers low..high, both included; other kinds are refused."""
    kinds = {"last": F.max_by(value, index), "mean": F.avg(value), "max": F.max(value), "min": F.min(value), "sum": F.sum(value)}
    unknown = sorted(set(how.values()) - set(kinds))
    if unknown:
        raise ValueError(f"unknown reductions {', '.join(unknown)}; known: {', '.join(sorted(kinds))}")
    return history.where(F.col(index).between(low, high)).groupBy(*keys).agg(*(kinds[k].alias(name) for name, k in how.items()))


def ratio_in_window(history: DataFrame, keys: list[str], num: Column, den: Column, time: Column, low, high, density: float = 1000.0) -> DataFrame:
    """Mean of num / (den / density * 1000) in a window of time, rows of no flow left out; refuses a window the record ends in."""
    rows = history.groupBy(*keys).agg(
        F.avg(F.when(time.between(low, high) & (den != 0), F.try_divide(num, den / density * 1000))).alias("value"), F.max(time).alias("t_end")
    )
    return rows.withColumn("status", F.when((F.col("t_end") >= low) & (F.col("t_end") < high), "PARTIAL").otherwise("OK")).drop("t_end")
