"""Ranks and order statistics of whole tables without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ensolith.lineage import cut

BINS = 4096
#: Groups whose state goes to every task; with more, rows are dealt by group.
GROUPS = 100_000


def numbered(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """df with numbers from 1 in the given order, which must leave no ties.

    Rows are dealt by ranges of the order; each partition counts its own and adds what stands in the partitions before.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(out, (own + F.col("_offset")).cast("long")).drop("_part", "_offset")


def average_ranks(df: DataFrame, value: str, tie: str, out: str) -> DataFrame:
    """df with ranks from 1 by value, equal values sharing their mean rank; ``tie`` makes rows distinct."""
    rows = numbered(df, [F.col(value).asc_nulls_last(), F.col(tie).asc_nulls_last()], "_r")
    shared = rows.groupBy(F.col(value).alias("_v")).agg(((F.min("_r") + F.max("_r")) / 2).alias(out))
    return rows.join(shared, F.col(value).eqNullSafe(F.col("_v"))).drop("_v", "_r")


def per_group(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined to a checkpointed row of each group: sent to the tasks while that is small, so that no task gets all of a group."""
    return rows.join(F.broadcast(state) if state.count() <= GROUPS else state, keys)


def values_at(df: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(keys, n, and a column for each name): the value at each place from 1 (expressions of the group's size n) of each group; null beyond its ends.

    Each pass counts a group's values in bins of the spans that are left, which are combined where they are read, and goes on
    with the bins that hold the places, until each is one value. A span's ends have bins of their own, so every pass
    narrows it, also around infinities and outliers; nothing is ordered.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"))
    spans = cut(known.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("n")))
    # halves, so that the width of the widest span is still a number
    share = F.try_divide(F.col("_x") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
    inner = F.least(F.lit(BINS - 2), F.lit(1) + F.floor(F.nanvl(F.coalesce(share, F.lit(0.0)), F.lit(0.0)) * (BINS - 2)).cast("int"))
    at = F.when(F.col("_x") == F.col("_lo"), 0).when(F.col("_x") == F.col("_hi"), BINS - 1).otherwise(inner)
    span = [*keys, "_lo", "_hi"]
    w = Window.partitionBy(*span).orderBy("_bin")  # BINS rows for each span at most
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), place.cast("long").alias("k")) for name, place in places.items()))).alias("_p")
    left = spans.select(*span, "n", asked).select(*span, F.col("_p.name").alias("_p"), F.col("_p.k").alias("_k"), "n").where("_k between 1 and n").drop("n")
    found = None
    while True:
        done = left.where("_lo = _hi").select(*keys, "_p", F.col("_lo").alias("_v"))
        found, left = done if found is None else found.unionByName(done), left.where("_lo < _hi")
        open_ = cut(left.select(*span).distinct())
        if not open_.limit(1).count():
            break
        inside = per_group(known, open_, keys).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
        bins = inside.groupBy(*span, at.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_x").alias("_a"), F.max("_x").alias("_z")).withColumn("_upto", F.sum("_c").over(w))
        hit = (F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_c") < F.col("_k"))
        left = cut(bins.join(left, span).where(hit).select(*keys, F.col("_a").alias("_lo"), F.col("_z").alias("_hi"), "_p", (F.col("_k") - F.col("_upto") + F.col("_c")).alias("_k")))
    named = found.groupBy(*keys).agg(*(F.max(F.when(F.col("_p") == name, F.col("_v"))).alias(name) for name in places))
    return spans.select(*keys, "n").join(named, keys, "left")


def kth_smallest(df: DataFrame, keys: list[str], value: str, place: Column) -> DataFrame:
    """(keys, n, kth): the value at a place from 1 (an expression of the group's size n) of each group; null beyond its ends."""
    return values_at(df, keys, value, {"kth": place})


def at_place(values: DataFrame, place: int) -> float | None:
    """The value at a place from 1 of a table (x, w) without nulls or infinities, each x standing w times; null beyond its ends.

    Each pass counts BINS bins of the span that is left and goes on with the smallest and
    largest value of the bin that holds the place, until these are one: an outlier costs a pass,
    and nothing is ordered.
    """
    left, inside = values, place
    span = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("w").alias("n")).first()
    if not 1 <= place <= (span["n"] or 0):
        return None
    lo, hi = span["lo"], span["hi"]
    while lo < hi:
        # halves, so that the width of the widest span is still a number
        share = (F.col("x") / 2 - lo / 2) / (hi / 2 - lo / 2)
        bins = left.groupBy(F.least(F.lit(BINS - 1), F.floor(share * BINS).cast("int")).alias("bin")).agg(F.sum("w").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        for r in sorted(bins.collect(), key=lambda r: r["bin"]):  # BINS rows at most
            if inside <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            inside -= r["n"]
        left = values.where(F.col("x").between(lo, hi))
    return lo


def quantile(df: DataFrame, value: str, level: float, times: Column | None = None) -> float | None:
    """The exact quantile of a column's finite values, between its two nearest order statistics, each value standing once or ``times``; null of no values."""
    values = cut(df.select(F.col(value).cast("double").alias("x"), (F.lit(1) if times is None else times).cast("long").alias("w")).where(F.abs("x") < float("inf")))
    at = ((values.agg(F.sum("w")).first()[0] or 0) - 1) * level
    low = at_place(values, int(at) + 1)
    return low if low is None or at == int(at) else low + (at - int(at)) * (at_place(values, int(at) + 2) - low)
