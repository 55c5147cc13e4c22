"""Errors along a profile and away from the training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ensolith.functions.metrics import weighted
from ensolith.lineage import cut
from ensolith.operators.contrasts import group_quantile, group_quantiles


def profile_costs(layers: DataFrame, keys: list[str], depth: str, s: Column, o: Column) -> DataFrame:
    """RMSE of each profile with layers weighted alike (uniform), by thickness and by falling depth (exponential).

    Depths are layer centres counted from zero, so a layer's thickness is the step from the one before.
    """
    w = Window.partitionBy(*keys)
    thick = F.col(depth) - F.lag(depth, 1, 0).over(w.orderBy(depth))
    fall = F.exp(-F.try_divide(F.col(depth), F.max(depth).over(w)))
    squared = layers.withColumns({"_t": thick, "_x": fall, "_e": (s - o) * (s - o)})
    e = F.col("_e")
    return squared.groupBy(*keys).agg(F.sqrt(F.avg(e)).alias("uniform"), F.sqrt(weighted(e, F.col("_t"))).alias("thickness"), F.sqrt(weighted(e, F.col("_x"))).alias("exponential"))


def boundary_profile(df: DataFrame, distance: str, error: str, bins: int = 4) -> DataFrame:
    """Errors by quantile bin of distance: (bin, low, high, n, mean_error, median_error).

    A bin holds its lower edge, the last one its upper edge too; empty bins are left out.
    """
    known = df.where(F.col(distance).isNotNull() & F.col(error).isNotNull()).withColumn("_all", F.lit(0))
    edges = group_quantiles(known, ["_all"], distance, {f"q{k}": k / bins for k in range(bins + 1)}).select(F.array(*(f"q{k}" for k in range(bins + 1))).alias("_q"))
    edges = F.broadcast(cut(edges))  # one row of edges
    inner = sum(((F.col(distance) >= F.get("_q", F.lit(k))).cast("long") for k in range(1, bins)), F.lit(0).cast("long"))
    binned = known.crossJoin(edges).select(inner.alias("bin"), F.col(error).alias("_e"))
    medians = group_quantile(binned, ["bin"], "_e", 0.5, "median_error")
    out = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("_e").alias("mean_error")).join(medians, "bin").crossJoin(edges)  # a row for each bin
    return out.select("bin", F.get("_q", F.col("bin").cast("int")).alias("low"), F.get("_q", F.col("bin").cast("int") + 1).alias("high"), "n", "mean_error", "median_error")
