"""Sensitivity from any cloud of inputs and outputs: density distance, spectral shares, and what noise earns.

All inputs are ranked in one pass (input, value, row), so there is one range sort however
many inputs there are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ensolith.lineage import cut
from ensolith.operators.ranks import numbered

#: Points at which densities are compared, and steps of y in which rows are counted before.
GRID, STEPS = 100, 1024


def ranked_inputs(df: DataFrame, inputs: list[str], y: str, key: str) -> DataFrame:
    """(key, y, input, place, n): every row's place from 0 by each input among the rows without a null, ties by key."""
    known = df.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    for x in inputs:
        known = known.where(F.col(x).isNotNull())
    known = cut(known.select(F.col(key).alias("key"), F.col(y).cast("double").alias("y"), *(F.col(x).cast("double").alias(f"_{k}") for k, x in enumerate(inputs))))
    n = known.count()
    each = known.select("key", "y", F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("x")) for k in range(len(inputs))))))
    names = F.array(*(F.lit(x) for x in inputs))
    ranks = numbered(each, [F.col("k"), F.col("x"), F.col("key")], "_r")
    return cut(ranks.select("key", "y", F.get(names, F.col("k")).alias("input"), (F.col("_r") - 1 - F.col("k") * n).alias("place"), F.lit(n).cast("long").alias("n")))


def spectral_share(ranked: DataFrame, harmonics: int = 10) -> DataFrame:
    """(input, first): the share of the variance of y in the first harmonics of its course along an input.

    The rows go up the odd places of the input and down the even ones, so that the course closes.
    The share that noise would have, 2 * harmonics / n, is taken out; null if y does not vary.
    """
    t = F.when(F.col("place") % 2 == 0, F.col("place") / 2).otherwise(F.col("n") - 1 - (F.col("place") - 1) / 2)
    turn = 2 * math.pi * t / F.col("n")
    sums = [f(m * F.col("_turn")) for m in range(1, harmonics + 1) for f in (F.cos, F.sin)]
    g = ranked.withColumn("_turn", turn).groupBy("input").agg(F.max("n").alias("n"), (F.var_pop("y") * F.count("y")).alias("v"), *(F.sum(F.col("y") * s).alias(f"_{k}") for k, s in enumerate(sums)))
    power = sum((F.col(f"_{k}") * F.col(f"_{k}") for k in range(len(sums))), F.lit(0.0)) * 2 / F.col("n")
    share, noise = F.try_divide(power, F.col("v")), 2.0 * harmonics / F.col("n")
    return g.select("input", F.when(noise < 1, share - noise / (1 - noise) * (1 - share)).alias("first"))


def slices_for(n: int) -> int:
    """How many slices of equally many rows: some n ** (2/6) for few rows, n ** (2/8) for many, 48 at most."""
    return max(1, round(min(math.ceil(n ** (2 / (7 + math.tanh((1500 - n) / 500)))), 48)))


def _smoothed(counts: np.ndarray, at: np.ndarray, grid: np.ndarray, n: float, total: float, squares: float, least: float) -> np.ndarray:
    """Density at the grid: normal kernels of Silverman's width, at least a step's."""
    spread = math.sqrt(max(0.0, (squares - total * total / n) / (n - 1))) if n > 1 else 0.0
    width = max(spread * (n * 0.75) ** -0.2, least)
    held = counts > 0
    z = (grid[:, None] - at[held]) / width
    return (np.exp(-z * z / 2) * counts[held]).sum(axis=1) / (n * width * math.sqrt(2 * math.pi))


def density_distance(ranked: DataFrame, keys: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """(keys, input, delta): half the mean area between the density of y in a slice of an input and over all.

    Slices hold equally many rows. y is counted in STEPS steps of its range in each slice, which is all that
    is exchanged; the densities of these counts are compared at GRID points. 0 if y does not vary.
    """
    keys = keys or []
    ends = ranked.agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.max("n").alias("n")).first()  # one row
    lo, hi, n = ends["lo"], ends["hi"], ends["n"]
    if not n:
        return ranked.select(*keys, "input", F.lit(None).cast("double").alias("delta")).where("false")
    many = slices or slices_for(n)
    step = (hi - lo) / STEPS
    slice_ = F.floor(F.col("place") * many / F.col("n")).cast("int")
    bin_ = F.least(F.lit(STEPS - 1), F.floor((F.col("y") - lo) / step).cast("int")) if step > 0 else F.lit(0)
    counts = ranked.groupBy(*keys, "input", slice_.alias("slice"), bin_.alias("bin")).agg(F.count("*").alias("c"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    grid = np.linspace(lo, hi, GRID)

    def distance(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[[0]][[*keys, "input"]].reset_index(drop=True)
        if step <= 0:
            return first.assign(delta=0.0)

        def density(part):
            per = np.bincount(part["bin"], part["c"], STEPS)
            return _smoothed(per, lo + (np.arange(STEPS) + 0.5) * step, grid, float(part["c"].sum()), float(part["s"].sum()), float(part["q"].sum()), step)

        every, rows, found = density(pdf), pdf["c"].sum(), 0.0
        for _, part in pdf.groupby("slice"):
            gap = np.abs(every - density(part))
            found += part["c"].sum() / (2 * rows) * float(((gap[1:] + gap[:-1]) / 2 * np.diff(grid)).sum())
        return first.assign(delta=found)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.select(*keys, "input").schema)
    return counts.groupBy(*keys, "input").applyInPandas(distance, f"{kept}, delta double")  # slices times STEPS rows a group


def scattered(key: Column, salt: int) -> Column:
    """A number below 2^31 of an integer key by squares modulo a prime, so that keys in a row scatter."""
    prime = F.lit(2147483647)
    x = F.pmod(key.cast("long") * 48271 + salt, prime)
    z = F.pmod(F.pmod(x * x, prime) + x * 40692, prime)
    return F.pmod(z * z, prime)


def noise_floor(ranked: DataFrame, turns: int = 5, slices: int | None = None) -> DataFrame:
    """(floor): the largest density distance of any input in ``turns`` dealings of y to other rows; one row.

    Rows are put in a hashed order of their integer keys once and each turn gives a row the y of the one a hashed number of
    places on, so inputs and outputs keep their own distributions and lose what ties them.
    """
    n = ranked.agg(F.max("n").alias("n")).first()["n"] or 0
    if n < 2:
        return ranked.sparkSession.createDataFrame([(None,)], "floor double")
    one = ranked.select("input").limit(1).first()["input"]
    rows = numbered(ranked.where(F.col("input") == one).select("key", "y"), [scattered(F.col("key"), 17), F.col("key")], "_at")
    on = 1 + F.pmod(scattered(F.col("turn"), 3), F.lit(n - 1))
    dealt = rows.select("y", F.explode(F.sequence(F.lit(1), F.lit(turns))).alias("turn"), "_at").select("y", "turn", F.pmod(F.col("_at") + on, F.lit(n)).alias("_to"))
    places = ranked.select("key", "input", "place", "n").join(rows.select("key", F.pmod(F.col("_at"), F.lit(n)).alias("_to")), "key")
    return density_distance(cut(places.join(dealt, "_to").select("turn", "input", "place", "n", "y")), ["turn"], slices).agg(F.max("delta").alias("floor"))


def given_data_sensitivity(df: DataFrame, inputs: list[str], y: str, key: str, turns: int = 5) -> DataFrame:
    """(input, delta, first, rank, distinguishable, n): both measures, the mean of an input's ranks by them, and whether delta clears the noise floor.

    Rows with a null input or output count for none; keys must be distinct.
    """
    ranked = ranked_inputs(df, inputs, y, key)
    both = density_distance(ranked).join(spectral_share(ranked), "input")
    floor = noise_floor(ranked, turns)
    names = F.collect_list(F.struct("input", "delta", "first"))  # a row for each input
    rows = both.agg(names.alias("i"), F.count("*").alias("_p")).withColumn("r", F.explode("i")).crossJoin(F.broadcast(floor))  # one row
    place = lambda c: F.size(F.filter("i", lambda o: (F.coalesce(F.abs(o[c]), F.lit(-1.0)) > F.coalesce(F.abs(F.col("r")[c]), F.lit(-1.0))) | ((F.abs(o[c]) == F.abs(F.col("r")[c])) & (o["input"] < F.col("r")["input"])))) + 1
    n = ranked.agg(F.max("n").alias("n"))
    return rows.crossJoin(F.broadcast(n)).select("r.input", "r.delta", "r.first", ((place("delta") + place("first")) / 2).alias("rank"), (F.col("r.delta") > F.col("floor")).alias("distinguishable"), "n")  # one row
