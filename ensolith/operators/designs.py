"""Experiment designs and hold-out splits, generated and cut by Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def design_size(method: str, n: int, p: int, second_order: bool = True) -> int:
    """Rows of a design over p parameters."""
    sizes = {"morris": n * (p + 1), "lhs": n, "sobol_seq": n, "sobol": n * (2 * p + 2 if second_order else p + 2)}
    if method not in sizes:
        raise ValueError(f"unknown design {method!r}")
    return sizes[method]


def morris_trajectories(spark, n: int, names: list[str], levels: int, seed: int) -> DataFrame:
    """n trajectories of len(names) + 1 points in the unit box: (trajectory, step, changed, one column for each name).

    Points lie on a grid of an even number of levels. Each step moves one parameter, in a
    hashed order, by levels / (2 (levels - 1)) up or down; ``changed`` names it (null at step 0).
    """
    if levels < 2 or levels % 2:
        raise ValueError("levels must be even")
    delta = levels / (2.0 * (levels - 1))

    def mixed(k, salt):
        return F.xxhash64("trajectory", F.lit(k), F.lit(seed), F.lit(salt))

    places = range(len(names))
    moves = F.transform(F.array_sort(F.array(*(F.struct(mixed(k, 2).alias("h"), F.lit(k).alias("k")) for k in places))), lambda s: s["k"])
    steps = spark.range(n).withColumnRenamed("id", "trajectory").withColumn("_moves", moves)
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(names)))))
    out = {}
    for k, name in enumerate(names):
        moved = F.col("step") >= F.array_position("_moves", k)
        high = moved == (F.pmod(mixed(k, 1), F.lit(2)) == 0)
        out[name] = F.pmod(mixed(k, 0), F.lit(levels // 2)) / (levels - 1.0) + F.when(high, delta).otherwise(0.0)
    changed = F.when(F.col("step") > 0, F.get(F.array(*(F.lit(x) for x in names)), F.get("_moves", F.col("step") - 1)))
    return steps.select("trajectory", "step", changed.alias("changed"), *(v.alias(c) for c, v in out.items()))


def _marked(df: DataFrame, bound: DataFrame, held: Column) -> DataFrame:
    """df with held_out by an expression that may use the one row of ``bound``."""
    return df.crossJoin(F.broadcast(bound)).withColumn("held_out", held).drop(*bound.columns)  # one row


def hold_out(df: DataFrame, score: Column, share: float) -> DataFrame:
    """df with held_out true for the rows whose score is in the upper ``share`` of all scores."""
    if share <= 0 or share >= 1:
        raise ValueError(f"no share of the rows: {share}")
    scored = df.withColumn("_score", score)
    return _marked(scored, scored.agg(F.percentile("_score", F.lit(1 - share)).alias("_bound")), F.col("_score") >= F.col("_bound")).drop("_score")


def hold_out_end(df: DataFrame, index: str, share: float, first: bool = False) -> DataFrame:
    """df with held_out true for the last (or first) rows of a consecutive index: their share of all, one at least."""
    if share <= 0 or share >= 1:
        raise ValueError(f"no share of the rows: {share}")
    many = F.greatest(F.lit(1.0), F.bround(F.count("*") * share))
    edge = F.min(index) + many if first else F.max(index) - many
    return _marked(df, df.agg(edge.alias("_edge")), F.col(index) < F.col("_edge") if first else F.col(index) > F.col("_edge"))


def with_radius(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with its mean distance from the middle of the box that its parameters span (column radius)."""
    box = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    boxed = df.crossJoin(F.broadcast(box))  # one row
    unit = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0))
    radius = sum((F.abs(unit(c) - 0.5) for c in columns), F.lit(0.0)) / len(columns)
    return boxed.select(*df.columns, F.round(radius, 12).alias("radius"))


def sweep(design: DataFrame, name: str, values: list[float]) -> DataFrame:
    """Every row of a design with each value of one more parameter."""
    return design.select("*", F.explode(F.array(*(F.lit(float(v)) for v in values))).alias(name))


def in_box(design: DataFrame, bounds: list[tuple[str, float, float]]) -> DataFrame:
    """A design of the unit box in native units: (name, lower, upper) of each of its parameters."""
    return design.withColumns({name: F.lit(low) + F.col(name) * (high - low) for name, low, high in bounds})


def subsets(groups: DataFrame, members: str, most: int = 16) -> DataFrame:
    """groups with experiment and its members: every non-empty choice from an array of distinct members, in the array's order.

    Experiment numbers are the choices as bits. A group of more than ``most`` members is refused, as it doubles with each.
    """
    size = F.size(members)
    checked = F.when(size > most, F.raise_error(F.concat(F.lit("too many members to combine: "), size.cast("string")))).otherwise(size)
    each = groups.where(size > 0).withColumn("experiment", F.explode(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), checked) - 1)))
    return each.withColumn(members, F.filter(members, lambda x, i: F.call_function("bit_get", F.col("experiment"), i).cast("int") == 1))
