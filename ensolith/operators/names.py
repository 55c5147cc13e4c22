"""Names that resemble each other, by the share of letters in matching blocks.

The ratio is twice the letters in the longest common block, and in those left and right of it
in turn, over the letters of both. It can be no more than what the two letter counts share, so names
are joined on their rarest letters (the n-th of a kind being a letter of its own): names that share
enough have one of them in common. The filter loses no pair.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-block ratio of each pair; it may differ with the order of the two."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _letters(name: Column) -> Column:
    """The letters of a name, each with how many of its kind stand before it."""
    letters = F.filter(F.split(name, ""), lambda x: x != "")
    return F.transform(letters, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def similar_names(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """(a, b, ratio, back): pairs of a left and a right name (column name) whose ratio or its reverse, b against a, is at the cutoff or above."""
    if not 0 < cutoff <= 1:
        raise ValueError("a cutoff above 0, at most 1")
    sides = [df.where("name is not null and name <> ''").select("name").distinct().withColumn("letters", _letters(F.col("name"))) for df in (left, right)]
    rare = sides[0].unionByName(sides[1]).select(F.explode("letters").alias("letter")).groupBy("letter").agg(F.count("*").alias("many"))
    least = cutoff / (2 - cutoff)  # of a name's letters, that it must share at least with any partner
    keyed = []
    for side in sides:
        own = side.select("name", "letters", F.explode("letters").alias("letter")).join(rare, "letter")
        order = own.groupBy("name").agg(F.first("letters").alias("letters"), F.array_sort(F.collect_list(F.struct("many", "letter"))).alias("o"))  # one name's letters
        need = F.size("letters") - F.ceil(F.size("letters") * least - 1e-9).cast("int") + 1
        keyed.append(order.select("name", "letters", F.explode(F.slice("o", F.lit(1), need)["letter"]).alias("letter")))
    a, b = (k.select("letter", F.col("name").alias(n), F.col("letters").alias(f"_{n}")) for k, n in zip(keyed, "ab"))
    total = F.size("_a") + F.size("_b")
    met = a.join(b, "letter").where((2 * F.least(F.size("_a"), F.size("_b")) >= cutoff * total - 1e-9) & (2 * F.size(F.array_intersect("_a", "_b")) >= cutoff * total - 1e-9))
    pairs = met.select("a", "b").distinct().withColumns({"ratio": block_ratio("a", "b"), "back": block_ratio("b", "a")})
    return pairs.where((F.col("ratio") >= cutoff) | (F.col("back") >= cutoff))


def renames(left: DataFrame, right: DataFrame, cutoff: float = 0.7) -> DataFrame:
    """(a, b, ratio): names that are each other's best match, both ways at the cutoff or above; of equal ratios the first name."""
    pairs = similar_names(left, right, cutoff)
    best = lambda by, ratio, other: F.row_number().over(Window.partitionBy(by).orderBy(F.desc(ratio), other)) == 1
    both = pairs.withColumn("_x", best("a", "ratio", "b")).withColumn("_y", best("b", "back", "a"))
    return both.where(F.col("_x") & F.col("_y") & (F.col("ratio") >= cutoff) & (F.col("back") >= cutoff)).select("a", "b", "ratio")


def suggestions(missing: DataFrame, known: DataFrame, n: int = 5, cutoff: float = 0.6) -> DataFrame:
    """(a, b, ratio, rank): the n known names closest to each missing one, of equal ratios the last name; the known name is held against the missing one."""
    w = Window.partitionBy("a").orderBy(F.desc("ratio"), F.desc("b"))
    close = similar_names(missing, known, cutoff).where(F.col("back") >= cutoff).select("a", "b", F.col("back").alias("ratio"))
    return close.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
