"""Balance files: a quoted header with commas, then rows of numbers set apart by white space alone.

Columns are named ``scope variable [unit]``. A unit with a slash is a rate, any other a running
total, so that a scope and variable name one column only together with that choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("source"), F.trim("value").alias("line")).where("line <> ''")


def _is_header() -> Column:
    return F.col("line").contains('"')


def _columns(lines: DataFrame) -> DataFrame:
    cells = lines.where(_is_header()).distinct().select("source", F.posexplode(F.split("line", ",")).alias("place", "cell"))
    named = cells.select("source", "place", F.trim(F.translate("cell", '"', "")).alias("name")).where("name <> ''")
    bare = F.trim(F.regexp_replace("name", r"\s*\[[^\]]*\]\s*$", ""))
    parts = named.withColumn("unit", F.trim(F.regexp_extract("name", r"\[([^\]]*)\]\s*$", 1))).withColumn("_bare", bare)
    family = F.when(F.col("_bare").rlike("^(Time|dt_)"), "time").when(F.col("_bare").startswith("Global "), "global").when(F.col("_bare").startswith("Region "), "region").otherwise("coupler")
    inner = F.when(F.col("family").isin("global", "region"), F.trim(F.regexp_replace("_bare", r"^\S+\s+", ""))).otherwise(F.col("_bare"))
    split = parts.withColumn("family", family).withColumn("_inner", inner)
    first, rest = F.regexp_extract("_inner", r"^(\S+)", 1), F.trim(F.regexp_replace("_inner", r"^\S+\s*", ""))
    scope = F.when(F.col("family") == "time", F.col("_bare")).when(F.col("family") == "global", "").otherwise(first)
    variable = F.when(F.col("family").isin("time", "global") | (rest == ""), F.col("_inner")).otherwise(rest)
    return split.select("source", "place", "name", scope.alias("scope"), variable.alias("variable"), "unit", "family", F.col("unit").contains("/").alias("is_rate"))


def balance_columns(spark: SparkSession, path: str, pattern: str = "*-mas.dat") -> DataFrame:
    """(source, place, name, scope, variable, unit, family, is_rate), a row for each column of each file.

    family is time, global, region or coupler. Cells without a name are no columns; a header
    written again after a restart counts once.
    """
    return _columns(_lines(spark, path, pattern))


def balance_series(spark: SparkSession, path: str, wanted: list[tuple[str, str, bool]], pattern: str = "*-mas.dat") -> DataFrame:
    """(source, time, name, value) of the columns named by (scope, variable, is_rate), a row for each record.

    Records with another number of fields than their header are left out whole, as a run was
    stopped while it wrote them; fields that are no numbers give no row. A file without a column
    has no rows of it. Two columns that answer to one choice are refused when they are read.
    Only the headers' choices are joined to the records, one row for each file.
    """
    if not wanted:
        raise ValueError("no columns are asked for")
    lines = _lines(spark, path, pattern)
    asked = [(F.col("scope") == s) & (F.col("variable") == v) & (F.col("is_rate") == F.lit(r)) for s, v, r in wanted]
    hits = [F.collect_list(F.when(a, F.struct("place", "name"))) for a in asked]
    one = [F.when(F.size(h) > 1, F.raise_error(F.concat(F.lit(f"several columns answer to {w}: "), F.array_join(h["name"], ", "))).cast(_CHOICE)).otherwise(h) for h, w in zip(hits, wanted)]
    clock = F.min(F.when((F.col("family") == "time") & F.col("name").startswith("Time"), F.col("place")))
    heads = _columns(lines).groupBy("source").agg(F.count("*").alias("_n"), clock.alias("_clock"), F.flatten(F.array(*one)).alias("_chosen"))
    records = lines.where(~_is_header()).select("source", F.split("line", r"\s+").alias("_f"))
    whole = records.join(heads, "source").where("size(_f) = _n")
    long = whole.select("source", "_f", F.expr("try_cast(get(_f, _clock) AS double)").alias("time"), F.explode("_chosen").alias("_c"))
    return long.select("source", "time", F.col("_c.name").alias("name"), F.expr("try_cast(get(_f, _c.place) AS double)").alias("value")).where("value is not null")


_CHOICE = "array<struct<place:int,name:string>>"
