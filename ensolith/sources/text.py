"""Readers and writers for the text formats of simulation decks, notes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def history(spark: SparkSession, path: str, variables: list[str], order: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Named columns of a Parquet history within an inclusive range of its order column; a missing variable is refused."""
    df = spark.read.parquet(path)
    missing = [v for v in variables if v not in df.columns]
    if missing:
        raise ValueError(f"not in the history: {', '.join(missing)}")
    if first is not None:
        df = df.where(F.col(order) >= first)
    if last is not None:
        df = df.where(F.col(order) <= last)
    return df.select(order, *variables)


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", comment: str = "#", header: bool = False) -> DataFrame:
    """Delimited text of a declared schema; comment lines are left out, values that do not parse are null."""
    return spark.read.csv(path, schema=schema, sep=sep, comment=comment, header=header, ignoreLeadingWhiteSpace=True)


def notes(spark: SparkSession, path: str, pattern: str = "*.md", store: str = "notes") -> DataFrame:
    """(store, source, title, text) of whole text files below a folder; the title is the first heading, else the name."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    files = files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    heading = F.trim(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1))
    name = F.regexp_extract("source", r"([^/]+?)(\.[^./]*)?$", 1)
    return files.select(F.lit(store).alias("store"), "source", F.when(heading != "", heading).otherwise(name).alias("title"), "text")


def parameter_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, lower_bound, upper_bound) of a parameter CSV with a header.

    Rows whose bounds are no numbers are dropped. A lower bound that is not below the upper one
    is refused when the row is read.
    """
    raw = spark.read.csv(path, header=True, comment="#", schema=None)
    low, high = F.expr("try_cast(lower_bound AS double)"), F.expr("try_cast(upper_bound AS double)")
    rows = raw.select("name", low.alias("lower_bound"), high.alias("upper_bound")).where("lower_bound is not null and upper_bound is not null")
    refused = F.raise_error(F.concat(F.lit("lower bound not below upper bound: "), "name")).cast("double")
    checked = F.when(F.col("lower_bound") < F.col("upper_bound"), F.col("lower_bound")).otherwise(refused)
    return rows.select("name", checked.alias("lower_bound"), "upper_bound")


def deck(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Entries of an XML deck as rows of a declared schema (attributes bear a leading underscore)."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def write_ranking(ranked: DataFrame, path: str) -> None:
    """A ranking as tab-separated text, its parts in the order of rank."""
    ranked.sort("rank").write.mode("errorifexists").csv(path, sep="\t", header=True)
