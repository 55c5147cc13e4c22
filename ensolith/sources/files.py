"""Case files, graphs, stores and result tables in files, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ensolith.functions.metrics import clean


def cases_in(spark: SparkSession, path: str, pattern: str, most: int | None = None) -> DataFrame:
    """(case_id, file) of the files below a folder whose name holds a case number: the first group of the pattern; numbers above ``most`` are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    number = F.expr("try_cast(_n AS bigint)")
    found = files.withColumn("_n", F.regexp_extract("file", pattern, 1)).select(number.alias("case_id"), "file").where("case_id is not null")
    return found if most is None else found.where(F.col("case_id") <= most)


def case_history(spark: SparkSession, path: str, pattern: str, variables: list[str], order: str, first: int | None = None, end: int | None = None, read: str = "parquet", **options) -> DataFrame:
    """(case_id, order column, variables) of all cases' files in one, for order values from first up to but without end.

    Files of one case (years, restarts) follow each other; a variable that no file has is refused.
    """
    df = spark.read.format(read).options(mergeSchema="true", recursiveFileLookup="true", **options).load(path)
    missing = [v for v in variables if v not in df.columns]
    if missing:
        raise ValueError(f"not in the history: {', '.join(missing)}")
    rows = df.select(F.expr("try_cast(_n AS bigint)").alias("case_id") if "_n" in df.columns else F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).cast("long").alias("case_id"), order, *(clean(F.col(v)).alias(v) for v in variables))
    rows = rows if first is None else rows.where(F.col(order) >= first)
    return rows if end is None else rows.where(F.col(order) < end)


def sniffed(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Delimited text whose first line that is no comment tells the delimiter: tab, semicolon, comma or white space."""
    head = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).first()
    line = head[0] if head else ""
    sep = next((s for s in ("\t", ";", ",") if s in line), " ")
    return spark.read.csv(path, sep=sep, header=header, comment="#", ignoreLeadingWhiteSpace=True)


def typed_parameters(raw: DataFrame) -> DataFrame:
    """(name, lower_bound, upper_bound, is_log, mode) of a parameter list read as text.

    Scales are log or linear, modes absolute (the default) or multiplier. A repeated name, bounds
    out of order, or a logarithmic lower bound that is not above zero are refused when read.
    """
    has = lambda c, other: F.lower(F.trim(c)) if c in raw.columns else F.lit(other)
    rows = raw.select("name", F.expr("try_cast(lower_bound AS double)").alias("lower_bound"), F.expr("try_cast(upper_bound AS double)").alias("upper_bound"), (has("scale", "linear") == "log").alias("is_log"), F.coalesce(has("mode", "absolute"), F.lit("absolute")).alias("mode"))
    n = rows.groupBy("name").agg(F.count("*").alias("_n"))
    bad = F.when(F.col("_n") > 1, "repeated name: ").when(~(F.col("lower_bound") < F.col("upper_bound")), "bounds out of order: ").when(F.col("is_log") & (F.col("lower_bound") <= 0), "logarithm of a bound not above zero: ")
    refused = F.raise_error(F.concat(bad, F.col("name"))).cast("double")
    return rows.join(n, "name").withColumn("lower_bound", F.when(bad.isNotNull(), refused).otherwise(F.col("lower_bound"))).drop("_n")


def scorable_targets(targets: DataFrame, names: list[str] | None = None) -> DataFrame:
    """targets (name, observed, track and more) with scored and a reason for those that are not: not_observed, other_track or not_named."""
    observed = clean(F.col("observed"))
    reason = F.when(observed.isNull(), "not_observed").when(F.col("track") == "soil_bgc", "other_track")
    if names is not None:
        reason = reason.when(~F.col("name").isin(names), "not_named")
    return targets.withColumn("reason", reason).withColumn("scored", F.col("reason").isNull())


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of JSON documents, arrays of entries included, by a declared schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and links as JSON lines in two folders of a new folder."""
    nodes.write.mode("errorifexists").json(f"{path}/nodes")
    edges.write.mode("errorifexists").json(f"{path}/links")


def load_graph(spark: SparkSession, path: str, node_schema: str = "node string, type string", edge_schema: str = "src string, dst string, relation string") -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(node_schema).json(f"{path}/nodes"), spark.read.schema(edge_schema).json(f"{path}/links")


def new_entries(store: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Entries whose key the store lacks, each key once (the first by all columns)."""
    last = entries.groupBy(key).agg(F.min(F.struct(*(c for c in entries.columns if c != key))).alias("_v"))
    return last.join(store.select(key).distinct(), key, "left_anti").select(key, "_v.*").select(*entries.columns)


def store_stats(store: DataFrame, kind: str) -> DataFrame:
    """Counts of a store's entries by kind."""
    return store.groupBy(kind).agg(F.count("*").alias("n"))


def ranking_layout(ranked: DataFrame, values: DataFrame, targets: list[str]) -> DataFrame:
    """(Rank, Set_ID, Composite, N_satisfied, RE_<target>.., Sim_<target>..) of ranked cases and their (case_id, target, relative_error, sim)."""
    wide = values.groupBy("case_id").agg(*(F.max(F.when(F.col("target") == t, F.col("relative_error"))).alias(f"RE_{t}") for t in targets), *(F.max(F.when(F.col("target") == t, F.format_string("%.6g", F.col("sim").cast("double")))).alias(f"Sim_{t}") for t in targets))
    j = ranked.join(wide, "case_id", "left")
    return j.select(F.col("rank").alias("Rank"), F.col("case_id").alias("Set_ID"), F.col("composite").alias("Composite"), F.col("n_satisfied").alias("N_satisfied"), *(f"RE_{t}" for t in targets), *(f"Sim_{t}" for t in targets))


def write_table(df: DataFrame, path: str, order: list[Column | str] | None = None, sep: str = ",") -> None:
    """A table as delimited text with a header; with an order, its parts follow it."""
    (df if order is None else df.sort(*order)).write.mode("errorifexists").csv(path, sep=sep, header=True)


def write_problem(spark: SparkSession, names: list[str], bounds: list[tuple[float, float]], path: str) -> None:
    """Names and bounds of a design's parameters, a line each in their order."""
    rows = [(k, n, float(a), float(b)) for k, (n, (a, b)) in enumerate(zip(names, bounds))]
    write_table(spark.createDataFrame(rows, "place int, name string, lower_bound double, upper_bound double"), path, ["place"])
