"""Keyed stores, run states and citation checks as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(store: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """store with each key's last update (by order) in the place of its row; new keys are added."""
    values = [c for c in store.columns if c not in keys]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, *(F.col(f"_v.{c}").alias(c) for c in values))
    return store.join(last, keys, "left_anti").select(*store.columns).unionByName(last.select(*store.columns))


def promote(staged: DataFrame, keys: list[str], confidence: Column, least: float) -> DataFrame:
    """Staged entries of enough confidence, as verified only where somebody vouches for them (verified_by)."""
    good = staged.where(confidence >= least)
    return good.select(*keys, confidence.alias("confidence"), F.col("verified_by").isNotNull().alias("verified"))


def reconcile(states: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Each case's state: what the scheduler says (terminal boolean) held against its output (complete boolean).

    A case that has ended without complete output has failed, whatever its exit said.
    """
    both = states.join(outputs, key, "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
    state = F.when(F.col("complete") & F.col("terminal"), "COMPLETED").when(F.col("terminal"), "FAILED").otherwise("RUNNING")
    return both.select(key, state.alias("state"))


def differing(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Entries of left that right lacks, or holds with a value further off than the tolerance."""
    r = right.select(*keys, F.col(value).alias("_right"))
    j = left.join(r, keys, "left")
    status = F.when(F.col("_right").isNull(), "missing").when(F.abs(F.col(value) - F.col("_right")) > tolerance, "changed")
    return j.withColumn("status", status).where("status is not null").select(*keys, "status")


def citations(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (id, path, line) cited in a text as path.suffix:line."""
    found = F.regexp_extract_all(text_col, F.lit(r"([A-Za-z0-9_./-]+\.[A-Za-z0-9]+:\d+)"), F.lit(1))
    cited = texts.select(id_col, F.explode(F.array_distinct(found)).alias("_c"))
    return cited.select(id_col, F.substring_index("_c", ":", 1).alias("path"), F.substring_index("_c", ":", -1).cast("long").alias("line"))


def check_citations(cited: DataFrame, files: DataFrame) -> DataFrame:
    """cited with a status against files (path, n_lines): missing, out_of_bounds or ok."""
    j = cited.join(files.select("path", "n_lines"), "path", "left")
    status = F.when(F.col("n_lines").isNull(), "missing").when(~F.col("line").between(1, F.col("n_lines")), "out_of_bounds").otherwise("ok")
    return j.withColumn("status", status).drop("n_lines")


def keyword_hits(texts: DataFrame, id_col: str, text_col: str, keywords: list[str]) -> DataFrame:
    """(id, n_matched keywords, n_hits) of the texts that hold one at least; plain strings, any case."""
    low = F.lower(text_col)
    counts = [F.regexp_count(low, F.lit(rf"\Q{k.lower()}\E")) for k in keywords]
    hits = texts.select(id_col, F.array(*counts).alias("_n"))
    total = F.aggregate("_n", F.lit(0), lambda s, x: s + x).cast("long")
    return hits.select(id_col, F.size(F.filter("_n", lambda x: x > 0)).cast("long").alias("n_matched"), total.alias("n_hits")).where("n_hits > 0")
