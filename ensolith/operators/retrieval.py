"""Chunking, filtered vector search and context assembly."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ensolith.functions.columns import clean_text

SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def split_recursively(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters: cut at the coarsest separator that occurs, finer ones for what is still too long."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next((s for s in separators if s == "" or s in text), "")
    if sep == "":
        return [text[i : i + size] for i in range(0, len(text), max(1, size - overlap))]
    finer, out, held = separators[separators.index(sep) + 1 :], [], ""
    for part in text.split(sep):
        joined = held + sep + part if held else part
        if len(joined) <= size:
            held = joined
            continue
        if held.strip():
            out.append(held)
        tail = held[-overlap:] if overlap and held else ""
        if len(part) > size:
            out += split_recursively(part, size, overlap, finer)
            held = ""
        else:
            held = tail + sep + part if tail and len(tail) + len(sep) + len(part) <= size else part
    if held.strip():
        out.append(held)
    return out


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200, least: int = 100) -> DataFrame:
    """(id, chunk_index, chunk): cleaned, split and numbered before the short ones go."""

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_recursively(t or "", size, overlap))

    cleaned = docs.select(id_col, clean_text(F.col(text_col)).alias("_t")).where(F.length("_t") >= least)
    return cleaned.select(id_col, F.posexplode(split("_t")).alias("chunk_index", "chunk")).where(F.length("chunk") >= least)


def _best_of_block(k: int, metric: str, digits: int | None):
    """Top k items of each query of one cogroup: similarities by falling, distances by rising value, ties by item_id."""

    def run(queries: pa.Table, items: pa.Table) -> pa.Table:
        if not queries.num_rows or not items.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "item_id": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
        q, v = (np.array(t[c].to_pylist(), np.float64) for t, c in ((queries, "q"), (items, "v")))
        ids, asked = items["item_id"].to_numpy(), queries["query_id"].to_numpy()
        out = []
        for i in range(len(q)):
            if metric == "cosine":
                norm = np.sqrt((v * v).sum(axis=1) * (q[i] * q[i]).sum())
                value = np.divide((v * q[i]).sum(axis=1), norm, out=np.full(len(v), np.nan), where=norm > 0)
            else:
                apart = np.abs(v - q[i])
                value = apart.max(axis=1) if metric == "largest" else np.sqrt((apart * apart).sum(axis=1))
            value = value if digits is None else np.round(value, digits)
            order = np.lexsort((ids, np.where(np.isnan(value), np.inf, -value if metric == "cosine" else value)))[:k]
            out.append((np.full(len(order), asked[i]), ids[order], value[order]))
        a, b, c = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": a, "item_id": b, "value": pa.array(c, from_pandas=True)})

    return run


def nearest(queries: DataFrame, items: DataFrame, k: int, prefilter: Column | None = None, digits: int | None = None, metric: str = "cosine", per_block: int = 512) -> DataFrame:
    """The k nearest items (item_id, v) of each query (query_id, q): (query_id, item_id, similarity, rank); ties by item_id.

    metric: cosine (larger is nearer), or euclidean or largest component (smaller is nearer). Items
    are filtered first and dealt over salts, queries over blocks; a task sees one block of queries
    and one salt of items and gives its k best, so what is exchanged does not grow with the items
    beyond them. With digits, values are rounded before they are ranked.
    """
    rows = (items if prefilter is None else items.where(prefilter)).select("item_id", "v")
    salts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-queries.count() // per_block))
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "q", F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("_block"), each(salts).alias("_salt"))
    dealt = rows.select(F.col("item_id").cast("long").alias("item_id"), "v", each(n).alias("_block"), F.pmod(F.xxhash64("item_id"), F.lit(salts)).alias("_salt"))
    best = asked.groupBy("_block", "_salt").cogroup(dealt.groupBy("_block", "_salt")).applyInArrow(_best_of_block(k, metric, digits), "query_id long, item_id long, value double")
    order = F.col("value").desc_nulls_last() if metric == "cosine" else F.col("value").asc_nulls_last()
    w = Window.partitionBy("query_id").orderBy(order, "item_id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", "item_id", F.col("value").alias("similarity"), "rank")


def nearest_of_each_query(hits: DataFrame, by: str, order: list[str], most: int | None = None) -> DataFrame:
    """Hits of several queries (query_no, pos, similarity and more) in one list: the first of each ``by``, by falling similarity, ``most`` at most."""
    kept = first_seen(hits, by, ["query_no", "pos"])
    ranked = kept.orderBy(F.desc("similarity"), *order)
    return ranked if most is None else ranked.limit(most)


def entities(queries: DataFrame, id_col: str, text_col: str, keywords: dict[str, str]) -> DataFrame:
    """(id, kind, entity) in questions: parameters (words with an underscore), groups (PFT #n), mechanisms by their keywords."""
    low = F.lower(text_col)
    kinds = {
        "parameter": F.regexp_extract_all(low, F.lit(r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b"), F.lit(1)),
        "group": F.transform(F.regexp_extract_all(low, F.lit(r"\bpft\s*#?\s*(\d+)"), F.lit(1)), lambda x: F.concat(F.lit("pft"), x)),
        "mechanism": F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), F.lit(m)) for w, m in keywords.items()))),
    }
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("entity"))
    found = F.flatten(F.array(*(F.transform(F.array_distinct(c), named(kind)) for kind, c in kinds.items())))
    return queries.select(id_col, F.inline(found))


def context(sections: DataFrame, id_col: str, order: list[str], per_section: int, max_chars: int) -> DataFrame:
    """(id, context): the first entries (id, section, text) of each section below its heading, cut to max_chars."""
    w = Window.partitionBy(id_col, "section").orderBy(*order)
    kept = sections.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_section)
    text = kept.groupBy(id_col, "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "text"))), lambda s: s["text"]), "\n").alias("_t"))
    whole = text.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "_t"))), lambda s: F.concat(F.lit("## "), s["section"], F.lit("\n"), s["_t"])), "\n\n").alias("_c"))
    return whole.select(id_col, F.substring("_c", 1, max_chars).alias("context"))


def first_seen(hits: DataFrame, by: str, order: list[str]) -> DataFrame:
    """One hit for each value of ``by``: the first in the given order."""
    return hits.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_k = 1").drop("_k")
