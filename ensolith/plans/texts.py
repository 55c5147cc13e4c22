"""Queries of names, rules, answers and differences of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ensolith.functions import answers, rules
from ensolith.operators import checks as K
from ensolith.operators import diffs as D
from ensolith.operators import names as N
from ensolith.plans.registry import query, table
from ensolith.plans.studies import _names


def name_tables(spark, d):
    """The names of segments and nations that one side lacks and the other side's own."""
    return _names(spark, d)


@query()
def j9_block_renames(spark, d):
    """Names that are each other's best match by matching blocks (rows only: the tests hold it against the standard library's ratio)."""
    return N.renames(*name_tables(spark, d), 0.7)


@query()
def t15_block_suggestions(spark, d):
    """The closest known names of each missing one by matching blocks (rows only: the tests hold it against the standard library)."""
    return N.suggestions(*name_tables(spark, d), 2, 0.6)


@query("SELECT doc_id, coalesce(n_chars >= 200 AND quality > 0.5, false) AS viable FROM documents LEFT JOIN labels USING (doc_id)")
def p13_text_rules(spark, d):
    """Rules given as text, all of which must hold."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", rules.all_hold(rules.parsed(["n_chars >= 200", "quality>.5"], ["n_chars", "quality"])).alias("viable"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f10_extracted_answers(spark, d):
    """JSON found in prose and fences, cut off, with stray quotes, breaks and commas."""
    props, kind = F.col("props"), F.col("event_id") % 5
    open_ = F.expr("substring(props, 1, length(props) - 1)")
    text = (
        F.when(kind == 0, F.concat(F.lit("Here it is:\n```json\n"), props, F.lit("\n```\nDone {or not}.")))
        .when(kind == 1, F.concat(F.lit("I found "), open_, F.lit(', "why": "the "best" one\n of all"} in the end')))
        .when(kind == 2, F.concat(open_, F.lit(", }")))
        .when(kind == 3, F.concat(open_, F.lit(', "list": [1, 2, {"a": "unfin')))
        .otherwise(F.concat(open_, F.lit(', "late":')))
    )
    found = table(spark, d, "events").select("event_id", answers.extract_json(text).alias("j"))
    return found.select("event_id", F.from_json("j", "k long")["k"].alias("k"))


def text_versions(spark, d):
    """Documents and the same with some words' lines changed, some lines gone and one added."""
    text = F.coalesce("text", F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.when(i % 7 == 3, F.concat(x, F.lit(" (changed)"))).otherwise(x))
    kept = F.filter(lines, lambda x, i: i % 11 != 5)
    return table(spark, d, "documents").select("doc_id", text.alias("old"), F.concat(F.array_join(kept, "\n"), F.lit("\nlast")).alias("new"))


@query()
def b5_line_hunks(spark, d):
    """The differences of two versions of each text, and how they move a cited range (rows only: the tests apply the hunks)."""
    found = D.line_hunks(text_versions(spark, d), "doc_id").select(F.col("doc_id").alias("path"), "start", "n_old", "n_new")
    cited = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit(8).alias("a"), F.lit(9).alias("b"))
    return K.shifted_ranges(cited, found)
