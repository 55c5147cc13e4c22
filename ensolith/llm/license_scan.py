"""License scans by an exact set-similarity join of word windows with license templates.

A block is any run of consecutive words of a document that is twice as long as the template,
whatever lines it goes over. A template matches a block that holds at least its threshold of
its distinct words (containment): long texts 0.8, short notices all of them, for a few common
words more or less would make another notice of them. Words are ordered by their frequency
over all documents, the rarest first; a block that meets the threshold must hold a word of the
template's prefix, the |T| - ceil(t |T|) + 1 rarest. Documents join the templates on the prefix
words they hold; the length filter drops pairs of too few template words in the whole
document, the positional filter those whose words left after the first one shared cannot make
up the rest. What is left is decided in the windows around the prefix words.

Only DataFrame functions run. Texts are read twice, for the words' frequencies and for all else.
Templates and phrases are parameters of a few rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ensolith.llm.blocks import cut

# Phrases whose consecutive words give the base labels, and public license texts as lower-cased words.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = [
    ("mit-notice", "released under the mit license"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0"),
    ("gpl-3.0-notice", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc-4.0-notice", "licensed under cc by nc 4 0"),
]
TEXTS = [
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("bsd-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "apache-2.0-text",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl-3.0-text",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details "
        "you should have received a copy of the gnu general public license along with this program",
    ),
]
TEMPLATES = [*((label, text, 1.0) for label, text in NOTICES), *((label, text, 0.8) for label, text in TEXTS)]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HITS = "array<struct<w:string,at:int>>"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), NOT_WORD), lambda w: w != "")


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _once(c: Column, f) -> Column:
    """f(c), with c computed once however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def template_order(docs: DataFrame, templates: list[tuple] = TEMPLATES, text_col: str = "text") -> list[str]:
    """The templates' distinct words, rarest first by the number of documents that hold them."""
    words = sorted({w for _, t, _ in templates for w in t.split()})
    held = docs.select(F.explode(F.array_intersect(_words(F.col(text_col)), _strings(words))).alias("w"))
    count = dict(held.groupBy("w").count().collect())  # a row for each template word at most
    return sorted(words, key=lambda w: (count.get(w, 0), w))


def _template_table(spark, templates: list[tuple], order: list[str]) -> DataFrame:
    """A row for each prefix word of each template: (w, label, template and prefix in global order, need, span)."""
    place = {w: i for i, w in enumerate(order)}
    rows = []
    for label, t, threshold in templates:
        own = sorted(set(t.split()), key=place.get)
        need = math.ceil(threshold * len(own) - 1e-9)
        prefix = own[: len(own) - need + 1]
        rows += [(w, label, own, prefix, need, 2 * len(t.split())) for w in prefix]
    return spark.createDataFrame(rows, "w string, label string, template array<string>, prefix array<string>, need int, span int")


def matches(held: DataFrame, templates: list[tuple], order: list[str]) -> DataFrame:
    """(row, label, containment) of documents (row, hits: their template words with places from 0) and templates that match."""
    table = _template_table(held.sparkSession, templates, order)
    prefixes = sorted({r["w"] for r in table.select("w").collect()})
    own = F.array_intersect(_strings(order), F.col("hits.w"))
    probes = held.select("row", "hits", own.alias("own")).select("row", "hits", "own", F.explode(F.array_intersect("own", _strings(prefixes))).alias("w"))
    pairs = probes.join(F.broadcast(table), "w")  # the templates' prefixes
    shared = F.array_intersect("template", "own")
    pairs = pairs.where((F.col("w") == F.get(shared, F.lit(0))) & (F.size(shared) >= F.col("need")))  # each pair once; length
    p, q = F.array_position("own", F.col("w")), F.array_position("template", F.col("w"))
    pairs = pairs.where(1 + F.least(F.size("own") - p, F.size("template") - q) >= F.col("need"))
    span = F.col("span")
    inside = F.filter("hits", lambda h: F.array_contains("template", h["w"]))

    def best(near: Column, at: Column) -> Column:
        """Most distinct words in a window that starts at a template word and covers the place."""
        count = lambda h: F.size(F.array_distinct(F.transform(F.filter(near, lambda g: (g["at"] >= h["at"]) & (g["at"] < h["at"] + span)), lambda g: g["w"])))
        return F.array_max(F.transform(F.filter(near, lambda h: h["at"] <= at), count))

    rare = lambda h: F.array_contains("prefix", h["w"])
    around = lambda all_: F.transform(F.filter(all_, rare), lambda o: _once(F.filter(all_, lambda h: (h["at"] > o["at"] - span) & (h["at"] < o["at"] + span)), lambda near: best(near, o["at"])))
    pairs = pairs.withColumn("most", F.array_max(_once(inside, around)))
    return pairs.where(F.col("most") >= F.col("need")).select("row", "label", (F.col("most") / F.size("template")).alias("containment"))


def _phrase_starts(words: Column, phrase: str) -> Column:
    p = phrase.split()
    last = F.size(words) - len(p)
    all_ = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    fits = lambda i: F.coalesce(sum((F.when(F.get(words, i + k) == w, 1).otherwise(0) for k, w in enumerate(p[1:], 1)), F.when(F.get(words, i) == p[0], 1).otherwise(0)) == len(p), F.lit(False))
    return F.when((last >= 0) & F.array_contains(words, p[-1]), F.filter(all_, fits)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, templates: list[tuple] = TEMPLATES, phrases: dict = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    n_base counts the places where a phrase's words stand consecutively, first_word and last_word
    are the smallest and largest (null without any). labels adds those of matching templates
    (label, text, threshold); both lists are distinct, sorted and joined by commas, empty where
    there is none. score is the best containment of a match, 1 if a phrase stands in the text,
    else 0. Null and empty texts have no words; very long ones are read whole. Repeated rows are
    kept and get the same result; a null id is kept. Other columns are ignored; an empty table
    gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = template_order(own, templates)
    need = {label: math.ceil(t * len(set(words.split())) - 1e-9) for label, words, t in templates}
    place = {w: i for i, w in enumerate(order)}
    prefixes = sorted({w for label, words, _ in templates for w in sorted(set(words.split()), key=place.get)[: len(set(words.split())) - need[label] + 1]})

    def marks(w: Column) -> Column:
        at = F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("at")))
        hits = F.when(F.arrays_overlap(w, _strings(prefixes)), F.filter(at, lambda h: h["w"].isin(order))).otherwise(F.array().cast(_HITS))
        return F.struct(F.size(w).cast("long").alias("n"), *(_phrase_starts(w, p).alias(f"p{i}") for i, p in enumerate(phrases)), hits.alias("hits"))

    marked = cut(own.select(F.monotonically_increasing_id().alias("row"), "id", _once(_words(F.col("text")), marks).alias("m")).select("row", "id", "m.*"))
    at = F.concat(*(f"p{i}" for i in range(len(phrases))))
    named = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values()))))
    base = marked.select("row", "id", F.col("n").alias("n_words"), F.size(at).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"), F.array_sort(F.array_distinct(named)).alias("base"))
    found = matches(marked.where(F.size("hits") > 0).select("row", "hits"), templates, order).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    more = F.coalesce("more", F.array().cast("array<string>"))
    return base.join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle(templates: list[tuple] = TEMPLATES) -> str:
    """The same by plain comparison of the windows at every template word, for DuckDB."""
    lower = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    values = ", ".join(f"('{label}', list_distinct(string_split('{t}', ' ')), {math.ceil(threshold * len(set(t.split())) - 1e-9)}, {len(set(t.split()))}, {2 * len(t.split())})" for label, t, threshold in templates)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {lower} AS t FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(t, {word}) AS w FROM d),
p AS (SELECT r, w, unnest(range(len(w))) AS i FROM w WHERE list_contains(w, 'license')),
b AS (SELECT r, i, CASE WHEN w[i + 1] = 'mit' AND w[i + 2] = 'license' THEN 'mit' WHEN w[i + 1] = 'apache' AND w[i + 2] = 'license' THEN 'apache'
        WHEN w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license' THEN 'gpl' END AS label FROM p),
base AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS z, list(DISTINCT label) AS labels FROM b WHERE label IS NOT NULL GROUP BY r),
v(label, tw, need, size, span) AS (VALUES {values}),
c AS (SELECT r, w, label, tw, need, size, span FROM (SELECT r, w, list_distinct(w) AS own FROM w), v WHERE len(list_intersect(own, tw)) >= need),
u AS (SELECT r, label, tw, need, size, span, unnest(w) AS x, unnest(range(len(w))) AS i FROM c),
h AS (SELECT * FROM u WHERE list_contains(tw, x)),
f AS (SELECT a.r, a.label, a.i, any_value(a.need) AS need, count(DISTINCT b.x) / any_value(a.size) AS held, count(DISTINCT b.x) AS n FROM h a JOIN h b ON a.r = b.r AND a.label = b.label AND b.i BETWEEN a.i AND a.i + a.span - 1 GROUP BY a.r, a.label, a.i),
m AS (SELECT r, list(DISTINCT label) AS labels, max(held) AS best FROM f WHERE n >= need GROUP BY r)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(m.labels, [])))), ',') AS labels,
  CAST(CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN m USING (r)"""
