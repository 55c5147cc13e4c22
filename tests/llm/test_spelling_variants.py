"""Spelling variants against a plain version that compares all words with all."""

import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ensolith.llm import queries
from ensolith.llm import spelling_variants as V

R = random.Random(6)


def counted(rows, every=97, least=3):
    n = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] = n.get(run, 0) + 1
    return {w: c for w, c in n.items() if c >= least}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(n):
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and is_near(a, b):
            near[a].append(b)
            near[b].append(a)
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: x for w, x in best.items() if n[x] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op13_spelling_variants(spark, sf_dir)) == brute(counted(rows))


@pytest.mark.parametrize("hot", [2, 4096])
def test_dense_words_of_few_letters(spark, hot):
    words = {"".join(R.choice("abÿ") for _ in range(R.randint(5, 8))) for _ in range(500)} | {"aaaaa", "aaaaaa", "aaaaaaa", "ababa", "babab", "ababab"}
    n = {w: R.randint(3, 60) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    pairs = [(r["a"], r["b"]) for r in V.near_pairs(df, hot).collect()]
    assert len(pairs) == len(set(pairs))
    assert {frozenset(p) for p in pairs} == {frozenset(p) for p in itertools.combinations(n, 2) if is_near(*p)}


def test_nulls_long_texts_repeated_rows_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(V, "PART_LETTERS", 100)
    base = ["stone", "stones", "storm", "stöne", "house", "mouse", "HOUSE", "Ünder", "ünder", "Àbcde"]
    long = " ".join(R.choice(base) for _ in range(20_000))
    rows = [(1, long), (2, None), (3, ""), (4, "x" * 3000 + " " + "y" * 3000), (4, "x" * 3000), (5, "x" * 3000 + "1" + "x" * 3001), (6, "x" * 3001), (6, "x" * 3001), (None, "stone stone"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("*", F.lit(1).alias("word"), F.lit("x").alias("n"), F.lit(2).alias("form"))
    assert rows_of(V.group_variants(docs, every=5)) == brute(counted(rows, 5))
    assert rows_of(V.group_variants(docs.where("false"))) == []
    assert rows_of(V.group_variants(docs.where("doc_id = 3"))) == []
    with pytest.raises(ValueError):
        V.group_variants(docs, times=1)


def test_forms_lead_on_to_the_last(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(13)] + [("x", "w0"), ("y", "z")]
    got = dict(tuple(r) for r in V.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {**{w: "w13" for w, _ in chain}, "y": "z"}


def test_words_handed_on_early_count_the_same(spark, monkeypatch):
    rows = [(k, " ".join(f"word{chr(97 + R.randrange(26))}{chr(97 + R.randrange(26))}" for _ in range(50))) for k in range(30)]
    monkeypatch.setattr(V, "MAX_COUNTED", 10)
    got = {r["word"]: r["n"] for r in V.count_words(spark.createDataFrame(rows, "doc_id long, text string"), 97, 1).collect()}
    assert got == counted(rows, 97, 1)
