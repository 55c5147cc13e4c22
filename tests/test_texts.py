"""Names, rules, answers and differences against plain versions."""

import json
import random
from difflib import SequenceMatcher, get_close_matches

import pytest
from pyspark.sql import functions as F

from ensolith.functions import answers, rules
from ensolith.operators import diffs as D
from ensolith.operators import names as N
from ensolith.plans import texts

R = random.Random(2)


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def best(name, others, flip=False):
    return min(((-ratio(name, c), c) for c in others), default=(0, None))


def brute_renames(left, right, cutoff):
    out = set()
    for a in left:
        r, b = best(a, right)
        if b is not None and -r >= cutoff:
            back, partner = best(b, left)
            if partner == a and -back >= cutoff:
                out.add((a, b, -r))
    return out


def test_pairs_equal_the_standard_ratio(spark):
    word = lambda: "".join(R.choice("aabbcdeé_1") for _ in range(R.randint(1, 12)))
    left, right = {word() for _ in range(90)}, {word() for _ in range(90)}
    df = lambda names: spark.createDataFrame([(x,) for x in names] + [(None,), ("",)], "name string").repartition(3)
    for cutoff in (0.55, 0.8, 1.0):
        got = {(r["a"], r["b"]): (r["ratio"], r["back"]) for r in N.similar_names(df(left), df(right), cutoff).collect()}
        assert got == {(a, b): (ratio(a, b), ratio(b, a)) for a in left for b in right if max(ratio(a, b), ratio(b, a)) >= cutoff}
    assert {tuple(r) for r in N.renames(df(left), df(right), 0.6).collect()} == brute_renames(left, right, 0.6)
    found = {}
    for r in N.suggestions(df(left), df(right), 3, 0.5).orderBy("a", "rank").collect():
        found.setdefault(r["a"], []).append(r["b"])
    assert found == {a: m for a in left if (m := get_close_matches(a, sorted(right), 3, 0.5))}
    with pytest.raises(ValueError):
        N.similar_names(df(left), df(right), 0.0)


def test_name_queries_against_the_standard_library(spark, sf_dir):
    left, right = ({r["name"] for r in t.collect()} for t in texts.name_tables(spark, sf_dir))
    assert {tuple(r) for r in texts.j9_block_renames(spark, sf_dir).collect()} == brute_renames(left, right, 0.7)
    found = {}
    for r in texts.t15_block_suggestions(spark, sf_dir).orderBy("a", "rank").collect():
        found.setdefault(r["a"], []).append(r["b"])
    assert found == {a: m for a in left if (m := get_close_matches(a, sorted(right), 2, 0.6))}


def test_rules_hold_or_are_refused(spark):
    df = spark.createDataFrame([(2.0, 1.0), (1.0, 1.0), (None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (3.0, -1.0)], "NPP double, x double")
    held = lambda *t: [r["h"] for r in df.select(rules.all_hold(rules.parsed(list(t), ["NPP", "x"])).alias("h")).collect()]
    assert held("NPP>1.0") == [True, False, False, False, False, True]
    assert held(" NPP >= 1 ", "x>-.5e0") == [True, True, False, False, False, False]
    assert held("NPP<=1") == [False, True, False, False, False, False]
    for bad in ("", "NPP", "NPP > ", "> 1", "NPP > 1; drop table x", "NPP > 1 or 1 = 1", "NPP == 1", "NPP > x", "__import__('os')>1", "NPP > nan", "NPP > 1e999", "y > 1", "NPP > 1 > 0", "NPP>1)", "`NPP`>1"):
        with pytest.raises(ValueError):
            rules.parsed(["x > 0", bad], ["NPP", "x"])
    with pytest.raises(ValueError):
        rules.all_hold([])


def test_flags_of_a_mode(spark):
    df = spark.createDataFrame([(1, {"applies_universal": True}), (2, {"applies_in_mode_sp": True, "applies_in_fire_false": True}), (3, {"applies_in_mode_sp": True}), (4, None), (5, {"applies_in_mode_sp": True, "applies_in_fire_true": True})], "id int, flags map<string,boolean>")
    assert [r["id"] for r in df.where(rules.applicable(F.col("flags"), {"mode": "sp", "fire": False})).orderBy("id").collect()] == [1, 2]


@pytest.mark.parametrize(("text", "want"), [
    ('{"a": 1}', {"a": 1}), ("[1, 2]", [1, 2]), ('Sure: {"a": {"b": [1, "}"]}} and so on', {"a": {"b": [1, "}"]}}),
    ('```json\n{"a": 1}\n```', {"a": 1}), ('```\n{"a": 1}\n```', {"a": 1}), ('{"a": "x\ny\tz"}', {"a": "x\ny\tz"}),
    ('{"a": 1,}', {"a": 1}), ('{"a": [1, 2, ], }', {"a": [1, 2]}), ('{"a": "say "hi" now"}', {"a": 'say "hi" now'}),
    ('{"a": "one "two", three", "b": 2}', {"a": 'one "two", three', "b": 2}), ('{"a": 1, "b": "cut o', {"a": 1, "b": "cut o"}), ('{"a": 1, "b":', {"a": 1}),
    ('{"a": 1, "b', {"a": 1}), ('{"a": [1, 2, {"c": 3', {"a": [1, 2, {"c": 3}]}), ('{"a": 1, "b": tr', {"a": 1}), ('{"a": "b\\"c"}', {"a": 'b"c'}), ('{"a": "é\\', {"a": "é"}),
    ("no answer", None), ("", None), (None, None), ("{a: 1}", None), ('{"a": 1]', None), ("{", {}), ("[", []),
])
def test_answers_are_mended(text, want):
    got = answers.extracted(text)
    assert (None if got is None else json.loads(got)) == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def test_hunks_are_shortest_and_apply():
    for _ in range(400):
        old = [R.choice("abcd") for _ in range(R.randint(0, 14))]
        new = [x for x in old if R.random() < 0.7] if R.random() < 0.5 else [R.choice("abcd") for _ in range(R.randint(0, 14))]
        for _ in range(R.randint(0, 3)):
            new.insert(R.randint(0, len(new)), R.choice("abcde"))
        found = D.hunks(old, new)
        assert D.applied(old, found) == new
        assert sum(h["n_old"] + h["n_new"] for h in found) == distance(old, new)
        assert all(h["n_old"] or h["n_new"] for h in found)


def test_hunks_of_documents_give_the_new_text(spark, sf_dir):
    versions = {r["doc_id"]: (r["old"], r["new"]) for r in texts.text_versions(spark, sf_dir).collect()}
    found = {}
    for r in D.line_hunks(texts.text_versions(spark, sf_dir), "doc_id").orderBy("doc_id", "start").collect():
        found.setdefault(r["doc_id"], []).append(r.asDict())
    for i, (old, new) in versions.items():
        assert D.applied(old.split("\n") if old else [], found.get(i, [])) == new.split("\n")
    assert texts.b5_line_hunks(spark, sf_dir).count() > 0
