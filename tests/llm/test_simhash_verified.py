"""SimHash links that the texts' shingles decide: against all pairs, in hot groups, and by rows."""

import random

import pytest
from brute import simhash as brute

from ensolith.llm import simhash

R = random.Random(11)
WORDS = [f"w{i}" for i in range(3000)]


def near(words, edits):
    w = list(words)
    for _ in range(edits):
        w[R.randrange(len(w))] = R.choice(WORDS)
    return " ".join(w)


def corpus():
    texts = []
    for n in (20, 60, 150, 400):
        for _ in range(6):
            base = [R.choice(WORDS) for _ in range(n)]
            texts += [near(base, R.randint(0, max(1, n // 40))) for _ in range(6)]
    texts += [" ".join(R.choice(WORDS) for _ in range(R.randint(1, 200))) for _ in range(60)]
    texts += ["", None, " \n", "a", "a", "A", "one two three", " ".join(WORDS * 12)]
    R.shuffle(texts)
    return list(enumerate(texts))


def test_verified_links_match_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows, 5, 12, 0.8)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 40


@pytest.mark.parametrize("group_rows, agree", [(8, 2), (50, 3), (1 << 17, 2)])
def test_candidates_are_all_pairs_within_the_distance(spark, group_rows, agree):
    base = [R.getrandbits(64) for _ in range(3)]
    prints = [b ^ sum(1 << R.randrange(64) for _ in range(R.randint(0, 8))) & (2**64 - 1) for b in base for _ in range(60)]
    rows = [(k, simhash._signed(p), R.randint(5, 12), k if R.random() < 0.5 else 1000 + k % 3) for k, p in enumerate(prints)]
    nodes = spark.createDataFrame([(*r[:3], 0, 0, r[3]) for r in rows], "node long, fp long, n long, odd long, odd2 long, component long")
    got = {tuple(r) for r in simhash.candidates(nodes, 8, 0.8, agree, group_rows).collect()}
    want = {(i, j) for i, _, n, c in rows for j, _, m, d in rows if i < j and c != d and min(n, m) >= 0.8 * max(n, m) and (prints[i] ^ prints[j]).bit_count() <= 8}
    assert got == want


def test_one_row_of_each_group_stays_and_ids_may_repeat(spark):
    base = [R.choice(WORDS) for _ in range(200)]
    w, u = " ".join(base), " ".join(R.choice(WORDS) for _ in range(80))
    z = " ".join(R.choice(WORDS) for _ in range(50))
    rows = [(3, w, "x"), (5, near(base, 1), "x"), (5, u, "y"), (7, z, "x"), (7, z, "y"), (None, z, "x"), (None, "without id", "x"), (9, None, "x"), (2, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted([(3, w), (5, u), (7, z), (0, "without id"), (2, "")])
    assert simhash.drop_near_duplicates(docs).columns == docs.columns
    assert simhash.drop_near_duplicates(docs.where("false")).count() == 0
    assert simhash.near_duplicates(docs.where("false")).count() == 0
