"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, operator by operator."""

import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from ensolith.llm import bpe, chat_format, decontamination, embedding_dedup, license_scan, lm_scoring, queries, simhash, substring_dedup, suffix_dedup, toxicity
from ensolith.llm.components import components

R = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(R.choice(WORDS) for _ in range(60_000))
PASSAGE = " ".join(R.choice(WORDS) for _ in range(80))
TEXTS = [
    (1, "plain text of five words"), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, LONG), (7, f"before {PASSAGE} after"), (8, f"{PASSAGE}"), (9, f"x {PASSAGE} y {PASSAGE} z"),
    (10, "Ünïcode ΣΑΣ no break é ﬁ"), (10, "Ünïcode ΣΑΣ no break é ﬁ"), (11, "a"), (12, "a"), (None, "a row without id"), (None, None), (13, "the MIT License, the mit license"), (14, "aaaa " * 200),
]
CLASHING = "score double, predicted int, n_words long, n_hit long, fp long, key long, h string, grp int, id long, label string, component long, node long, text2 string, token_ids string, decoded int, _text string, _h int, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    return with_clashes(spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3))


@pytest.fixture(scope="module")
def none(spark):
    return with_clashes(spark.createDataFrame([], "doc_id long, text string"))


def with_clashes(df):
    return df.select("*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASHING.split(", ")))


@pytest.fixture(scope="module")
def labels(spark):
    return with_clashes(spark.createDataFrame([(1, 0, 1), (5, 0, 0), (7, 1, None), (None, 1, 1), (99, 1, 1), (8, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int"))


@pytest.fixture(scope="module")
def benchmark(spark):
    return with_clashes(spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (4, "Plain, TEXT"), (None, "five words"), (5, "not anywhere in there at all")], "item_id long, text string"))


def ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)


ALL_IDS = sorted((i is None, i or 0) for i, _ in TEXTS)


def test_toxicity(docs, none, labels):
    got = toxicity.digest(docs, labels).collect()
    assert ids(got) == ALL_IDS
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.digest(none, labels).count() == 0
    assert {r["score"] for r in toxicity.digest(docs, labels.where("false")).collect()} == {0.0}


def test_block_max_search_is_exact_with_ties():
    import numpy as np

    arrays = lambda v: (np.array(sorted(v), np.int64), np.array([v[t] for t in sorted(v)]))
    vectors = [{R.randrange(30): float(R.randint(1, 4)) for _ in range(R.randint(0, 6))} for _ in range(700)]
    index = toxicity.BlockMaxIndex([arrays(v) for v in vectors], 30)
    for _ in range(40):
        q = {R.randrange(30): float(R.randint(1, 4)) for _ in range(4)}
        every = sorted(((round(sum(w * v.get(t, 0.0) for t, w in q.items()), 12), e) for e, v in enumerate(vectors)), key=lambda x: (-x[0], x[1]))
        assert index.nearest(*arrays(q), 15) == [x for x in every if x[0] > 0][:15]
        assert index.nearest(*arrays(q), 15, without=every[0][1]) == [x for x in every[1:] if x[0] > 0][:15]


def test_toxicity_against_dense_cosine(spark):
    words = [f"u{i}" for i in range(120)]
    rows = [(i, " ".join(R.choice(words[:60] if i % 3 else words[30:]) for _ in range(R.randint(0, 40)))) for i in range(150)]
    labelled = [(i, int(i % 3 == 0)) for i in range(0, 150, 2)]
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labelled, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_texts(d, toxicity.fit(d, y)).collect()}
    want = brute.toxicity(rows, labelled)
    for i, (score, near) in want.items():
        assert got[i]["score"] == pytest.approx(score, abs=1e-9) and got[i]["neighbours"] == near


def test_lm_scoring(docs, none, spark):
    got = lm_scoring.score_texts(docs).collect()
    assert ids(got) == ALL_IDS
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    once = [(i, t) for i, t in dict(TEXTS).items() if i is not None]
    want = brute.language_model(once)
    for r in lm_scoring.score_texts(spark.createDataFrame(once, "doc_id long, text string")).collect():
        assert tuple(r)[1:] == pytest.approx(want[r["doc_id"]], rel=1e-9)
    assert lm_scoring.score_texts(none).count() == 0


def test_lm_scoring_with_states_of_rare_pairs(spark):
    rows = [(i, " ".join(R.choice(WORDS[:12]) for _ in range(R.randint(0, 40)))) for i in range(60)]
    got = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute.language_model(rows)
    assert all(tuple(r)[1:] == pytest.approx(want[r["doc_id"]], rel=1e-9) for r in got) and len(got) == 60


def test_license_scan(docs, none):
    got = license_scan.scan(docs).collect()
    assert ids(got) == ALL_IDS
    by = {r["doc_id"]: r for r in got}
    assert tuple(by[13])[1:7] == (6, 2, 1, 4, "mit", "mit") and by[13]["score"] == 1.0
    assert tuple(by[2])[1:] == tuple(by[3])[1:] == (0, 0, None, None, "", "", 0.0)
    assert license_scan.scan(none).count() == 0


def test_license_templates_by_containment(spark):
    texts = [
        "x\nReleased under the MIT-license terms", "license mit the under released", "released under the gpl license", "Licensed under the gnu license version 2.0",
        "released under " + "z " * 10 + "the mit license", " ".join(w for i, w in enumerate(license_scan.TEXTS[0][1].split()) if i not in (3, 7)),
        "the the the a a of of to in " * 3000 + "permission hereby granted", *(t for _, t in license_scan.TEXTS),
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(d).collect()}
    assert [got[k] for k in range(5)] == [("mit,mit-notice", 1.0), ("mit-notice", 1.0), ("", 0.0), ("", 0.0), ("mit", 1.0)]
    assert got[5][0] == "mit-grant" and 0.8 <= got[5][1] < 1 and got[6] == ("", 0.0)
    for k, (label, _) in enumerate(license_scan.TEXTS):
        assert label in got[7 + k][0].split(",") and got[7 + k][1] == 1.0


def test_preference_format(spark):
    rows = [(0, 0, "user", "hi"), (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, None, None), (3, 0, None, None), (4, None, "user", "x"), (None, 0, "user", "lost"), (6, 0, "user", "q"), (7, 0, "user", "q"), (7, 1, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("n_common"), F.lit("").alias("turns"), F.lit(2).alias("pair_id"))
    got = {r["pair_id"]: r for r in chat_format.format_pairs(chat_format.neighbours_as_pairs(turns)).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert (got[0]["n_common"], got[0]["prompt"], got[0]["status"]) == (1, "<|user|>\nhi<|end|>\n", "paired")
    a, b = map(int, got[0]["chosen_spans"].split("-"))
    assert got[0]["chosen"][a:b] == "yes"
    assert got[1]["status"] == "identical" and got[1]["chosen"] == got[1]["rejected"] == ""
    assert got[2]["status"] == "unpaired" and got[2]["rejected"] is None
    assert (got[3]["chosen"], got[3]["n_common"], got[3]["status"]) == ("", 1, "paired")
    assert chat_format.format_pairs(chat_format.neighbours_as_pairs(turns.where("false"))).count() == 0


def test_preference_format_of_null_and_very_long_turns(spark):
    schema = "pair_id long, chosen array<struct<turn:bigint,role:string,text:string>>, rejected array<struct<turn:bigint,role:string,text:string>>"
    rows = [(1, [(0, None, "a"), (1, "assistant", None)], [(0, None, "a"), (1, "assistant", "x")]), (2, [(0, "user", LONG), (1, "assistant", "y")], [(0, "user", LONG), (1, "assistant", LONG)])]
    got = {r["pair_id"]: r for r in chat_format.format_pairs(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1]["n_common"], got[1]["prompt"], got[1]["chosen"]) == (1, "<||>\na<|end|>\n", "<|assistant|>\n<|end|>\n")
    assert got[2]["n_common"] == 1 and got[2]["prompt"] == f"<|user|>\n{LONG}<|end|>\n" and LONG in got[2]["rejected"]


def test_decontamination(docs, none, benchmark, spark):
    got = decontamination.digest(docs, benchmark).collect()
    assert ids(got) == ALL_IDS
    items = [(1, PASSAGE), (4, "Plain, TEXT"), (5, "not anywhere in there at all")]
    want = dict(zip([i for i, _ in TEXTS], brute.contamination([t for _, t in TEXTS], [*items, ("", "five words")])))
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 1:
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == want[r["doc_id"]]
    one = next(r for r in got if r["doc_id"] == 1)
    assert (one["n_hit"], one["n_items"]) == (4, 1)  # the item without an id hits but is not listed
    assert decontamination.digest(none, benchmark).count() == 0
    assert not any(r["contaminated"] for r in decontamination.digest(docs, benchmark.where("false")).collect())


def test_decontamination_in_benchmark_blocks(docs, benchmark):
    whole = decontamination.find_contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "item_ids").collect()
    parts = decontamination.find_contamination(docs, benchmark, block_bytes=200).select("doc_id", "n_words", "n_hit", "item_ids").collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, parts))


def test_substring_dedup(docs, none):
    got = substring_dedup.digest(docs).collect()
    assert ids(got) == ALL_IDS
    want = sorted(brute.substring([t for _, t in TEXTS]))
    assert sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert substring_dedup.digest(none).count() == 0
    again = substring_dedup.rewrite(docs)
    assert again.columns == docs.columns and again.count() == len(TEXTS)


@pytest.mark.parametrize("width", [1, 2, 5])
def test_substring_dedup_of_dense_repeats(spark, width):
    texts = [" ".join(R.choice("ab c d e".split()) for _ in range(R.randint(0, 25))) for _ in range(40)]
    got = substring_dedup.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == brute.substring(texts, width)


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    got = bpe.encode(docs, queries.tokenizer_path()).collect()
    assert ids(got) == ALL_IDS
    for r in got:
        if r["text"] is None:
            assert r["token_ids"] is None and r["decoded"] is None
        else:
            want = t.encode(r["text"], add_special_tokens=False).ids
            assert r["token_ids"] == want and r["decoded"] == t.decode(want, skip_special_tokens=False)
    assert bpe.encode(none, queries.tokenizer_path()).count() == 0
    assert bpe.digest(docs, queries.tokenizer_path()).where("n_tokens is null").count() == 0


def test_bpe_of_odd_characters():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    e = bpe.WordEncoder(bpe.tokenizer_spec(queries.tokenizer_path()))
    texts = ["".join(R.choice(["a", "B", "'s", "'ll", "1", "!", "_", " ", "\u0085", "\x1c", " ", "　", "İ", "ß", "Σ", "é", "é", "漢", "😀", "‍", "<|endoftext|>", "<|startoftext|>", "<|", "﻿"]) for _ in range(R.randint(0, 30))) for _ in range(3000)]
    import numpy as np

    for x, got, want in zip(texts, e.encode(texts), t.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, "<i4").tolist() == want.ids, repr(x)


def test_embedding_dedup(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (10, [2.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [], 1), (14, [-1.0, 0.0], 1), (15, [1e-30, 0.0], 2)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *(F.lit(None).cast("long").alias(c) for c in ("id", "vec", "cell", "node", "key", "copies")))
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_vectors(v).collect()}
    assert got == brute.embedding(rows)
    assert got[1] == (3, 1, True) and got[15][1] == 3
    assert embedding_dedup.near_vectors(v.where("false")).count() == 0
    copies = embedding_dedup.near_vectors(v.where("vec_id = 1").unionByName(v.where("vec_id = 1"))).collect()
    assert [tuple(r) for r in copies] == [(1, 1, 1, True)] * 2


@pytest.mark.parametrize("cell_rows", [8, 64])
def test_embedding_dedup_over_many_cells(spark, cell_rows):
    import numpy as np

    g = np.random.default_rng(3)
    centres = g.normal(size=(20, 6))
    rows = [(int(i), (centres[g.integers(20)] + g.normal(size=6) * 0.12).tolist(), int(g.integers(3) > 0)) for i in g.permutation(500)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_vectors(v, cell_rows=cell_rows).collect()}
    assert got == brute.embedding(rows)


def test_suffix_dedup(docs, none):
    got = suffix_dedup.digest(docs).collect()
    assert ids(got) == ALL_IDS
    known = sorted((r for r in TEXTS if r[0] is not None), key=lambda r: r[0])
    want = brute.suffix([t for _, t in known])
    mine = sorted(((r["doc_id"], r["n_removed"], r["n_bytes"], r["n_spans"], r["kept_sha256"]) for r in got if r["doc_id"] is not None))
    assert [(b, a, c, d) for _, a, b, c, d in mine] == want
    assert suffix_dedup.digest(none).count() == 0


@pytest.mark.parametrize("length", [3, 9])
def test_suffix_dedup_of_dense_repeats(spark, length):
    texts = ["".join(R.choice("abü") for _ in range(R.randint(0, 40))) for _ in range(40)]
    got = suffix_dedup.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == brute.suffix(texts, length)


@pytest.mark.parametrize("hot_runs", [0, 2, 4096])
def test_suffix_dedup_of_hot_strings_and_ties(spark, hot_runs):
    phrase = "".join(R.choice("abcdefgh ") for _ in range(90))
    texts = [f"{R.randint(0, 9)}{phrase}{R.choice('xyz')}{'q' * R.randint(0, 60)}" for _ in range(40)] + ["z" * 700, "z" * 650, "ab" * 300]
    rows = list(enumerate(texts))
    got = suffix_dedup.remove_later_copies(spark.createDataFrame(rows, "doc_id long, text string"), 40, hot_runs=hot_runs).collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in sorted(got, key=lambda r: r["doc_id"])] == brute.suffix(texts, 40)
    tied = [(1, phrase + "one"), (1, phrase + "two"), (None, phrase + "three"), (None, phrase + "four")] * 2
    outs = set()
    for n in ("2", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = suffix_dedup.remove_later_copies(spark.createDataFrame(tied, "doc_id long, text string").repartition(int(n)), 40, hot_runs=hot_runs).collect()
        outs.add(tuple(sorted((str(r["doc_id"]), r["kept"]) for r in got)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(outs) == 1


def test_suffix_dedup_of_a_text_cut_into_pieces(spark, monkeypatch):
    from ensolith.llm import blocks

    text = "".join(R.choice("abc") for _ in range(3000))
    texts = [text + text[500:900], text[1000:1200] + "x" + text[1100:1300]]
    bounds = [0, len(texts[0]) + 1, len(texts[0]) + len(texts[1]) + 2]
    import numpy as np

    block = blocks.Block(0, np.arange(2), np.ones(2, bool), np.ones(2, bool), np.array(bounds), np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8))
    whole = suffix_dedup.runs_of(block, 30, 10)
    monkeypatch.setattr(suffix_dedup, "_PIECE", 64)
    parts = suffix_dedup.runs_of(block, 30, 10)
    starts = lambda runs: {(int(d), p, int(k)) for d, a, z, k, _ in zip(*runs) for p in range(a, z + 1)}
    assert starts(whole) == starts(parts)


def test_longest_previous_factors():
    import numpy as np

    for _ in range(50):
        raw = [bytes(R.choice(b"ab\0") for _ in range(R.randint(1, 30))) for _ in range(R.randint(1, 6))]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(x) for x in raw])
        place = np.arange(len(buf))
        size = ends[np.searchsorted(ends, place, "right")] - place
        got = suffix_dedup.previous_factors(buf, place, size, place)
        body = bytes(buf)
        for i in place:
            best = 0
            for j in range(i):
                k = 0
                while k < min(size[i], size[j]) and body[i + k] == body[j + k]:
                    k += 1
                best = max(best, k)
            assert got[i] == best


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs, 3, 2, None).collect()
    assert ids(got) == ALL_IDS
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["fingerprint"] for i in (2, 3, 4)} == {"0" * 16} and {by[i]["component_id"] for i in (2, 3, 4)} == {2}
    assert by[6]["component_id"] == 5 and by[12]["component_id"] == 11
    known = dict(r for r in TEXTS if r[0] is not None)
    want = brute.simhash(list(known.items()))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in by.items() if i is not None} == want
    assert simhash.near_duplicates(none, 3, 2, None).count() == 0


@pytest.mark.parametrize("split_over", [1, 8, 4096])
def test_simhash_links_survive_the_splitting_of_groups(spark, split_over):
    base = [R.getrandbits(64) for _ in range(12)]
    prints = sorted({b ^ sum(1 << R.randrange(64) for _ in range(R.randint(0, 4))) & (2**64 - 1) for b in base for _ in range(25)})
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    edges = simhash.linked(df, 2, split_over)
    label = {p: p for p in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, p in enumerate(prints):
        for q in prints[i + 1 :]:
            if (p ^ q).bit_count() <= 2:
                label[root(q)] = root(p)
    want = {}
    for p in prints:
        want.setdefault(root(p), set()).add(p)
    got = {}
    for r in components(edges).collect():
        got.setdefault(r["component"], set()).add(r["node"] & (2**64 - 1))
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(300)] + [(5, 5), (1000, 1001), (1001, 1000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*path, (None, 3)], "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digests_are_of_the_kept_text(spark):
    r = substring_dedup.digest(spark.createDataFrame([(1, "b  a\n")], "doc_id long, text string")).first()
    assert r["kept_sha256"] == hashlib.sha256(b"b a").hexdigest()
