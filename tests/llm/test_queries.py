"""The registered queries against DuckDB, brute force, or the tokenizers library, over the whole small tables."""

import hashlib

import brute
import pytest

from ensolith.llm import queries, toxicity


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])


def test_toxicity_ranks_held_out_documents(spark, sf_dir):
    got = by_id(queries.op1_toxicity(spark, sf_dir))
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == toxicity.held_out(i) for i, r in got.items())
    out = [(r["score"], truth[i]) for i, r in got.items() if r["held_out"] and i in truth]
    pos, neg = [s for s, y in out if y], [s for s, y in out if not y]
    if pos and neg:
        assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) > 0.9


def test_lm_scores_match_brute_force(spark, sf_dir, documents):
    want = brute.language_model(documents)
    got = by_id(queries.op2_lm_scoring(spark, sf_dir))
    assert len(got) == len(want)
    for i, (held, n, known, total, base, score) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_decontamination_matches_brute_force(spark, sf_dir, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = dict(zip([i for i, _ in documents], brute.contamination([t for _, t in documents], items)))
    got = by_id(queries.op5_decontamination(spark, sf_dir))
    assert {i: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for i, r in got.items()} == want
    assert any(r["contaminated"] for r in got.values())


def test_substring_dedup_matches_brute_force(spark, sf_dir, documents):
    want = dict(zip([i for i, _ in documents], brute.substring([t for _, t in documents])))
    got = by_id(queries.op6_substring_dedup(spark, sf_dir))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == want


def test_bpe_matches_the_tokenizers_library(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    got = by_id(queries.op7_bpe(spark, sf_dir))
    for (i, _), e in zip(documents, t.encode_batch([x or "" for _, x in documents], add_special_tokens=False)):
        r = got[i]
        assert r["n_tokens"] == len(e.ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_embedding_dedup_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.op8_embedding_dedup(spark, sf_dir).collect()}
    assert got == brute.embedding(rows)


def test_suffix_dedup_matches_brute_force(spark, sf_dir, documents):
    want = dict(zip([i for i, _ in documents], brute.suffix([t for _, t in documents])))
    got = by_id(queries.op9_suffix_dedup(spark, sf_dir))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want


def test_simhash_matches_brute_force(spark, sf_dir, documents):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, sf_dir).collect()}
    assert got == brute.simhash(documents)
