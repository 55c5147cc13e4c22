"""Token counts against the sentencepiece library, at every prefix."""

import random

import pytest
from pyspark.sql import functions as F

from ensolith.llm import queries, token_counts

PATH = queries.tokenizer_path("piece_bpe_32k.model")
R = random.Random(3)
ODD = "ab e\n\t<s></s>  ▁é中😀\x01i nthe  \x00​�ﬁ"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_query_matches_the_library(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op11_token_counts(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for i, n in zip(texts, map(len, library.encode(list(texts.values())))):
        r = got[i]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[i].encode()), n, n > 4096)


def test_every_prefix_has_its_exact_count(library):
    counter = token_counts._counter(token_counts.model_bytes(PATH))
    texts = ["".join(R.choice(ODD) for _ in range(R.randint(0, 30))) for _ in range(400)] + ["a" * 300, " " * 300, "the " * 60, "1" * 90, "<unk><s></s><0x41>", "ein Haus, une maison; naïve"]
    for text, steps in zip(texts, counter.tables(texts)):
        assert steps.astype(int).cumsum().tolist() == [len(library.encode(text[:i])) for i in range(1, len(text) + 1)], text


def test_parts_and_full_caches_change_nothing(library, monkeypatch):
    counter = token_counts.PrefixCounter(token_counts._counter(token_counts.model_bytes(PATH)).score)
    texts = [" ".join(R.choice(["the", "of", "naïve", "", "x" * R.randint(1, 9), "re" * R.randint(1, 5)]) for _ in range(300)) for _ in range(6)]
    for name, n in (("PART_LETTERS", 50), ("MAX_CACHED_CHUNKS", 20), ("MAX_CACHED_PAIRS", 15)):
        monkeypatch.setattr(token_counts, name, n)
    assert [int(s.sum(dtype=int)) for s in counter.tables(texts)] == [len(x) for x in library.encode(texts)]


def test_rows_nulls_long_texts_and_clashing_names(spark, library):
    long = " ".join(R.choice(["lorem", "ipsum", "dolor", "12", "é"]) for _ in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, "twice"), (5, "twice"), (None, "no id"), (6, "x" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("*", F.lit("clash").alias("n_tokens"), F.lit(1).alias("prefix_steps"), F.lit(2).alias("n_bytes"))
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.digest(docs, PATH).collect())
    want = sorted((i or 0, len((t or "").encode()), n, n > 4096) for (i, t), n in zip(rows, [len(library.encode(t or "")) for _, t in rows]))
    assert got == want
    assert token_counts.digest(docs.where("false"), PATH).count() == 0
    assert token_counts.prefix_tables(docs, PATH).columns == ["doc_id", "text", "n_bytes", "n_tokens", "prefix_steps"]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    other = pb.ModelProto()
    other.trainer_spec.model_type = other.trainer_spec.UNIGRAM
    (tmp_path / "other.model").write_bytes(other.SerializeToString())
    with pytest.raises(ValueError):
        token_counts.model_bytes(str(tmp_path / "other.model"))


def test_budgets_and_places_are_answered_from_the_table(spark, library):
    rows = [(k, "".join(R.choice(ODD) for _ in range(40)), R.randint(-2, 50)) for k in range(60)] + [(60, None, 3), (61, "some words", None)]
    tables = token_counts.prefix_tables(spark.createDataFrame(rows, "doc_id long, text string, at long"), PATH)
    texts = {k: t or "" for k, t, _ in rows}
    for r in token_counts.tokens_at(tables, "at").collect():
        assert r["tokens_at"] == (None if r["at"] is None else len(library.encode(texts[r["doc_id"]][: max(r["at"], 0)])))
    for budget in (0, 7):
        for r in token_counts.fit_to_budget(tables, budget).collect():
            t = texts[r["doc_id"]]
            best = max(i for i in range(len(t) + 1) if len(library.encode(t[:i])) <= budget)
            assert (r["fit_chars"], r["fit_tokens"], r["fit_text"]) == (best, len(library.encode(t[:best])), t[:best])
    with pytest.raises(ValueError):
        token_counts.fit_to_budget(tables, -1)
