"""Every stage of the pipeline against a plain version of it, on the documents that the stage got."""

import brute
import corpus_pipeline as P
from ensolith.llm import bpe, queries, toxicity


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages_and_run(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    kept.append(docs)
    assert all(sorted(d.columns) == sorted(kept[0].columns) for d in kept[:-1])
    toxic = {r["doc_id"] for r in toxicity.digest(kept[0], spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    assert pairs(kept[1]) == [r for r in pairs(kept[0]) if r[0] not in toxic]
    groups = brute.simhash(pairs(kept[1]), 5, 12, 0.8)
    assert pairs(kept[2]) == [r for r in pairs(kept[1]) if groups[r[0]][1] == r[0]]
    before, after = pairs(kept[2]), pairs(kept[3])
    cut = brute.substring([t for _, t in before])
    assert [i for i, _ in before] == [i for i, _ in after]
    assert [(n - gone) for n, gone, _ in cut] == [len((t or "").encode().split()) for _, t in after]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute.contamination([t for _, t in after], items)
    assert pairs(kept[4]) == [r for r, h in zip(after, hits) if not h[1]]
    encoder = bpe.WordEncoder(bpe.tokenizer_spec(queries.tokenizer_path()))
    got = {r["doc_id"]: r["token_ids"] for r in kept[5].collect()}
    assert set(got) == {i for i, _ in pairs(kept[4])}
    assert all(len(encoder.encode([t or ""])[0]) == 4 * len(got[i]) for i, t in pairs(kept[4]))
    whole = P.run(spark, sf_dir)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, kept[5].collect()))


def test_pipeline_keeps_odd_rows_and_takes_an_empty_table(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a row without an id", "en", "s", 3), (None, "a row without an id", "en", "s", 3)]
    for data, n in ((rows, 2), ([], 0)):
        docs = spark.createDataFrame(data, schema)
        for _, stage in P.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert docs.count() == n  # null and empty texts are one group, the two copies without an id another: one of each stays
