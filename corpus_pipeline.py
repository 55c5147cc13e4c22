"""A corpus cleaned for training in five stages, each over all that the stage before kept.

toxicity drops documents scored toxic; simhash keeps one document of each group of near copies;
substring takes repeated 35-word windows out of the texts; decontaminate drops documents with a
benchmark window; encode returns token ids. All but the last keep every column of documents.
"""

from __future__ import annotations

import functools
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensolith.llm import bpe, decontamination, simhash, substring_dedup, toxicity
from ensolith.llm.blocks import use_checkpoints
from ensolith.llm.queries import tokenizer_path
from ensolith.llm.textops import give_back_memory


def _lean(stage):
    """The stage, begun without what the stages before left in the driver's Python."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        gc.collect()
        give_back_memory()
        return stage(spark, docs, sf_dir)

    return run


def _apart(docs: DataFrame) -> DataFrame:
    """docs with columns of other names than any operator adds."""
    return docs.withColumnsRenamed({c: f"_c{k}" for k, c in enumerate(docs.columns) if c != "text"})


def _back(docs: DataFrame, found: DataFrame) -> DataFrame:
    return found.select(*(F.col("text" if c == "text" else f"_c{k}").alias(c) for k, c in enumerate(docs.columns)))


@_lean
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5, among them null and empty texts; repeated rows stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _back(docs, toxicity.score_texts(_apart(docs), model).where("predicted = 0"))


@_lean
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, fingerprints that agree in 0.8 of their bits, Jaccard of 0.8 or more.

    The row of the smallest doc_id stays. Rows are told apart by id and text, so rows that
    share an id lose nothing; null and empty texts are one group.
    """
    return simhash.drop_near_duplicates(docs, shingle=5, distance=12, similarity=0.8)


@_lean
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without words of 35-word windows that start anywhere else; n_chars is that of the new text, null texts stay null."""
    kept = substring_dedup.rewrite(docs)
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


@_lean
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word in a window of a benchmark item; null and empty texts stay."""
    return _back(docs, decontamination.find_contamination(_apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0"))


@_lean
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded_sha256), a row for each row; null texts count as empty."""
    got = bpe.encode(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), tokenizer_path())
    return got.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", reject_toxic), ("simhash", drop_near_copies), ("substring", cut_repeats), ("decontaminate", drop_contaminated), ("encode", encode)]

#: SimHash and the tokenizer are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows, written to the shared folder and read again as the next one's docs."""
    use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
