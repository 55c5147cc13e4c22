"""The queries of this subpackage over the standard tables, and SQL where it can express them."""

from __future__ import annotations

from ensolith.llm import bpe, centroid_clustering, chat_format, decontamination, embedding_dedup, license_scan, lm_scoring, simhash, spelling_variants, substring_dedup, suffix_dedup, token_counts, toxicity


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, sf_dir):
    return toxicity.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_lm_scoring(spark, sf_dir):
    return lm_scoring.score_texts(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark, sf_dir):
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op4_preference_format(spark, sf_dir):
    return chat_format.format_pairs(chat_format.neighbours_as_pairs(_table(spark, sf_dir, "conversations")))


def op5_decontamination(spark, sf_dir):
    return decontamination.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(_table(spark, sf_dir, "documents"))


def op7_bpe(spark, sf_dir):
    return bpe.digest(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, distance=2, similarity=None)


def op11_token_counts(spark, sf_dir):
    return token_counts.digest(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op12_centroid_clustering(spark, sf_dir):
    return centroid_clustering.sort_means(_table(spark, sf_dir, "embeddings"))[0]


def op13_spelling_variants(spark, sf_dir):
    return spelling_variants.group_variants(_table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_lm_scoring, op3_license_scan, op4_preference_format, op5_decontamination, op6_substring_dedup, op7_bpe, op8_embedding_dedup, op9_suffix_dedup, op10_simhash, op11_token_counts, op12_centroid_clustering, op13_spelling_variants, pipeline)}

_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLES = {
    "op12_centroid_clustering": centroid_clustering.oracle(),
    "op13_spelling_variants": spelling_variants.oracle(),
    "op3_license_scan": license_scan.oracle(),
    "op4_preference_format": chat_format.oracle(),
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM benchmark),
k AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM k),
sizes AS (SELECT DISTINCT n FROM win),
p AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
q AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS s FROM p),
h AS (SELECT doc_id, q.n, i, item_id FROM q JOIN win ON q.s = win.s AND q.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
q AS (SELECT doc_id, i, sha256(array_to_string(w[i + 1 : i + 35], ' ')) AS h FROM p),
r AS (SELECT h FROM q GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM q WHERE h IN (SELECT h FROM r)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS k FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS s FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
c(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x),
m AS (SELECT x, min(y) AS component_id FROM c GROUP BY x),
n AS (SELECT x, count(*) AS k FROM l GROUP BY x)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m ON v.vec_id = m.x LEFT JOIN n ON v.vec_id = n.x""",
}
