"""Spelling variants of the words of a corpus, by a rare-first q-gram prefix filter.

Words are near if one inserted, deleted or replaced letter makes one the other. Such an edit
touches at most two of a word's bigrams; all others stand in both words, at the same place or,
behind an inserted letter, one place on. Bigrams are ordered by how many words hold them, the
rarest first, and within a word by place. Of the bigrams that near words share, the first in
this order has at most two before it in either word, so it is among the three rarest of both.
Words are joined on those three alone, with their places and lengths as keys, and verified.

The order is of bigrams and not of bigrams at their places, as a shifted bigram must keep its
rank. The letters are 26 and 64 more, so there are 8100 bigrams at most, whatever the corpus is.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensolith.lineage import cut
from ensolith.llm.textops import LOWER, give_back_memory

RUN = re.compile("[a-zÀ-ÿ]+")
_NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")
#: These change the cost, not the result: letters looked at once, words counted before they are handed on.
PART_LETTERS = 1 << 20
MAX_COUNTED = 200_000
#: Bigrams of the three of a word, and letters of the shortest word.
PREFIX, SHORTEST = 3, 5
_BITS = 32


def _parts(text: str):
    """A long text in parts, none ending inside a run."""
    at = 0
    while len(text) - at > PART_LETTERS and (m := _NO_LETTER.search(text, at + PART_LETTERS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def count_words(docs: DataFrame, every: int, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of letters with at least SHORTEST letters that occur ``least`` times or more.

    Where ``every`` divides crc32 of ``<id>:<run>`` the run loses its letter at crc32 modulo its length.
    """

    def run(batches):
        total: Counter = Counter()

        def hand_on():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for part in _parts(text.as_py() or ""):
                    for word, n in Counter(RUN.findall(part.encode().translate(LOWER).decode())).items():
                        if len(word) >= SHORTEST:
                            h = zlib.crc32(word.encode(), start)
                            if h % every == 0:
                                k = h % len(word)
                                word = word[:k] + word[k + 1 :]
                                if len(word) < SHORTEST:
                                    continue
                            total[word] += n
                    if len(total) >= MAX_COUNTED:
                        yield hand_on()
        if total:
            yield hand_on()
        give_back_memory()

    counted = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """Rank of every bigram, the rarest first: at most 8100 entries, as the letters are 90."""

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for w in batch.column(0).to_pylist():
                found.update(w[i : i + 2] for i in range(len(w) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["gram", "n"])

    rows = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r["gram"]: k for k, r in enumerate(sorted(rows, key=lambda r: (r["n"], r["gram"])))}


def _halves(word: str, more: int) -> tuple[int, int]:
    """Hashes of a word's two halves, without the ``more`` letters between them."""
    h = (len(word) - more) // 2
    return tuple(zlib.crc32(x.encode()) - (1 << 31) for x in (word[:h], word[h + more :]))


def rare_places(words: DataFrame) -> DataFrame:
    """(word, n, size, rare, halves): the three rarest bigrams of each word, as rank * 2^32 + place, in order.

    Whatever letter differs, one half of the shorter word is also that of the other: halves are
    hashes of the two of a word, then of those left if the letter in its middle is the one too many.
    """
    order = bigram_order(words)

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            rare = [sorted((order[w[i : i + 2]] << _BITS) + i for i in range(len(w) - 1))[:PREFIX] for w in names]
            halves = [pa.array(x, pa.int32()) for x in zip(*([*_halves(w, 0), *_halves(w, 1)] for w in names))] or [pa.array([], pa.int32())] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(len, names), pa.int32()), pa.array(rare, pa.list_(pa.int64())), *halves], names=["word", "n", "size", "rare", "head", "tail", "head2", "tail2"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, size int, rare array<long>, head int, tail int, head2 int, tail2 int")


def near_pairs(words: DataFrame, hot: int = 4096) -> DataFrame:
    """(a, a_n, b, b_n): every two near words of (word, n) once, b the longer or else the later one.

    A key (bigram, place, length) with more than ``hot`` words (more where there are very many
    words, so that at most 20000 keys can be) is dealt to as many tasks as it has shares of
    that size: its words are dealt out, and who asks for it asks all shares.
    """
    held = cut(rare_places(words))
    index = held.select(F.explode("rare").alias("at"), "*")
    hot = max(hot, held.count() * PREFIX // 20_000)
    shares = index.groupBy("at", "size").agg(F.count("*").alias("many")).where(F.col("many") > hot)
    shares = F.broadcast(shares.select("at", "size", F.ceil(F.col("many") / hot).cast("int").alias("shares")))  # 20000 rows at most
    share_of = F.coalesce("shares", F.lit(1))
    right = index.join(shares, ["at", "size"], "left").select("at", "size", F.pmod(F.xxhash64("word"), share_of).cast("int").alias("share"), F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("rare").alias("b_rare"), *(F.col(c).alias(f"b_{c}") for c in ("head", "tail", "head2", "tail2")))
    ask = lambda on, more: F.struct((F.col("at") + on).alias("at"), (F.col("size") + more).alias("size"))
    asks = F.explode(F.array(ask(0, 0), ask(0, 1), ask(1, 1)))
    left = index.select(asks.alias("ask"), F.col("at").alias("own"), F.col("size").alias("a_size"), F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("rare").alias("a_rare"), "head", "tail")
    left = left.select("ask.*", *left.columns[1:]).join(shares, ["at", "size"], "left")
    left = left.withColumn("share", F.explode(F.sequence(F.lit(0), share_of - 1))).drop("shares")
    longer = F.col("size") > F.col("a_size")
    met = left.join(right, ["at", "size", "share"])
    half = F.when(longer, (F.col("head") == F.col("b_head2")) | (F.col("tail") == F.col("b_tail2"))).otherwise((F.col("head") == F.col("b_head")) | (F.col("tail") == F.col("b_tail")))
    met = met.where(half & (longer | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    # of several keys that the two share, the first one tells
    shared = F.filter("a_rare", lambda x: F.array_contains("b_rare", x) | (longer & F.array_contains("b_rare", x + 1)))
    first = (F.element_at(shared, 1) == F.col("own")) & ((F.col("at") == F.col("own")) | ~F.array_contains("b_rare", F.col("own")))
    return met.where(first).select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), form not null: the last word that forms lead to, in steps that double."""
    up = cut(forms.select("word", F.col("form").alias("up"), F.lit(True).alias("moved")))
    while up.where("moved").limit(1).count():
        on = up.select(F.col("word").alias("up"), F.col("up").alias("next"))
        up = cut(up.select("word", "up").join(on, "up", "left").select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
    return up.select("word", F.col("up").alias("root"))


def group_variants(docs: DataFrame, every: int = 97, least: int = 3, times: int = 2, hot: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the corpus.

    form is the near word of the largest n, of equal ones the first in code-point order, if its n is
    ``times`` (2 or more) the word's n at least, else null; root is where forms lead at last, the
    word itself if it has no form; n_near counts near words. Null and empty texts hold no words;
    very long texts are read in parts that end between words; repeated rows count as often as
    they stand; a null id counts as an empty one. Other columns are ignored; an empty table
    gives an empty result.
    """
    if times < 2:
        raise ValueError("forms must lead to words that are more frequent")
    words = cut(count_words(docs, every, least, id_col, text_col))
    pairs = near_pairs(words, hot)
    each = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))).alias("x")).select("x.*")
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    strong = -F.col("best.m") >= times * F.col("n")
    found = cut(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")))
    return found.join(roots(found.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle(every: int = 97, least: int = 3) -> str:
    """DuckDB SQL for the rows of ``group_variants``: crc32 by its rule, near words by what is left without one letter."""
    letters = "A-Za-zÀ-ÿ"
    one = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, {one} FROM bits WHERE k < 8),
t AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS MATERIALIZED (SELECT i, w, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{letters}]+')) AS w FROM documents) GROUP BY i, w HAVING length(w) >= {SHORTEST}),
bytes AS (SELECT i, w, n, list_prepend(4294967295, flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x) - 64] END FOR x IN string_split(i || ':' || w, '')])) AS b FROM runs),
crc AS (SELECT w, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, t),
cut AS (SELECT CASE WHEN h % {every} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM crc),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {least}),
d AS MATERIALIZED (SELECT DISTINCT word, n, length(word) AS size, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS k FROM w)),
near AS MATERIALIZED (SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM d a JOIN d b ON a.rest = b.rest AND a.k = b.k AND a.size = b.size AND a.word <> b.word
  UNION SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON d.rest = w.word),
best AS (SELECT a, count(*) AS n_near, arg_min(b, (-bn, b)) AS b, max(bn) AS bn FROM near GROUP BY a),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 2 * n THEN b END AS form, CASE WHEN bn >= 2 * n THEN bn END AS form_n FROM w LEFT JOIN best ON word = a),
up(word, goal) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON up.goal = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.goal AS root, f.n, f.n_near, f.form_n FROM f JOIN up ON f.word = up.word JOIN f e ON up.goal = e.word WHERE e.form IS NULL"""
