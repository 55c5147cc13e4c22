"""Benchmark decontamination: a prefix-filtered join of documents with item-sized windows.

An item's windows are its runs of ``width`` consecutive words (an item of fewer words is one
window). A document holds a window only if it holds all of its words, so the prefix that must
be joined is one word: the rarest, by the words' counts over all documents. Wherever a
document has that word, its offset in the window fixes where the window would start; starts
outside the document are dropped (length and position), the rest compared word by word.

The benchmark is the stated query set: it goes through the driver to the tasks in blocks of at
most ``block_bytes`` of text, with one step over the documents for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensolith.llm import textops as X

BENCHMARK_BLOCK_BYTES = 8 << 20


class WindowIndex:
    """Windows of a block of items by their rarest word."""

    def __init__(self, items: list[tuple], width: int, rarity: dict[int, int]):
        hashes, first = X.text_words([t for _, t in items])
        starts, sizes, owner = [], [], []
        for k in range(len(items)):
            n = int(first[k + 1] - first[k])
            if n:
                for i in range(max(1, n - width + 1)):
                    starts.append(int(first[k]) + i)
                    sizes.append(min(n, width))
                    owner.append(k)
        self.size, self.owner = np.array(sizes, np.int64), np.array(owner, np.int64)
        self.words = np.zeros((len(starts), width), np.uint64)
        for k, (s, n) in enumerate(zip(starts, sizes)):
            self.words[k, :n] = hashes[s : s + n]
        count = np.array([rarity.get(int(h), 0) for h in hashes], np.int64)
        self.offset = np.array([min(range(n), key=lambda j: (count[s + j], int(hashes[s + j]), j)) for s, n in zip(starts, sizes)], np.int64)
        prefix = self.words[np.arange(len(starts)), self.offset] if starts else np.zeros(0, np.uint64)
        self.prefix = X.HashSet(prefix)
        place = np.searchsorted(self.prefix.values, prefix)
        self.by_prefix, self.bounds = X.fan_out(place, len(self.prefix.values))

    def occurrences(self, hashes: np.ndarray, first: np.ndarray):
        """(start word, window) of every occurrence of a window in the documents."""
        at, k = self.prefix.find(hashes)
        n = self.bounds[k + 1] - self.bounds[k]
        found_s, found_w = [], []
        ends = np.cumsum(n)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, 1 << 20):  # a very common prefix word has many
            flat = np.arange(lo, min(lo + (1 << 20), int(ends[-1])))
            row = np.searchsorted(ends, flat, "right")
            w = self.by_prefix[self.bounds[k[row]] + flat - (ends[row] - n[row])]
            s = at[row] - self.offset[w]
            doc = np.searchsorted(first, at[row], "right") - 1
            ok = (s >= first[doc]) & (s + self.size[w] <= first[doc + 1])
            s, w = s[ok], w[ok]
            for j in range(self.words.shape[1]):
                used = j < self.size[w]
                same = ~used
                same[used] = hashes[s[used] + j] == self.words[w[used], j]
                s, w = s[same], w[same]
            found_s.append(s)
            found_w.append(w)
        return (np.concatenate(found_s), np.concatenate(found_w)) if found_s else (at[:0], at[:0])


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Lists of (id as text, text), each of about block_bytes at most, whole benchmark in all."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 32).alias("b")).first()["b"] or 0
    parts = max(1, -(-int(total) // block_bytes))
    for p in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == p)
        yield [tuple(r) for r in own.distinct().collect()]


def word_counts(docs: DataFrame, words: np.ndarray, text_col: str = "text") -> dict[int, int]:
    """Counts over all documents of the given word hashes, of a benchmark block at most."""
    known = X.HashSet(words)

    def count(batches):
        total = np.zeros(len(known.values), np.int64)
        for batch in batches:
            for _, _, hashes, _ in X.text_slices(batch.column(0)):
                total += np.bincount(known.find(hashes)[1], minlength=len(total))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known.values[k].view(np.int64)), pa.array(total[k])], names=["word", "n"])

    got = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in got}


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BENCHMARK_BLOCK_BYTES) -> DataFrame:
    """docs with columns n_words long, n_hit long and item_ids array<string> (sorted, distinct).

    A word is hit if it lies in any occurrence of a window. Null text has no words. Items of no
    words, or null, have no windows; repeated items count once; an item without an id hits words
    but is not listed. Input columns that bear the added names are replaced. Very long texts are
    read whole. All documents are returned, repeated rows too; an empty table or benchmark gives
    no hits.
    """
    own = docs.drop("n_words", "n_hit", "item_ids", "_spans")
    names = own.columns
    at_text = names.index(text_col)
    carried = own.withColumns({"item_ids": F.array().cast("array<string>"), "_spans": F.array().cast("array<long>"), "n_words": F.lit(0).cast("long")})
    kinds = {"item_ids": pa.list_(pa.string()), "_spans": pa.list_(pa.int64()), "n_words": pa.int64()}
    for items in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        words = np.unique(X.text_words([t for _, t in items])[0])
        index = WindowIndex(items, width, word_counts(docs, words, text_col) if len(words) else {})
        ids = [i for i, _ in items]

        def probe(batches, index=index, ids=ids):
            for batch in batches:
                texts = batch.column(at_text).cast(pa.string())
                listed, spans = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
                count = np.zeros(batch.num_rows, np.int64)
                for i, j, hashes, first in X.text_slices(texts):
                    count[i:j] = np.diff(first)
                    s, w = index.occurrences(hashes, first)
                    doc = np.searchsorted(first, s, "right") - 1
                    for d, a, k in zip((doc + i).tolist(), (s - first[doc]).tolist(), w.tolist()):
                        spans[d] += [a, a + int(index.size[k])]
                        listed[d].append(ids[index.owner[k]])
                listed = [sorted({x for x in v if x is not None}) if v else v for v in listed]
                added = [pa.array(listed, kinds["item_ids"]), pa.array(spans, kinds["_spans"]), pa.array(count)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *added], names=[*names, *kinds])

        carried = carried.mapInArrow(probe, carried.schema)
    # spans of different blocks may overlap: words hit are the length of their union
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size("_spans") / 2 - 1).cast("int")), lambda k: F.struct(F.get("_spans", k * 2).alias("a"), F.get("_spans", k * 2 + 1).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    union = F.aggregate(pairs, start, lambda x, p: F.struct((x["n"] + F.greatest(p["b"] - F.greatest(p["a"], x["end"]), F.lit(0).cast("long"))).alias("n"), F.greatest(x["end"], p["b"]).alias("end")))["n"]
    return carried.withColumn("n_hit", F.when(F.size("_spans") > 0, union).otherwise(F.lit(0).cast("long"))).select(*names, "n_words", "n_hit", "item_ids")


def digest(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of find_contamination; a row for each row of docs."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, width)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
