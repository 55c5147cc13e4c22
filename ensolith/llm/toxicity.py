"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of the labelled training documents (``max_examples`` of each
label, those of the smallest hashes of their ids). Terms are all words of the examples; their
document frequencies come from all documents. Vectors hold log(1 + count) * idf * contrast of
these terms, scaled to length one. The contrast is ``floor`` + (z / 4)**2, where z says by how
many standard errors the labels of the sample differ in the presence of a word: it weighs
terms and drops none. A term's postings are cut into blocks of examples with the block's
largest weight; a query visits blocks by falling upper bound and stops when no block can reach
the k-th best, so the k nearest are exact. Votes are weighted by 1 / (distance + ``soften``).
The raw vote is calibrated by isotonic regression over the examples, each scored without
itself, with the labels weighted to their shares in all training labels.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensolith.llm import textops as X
from ensolith.llm.blocks import cut

BLOCK = 512


def _ranges(starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places starts[i] .. starts[i] + count[i] - 1, one after the other."""
    return np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class BlockMaxIndex:
    """Postings by term and example, in blocks of BLOCK examples with the block's largest weight."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        """vectors: (terms, weights) of each example."""
        self.n_examples = len(vectors)
        self.n_blocks = -(-len(vectors) // BLOCK)
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors]).astype(np.int64) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((example, term))
        term, example, self.weight = term[order], example[order], weight[order]
        start = X.group_edges(term, example // BLOCK)  # postings of a term in a block
        self.most = np.maximum.reduceat(self.weight, start) if len(start) else self.weight
        self.of_term = np.searchsorted(term[start], np.arange(n_terms + 1)).astype(np.int32)
        # every worker holds these: small types
        self.count = np.diff(np.append(start, len(term))).astype(np.int32)
        self.block = (example[start] // BLOCK).astype(np.int32)
        self.start, self.example = start.astype(np.int32), example.astype(np.int32)

    def nearest(self, terms: np.ndarray, q: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k best (similarity, example) above zero for distinct terms and their weights; equal similarities by smaller example.

        The quarter of the blocks of the largest bounds comes first, then all that can still reach the k-th best.
        """
        if not len(terms) or not self.n_blocks:
            return []
        n = self.of_term[terms + 1] - self.of_term[terms]
        at, weight = _ranges(self.of_term[terms], n), np.repeat(q, n)
        block = self.block[at]
        upper = np.bincount(block, weight * self.most[at], self.n_blocks)
        order = np.argsort(-upper, kind="stable")
        first = order[: max(1, self.n_blocks // 4)]
        best_s, best_e = np.zeros(0), np.zeros(0, np.int64)
        for own in (first, order[len(first) :]):
            least = best_s[-1] if len(best_s) == k else 0.0
            own = own[(upper[own] > 0) & (upper[own] >= least - 1e-12)]
            if not len(own):
                break
            visited = np.zeros(self.n_blocks, bool)
            visited[own] = True
            some = np.flatnonzero(visited[block])
            count = self.count[at[some]]
            post = _ranges(self.start[at[some]], count)
            s = np.round(np.bincount(self.example[post], np.repeat(weight[some], count) * self.weight[post], self.n_examples), 12)
            if 0 <= without < len(s):
                s[without] = 0.0
            e = np.flatnonzero((s > 0) & (s >= least))
            if len(e) > k:
                e = e[s[e] >= np.partition(s[e], len(e) - k)[len(e) - k]]
            s, e = np.concatenate([best_s, s[e]]), np.concatenate([best_e, e])
            top = np.lexsort((e, -s))[:k]
            best_s, best_e = s[top], e[top]
        return list(zip(best_s.tolist(), best_e.tolist()))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted least-squares rising fit of y to x: block means of x and of y."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of y, sum of x
    for i in order:
        blocks.append([w[i], w[i] * y[i], w[i] * x[i]])
        while len(blocks) > 1 and (blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0] or blocks[-2][2] * blocks[-1][0] == blocks[-1][2] * blocks[-2][0]):
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 2] / b[:, 0], b[:, 1] / b[:, 0]


class Model:
    """Terms, examples and calibration: bounded by ``max_examples`` of each label and their texts, whatever the corpus."""

    def __init__(self, terms: np.ndarray, factor: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], share: float, k: int, soften: float):
        """terms and their factors (idf times contrast); examples (id, label, terms, counts)."""
        self.set = X.HashSet(terms)
        self.factor, self.k, self.soften, self.share = factor, k, soften, share
        self.ids = [e[0] for e in examples]
        self.toxic = np.array([e[1] for e in examples], float)
        vectors = [self.vector(t, c) for _, _, t, c in examples]
        self.index = BlockMaxIndex(vectors, len(factor))
        pos, neg = self.toxic.sum(), len(examples) - self.toxic.sum()
        weight = np.where(self.toxic > 0, share / max(pos, 1), (1 - share) / max(neg, 1)) if examples else np.zeros(0)
        self.weight = weight
        bare = np.array([not len(t) for t, _ in vectors], bool)
        prior = 2.0 * (share / max(1, len(examples))) if examples else 0.0
        mass = weight[bare].sum() + 2.0 / max(1, len(examples))
        self.bare = float(((weight * self.toxic)[bare].sum() + prior) / mass) if examples else share
        self.bare = min(self.bare, max(share, 1e-6))
        full = np.flatnonzero(~bare)
        raw = np.array([self.raw(self.index.nearest(*vectors[e], k, int(e))) for e in full])
        self.knots = isotonic(raw, self.toxic[full], weight[full]) if len(full) > 1 else (np.array([0.0, 1.0]), np.array([self.bare, max(share, self.bare)]))
        self.memo: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.log1p(counts) * self.factor[terms]
        norm = np.sqrt((v * v).sum())
        return (terms, v / norm) if norm else (terms[:0], v[:0])

    def raw(self, near: list[tuple[float, int]]) -> float:
        """Distance-weighted vote, labels weighted to their shares; a vote of the share is the neighbours' weakest part."""
        mass, vote = 1e-3, 1e-3 * self.share
        scale = len(self.ids)
        for s, e in near:
            w = self.weight[e] * scale / (1.0 - s + self.soften)
            mass += w
            vote += w * self.toxic[e]
        return vote / mass

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple[float, int]]]:
        """(calibrated score, nearest examples)."""
        key = (terms.tobytes(), counts.tobytes())
        got = self.memo.get(key)
        if got is None:
            near = self.index.nearest(*self.vector(terms, counts), self.k)
            p = float(np.interp(self.raw(near), *self.knots)) if near else self.bare
            got = (min(1.0, max(0.0, p)), near)
            if len(self.memo) > 256:
                self.memo.clear()
            self.memo[key] = got
        return got


def held_out(doc_id, parts: int = 5) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == 0


def _counts(hashes: np.ndarray, first: np.ndarray, known: X.HashSet) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, counts) of each document, terms rising."""
    at, term = known.find(hashes)
    code, count = np.unique((np.searchsorted(first, at, "right") - 1) * max(1, len(known.values)) + term, return_counts=True)
    doc, term = np.divmod(code, max(1, len(known.values)))
    edges = np.searchsorted(doc, np.arange(len(first)))
    return [(term[a:z], count[a:z]) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist())]


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 2048, k: int = 15, soften: float = 0.05, floor: float = 0.02, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the labelled documents that are not held out (crc32 of the id as text modulo 5 is not 0).

    max_examples bounds the sample of each label, and their texts the vocabulary; document
    frequencies cover all of docs. Null labels, ids and texts are no examples; of several labels
    of one id the highest counts, of several texts the smallest. Without any example the score
    of every text is 0.
    """
    key = F.col(id_col).cast("long")
    known = labels.select(key.alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    known = known.where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) != 0)
    share = known.agg(F.count("*"), F.sum("y")).first()
    share = (share[1] or 0) / share[0] if share[0] else 0.0
    order = [F.xxhash64("id"), F.col("id")]
    picked = known.where("y = 1").orderBy(*order).limit(max_examples).unionByName(known.where("y = 0").orderBy(*order).limit(max_examples))
    texts = docs.select(key.alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(picked), "id")  # 2 * max_examples rows at most
    sample = cut(sample.groupBy("id", "y").agg(F.min("text").alias("text")))

    def presence(batches):
        for batch in batches:
            for i, _, hashes, first in X.text_slices(batch.column(0)):
                y = batch.column(1).to_pylist()
                for d in range(len(first) - 1):
                    h = np.unique(hashes[first[d] : first[d + 1]])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), y[i + d]), pa.int32())], names=["term", "y"])

    sizes = dict(sample.groupBy("y").count().collect())
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    seen = sample.select("text", "y").mapInArrow(presence, "term long, y int").groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).toArrow()  # words of the examples
    terms = seen["term"].to_numpy().view(np.uint64)
    order = np.argsort(terms)
    terms, a, b = terms[order], seen["a"].to_numpy()[order], seen["b"].to_numpy()[order]
    both = (a + b) / max(1, pos + neg)
    error = np.sqrt(both * (1 - both) * (1.0 / max(1, pos) + 1.0 / max(1, neg)))
    apart = np.abs(a / max(1, pos) - b / max(1, neg)) - 0.5 / max(1, pos) - 0.5 / max(1, neg)  # with the correction for small counts
    z = np.divide(np.maximum(apart, 0.0), error, out=np.zeros(len(terms)), where=error > 0)
    contrast = floor + (z / 4.0) ** 2
    known_terms = X.HashSet(terms)

    def frequency(batches):
        total, rows = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for _, _, hashes, first in X.text_slices(batch.column(0)):
                at, t = known_terms.find(hashes)
                doc = np.searchsorted(first, at, "right") - 1
                total += np.bincount(np.unique(doc * max(1, len(terms)) + t) % max(1, len(terms)), minlength=len(terms)) if len(terms) else 0
            rows += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1], pa.int32()), pa.array([*total[some].tolist(), rows], pa.int64())], names=["term", "n"])

    got = texts.select("text").mapInArrow(frequency, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms) + 1, np.int64)  # the last place counts the documents
    df[got["term"].to_numpy()] = got["n"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def vectors(batches):
        for batch in batches:
            for i, j, hashes, first in X.text_slices(batch.column(2)):
                counts = _counts(hashes, first, known_terms)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array([t for t, _ in counts], pa.list_(pa.int32())), pa.array([c for _, c in counts], pa.list_(pa.int32()))], names=["id", "y", "t", "c"])

    rows = sample.select("id", "y", "text").mapInArrow(vectors, "id long, y int, t array<int>, c array<int>").toArrow()
    # no Python number for each term of each example: the driver holds them all
    lists = [[x.values.to_numpy().astype(np.int64) for b in rows[name].chunks for x in b] for name in ("t", "c")]
    examples = sorted(zip(rows["id"].to_pylist(), rows["y"].to_pylist(), *lists), key=lambda e: e[:2])
    del rows, lists, seen, got
    model = Model(terms, idf * contrast, examples, share, k, soften)
    del examples
    X.give_back_memory()  # the driver's Python outlives the fit
    return model


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score double, predicted int and the evidence: neighbours array<long>, similarities array<double>.

    Only the text is read. Null and empty texts, and those without any term of the model, get
    the share of toxic ones among such examples. Very long texts are read whole. Rows are kept as
    they are, also repeated ones; input columns that bear the added names are replaced. An empty
    table gives an empty result.
    """
    own = docs.drop("score", "predicted", "neighbours", "similarities")
    names = own.columns
    at_text = names.index(text_col)
    shared = own.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            got = []
            for _, _, hashes, first in X.text_slices(batch.column(at_text).cast(pa.string()), 1 << 20):
                got += [m.score(*c) for c in _counts(hashes, first, m.set)]
            p = [s for s, _ in got]
            added = [pa.array(p, pa.float64()), pa.array([int(s >= 0.5) for s in p], pa.int32()), pa.array([[m.ids[e] for _, e in near] for _, near in got], pa.list_(pa.int64())), pa.array([[s for s, _ in near] for _, near in got], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*names, "score", "predicted", "neighbours", "similarities"])

    none = F.lit(None)
    schema = own.select("*", none.cast("double").alias("score"), none.cast("int").alias("predicted"), none.cast("array<long>").alias("neighbours"), none.cast("array<double>").alias("similarities")).schema
    return own.mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, nearest example and its similarity)."""
    scored = score_texts(docs.select("doc_id", "text"), fit(docs, labels))
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted", F.get("neighbours", F.lit(0)).alias("nearest"), F.get("similarities", F.lit(0)).alias("similarity"))
