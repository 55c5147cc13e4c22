"""Language-model scoring with a weighted backoff automaton.

The model is a trigram model over words, learnt from every training document. The last two
words (wherever they stand together in training), the last one and none are states; a state
has an arc for every word seen after it and one failure arc to the state of one word less. Smoothing (a Dirichlet prior from the state
below; mu and mu3 are parameters):

    p(w)       = (c(w) - D) / N, and D * V / N for the class of unknown words
    p(w | v)   = (c(v w) + mu * p(w)) / (c(v) + mu)
    p(w | u v) = (c(u v w) + mu3 * p(w | v)) / (c(u v) + mu3)

An arc of a word seen weighs log10 of its p, the failure arc of a state of count c log10
mu / (c + mu). D is the absolute discount n1 / (n1 + 2 n2) of the counts of counts. Counts
live in hash buckets and grow with the corpus; a block of documents gets the counts of its own
words, pairs and triples, which is the part of the automaton that its texts can reach. The
state before a word is what its last two words make of it, so a block's texts are traversed
left to right at once: each token takes the arc of its longest state that has one, behind the
failure arcs of the longer ones. A triple is asked for only if its first two words and its last
two both stand in several blocks; else it stands in this block alone, which has all its counts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensolith.llm import blocks as B
from ensolith.llm import textops as X

END = np.uint64(0x5851F42D4C957F2D)
BEGIN = np.uint64(0x14057B7EF767814F)


def remainder(doc_id, parts: int = 5) -> int:
    """crc32 of the id as text, modulo parts; rows without an id have none (-1)."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % parts


def _tokens(block: B.Block):
    """(distinct hashes, token numbers, bounds by document): words and one end each."""
    hashes, _, _, first = X.words_of(block.buf, block.bounds, X.SPACE_WORDS, lower=True)
    tokens = np.insert(hashes, first[1:], END)
    kinds, number = np.unique(tokens, return_inverse=True)
    return kinds, number.astype(np.int64), first + np.arange(len(first))


def _pairs(kinds, number, bounds):
    """(pair hashes, first word's number or -1 for the beginning, pair number of each token)."""
    before = np.empty(len(number), np.int64)
    before[1:] = number[:-1]
    before[bounds[:-1]] = len(kinds)
    code, pair = np.unique(before * (len(kinds) + 1) + number, return_inverse=True)
    left, right = code // (len(kinds) + 1), code % (len(kinds) + 1)
    h = X.mix(np.append(kinds, BEGIN)[left] * np.uint64(0x9FB21C651E98DF25) + X.mix(kinds[right]))
    return h, left, pair


def _triples(kinds, number, bounds, h, pair):
    """(hashes, pair of the first two words, pair of the last two, triple number of each token or -1): documents' first tokens have none."""
    inner = np.ones(len(number), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    code, inverse = np.unique(pair[at - 1] * len(kinds) + number[at], return_inverse=True)
    right = np.empty(len(code), np.int64)
    right[inverse] = pair[at]
    left = code // max(1, len(kinds))
    of = np.full(len(number), -1, np.int64)
    of[at] = inverse
    return X.mix(h[left] * np.uint64(0x9FB21C651E98DF25) + X.mix(kinds[code % max(1, len(kinds))] + np.uint64(1))), left, right, of


def _layout(h: np.ndarray, n: int):
    """(order by fingerprint, bounds of the n buckets): a bucket is a range of fingerprints, so those of one message lie close and pack well."""
    order = np.argsort(h)
    starts = np.arange(1, n, dtype=np.uint64) * np.uint64(-(-(1 << 64) // n))
    return order, np.concatenate([[0], np.searchsorted(h[order], starts), [len(h)]])


def _send(grp, order, bounds, fp, counts):
    rows = []
    for b in np.flatnonzero(np.diff(bounds)):
        k = order[bounds[b] : bounds[b + 1]]
        rows.append((int(b), grp, X.pack(np.diff(fp[k], prepend=np.uint64(0))), X.pack(counts[k].astype(np.uint32)), None, len(k)))
    return rows


def _sum(rows: list[dict], tag: bytes, stats: bool) -> list[tuple]:
    """Every fingerprint's training count in the corpus, doubled, and 1 more if several blocks have it; for each block that asked."""
    fp = np.concatenate([np.cumsum(X.unpack(r["a"], np.uint64), dtype=np.uint64) for r in rows])
    count = np.concatenate([X.unpack(r["b"], np.uint32) for r in rows]).astype(np.int64)
    order = np.argsort(fp)
    edges = X.group_edges(fp[order])
    total = np.add.reduceat(count[order], edges)
    all_ = np.empty(len(fp), np.int64)
    blocks = np.diff(np.append(edges, len(fp)))
    all_[order] = np.repeat(2 * total + (blocks > 1), blocks)
    out, at = [], 0
    for r in rows:
        own = all_[at : at + r["n"]]
        at += r["n"]
        out.append((r["bucket"], r["grp"], X.pack(own), None, tag, r["n"]))
    if stats:
        known = total[total > 0]
        for name, v in ((b"N", known.sum()), (b"V", len(known)), (b"1", (known == 1).sum()), (b"2", (known == 2).sum())):
            out.append((rows[0]["bucket"], -1, None, None, name, int(v)))
    return out


def score_texts(docs: DataFrame, mu: float = 200.0, mu3: float = 50.0, held_out_part: int | None = 1, parts: int = 5, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 * B.BLOCK_BYTES) -> DataFrame:
    """One row per document: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Documents whose crc32(doc_id as text) modulo ``parts`` is ``held_out_part`` are scored but
    not learnt from. Words are told apart by 64-bit hashes, and so are pairs and triples. Null
    text counts as empty: its one token is the end. A row without an id is not held out. Repeated
    rows count as often as they stand. With no training tokens at all every score is 0. Other
    columns are ignored; an empty table gives an empty result.
    """
    n = B.n_blocks(docs, text_col, block_bytes)
    pieces = B.deal(docs, n, id_col, text_col)

    def trained(block, bounds):
        return np.repeat([remainder(i, parts) != held_out_part for i in block.id_list()], np.diff(bounds)).astype(bool)

    def words(block):
        kinds, number, bounds = _tokens(block)
        order, at = _layout(kinds, n)
        return _send(block.group, order, at, kinds, np.bincount(number[trained(block, bounds)], minlength=len(kinds)))

    counts = B.cut(B.answer(B.ask(pieces, words), lambda rows: _sum(rows, b"1", True)))
    stats = {bytes(r["c"]): r["s"] for r in counts.where("grp = -1").groupBy("c").agg(F.sum("n").alias("s")).collect()}
    total, kinds_all = stats.get(b"N", 0), stats.get(b"V", 0)
    ones, twos = stats.get(b"1", 0), stats.get(b"2", 0)
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5

    def pairs(block):
        kinds, number, bounds = _tokens(block)
        h, _, pair = _pairs(kinds, number, bounds)
        order, at = _layout(h, n)
        return _send(block.group, order, at, h, np.bincount(pair[trained(block, bounds)], minlength=len(h)))

    pair_counts = B.cut(B.answer(B.ask(pieces, pairs), lambda rows: _sum(rows, b"2", False)))

    def placed(h, answers):
        """The answers to all hashes."""
        order, at = _layout(h, n)
        out = np.zeros(len(h), np.int64)
        for b, r in answers.items():
            out[order[at[b] : at[b + 1]]] = X.unpack(r["a"], np.int64)
        return out

    def in_several(twice, left, right):
        """Mask of the triples whose two pairs both stand in several blocks."""
        return (twice[left] & twice[right] & 1) > 0

    def triples(block, answers):
        kinds, number, bounds = _tokens(block)
        h, _, pair = _pairs(kinds, number, bounds)
        h3, left, right, of = _triples(kinds, number, bounds, h, pair)
        shared = in_several(placed(h, answers), left, right)
        order, at = _layout(h3[shared], n)
        own = np.bincount(of[trained(block, bounds) & (of >= 0)], minlength=len(h3))
        return _send(block.group, order, at, h3[shared], own[shared])

    triple_counts = B.answer(B.ask_again(pieces, pair_counts, triples), lambda rows: _sum(rows, b"3", False))

    def traverse(block, answers):
        one, two, three = ({b: r for (t, b), r in answers.items() if t == tag} for tag in (b"1", b"2", b"3"))
        kinds, number, bounds = _tokens(block)
        c = placed(kinds, one) >> 1
        h, left, pair = _pairs(kinds, number, bounds)
        twice = placed(h, two)
        c2 = twice >> 1
        h3, left3, right3, of = _triples(kinds, number, bounds, h, pair)
        c3 = np.bincount(of[trained(block, bounds) & (of >= 0)], minlength=len(h3))
        shared = in_several(twice, left3, right3)
        c3[shared] = placed(h3[shared], three) >> 1
        base = np.log10((c + 0.5) / (total + 0.5 * (kinds_all + 1)))
        root = np.log10(np.where(c > 0, c - discount, discount * kinds_all) / total) if total else np.zeros(len(kinds))
        end = np.flatnonzero(kinds == END)
        state = np.append(c, c[end[0]] if len(end) else 0)[left]  # as often as a text begins, one ends
        right = np.empty(len(h), np.int64)
        right[pair] = number
        weight = root[right]
        weight = np.where(c2 > 0, np.log10((c2 + mu * 10**weight) / (state + mu)), np.log10(mu / (state + mu)) + weight)
        arc = weight[pair]
        longer = np.where(c3 > 0, np.log10((c3 + mu3 * 10 ** weight[right3]) / (c2[left3] + mu3)), np.log10(mu3 / (c2[left3] + mu3)) + weight[right3])
        inner = of >= 0
        arc[inner] = np.where(c2[left3] > 0, longer, weight[right3])[of[inner]]
        sums = lambda v: np.add.reduceat(v, bounds[:-1]) if len(v) else np.zeros(0)
        return pa.table({
            id_col: pa.array(block.id_list(), pa.int64()), "held_out": [remainder(i, parts) == held_out_part for i in block.id_list()],
            "n_tokens": np.diff(bounds), "n_known": sums((c > 0)[number].astype(np.int64)), "train_tokens": np.full(len(block.ids), total, np.int64),
            "base_score": sums(base[number]), "score": sums(arc) if total else np.zeros(len(block.ids)),
        })

    answers = counts.where("grp >= 0").unionByName(pair_counts).unionByName(triple_counts)
    return B.settle(pieces, answers, traverse, f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
