"""Substring dedup with fixed-block anchors.

Every window of ``width`` words contains a whole block of ``width // 2`` words of its own
document's non-overlapping blocks. So the blocks alone are indexed, every rolling window of
that size probes the index, and a hit is extended on both sides to the full windows around
it. These are compared by 64-bit hashes, and those that repeat are joined to maximal repeats.
A block of documents sends each hash once, so a passage that thousands share, or a word that a
text repeats, costs a hash bucket as many entries as there are blocks at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensolith.llm import blocks as B
from ensolith.llm import textops as X

_SECOND = 0xC2B2AE3D27D4EB4F | 5
#: A block takes about 25 times its text of a worker's memory.
BLOCK_BYTES = 5 << 20


def _hashes_of(block: B.Block):
    """(hashes, first word of each document)."""
    return X.word_hashes(block.buf, block.bounds, X.SPACE_WORDS)


def _windows(hashes: np.ndarray, first: np.ndarray, starts: np.ndarray, width: int, base: int = X.BASE) -> np.ndarray:
    """Hashes of the windows at the rising starts, some documents at a time."""
    out = np.empty(len(starts), np.uint64)
    for i, j in X.chunks_of(first, 1 << 17):
        lo, hi = int(first[i]), int(first[j])
        a, z = np.searchsorted(starts, [lo, hi])
        if a < z:
            own = starts[a:z] - lo
            out[a:z] = X.span_hashes(X.prefix_sums(hashes[lo:hi], base), own, own + width, base)
    return out


def _anchors(hashes: np.ndarray, first: np.ndarray, size: int):
    """(positions, hash of the size words from each, is it one of its document's blocks)."""
    at = np.flatnonzero(X.window_starts(first, size))
    doc_first = np.repeat(first[:-1], np.diff(first))
    return at, _windows(hashes, first, at, size), (at - doc_first[at]) % size == 0


class Folded:
    """The distinct hashes of a block, in order of bucket, and where each item's stands among them.

    A block sends a hash once however often it has it, so a bucket gets as many of one hash as
    there are blocks at most.
    """

    def __init__(self, h: np.ndarray, buckets: int, dtype, by: np.ndarray | None = None):
        # what a worker holds at once is dear: small types, and nothing kept for longer than it is used
        order = np.argsort(h, kind="stable").astype(np.int32)  # a block is far below 2**31 words
        kinds = h[order]
        new = np.ones(len(h), bool)
        new[1:] = kinds[1:] != kinds[:-1]
        inverse = np.empty(len(h), np.int32)
        inverse[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        edges = np.flatnonzero(new).astype(np.int32)
        kinds, index = kinds[edges], order[edges]
        more = np.diff(edges, append=np.int32(len(h))) > 1
        del order, new, edges
        fp = kinds.astype(dtype)
        deal = ((kinds >> np.uint64(32) if by is None else by[index]) % np.uint64(buckets)).astype(np.uint32)
        del kinds, index
        rising = np.argsort(fp, kind="stable").astype(np.int32)
        order, self.bounds = X.fan_out(deal[rising], buckets)
        order = rising[order]
        del rising, deal
        self.fp, self.more = fp[order], more[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.of = place[inverse]

    def rows(self, grp: int, flags: np.ndarray | None = None):
        """A message for each bucket: rising hashes, which stand here more than once, flags."""
        for b in np.flatnonzero(np.diff(self.bounds)):
            k = slice(self.bounds[b], self.bounds[b + 1])
            yield (int(b), grp, X.pack(np.diff(self.fp[k], prepend=self.fp.dtype.type(0))), X.pack_mask(self.more[k]), None if flags is None else X.pack_mask(flags[k]), int(self.bounds[b + 1] - self.bounds[b]))

    def hits(self, answers: dict) -> np.ndarray:
        """Mask over the items from the masks that the buckets gave."""
        hit = np.zeros(len(self.fp), bool)
        for b, r in answers.items():
            hit[self.bounds[b] : self.bounds[b + 1]] = X.unpack_mask(r["a"], r["n"])
        return hit[self.of]


def _repeated(rows: list[dict], dtype, flagged: bool):
    """Messages with the mask of the fingerprints that stand at two places or more (one of them flagged, if asked)."""
    fp = np.concatenate([np.cumsum(X.unpack(r["a"], dtype), dtype=dtype) for r in rows])
    more = np.concatenate([X.unpack_mask(r["b"], r["n"]) for r in rows])
    order = np.argsort(fp, kind="stable")
    edges = X.group_edges(fp[order])
    sizes = np.diff(np.append(edges, len(fp)))
    good = (sizes > 1) | (np.logical_or.reduceat(more[order], edges) if len(edges) else sizes > 1)
    if flagged:
        flags = np.concatenate([X.unpack_mask(r["c"], r["n"]) for r in rows])
        good &= np.logical_or.reduceat(flags[order], edges) if len(edges) else good
    hit = np.zeros(len(fp), bool)
    hit[order] = np.repeat(good, sizes)
    at = 0
    for r in rows:
        own = hit[at : at + r["n"]]
        at += r["n"]
        if own.any():
            yield (r["bucket"], r["grp"], X.pack_mask(own), None, b"2" if not flagged else b"1", r["n"])


def maximal(starts: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the maximal repeats that windows at the sorted starts make up, over n words."""
    if not len(starts):
        return starts, starts
    edges = np.flatnonzero(np.diff(starts, prepend=-(n + width)) > width)
    return starts[edges], starts[np.append(edges[1:], len(starts)) - 1] + width


def repeated_windows(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None):
    """(pieces, answers, marks): what ``remove_repeats`` and ``kept_texts`` settle from."""
    size = (width + 1) // 2
    n = B.n_blocks(docs, text_col, block_bytes)
    pieces = B.deal(docs, n, id_col, text_col, carry)

    def probe(block):
        _, h, is_block = _anchors(*_hashes_of(block), size)
        folded = Folded(h, n, np.uint32)
        flags = np.zeros(len(folded.fp), bool)
        flags[folded.of[is_block]] = True
        return list(folded.rows(block.group, flags))

    hits = B.cut(B.answer(B.ask(pieces, probe), lambda rows: list(_repeated(rows, np.uint32, True))))

    def candidates(hashes, first, answers):
        """Starts of the full windows around the anchors hit, and their distinct hashes (64 bits, and those that pick the bucket)."""
        at, h, _ = _anchors(hashes, first, size)
        hit = np.zeros(len(hashes), bool)
        hit[at[Folded(h, n, np.uint32).hits(answers)]] = True
        ends = np.flatnonzero(hit)
        near = X.covered(np.maximum(ends - (width - size), 0), width - size + 1, len(hashes)) if len(ends) else hit
        start = np.flatnonzero(near & X.window_starts(first, width))
        return start, Folded(_windows(hashes, first, start, width), n, np.uint64, _windows(hashes, first, start, width, _SECOND))

    def verify(block, answers):
        if not answers:
            return []
        return list(candidates(*_hashes_of(block), answers)[1].rows(block.group))

    repeats = B.answer(B.ask_again(pieces, hits, verify), lambda rows: list(_repeated(rows, np.uint64, False)))

    def marks(block, answers):
        """(starts, ends, first, removed) of the words of the block."""
        hashes, first = _hashes_of(block)
        one = {b: r for (tag, b), r in answers.items() if tag == b"1"}
        two = {b: r for (tag, b), r in answers.items() if tag == b"2"}
        removed = np.zeros(len(hashes), bool)
        if two:
            start, folded = candidates(hashes, first, one)
            begins, ends = maximal(start[folded.hits(two)], width, len(hashes))
            removed = X.covered_spans(begins, ends, len(hashes))
            del start, folded
        del hashes
        return *X.words_at(block.buf, block.bounds, X.SPACE_WORDS), first, removed

    return pieces, hits.unionByName(repeats), marks


def _kept(block, s, e, first, removed) -> list[bytes | None]:
    """The kept words of each document, joined by one space: a gather for some documents at a time."""
    out: list[bytes | None] = []
    for i, j in X.chunks_of(block.bounds):
        keep = first[i] + np.flatnonzero(~removed[first[i] : first[j]])
        starts, ends = s[keep], e[keep]
        size = ends - starts + 1
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(keep) else 0
        src = np.ones(total, np.int64)
        if len(keep):
            src[0] = starts[0]
            src[stop[:-1]] = starts[1:] - ends[:-1]  # the step from a word's separator to the next word
        buf = block.buf[np.cumsum(src)]
        buf[stop - 1] = 0x20
        edge = np.concatenate([[0], stop])[np.searchsorted(keep, first[i : j + 1])]
        out += [buf[a : max(a, z - 1)].tobytes() if ok else None for a, z, ok in zip(edge[:-1].tolist(), edge[1:].tolist(), block.has_text[i:j])]
    return out


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: (doc_id, n_words, n_removed, kept_text), kept words joined by one space.

    A word goes if any window of ``width`` words that covers it starts at another place too,
    in the same document or another; all copies go, and windows are judged on the input.
    Null text: no words, kept_text null. Empty text, or one of white space: no words, kept_text
    empty. Documents below ``width`` words keep everything. Repeated rows (also of one id) are
    separate places, so they remove each other. A null id is kept as null. Other columns are
    ignored; an empty table gives an empty result.
    """
    pieces, answers, marks = repeated_windows(docs, width, id_col, text_col, block_bytes)

    def result(block, got):
        s, e, first, removed = marks(block, got)
        gone = np.concatenate([[0], np.cumsum(removed)])
        texts = _kept(block, s, e, first, removed)
        return pa.table({id_col: pa.array(block.id_list(), pa.int64()), "n_words": np.diff(first), "n_removed": gone[first[1:]] - gone[first[:-1]], "kept_text": pa.array(texts, pa.binary()).cast(pa.string())})

    return B.settle(pieces, answers, result, f"{id_col} long, n_words long, n_removed long, kept_text string")


def rewrite(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their texts replaced by the kept texts of ``remove_repeats``; all rows and columns stay."""
    carry = [c for c in docs.columns if c not in (id_col, text_col)]
    pieces, answers, marks = repeated_windows(docs, width, id_col, text_col, carry=carry)
    schema = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col), *carry).schema

    def result(block, got):
        s, e, first, removed = marks(block, got)
        texts = _kept(block, s, e, first, removed)
        rest = {c: block.rest[f"c{k}"] for k, c in enumerate(carry)}
        return pa.table({id_col: pa.array(block.id_list(), pa.int64()), text_col: pa.array(texts, pa.binary()).cast(pa.string()), **rest})

    return B.settle(pieces, answers, result, schema).select(*docs.columns)


def digest(docs: DataFrame, width: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of remove_repeats."""
    return remove_repeats(docs, width).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
