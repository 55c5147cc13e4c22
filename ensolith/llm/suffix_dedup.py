"""Suffix-array dedup: longest-previous-factor arrays over the strings that may repeat.

A repeat of ``length`` bytes shares the smallest hash of the ``gram``-byte strings in it. Each
document is cut into runs of window starts with one such smallest string; a run's bytes are
its starts and the ``length - 1`` bytes after. Hash buckets then see every run's (smallest
string, hash of its bytes, first document), each once from a block of documents: whole copies
of a run go at once, the first stays. Where a smallest string stands in runs of different
bytes, the bytes of the first of each are sent on and their suffixes sorted: in suffix order
the previous and the next smaller text position hold the longest previous factor, and a factor
of ``length`` or more is removed. A smallest string of more than ``hot_runs`` different runs (a
phrase with ever other neighbours) would make one task's suffixes grow with the corpus: its
windows are dealt once more by a hash of their own, and buckets find the first of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensolith.llm import blocks as B
from ensolith.llm import textops as X

#: Changes the plan, not the result: runs of more kinds share no suffix array.
HOT_RUNS = 4096
_PLACE_BITS = 25
_PIECE = 1 << (_PLACE_BITS - 1)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width neighbours."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def _pieces(block: B.Block, length: int):
    """(docs, begins, ends) in bytes of the block: whole documents, or parts of a very long one that share length - 1 bytes."""
    for i, j in X.chunks_of(block.bounds):
        begins, ends = block.bounds[i:j], block.bounds[i + 1 : j + 1] - 1
        if j - i == 1 and ends[0] - begins[0] > _PIECE:
            for at in range(int(begins[0]), int(ends[0]), _PIECE):
                yield np.array([i]), np.array([at]), np.array([min(int(ends[0]), at + _PIECE + length - 1)])
        else:
            yield np.arange(i, j), begins, ends


def runs_of(block: B.Block, length: int, gram: int):
    """(doc, start, end, key, content hash): runs of window starts start..end that share the smallest gram."""
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for docs, begins, ends in _pieces(block, length):
        lo, hi = int(begins[0]), int(ends[-1])
        good = ends - begins >= length
        if not good.any():
            continue
        sums = X.prefix_sums(X.BYTE_CODES[block.buf[lo:hi]])
        at = np.arange(hi - lo - gram + 1)
        h = X.span_hashes(sums, at, at + gram)
        bits = np.uint64(_PLACE_BITS)
        low = _smallest(((h >> bits) << bits) | at.astype(np.uint64), length - gram + 1)
        place = (low & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        docs, begins, last = docs[good], begins[good] - lo, ends[good] - lo - length
        ok = _inside(begins, last, len(place))
        new = np.empty(len(place), bool)
        new[0] = True
        new[1:] = place[1:] != place[:-1]
        new[begins] = True
        starts = np.flatnonzero(new & ok)
        close = np.empty(len(place), bool)
        close[-1] = True
        close[:-1] = new[1:]
        close[last] = True
        stops = np.flatnonzero(close & ok)
        for k, v in enumerate((docs[np.searchsorted(begins, starts, "right") - 1], starts + lo, stops + lo, h[place[starts]], X.span_hashes(sums, starts, stops + length))):
            out[k].append(v)
    if not out[0]:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(v) for v in out)


def _hashes(block: B.Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of the block, rising and none over two documents."""
    out = np.zeros(len(starts), np.uint64)
    for i, j in X.chunks_of(block.bounds):
        lo, hi = int(block.bounds[i]), int(block.bounds[j])
        a, z = np.searchsorted(starts, [lo, hi])
        if a < z:
            out[a:z] = X.span_hashes(X.prefix_sums(X.BYTE_CODES[block.buf[lo:hi]]), starts[a:z] - lo, ends[a:z] - lo)
    return out


def _inside(begins: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    d = np.zeros(n + 1, np.int32)
    d[begins] += 1
    np.add.at(d, last + 1, -1)
    return np.cumsum(d[:n]) > 0


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number, zeros behind the end."""
    return np.ndarray((len(buf) + 1,), ">u8", np.concatenate([buf, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))


def _eight(words: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each place of which ``left`` belong to the string, zeros for the others."""
    cut = np.clip(8 - left, 0, 8).astype(np.uint64) * np.uint64(8)
    w = words[np.minimum(at, len(words) - 1)].astype(np.uint64)
    return np.where(left > 0, (w >> np.minimum(cut, np.uint64(63))) << np.minimum(cut, np.uint64(63)), np.uint64(0))


def suffix_order(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the given sizes. Eight bytes at a time: only suffixes still tied are sorted further."""
    order = np.arange(len(starts))
    rank = np.zeros(len(starts), np.int64)
    open_ = order
    for at in range(0, int(sizes.max(initial=0)), 8):
        if not len(open_):
            break
        left = np.minimum(sizes[open_] - at, 8)
        w = _eight(words, starts[open_] + at, left)
        k = np.lexsort((left, w, rank[open_]))  # of equal bytes, the one that ends first
        items, w, left, r = open_[k], w[k], left[k], rank[open_][k]
        edges = X.group_edges(r, w, left)
        count = np.diff(np.append(edges, len(items)))
        # a group's rank is the place of its first item: ranks of groups stay apart as they split
        within = X.group_edges(r)
        base = np.repeat(within, np.diff(np.append(within, len(items))))
        rank[items] = r + np.repeat(edges, count) - base
        open_ = items[np.repeat(count > 1, count) & (left == 8)]
        open_ = open_[sizes[open_] > at + 8]
    return np.argsort(rank, kind="stable")


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the strings at places a and b, ``most`` at most."""
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for at in range(0, int(most.max(initial=0)), 8):
        open_ = open_[most[open_] > at]
        if not len(open_):
            break
        apart = words[a[open_] + at].astype(np.uint64) ^ words[b[open_] + at].astype(np.uint64)
        equal = np.full(len(apart), 8, np.int64)
        some = np.flatnonzero(apart)
        equal[some] = sum((apart[some] >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8))
        out[open_] = np.minimum(at + equal, most[open_])
        open_ = open_[equal == 8]
    return out


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, or -1, by pointer jumping."""
    prev = np.arange(len(values)) - 1
    todo = np.flatnonzero((prev >= 0) & (values[prev] >= values)) if len(values) else prev
    while len(todo):
        prev[todo] = prev[prev[todo]]
        p = prev[todo]
        todo = todo[(p >= 0) & (values[p] >= values[todo])]
    return prev


def previous_factors(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Longest previous factor of the suffixes of the given sizes: their longest prefix that also starts at a smaller place."""
    words = _words(buf)
    order = suffix_order(words, starts, sizes)
    where, at, size = place[order], starts[order], sizes[order]
    before = nearest_smaller(where)
    after = len(where) - 1 - nearest_smaller(where[::-1])[::-1]
    factor = np.zeros(len(where), np.int64)
    for k, other in ((np.flatnonzero(before >= 0), before), (np.flatnonzero(after < len(where)), after)):
        o = other[k]
        factor[k] = np.maximum(factor[k], common_prefix(words, at[k], at[o], np.minimum(size[k], size[o])))
    out = np.zeros(len(where), np.int64)
    out[order] = factor
    return out


def _first_of(key: np.ndarray, doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Mask of the items that are the first of their key, by document and tie, then as they stand."""
    order = np.lexsort((np.arange(len(key)), tie, doc, key))
    first = np.zeros(len(key), bool)
    first[order[X.group_edges(key[order])]] = True
    return first


def _first_runs(rows: list[dict], hot_runs: int) -> list[tuple]:
    """Status of every run: 0 alone, 1 a later copy, else the first of its bytes where other bytes share the key: 2, or 3 if very many do."""
    key, content = (np.concatenate([X.unpack(r[c], np.uint64) for r in rows]) for c in ("a", "b"))
    doc = np.concatenate([X.unpack(r["c"], np.int64) for r in rows])
    tie, key = key & np.uint64(0xFFFFFFFF), key >> np.uint64(32)
    order = np.lexsort((np.arange(len(key)), tie, doc, content, key))
    k, c = key[order], content[order]
    firsts, keys = X.group_edges(k, c), X.group_edges(k)
    status = np.ones(len(key), np.uint8)
    kinds = np.diff(np.append(np.searchsorted(firsts, keys), len(firsts)))
    of = np.repeat(kinds, kinds)
    status[order[firsts]] = np.where(of > hot_runs, 3, np.where(of > 1, 2, 0))
    out, at = [], 0
    for r in rows:
        own = status[at : at + r["n"]]
        at += r["n"]
        if own.any():
            out.append((r["bucket"], r["grp"], X.pack(own), None, b"1", r["n"]))
    return out


def _factors(rows: list[dict], length: int) -> list[tuple]:
    """Longest previous factors of the starts of the runs sent, in their order, less length (and zero for shorter ones)."""
    z = zstandard.ZstdDecompressor()
    tie, doc, size, body = [], [], [], []
    for r in rows:
        meta = X.unpack(r["b"], np.int64).reshape(3, -1)
        tie.append(meta[0])
        doc.append(meta[1])
        size.append(meta[2])
        body.append(z.decompress(r["a"]))
    per = [len(x) for x in tie]
    tie, doc, size = np.concatenate(tie), np.concatenate(doc), np.concatenate(size)
    buf = np.frombuffer(b"".join(body), np.uint8)
    begin = np.cumsum(size) - size
    # places: runs by document, then as sent, which is their order in the document
    order = np.lexsort((np.arange(len(doc)), tie, doc))
    n_starts = size - length + 1
    base = np.empty(len(doc), np.int64)
    base[order] = np.cumsum(n_starts[order]) - n_starts[order]
    first = np.cumsum(n_starts) - n_starts
    step = np.arange(int(n_starts.sum())) - np.repeat(first, n_starts)
    factor = previous_factors(buf, np.repeat(begin, n_starts) + step, np.repeat(size, n_starts) - step, np.repeat(base, n_starts) + step)
    factor = np.maximum(factor - length + 1, 0).astype(np.uint8 if length < 128 else np.uint32)
    out, at = [], 0
    for r, k in zip(rows, np.split(n_starts, np.cumsum(per)[:-1])):
        own = factor[at : at + int(k.sum())]
        at += len(own)
        if own.any():
            out.append((r["bucket"], r["grp"], X.pack(own), None, b"2", len(own)))
    return out


def _first_windows(rows: list[dict]) -> list[tuple]:
    """Masks over the windows sent: they also stand in an earlier document."""
    key, tie = (np.concatenate([X.unpack(r[c], np.uint64).reshape(2, -1)[i] for r in rows]) for c, i in (("a", 0), ("a", 1)))
    doc = np.concatenate([X.unpack(r["b"], np.int64) for r in rows])
    later = ~_first_of(key, doc, tie)
    out, at = [], 0
    for r in rows:
        own = later[at : at + r["n"]]
        at += r["n"]
        if own.any():
            out.append((r["bucket"], r["grp"], X.pack_mask(own), None, b"3", r["n"]))
    return out


def _in_order(block: B.Block, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, tie) that order documents: by id, those without one last; then by a hash of the text, whatever the block."""
    texts = _hashes(block, block.bounds[:-1], block.bounds[1:]) >> np.uint64(32)
    return np.where(block.has_id, block.ids, np.iinfo(np.int64).max)[doc], texts[doc]


class _Runs:
    """A block's runs: those of one key and equal bytes are sent once, by the first of them."""

    def __init__(self, block: B.Block, length: int, gram: int, buckets: int):
        self.doc, self.start, self.stop, key, content = runs_of(block, length, gram)
        number, tie = _in_order(block, self.doc)
        by = np.lexsort((np.arange(len(key)), tie, number, content, key))
        edges = X.group_edges(key[by], content[by])
        self.first = by[edges]  # of each kind
        self.later = np.ones(len(key), bool)
        self.later[self.first] = False
        order, self.bounds = X.fan_out((key[self.first] >> np.uint64(32)) % np.uint64(buckets), buckets)
        self.first = self.first[order]
        self.key, self.content, self.number, self.tie = key[self.first], content[self.first], number[self.first], tie[self.first]
        # copies within the block are removed if any other run of the kind is the first, and are later copies anyhow

    def asked(self, answers: dict):
        """(bucket, kinds, status) of the buckets that answered."""
        for b in sorted(answers):
            yield b, np.arange(self.bounds[b], self.bounds[b + 1]), X.unpack(answers[b]["a"], np.uint8)

    def hot(self, answers: dict):
        """Runs of status 3."""
        own = [k[status == 3] for _, k, status in self.asked(answers)]
        return self.first[np.concatenate(own)] if own else self.first[:0]


def _windows(block: B.Block, runs: _Runs, hot: np.ndarray, length: int, buckets: int):
    """(starts, kind of each, first start of each kind, order and bounds by bucket, hashes) of the windows of hot runs."""
    hot = np.sort(hot)  # runs are numbered in order of document and place
    count = runs.stop[hot] - runs.start[hot] + 1
    start = np.repeat(runs.start[hot] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    h = _hashes(block, start, start + length)
    doc = np.repeat(runs.doc[hot], count)
    number, tie = _in_order(block, doc)
    order = np.lexsort((np.arange(len(h)), tie, number, h))
    edges = X.group_edges(h[order])
    first = order[edges]
    kind = np.empty(len(h), np.int64)
    kind[order] = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(h))))
    deal, bounds = X.fan_out((X.mix(h[first]) >> np.uint64(32)) % np.uint64(buckets), buckets)
    return start, kind, first, deal, bounds, h[first], number[first], tie[first]


def repeated_bytes(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES, hot_runs: int = HOT_RUNS):
    """(pieces, answers, marks) to settle from."""
    gram = max(1, length // 3)
    n = B.n_blocks(docs, text_col, block_bytes)
    pieces = B.deal(docs, n, id_col, text_col)

    def ask(block):
        runs = _Runs(block, length, gram, n)
        rows = []
        for b in np.flatnonzero(np.diff(runs.bounds)):
            k = slice(runs.bounds[b], runs.bounds[b + 1])
            rows.append((int(b), block.group, X.pack((runs.key[k] << np.uint64(32)) | runs.tie[k]), X.pack(runs.content[k]), X.pack(runs.number[k]), int(runs.bounds[b + 1] - runs.bounds[b])))
        return rows

    statuses = B.cut(B.answer(B.ask(pieces, ask), lambda rows: _first_runs(rows, hot_runs)))

    def send(block, answers):
        if not answers:
            return []
        runs = _Runs(block, length, gram, n)
        z, rows = zstandard.ZstdCompressor(level=3), []
        for b, own, status in runs.asked(answers):
            k = own[status == 2]
            k = k[np.argsort(runs.first[k])]  # as they stand in the block
            if len(k):
                at, end = runs.start[runs.first[k]], runs.stop[runs.first[k]] + length
                body = b"".join(block.buf[s:e].tobytes() for s, e in zip(at.tolist(), end.tolist()))
                rows.append((b, block.group, z.compress(body), X.pack(np.concatenate([runs.tie[k].view(np.int64), runs.number[k], end - at])), None, len(k)))
        hot = runs.hot(answers)
        if len(hot):
            _, _, _, deal, bounds, h, number, tie = _windows(block, runs, hot, length, n)
            for b in np.flatnonzero(np.diff(bounds)):
                k = deal[bounds[b] : bounds[b + 1]]
                rows.append((int(b), block.group, X.pack(np.concatenate([h[k], tie[k]])), X.pack(number[k]), b"w", len(k)))
        return rows

    def found(rows):
        parts = [[r for r in rows if (r["c"] is None) == own] for own in (True, False)]
        return (_factors(parts[0], length) if parts[0] else []) + (_first_windows(parts[1]) if parts[1] else [])

    factors = B.answer(B.ask_again(pieces, statuses, send), found)

    def marks(block, answers):
        """Mask of removed bytes over the block's buffer."""
        one, two, three = ({b: r for (tag, b), r in answers.items() if tag == t} for t in (b"1", b"2", b"3"))
        runs = _Runs(block, length, gram, n)
        begins, ends = [runs.start[runs.later]], [runs.stop[runs.later] + length]
        for b, own, status in runs.asked(one):
            k = runs.first[own[status == 1]]
            begins.append(runs.start[k])
            ends.append(runs.stop[k] + length)
            if b in two:
                k = np.sort(runs.first[own[status == 2]])
                count = runs.stop[k] - runs.start[k] + 1
                at = np.repeat(runs.start[k] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                factor = X.unpack(two[b]["a"], np.uint8 if length < 128 else np.uint32).astype(np.int64)
                begins.append(at[factor > 0])
                ends.append(at[factor > 0] + factor[factor > 0] + length - 1)
        hot = runs.hot(one)
        if len(hot):
            start, kind, first, deal, bounds, *_ = _windows(block, runs, hot, length, n)
            later = np.zeros(len(first), bool)
            for b, r in three.items():
                later[deal[bounds[b] : bounds[b + 1]]] = X.unpack_mask(r["a"], r["n"])
            gone = later[kind]
            gone[np.setdiff1d(np.arange(len(start)), first)] = True
            begins.append(start[gone])
            ends.append(start[gone] + length)
        return X.covered_spans(np.concatenate(begins), np.concatenate(ends), len(block.buf))

    return pieces, statuses.unionByName(factors), marks


def remove_later_copies(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_removed, n_spans, kept binary).

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a
    document of smaller id, or earlier in its own. Strings never cross documents and are judged
    on the input. n_spans counts maximal removed runs. kept holds the remaining bytes, which
    need not be valid UTF-8. Null text counts as empty and keeps a null; texts below ``length``
    bytes keep everything. Rows of one id are ordered by a hash of their text; rows without an id come
    last, ordered likewise. Repeated rows remove each other but for the first. Other columns are ignored; an
    empty table gives an empty result.
    """
    pieces, answers, marks = repeated_bytes(docs, length, id_col, text_col, block_bytes, hot_runs)

    def result(block, got):
        gone = marks(block, got)
        n = len(block.ids)
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        spans = np.concatenate([[0], np.cumsum(begins)])
        lo, hi = block.bounds[:-1], block.bounds[1:] - 1
        kept = block.buf[~gone]
        at = np.concatenate([[0], np.cumsum(~gone)])
        texts = [kept[at[a] : at[b]].tobytes() if ok else None for a, b, ok in zip(lo.tolist(), hi.tolist(), block.has_text)]
        return pa.table({id_col: pa.array(block.id_list(), pa.int64()), "n_bytes": hi - lo, "n_removed": total[hi] - total[lo], "n_spans": spans[hi] - spans[lo], "kept": pa.array(texts, pa.binary())}) if n else pa.table({})

    return B.settle(pieces, answers, result, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of remove_later_copies."""
    return remove_later_copies(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))
