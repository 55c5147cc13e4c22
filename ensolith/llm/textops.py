"""Vectorised text primitives: tokenising, rolling hashes, compact arrays.

Everything works on one concatenated byte buffer in which each document is
followed by a separator byte that no token class contains, so that a batch of
documents is handled by a few numpy passes instead of a loop over words.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

SEPARATOR = 0x0A
CHUNK_BYTES = 1 << 20

BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(seed & 1)


BYTE_CODES = _table(20240607)

#: Words that any byte but ASCII white space makes up.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Words of digits, lower-case letters and bytes above ASCII (applied after lower-casing).
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Byte translation that lower-cases A-Z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOWER_ARRAY = np.frombuffer(LOWER, np.uint8)


def give_back_memory() -> None:
    """Return freed memory to the system: a Python worker outlives its tasks, and what it keeps adds to the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER_ARRAY[buf]


def powers(n: int, inverse: bool = False, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or those of its inverse."""
    b = pow(base, -1, 1 << 64) if inverse else base
    got = _powers.get(b)
    if got is None or len(got) < n:
        a = np.full(max(n, 1 << 16), b & _MASK, np.uint64)
        a[0] = 1
        got = _powers[b] = np.cumprod(a)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(codes: np.ndarray, base: int = BASE) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes), base=base), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of codes[start:end] for each pair, the same wherever the span stands."""
    h = (sums[ends] - sums[starts]) * powers(len(sums), True, base)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chunks_of(bounds: np.ndarray, size: int = CHUNK_BYTES):
    """Ranges (i, j) of documents of about size bytes; bounds has len(documents)+1 offsets."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_spans(buf: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of starts and ends of the words; buf ends with a separator."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = words[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.append(edge, len(buf))
    return edge[0::2], edge[1::2]


def words_of(buf: np.ndarray, bounds: np.ndarray, words: np.ndarray, lower: bool = False):
    """(hashes, starts, ends, first): all words in order; document d has words first[d]:first[d+1]."""
    hashes, starts, ends = [], [], []
    for i, j in chunks_of(bounds):
        lo, hi = int(bounds[i]), int(bounds[j])
        part = buf[lo:hi]
        if lower:
            part = lower_ascii(part)
        s, e = word_spans(part, words)
        if len(s):
            hashes.append(span_hashes(prefix_sums(BYTE_CODES[part]), s, e))
            starts.append(s + lo)
            ends.append(e + lo)
    if not starts:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(bounds), np.int64)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), starts, np.concatenate(ends), np.searchsorted(starts, bounds).astype(np.int64)


def word_hashes(buf: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of words_of alone, which takes less memory."""
    hashes, first, n = [], [np.zeros(1, np.int64)], 0
    for i, j in chunks_of(bounds):
        lo = int(bounds[i])
        part = buf[lo : int(bounds[j])]
        s, e = word_spans(part, words)
        if len(s):
            hashes.append(span_hashes(prefix_sums(BYTE_CODES[part]), s, e))
        first.append(n + np.searchsorted(s, bounds[i + 1 : j + 1] - lo))
        n += len(s)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(first).astype(np.int64)


def words_at(buf: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of words_of alone."""
    found = [(s + lo, e + lo) for i, j in chunks_of(bounds) for lo in [int(bounds[i])] for s, e in [word_spans(buf[lo : int(bounds[j])], words)]]
    none = np.zeros(0, np.int64)
    return (np.concatenate([s for s, _ in found]), np.concatenate([e for _, e in found])) if found else (none, none)


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Mask over words: a window of width words that starts here stays in its document."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int32)
    long = np.diff(first) >= width
    np.add.at(ok, first[:-1][long], 1)
    np.add.at(ok, first[1:][long] - width + 1, -1)
    return np.cumsum(ok[:n]) > 0


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask over n places that lie in [s, s+width) of any start."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + width, n), -1)
    return np.cumsum(d[:n]) > 0


def covered_spans(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask over n places that lie in any [begin, end)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, begins, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:n]) > 0


def pack(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    kind = np.dtype(dtype)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack_mask(m: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(m).tobytes())


def unpack_mask(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8), count=n).astype(bool)


def fan_out(bucket: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): items of bucket b are order[bounds[b]:bounds[b+1]], in their own order."""
    small = bucket.astype(np.uint16 if n_buckets <= 1 << 16 else np.uint32)
    return np.argsort(small, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(small, minlength=n_buckets))]).astype(np.int64)


def group_edges(*sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class HashSet:
    """Membership and place of hashes in a small sorted set, behind a bitmap."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.map = np.zeros(1 << 20, bool)
        self.map[(self.values & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray):
        """(positions in hashes, places in values) of the members."""
        at = np.flatnonzero(self.map[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        k = np.searchsorted(self.values, hashes[at])
        ok = k < len(self.values)
        ok[ok] = self.values[k[ok]] == hashes[at[ok]]
        return at[ok], k[ok]


def text_words(texts: list, words: np.ndarray = ALNUM_WORDS):
    """(hashes, first) of the lower-cased words of texts; null has none."""
    raw = [(t or "").encode() for t in texts]
    buf = np.frombuffer(b"".join(x + b"\n" for x in raw), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])]).astype(np.int64)
    hashes, _, _, first = words_of(buf, bounds, words, lower=True)
    return hashes, first


def text_slices(column, size: int = 4 << 20):
    """The same for an Arrow column of strings, slice by slice to bound the memory: (from, to, hashes, first)."""
    length = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64) + 1
    for i, j in chunks_of(np.concatenate([[0], np.cumsum(length)]), size):
        yield i, j, *text_words(column[i:j].to_pylist())
    give_back_memory()
