"""Plain versions of the operators, by comparing everything with everything."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import xxhash

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def groups(keys, linked):
    """{key: smallest key it reaches} of sorted keys and a function that says if two are linked."""
    root_of = {i: i for i in keys}

    def root(i):
        while root_of[i] != i:
            i = root_of[i]
        return i

    for i, j in itertools.combinations(sorted(keys), 2):
        if linked(i, j):
            a, b = sorted((root(i), root(j)))
            root_of[b] = a
    return {i: root(i) for i in root_of}


def simhash(rows, shingle=3, distance=2, similarity=None):
    """{doc_id: (fingerprint, component_id)} of (doc_id, text)."""
    prints, sets = {}, {}
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        grams = [b" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        sets[i] = set(grams)

    def linked(i, j):
        if similarity is None:
            return (prints[i] ^ prints[j]).bit_count() <= distance
        if not sets[i] or not sets[j]:
            return not sets[i] and not sets[j]
        return (prints[i] ^ prints[j]).bit_count() <= distance and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9

    root = groups(prints, linked)
    return {i: (f"{p:016x}", root[i]) for i, p in prints.items()}


def substring(texts, width=35):
    """[(n_words, n_removed, sha256)] by plain counting."""
    words = [[] if t is None else t.encode().split() for t in texts]
    count = {}
    for w in words:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            count[k] = count.get(k, 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def suffix(texts, length=100):
    """[(n_bytes, n_removed, n_spans, sha256)] by a set of seen strings, texts in order of their ids."""
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def language_model(rows, mu=200.0, mu3=50.0):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score, score)} of (doc_id, text)."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    uni, bi, tri = {}, {}, {}
    texts = {i: ["<s>", *(t or "").encode().translate(LOWER).split(), None] for i, t in rows}
    for i, w in texts.items():
        if not held(i):
            for k in range(1, len(w)):
                for counts, key in ((uni, w[k]), (bi, (w[k - 1], w[k])), (tri, tuple(w[k - 2 : k + 1]) if k > 1 else None)):
                    counts[key] = counts.get(key, 0) + 1
    n, v = sum(uni.values()), len(uni)
    ones, twos = (sum(c == k for c in uni.values()) for k in (1, 2))
    d = ones / (ones + 2 * twos) if ones and twos else 0.5
    p = lambda w: ((uni[w] - d) if w in uni else d * v) / n if n else 1.0
    p2 = lambda a, w: (bi.get((a, w), 0) + mu * p(w)) / (uni.get(None if a == "<s>" else a, 0) + mu)
    p3 = lambda a, b, w: (tri.get((a, b, w), 0) + mu3 * p2(b, w)) / (bi.get((a, b), 0) + mu3)
    out = {}
    for i, w in texts.items():
        base = sum(math.log10((uni.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w[1:])
        score = sum(math.log10(p2(w[k - 1], w[k]) if k == 1 or not bi.get((w[k - 2], w[k - 1])) else p3(*w[k - 2 : k + 1])) for k in range(1, len(w)))
        out[i] = (held(i), len(w) - 1, sum(x in uni for x in w[1:]), n, base, score)
    return out


def embedding(rows, threshold=0.98):
    """{vec_id: (n_links, component_id, kept)} of (vec_id, embedding, label) by all pairs."""
    good = {}
    for i, v, label in rows:
        if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = (np.array(v, np.float64), label)
    group, links = {r[0]: r[0] for r in rows}, dict.fromkeys((r[0] for r in rows), 0)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(good)
    for p, i in enumerate(ids):
        for j in ids[p + 1 :]:
            (x, a), (y, b) = good[i], good[j]
            if a == b and len(x) == len(y) and (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= threshold:
                links[i] += 1
                links[j] += 1
                s, t = sorted((root(i), root(j)))
                group[t] = s
    return {i: (links[i], root(i), root(i) == i) for i in group}


def toxicity(rows, labelled, k=15, soften=0.05, floor=0.02):
    """{doc_id: (score, nearest examples)} by dense cosine over all examples, of (doc_id, text) and (doc_id, label)."""
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
    texts = {i: words(t) for i, t in rows}
    train = sorted((i, y) for i, y in labelled if zlib.crc32(str(i).encode()) % 5)
    ids, y = [i for i, _ in train], np.array([y for _, y in train], float)
    vocabulary = sorted({w for i in ids for w in texts[i]})
    place = {w: n for n, w in enumerate(vocabulary)}
    count = np.zeros((len(rows), len(vocabulary)))
    row_of = {i: n for n, (i, _) in enumerate(rows)}
    for i, ws in texts.items():
        for w in ws:
            if w in place:
                count[row_of[i], place[w]] += 1
    held = count[[row_of[i] for i in ids]] > 0
    pos, neg = y.sum(), len(y) - y.sum()
    a, b = held[y == 1].sum(axis=0), held[y == 0].sum(axis=0)
    both = (a + b) / len(y)
    error = np.sqrt(both * (1 - both) * (1 / pos + 1 / neg))
    apart = np.maximum(np.abs(a / pos - b / neg) - 0.5 / pos - 0.5 / neg, 0)
    z = np.divide(apart, error, out=np.zeros(len(vocabulary)), where=error > 0)
    idf = np.log((1 + len(rows)) / (1 + (count > 0).sum(axis=0))) + 1
    v = np.log1p(count) * idf * (floor + (z / 4) ** 2)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    share = y.mean()
    weight = np.where(y > 0, share / pos, (1 - share) / neg)
    e = v[[row_of[i] for i in ids]]

    def near(q, without=None):
        s = np.round(e @ q, 12)
        return [(s[n], n) for n in sorted(range(len(ids)), key=lambda n: (-s[n], n)) if s[n] > 0 and n != without][:k]

    def raw(found):
        w = [weight[n] * len(ids) / (1 - s + soften) for s, n in found]
        return (1e-3 * share + sum(x * y[n] for x, (_, n) in zip(w, found))) / (1e-3 + sum(w))

    full = [n for n in range(len(ids)) if e[n].any()]
    bare = [n for n in range(len(ids)) if not e[n].any()]
    none = ((weight * y)[bare].sum() + 2 * share / len(ids)) / (weight[bare].sum() + 2 / len(ids))
    # isotonic fit by the largest rising minimum of means
    votes = np.array([raw(near(e[n], n)) for n in full])
    level = sorted(set(votes))
    mass = np.array([weight[full][votes == x].sum() for x in level])
    mean = np.array([(weight * y)[full][votes == x].sum() for x in level]) / mass
    fit = [max(min(np.average(mean[i : j + 1], weights=mass[i : j + 1]) for j in range(n, len(level))) for i in range(n + 1)) for n in range(len(level))]
    knots = [list(g) for _, g in itertools.groupby(range(len(level)), key=lambda n: round(fit[n], 12))]
    kx = [np.average([level[n] for n in g], weights=mass[g]) for g in knots]
    ky = [fit[g[0]] for g in knots]
    out = {}
    for i, _ in rows:
        found = near(v[row_of[i]])
        out[i] = (min(1, max(0, float(np.interp(raw(found), kx, ky)))) if found else min(none, max(share, 1e-6)), [ids[n] for _, n in found])
    return out


def contamination(texts, items, width=10):
    """[(n_words, n_hit, n_items, sha256)] by looking for every window at every place."""
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
    windows: dict = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out
