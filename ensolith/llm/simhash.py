"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are taken in the documents' tasks and equal ones are one class from the start.
Bits are cut into fields, and two fingerprints at the distance at most agree on some fields at
least, so each goes to the groups of all such choices of fields. In a group, fingerprints are
sorted by Gray rank; runs of neighbours become nodes that hold the bits all members share (a
mask and their values), level over level. Pairs of nodes are compared by the differences on
bits both share, which only add up downwards, so a pair above the distance prunes all members'
pairs at once.

Links are of two kinds. By fingerprints alone (``similarity`` None): groups give spanning
stars of their links. By fingerprints and texts: fingerprints that agree in ``1 - distance/64``
of their bits are candidates, and the Jaccard similarity of the texts' shingles decides. Then
texts of one group are first held against their neighbours in Gray order, in some rounds, which
joins great groups of near copies at a cost linear in them; after that all pairs within the
distance are enumerated, but for those of one component, whose nodes are pruned as a whole.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ensolith.llm import textops as X
from ensolith.llm.blocks import cut
from ensolith.llm.components import components

FAN = 8
#: Changes the plan of ``linked``, not its result: larger groups are dealt once more.
SPLIT_GROUPS_OVER = 4096
#: Changes the plan of ``candidates``, not its result: rows of a group that one task takes at once.
GROUP_ROWS = 1 << 17
#: Changes the plan, not the result: rounds in which texts are held against neighbours alone.
TURNS = 2
BITMAP_BITS = 1 << 26
#: Changes the plan, not the result: sketches of 2**WIDE_BITS places sort out pairs before the texts are read again.
WIDE_BITS = 10
_ALL = (1 << 64) - 1
#: A class of equal texts: its number, fingerprint, distinct shingles, sketch and component.
_NODE = ["node", "fp", "n", "odd", "odd2", "component"]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of the shingles of one text, repeats included: runs of words, or all words of a short text."""
    w = (text or "").encode().translate(X.LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
    return np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64)


def fingerprint_of(h: np.ndarray) -> int:
    """Unsigned SimHash of shingle hashes; zero without any."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0])


def odd_sketch(h: np.ndarray, bits: int) -> bytes:
    """2**bits parities of the distinct shingle hashes by so many of their bits.

    Two texts' sketches differ in no more places than their sets of shingles differ in members.
    """
    odd = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def most_apart(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Members in one only of two sets of these sizes, at most, for that Jaccard similarity."""
    return (1 - similarity) / (1 + similarity) * (n + m) + 1e-9


def may_be_similar(size: tuple, odd: tuple, odd2: tuple, similarity: float) -> np.ndarray:
    """Mask of the pairs that sizes and sketches of both sides allow to have that Jaccard similarity."""
    n, m = size
    apart = np.bitwise_count(odd[0] ^ odd[1]).astype(np.int64) + np.bitwise_count(odd2[0] ^ odd2[1])
    return (np.minimum(n, m) >= similarity * np.maximum(n, m)) & (apart <= most_apart(n, m, similarity))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned SimHash of one text."""
    return fingerprint_of(shingles(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, text_col: str = "text", out: str = "fp") -> DataFrame:
    """docs without its text column, with the fingerprint as a (signed) long."""
    own = docs.drop(out)
    names = [c for c in own.columns if c != text_col]
    ordered = own.select(*names, F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        for batch in batches:
            fp = [_signed(fingerprint(t, shingle)) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp, pa.int64())], names=[*names, out])
        X.give_back_memory()

    return ordered.mapInArrow(run, ordered.select(*names, F.lit(None).cast("long").alias(out)).schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each word in the Gray code sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Levels of nodes over fingerprints sorted by group and Gray rank; level 0 are the fingerprints.

    With sizes and components, nodes also hold their range of sizes and their one component (or
    -1); members of one component that are many in a group stand together.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray, size: np.ndarray | None = None, component: np.ndarray | None = None):
        rank = gray_rank(fp)
        if size is None:
            order = np.lexsort((rank, group))
        else:
            by = np.lexsort((component, group))
            edges = X.group_edges(group[by], component[by])
            many = np.empty(len(fp), np.int64)
            many[by] = np.repeat(np.diff(np.append(edges, len(fp))), np.diff(np.append(edges, len(fp))))
            order = np.lexsort((rank, (np.log2(np.maximum(size, 1)) * 3).astype(np.int64), np.where(many >= FAN, component, -1), group))
        self.order, self.fp = order, fp[order]
        key = group[order]
        full = np.full(len(fp), np.uint64(_ALL))
        self.levels = [(self.fp, full, None, None)]  # bits, mask, first child, end of children
        self.ranges = None if size is None else [(size[order], size[order], component[order])]  # least and largest size, component
        while True:
            edges = X.group_edges(key)
            if len(edges) == len(key):
                break
            count = np.diff(np.append(edges, len(key)))
            place = np.arange(len(key)) - np.repeat(edges, count)
            heads = np.flatnonzero(place % FAN == 0)
            bits, mask = self.levels[-1][:2]
            ends = np.append(heads[1:], len(key))
            apart = np.bitwise_or.reduceat(bits ^ np.repeat(bits[heads], ends - heads), heads)
            shared = np.bitwise_and.reduceat(mask, heads) & ~apart
            self.levels.append((bits[heads] & shared, shared, heads, ends))
            if self.ranges is not None:
                low, high, one = self.ranges[-1]
                same = np.logical_and.reduceat(one == np.repeat(one[heads], ends - heads), heads)
                self.ranges.append((np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads), np.where(same, one[heads], -1)))
            key = key[heads]

    def links(self, distance: int, ratio: float = 0.0, at_once: int = 1 << 18):
        """Chunks (i, j) of places of fingerprints of one group within the distance, i before j.

        With sizes: only of sizes whose ratio is ``ratio`` at least, and of different components.
        """
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        todo = [(top, roots, roots)] if top else []
        while todo:
            level, a, b = todo.pop()
            if len(a) * FAN * FAN > at_once * 4:
                half = len(a) // 2
                todo += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            _, _, first, end = self.levels[level]
            na, nb = end[a] - first[a], end[b] - first[b]
            n = na * nb
            pair = np.repeat(np.arange(len(a)), n)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            i, j = first[a[pair]] + k // nb[pair], first[b[pair]] + k % nb[pair]
            bits, mask = self.levels[level - 1][:2]
            ok = (i <= j) if level > 1 else (i < j)
            i, j = i[ok], j[ok]
            ok = np.bitwise_count((bits[i] ^ bits[j]) & mask[i] & mask[j]) <= distance
            i, j = i[ok], j[ok]
            if self.ranges is not None and len(i):
                low, high, one = self.ranges[level - 1]
                ok = (high[i] >= ratio * low[j]) & (high[j] >= ratio * low[i]) & ((one[i] != one[j]) | (one[i] < 0))
                i, j = i[ok], j[ok]
            if not len(i):
                continue
            if level == 1:
                yield i, j
            else:
                todo.append((level - 1, i, j))


def union(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (smallest place reached) after linking i with j."""
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return labels
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            nxt = labels[labels]
            if (nxt == labels).all():
                break
            labels = nxt


def _fields(bits: list[int], n: int) -> list[int]:
    """Masks of the bits dealt into n fields."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(bits, n)]


def linked(distinct: DataFrame, distance: int = 2, split_over: int = SPLIT_GROUPS_OVER) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column fp, distinct) within the distance, directly or by others."""
    fields = [_signed(m) for m in _fields(list(range(64)), distance + 2)]
    masks = list(itertools.combinations(fields, 2))
    keys = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed((a | b) & (2**64 - 1)))).alias("v")) for k, (a, b) in enumerate(masks)))
    dealt = distinct.select("fp", F.inline(keys))
    large = dealt.groupBy("k", "v").count().where(F.col("count") > split_over).select("k", "v", F.lit(True).alias("large"))
    dealt = dealt.join(large, ["k", "v"], "left")
    finer = F.lit(None).cast("array<struct<k2:int,v2:bigint>>")
    for k, (a, b) in enumerate(masks):
        used = (a | b) & (2**64 - 1)
        rest = [_signed(m) for m in _fields([x for x in range(64) if not used >> x & 1], distance + 2)]
        own = F.array(*(F.struct(F.lit(n).alias("k2"), F.col("fp").bitwiseAND(F.lit(_signed((c | d) & (2**64 - 1)))).alias("v2")) for n, (c, d) in enumerate(itertools.combinations(rest, 2))))
        finer = F.when((F.col("k") == k) & F.col("large"), own).otherwise(finer)
    whole = F.array(F.struct(F.lit(-1).alias("k2"), F.lit(0).cast("long").alias("v2")))
    dealt = dealt.select("fp", "k", "v", F.inline(F.coalesce(finer, whole)))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("fp", F.xxhash64("k", "v", "k2", "v2").alias("key"))

    def stars(part):
        fp, key = (part.column(c).to_numpy().copy() for c in ("fp", "key"))
        yield _stars(fp.view(np.uint64), key, distance)

    return _by_group(dealt, stars, "a long, b long")


def _by_group(dealt: DataFrame, links, ddl: str, group_rows: int | None = None) -> DataFrame:
    """links(table of whole groups) over the groups of ``dealt`` (column key), many at a time.

    With group_rows, a group of more rows is not taken: it gives a row of nulls with its key last.
    """
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = dealt.columns
    width = len(ddl.split(","))

    def run(batches):
        """A group stands in one piece as rows are sorted by key."""
        held: list[pa.Table] = []
        rows, refused = 0, None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                if refused is not None:
                    table = table.filter(pa.array(table.column("key").to_numpy() != refused))
                if not table.num_rows:
                    continue
                held.append(table)
                rows += table.num_rows
                if rows < 200_000:
                    continue
            if not held:
                continue
            table = pa.concat_tables(held)
            key = table.column("key").to_numpy()
            stop = len(key) if batch is None else int(np.searchsorted(key, key[-1]))  # the last group may go on
            whole, rest = table.slice(0, stop), table.slice(stop)
            if group_rows is not None:
                edges = X.group_edges(key)
                large = key[edges[np.diff(np.append(edges, len(key))) > group_rows]]
                if len(large):
                    whole = whole.filter(pa.array(~np.isin(key[:stop], large)))
                    if key[-1] in large:
                        refused, rest = key[-1], rest.slice(0, 0)
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(len(large), pa.int64())] * (width - 1), pa.array(large)], names=[x.split()[0] for x in ddl.split(", ")])
            held, rows = ([rest], rest.num_rows) if rest.num_rows else ([], 0)
            if whole.num_rows:
                yield from links(whole)
        X.give_back_memory()

    return dealt.repartition(n, "key").sortWithinPartitions("key").select(*names).mapInArrow(run, ddl)


def _stars(fp: np.ndarray, key: np.ndarray, distance: int) -> pa.RecordBatch:
    index = GrayIndex(key, fp)
    labels = np.arange(len(fp))
    for i, j in index.links(distance):
        labels = union(labels, i, j)
    k = np.flatnonzero(labels != np.arange(len(fp)))
    return pa.RecordBatch.from_arrays([pa.array(index.fp[k].view(np.int64)), pa.array(index.fp[labels[k]].view(np.int64))], names=["a", "b"])


def _dealt(nodes: DataFrame, masks: list[int], *more: str) -> DataFrame:
    """nodes once for each mask, with its number k and a key of it and its bits."""
    bits = F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))
    return nodes.select(*_NODE, *more, F.posexplode(bits).alias("k", "bits")).select(*_NODE, *more, "k", F.xxhash64("k", "bits").alias("key"))


def neighbours(nodes: DataFrame, distance: int, similarity: float, turn: int = 0) -> DataFrame:
    """(a, b) of each node and two of each of its groups, where these are near and in another component.

    These are the one before it and the first of the group, in the order of falling degree
    (column degree: links known by now) and Gray rank. Groups are of disjoint pairs of fields;
    another turn deals the bits otherwise. They are read row by row, so they may be of any size.
    """
    bits = [(x * (1, 5, 11, 23)[turn % 4] + 7 * turn) % 64 for x in range(64)]
    fields = _fields(bits, distance + 2)
    masks = [a | b for a, b in zip(fields[::2], fields[1::2])]
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rank = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    dealt = _dealt(nodes, masks, "degree").repartition(n, "key").sortWithinPartitions("key", F.desc("degree"), rank)

    def run(batches):
        last = head = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in (*_NODE, "key")])
            if last is not None:
                rows = np.concatenate([head, last, rows], axis=1)
            key = rows[-1]
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            first = np.repeat(heads, np.diff(np.append(heads, len(key))))
            last, head = rows[:, -1:], rows[:, first[-1:]]
            i = np.concatenate([np.arange(1, len(key)), np.arange(len(key))])
            j = np.concatenate([np.arange(len(key) - 1), first])
            node, fp, size, odd, odd2, own, _ = rows
            bits = [x.view(np.uint64) for x in (fp, odd, odd2)]
            ok = (key[i] == key[j]) & (own[i] != own[j]) & (np.bitwise_count(bits[0][i] ^ bits[0][j]) <= distance)
            i, j = i[ok], j[ok]
            ok = may_be_similar((size[i], size[j]), (bits[1][i], bits[1][j]), (bits[2][i], bits[2][j]), similarity)
            a, b = node[i[ok]], node[j[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def candidates(nodes: DataFrame, distance: int, similarity: float, agree: int = 2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): every pair of nodes within the distance, of different components, whose sizes and sketches allow that Jaccard similarity.

    Within the distance, ``agree`` of ``distance + agree`` fields at least are equal; a pair is
    given by the group of the first of these only. Groups of more than group_rows rows are cut
    into blocks, and every two blocks meet.
    """
    fields = np.array(_fields(list(range(64)), distance + agree), np.uint64)
    masks = [int(sum(int(fields[f]) for f in c)) for c in itertools.combinations(range(len(fields)), agree)]
    wanted = np.array(masks, np.uint64)

    def pairs(part):
        node, fp, size, odd, odd2, component, k, key = (part.column(c).to_numpy().copy() for c in (*_NODE, "k", "key"))
        index = GrayIndex(key, fp.view(np.uint64), size, component)
        node, size, odd, odd2, k = (x[index.order] for x in (node, size, odd.view(np.uint64), odd2.view(np.uint64), k))
        for i, j in index.links(distance, similarity):
            ok = may_be_similar((size[i], size[j]), (odd[i], odd[j]), (odd2[i], odd2[j]), similarity)
            i, j = i[ok], j[ok]
            apart, seen, first = index.fp[i] ^ index.fp[j], np.zeros(len(i), np.int64), np.zeros(len(i), np.uint64)
            for field in fields:
                equal = (apart & field == 0) & (seen < agree)
                first[equal] |= field
                seen += equal
            own = first == wanted[k[i]]
            i, j = i[own], j[own]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), pa.nulls(len(i), pa.int64())], names=["a", "b", "key"])

    dealt = _dealt(nodes, masks)
    found = cut(_by_group(dealt, pairs, "a long, b long, key long", group_rows))
    whole = found.where("key is null").select("a", "b")
    large = found.where("key is not null").select("key").distinct()
    if not large.isEmpty():
        count = dealt.join(large, "key", "left_semi").groupBy("key").agg(F.ceil(F.count("*") * 2 / group_rows).alias("blocks"))
        rows = dealt.join(cut(count), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
        rows = rows.select(*_NODE, "k", "key", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        rows = rows.select(*_NODE, "k", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
        whole = whole.unionByName(_by_group(rows, pairs, "a long, b long, key long").select("a", "b").distinct())
    return whole


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the hashes (column t): it admits all of them, and few others."""
    bit = F.pmod("t", F.lit(BITMAP_BITS))
    words = hashes.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(t, {BITMAP_BITS}) & 63 as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose texts have that Jaccard similarity of their distinct shingles."""
    pairs = cut(pairs)
    ends = lambda: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = ends().join(classes.select("node", "n", "wide"), "node")
    side = lambda k: known.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("wide").alias(f"w{k}"))

    def close(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(c).to_numpy() for c in ("na", "nb"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(n), -1) for c in ("wa", "wb"))
            ok = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most_apart(n, m, similarity)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    pairs = cut(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "wa", "wb").mapInArrow(close, "a long, b long"))
    used = cut(ends().join(classes.select("node", "t", "t2"), "node"))
    shared = texts.sparkSession.sparkContext.broadcast(_bitmap(used))

    def sets(batches):
        bitmap = shared.value
        for batch in batches:
            at = np.mod(batch.column(0).to_numpy(), BITMAP_BITS)
            batch = batch.filter(pa.array((bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0))
            held = [np.unique(shingles(t, shingle)) for t in batch.column(2).to_pylist()]
            offsets = pa.array(np.cumsum([0, *map(len, held)]), pa.int32())
            keys = pa.array(np.concatenate(held).view(np.int64) if held else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, keys)], names=["t", "t2", "keys"])
        X.give_back_memory()

    got = texts.select("t", "t2", "text").mapInArrow(sets, "t long, t2 long, keys array<long>").dropDuplicates(["t", "t2"])
    got = used.join(got, ["t", "t2"]).select("node", "keys")
    both = pairs.join(got.select(F.col("node").alias("a"), F.col("keys").alias("x")), "a").join(got.select(F.col("node").alias("b"), F.col("keys").alias("y")), "b")
    same, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    out = cut(both.where((same >= similarity * (total - same) - 1e-9) & (total > 0)).select("a", "b"))
    shared.destroy()  # else the driver holds it until it happens to collect its garbage
    return out


def _classes(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows (id, t, t2, fp and more), texts (t, t2, text), classes (node, t, t2, fp, n, sketch, id)): equal texts are one class."""
    texts = docs.select("id", F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")

    def marks(batches):
        for batch in batches:
            held = [shingles(t, shingle) for t in batch.column(3).to_pylist()]
            fp = [_signed(fingerprint_of(h)) for h in held]
            held = [np.unique(h) for h in held]
            odd = np.frombuffer(b"".join(odd_sketch(h, 7) for h in held), np.int64).reshape(-1, 2)
            columns = [pa.array(c, pa.int64()) for c in (fp, [len(h) for h in held], odd[:, 0], odd[:, 1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, pa.array([odd_sketch(h, WIDE_BITS) for h in held], pa.binary())], names=["id", "t", "t2", "fp", "n", "odd", "odd2", "wide"])
        X.give_back_memory()

    rows = cut(texts.mapInArrow(marks, "id long, t long, t2 long, fp long, n long, odd long, odd2 long, wide binary"))
    own = rows.groupBy("t", "t2").agg(*(F.min(c).alias(c) for c in ("fp", "n", "odd", "odd2", "wide", "id")))
    return rows, texts.select("t", "t2", "text"), cut(own.withColumn("node", F.monotonically_increasing_id()))


def _joined(reach: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) of the components so far and more links: their stars stand for the links they came from."""
    if reach is None:
        return components(links)
    return reach if links.isEmpty() else components(links.unionByName(reach.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _linked_classes(texts: DataFrame, classes: DataFrame, shingle: int, distance: int, similarity: float) -> DataFrame:
    """(node, component) of the classes that link to others."""
    nodes, links, reach = classes.select(*_NODE[:-1]), None, None
    placed = nodes.select("*", F.col("node").alias("component"), F.lit(0).cast("long").alias("degree"))
    for turn in range(TURNS):
        found = _verified(neighbours(placed, distance, similarity, turn), texts, classes, shingle, similarity)
        links = found if links is None else links.unionByName(found)
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        reach = _joined(reach, found)
        placed = cut(nodes.join(reach.join(degree, "node"), "node", "left").select(*_NODE[:-1], F.coalesce("component", "node").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree")))
    # as many agreeing fields as keep the mean group small; this changes the cost alone
    count = nodes.count()
    agree = next((k for k in (2, 3) if count / 2 ** (64 * k / (distance + k)) <= 4096), 4)
    more = _verified(candidates(placed, distance, similarity, agree), texts, classes, shingle, similarity)
    return _joined(reach, more)


def _text(text_col: str) -> Column:
    """The text; empty for all texts without words."""
    text = F.col(text_col).cast("string")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise("")


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), _text(text_col).alias("text"))


def near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = 12, similarity: float | None = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, fingerprint as 16 hex digits, component_id).

    Texts link if their fingerprints differ in ``distance`` bits at most and, unless
    ``similarity`` is None, the Jaccard similarity of their distinct shingles is that or more.
    component_id is the smallest doc_id reachable over links. Words are lower-cased (A to Z) and
    parted by ASCII white space; a text of fewer words than a shingle is one shingle. Null and
    empty texts, and those of white space, have fingerprint zero; with a similarity they link
    with each other only, else like any other. Very long texts are read whole. Equal texts are
    one class from the start, so copies cost nothing here. Repeated rows stay rows; a null id is
    kept, and counts for a component's id only if no other is there (then it is null). Other
    columns are ignored; an empty table gives an empty result.
    """
    own = _own(docs, id_col, text_col)
    if similarity is None:
        rows = cut(fingerprints(own, shingle))
        classes, key = rows.groupBy("fp").agg(F.min("id").alias("id")), ["fp"]
        classes = classes.withColumn("node", F.col("fp"))
        reach = components(linked(classes.select("fp"), distance))
    else:
        rows, texts, classes = _classes(own, shingle)
        reach, key = _linked_classes(texts, classes, shingle, distance, similarity), ["t", "t2"]
    first = classes.join(cut(reach), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = first.groupBy("component").agg(F.min("id").alias("component_id"))
    known = first.join(named, "component").select(*key, "component_id")
    return rows.join(known, key).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = 12, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of ``near_duplicates``: that of the smallest id, rows without an id after all others.

    Rows are told apart by id and text, not by id alone: of rows that share an id, those whose
    texts are in different groups all stay. All columns are kept. Null and empty texts are one
    group. An empty table gives an empty result.
    """
    _, texts, classes = _classes(_own(docs, id_col, text_col), shingle)
    reach = cut(_linked_classes(texts, classes, shingle, distance, similarity))
    inside = classes.join(reach, "node").select("t", "t2", "component", F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("t").alias("t"), F.col("t2").alias("t2")).alias("place"))
    kept = inside.groupBy("component").agg(F.min("place").alias("best"))
    gone = inside.join(kept, "component").where("place <> best").select("t", "t2")
    names = docs.columns
    text = _text(text_col)
    row = F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(names)))
    # of the rows of one text the first; copies fold before the exchange
    best = docs.select(F.xxhash64(text).alias("_t"), F.xxhash64(F.lit(1), text).alias("_t2"), row.alias("_row"), F.struct(F.col(id_col).isNull(), F.col(id_col).cast("long")).alias("_at"))
    best = best.groupBy("_t", "_t2").agg(F.min_by("_row", "_at").alias("_row"))
    left = best.join(gone.select(F.col("t").alias("_t"), F.col("t2").alias("_t2")), ["_t", "_t2"], "left_anti")
    return left.select(*(F.col(f"_row.c{k}").alias(c) for k, c in enumerate(names)))
