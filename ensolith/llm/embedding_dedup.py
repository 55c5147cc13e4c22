"""Embedding near-dedup by cover-tree dual traversal.

Equal vectors of a label are one class from the start. Classes of a label are dealt into
cells level by level: a cell of more than ``cell_rows`` classes gets up to FAN centres of its
own, and its classes go to the nearest one, until cells are small or split no further (these are
cut by hash). Centres travel to the classes by the cells' key, never through the driver. A pair
of cells is only visited if their centres are close enough for their covering radii. A visit
builds a cover tree over each node's unit vectors, nested levels whose radii halve, and walks
both trees together: a pair of tree nodes further apart than both radii and the threshold is
dropped with all below. Pairs left at the leaves are compared by cosine in double precision.
A visit returns link counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensolith.llm.blocks import cut
from ensolith.llm.components import components
from ensolith.llm.simhash import union

CELL_ROWS = 4096
#: Centres of a cell that is split, rows of a cell that one task routes at once, and levels at most.
FAN = 64
ROUTED_ROWS = 1 << 16
LEVELS = 6
#: Above the rounding of a few distances of unit vectors.
SLACK = 1e-6
LEAST_BOUND = 1e-5


class CoverTree:
    """levels[k] = (points, parents, radii): nested centres by place, covering radii that halve."""

    def __init__(self, unit: np.ndarray):
        n = len(unit)
        self.unit = unit
        points, member = np.zeros(1, np.int64), np.zeros(n, np.int64)  # member: each vector's node of the level
        dist = _distances(unit, unit[:1])[:, 0]
        self.levels = [(points, np.zeros(1, np.int64), np.array([dist.max()]))]
        bound = 1.0
        while self.levels[-1][2].max() > 0 and bound > LEAST_BOUND:
            centres, parents, radii = [], [], []
            new = np.empty(n, np.int64)
            order = np.argsort(member, kind="stable")
            edges = np.searchsorted(member[order], np.arange(len(points) + 1))
            for node, lead in enumerate(points):
                left = order[edges[node] : edges[node + 1]]
                if self.levels[-1][2][node] == 0:
                    new[left] = len(centres)
                    centres.append(lead)
                    parents.append(node)
                    radii.append(0.0)
                    continue
                first = True
                while len(left):
                    c = lead if first else left[0]
                    first = False
                    d = _distances(unit[left], unit[c : c + 1])[:, 0]
                    d[left == c] = 0.0
                    near = d <= bound
                    new[left[near]] = len(centres)
                    centres.append(c)
                    parents.append(node)
                    radii.append(float(d[near].max(initial=0.0)))
                    left = left[~near]
            points, member = np.array(centres, np.int64), new
            self.levels.append((points, np.array(parents, np.int64), np.array(radii)))
            bound /= 2
        #: Vectors of the last level's nodes (more than one only where they are equal, or almost).
        self.order = np.argsort(member, kind="stable")
        self.edges = np.searchsorted(member[self.order], np.arange(len(points) + 1))

    def below(self, level: int):
        """(order, edges): the children of each node of the level."""
        parents = self.levels[level + 1][1]
        order = np.argsort(parents, kind="stable")
        return order, np.searchsorted(parents[order], np.arange(len(self.levels[level][0]) + 1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _expand(tree: CoverTree, level: int, nodes: np.ndarray):
    """(row of nodes, child) for all children a level down, or the nodes themselves where the tree has ended."""
    if level + 1 >= len(tree.levels):
        return np.arange(len(nodes)), nodes
    order, edges = tree.below(level)
    n = edges[nodes + 1] - edges[nodes]
    row = np.repeat(np.arange(len(nodes)), n)
    return row, order[edges[nodes[row]] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]


def close_pairs(a: CoverTree, b: CoverTree, reach: float, at_once: int = 1 << 20):
    """Chunks (i, j) of places of vectors whose distance may be reach at most."""
    same = a is b
    depth = max(len(a.levels), len(b.levels)) - 1
    todo = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, x, y = todo.pop()
        la, lb = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
        if level == depth:
            na, nb = a.edges[x + 1] - a.edges[x], b.edges[y + 1] - b.edges[y]
            n = na * nb
            pair = np.repeat(np.arange(len(x)), n)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            i, j = a.order[a.edges[x[pair]] + k // nb[pair]], b.order[b.edges[y[pair]] + k % nb[pair]]
            if same:  # two nodes' pairs come once, a node's own twice
                once = (x[pair] != y[pair]) | (i < j)
                i, j = i[once], j[once]
            yield i, j
            continue
        # pairs by their first node: the second nodes' children are compared with its children at once
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        edges = np.append(np.flatnonzero(np.diff(x, prepend=-1)), len(x))
        found_x, found_y, held = [], [], 0
        ra, rb = a.levels[min(level + 1, len(a.levels) - 1)], b.levels[min(level + 1, len(b.levels) - 1)]
        for s, e in zip(edges[:-1], edges[1:]):
            _, left = _expand(a, la, x[s : s + 1])
            _, right = _expand(b, lb, y[s:e])
            step = max(1, at_once // max(1, len(right)))
            for k in range(0, len(left), step):
                own = left[k : k + step]
                near = _distances(a.unit[ra[0][own]], b.unit[rb[0][right]]) <= reach + ra[2][own][:, None] + rb[2][right][None, :]
                if same:
                    near &= own[:, None] <= right[None, :]
                p, q = np.nonzero(near)
                found_x.append(own[p])
                found_y.append(right[q])
                held += len(p)
                if held > at_once:
                    todo.append((level + 1, np.concatenate(found_x), np.concatenate(found_y)))
                    found_x, found_y, held = [], [], 0
        if held:
            todo.append((level + 1, np.concatenate(found_x), np.concatenate(found_y)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _visit(left: pa.Table, right: pa.Table, threshold: float) -> pa.Table:
    """Rows (class, links, root): copies linked to each class in this visit, and the root of its links' tree."""
    same = right is None
    sides = [left] if same else [left, right]
    ids = [t["class_id"].to_numpy() for t in sides]
    copies = [t["copies"].to_numpy() for t in sides]
    raw = [_matrix(t["vec"]) for t in sides]
    norm = [np.sqrt((v * v).sum(axis=1)) for v in raw]
    trees = [CoverTree(v / n[:, None]) for v, n in zip(raw, norm)]
    a, b = trees[0], trees[-1]
    offset = 0 if same else len(ids[0])
    links = np.zeros(len(ids[0]) + (0 if same else len(ids[1])), np.int64)
    labels = np.arange(len(links))
    for i, j in close_pairs(a, b, math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK):
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            cosine = (raw[0][p] * raw[-1][q]).sum(axis=1) / (norm[0][p] * norm[-1][q])
            p, q = p[cosine >= threshold], q[cosine >= threshold]
            np.add.at(links, p, copies[-1][q])
            np.add.at(links, q + offset, copies[0][p])
            labels = union(labels, p, q + offset)
    every = np.concatenate(ids)
    k = np.flatnonzero(links)
    return pa.table({"class_id": every[k], "links": links[k], "root": every[labels[k]]})


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept).

    Vectors link if their labels are equal and not null and their cosine is ``threshold`` or
    more. Vectors that are null, empty or zero, or hold a null or non-finite component, link with
    nothing; so do vectors of different lengths with each other. Equal vectors are classes with
    copies; repeated ids are rows of their own. Rows without an id link like others and carry a
    null component only if no row of it has an id. Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("label"))
    size = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    fit = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (size > 0)
    rows = cut(rows.withColumn("fit", F.coalesce(fit, F.lit(False))).withColumn("dim", F.coalesce(F.size("vec"), F.lit(0))))
    # Rows find their class by the whole digest of label and vector; the classes' numbers are fixed by the checkpoint
    keyed = rows.withColumn("key", F.unhex(F.sha2(F.to_json(F.struct("label", "vec")).cast("binary"), 256)))
    classes = keyed.where("fit").groupBy("key", "label", "dim", "vec").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    classes = cut(classes.withColumn("class_id", F.monotonically_increasing_id()))
    dealt = _in_cells(classes, cell_rows)
    filled = dealt.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / cell_rows).alias("parts"))
    node = F.struct("label", "dim", "cell", F.pmod(F.xxhash64("class_id", F.lit(1)), F.col("parts")).alias("part"))
    dealt = cut(dealt.join(filled, ["label", "dim", "cell"]).withColumn("node", F.xxhash64(node)).select("label", "dim", "node", "class_id", "copies", "vec"))
    centre, radius = _node_balls(dealt)
    balls = cut(centre.join(radius, "node"))
    x, y = balls.alias("x"), balls.alias("y")
    apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.aggregate(F.zip_with("x.centre", "y.centre", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p))))
    pairs = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.dim") == F.col("y.dim")) & (F.col("x.node") <= F.col("y.node")))
    pairs = pairs.where((F.col("x.node") == F.col("y.node")) | (apart <= F.col("x.radius") + F.col("y.radius") + math.acos(min(1.0, threshold)) + 1e-6))
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("node")), F.struct(F.lit(1).alias("side"), F.col("b").alias("node")))
    asked = pairs.select("a", "b", F.inline(F.when(F.col("a") == F.col("b"), F.slice(sides, 1, 1)).otherwise(sides)))
    sent = asked.join(dealt.select("node", "class_id", "copies", "vec"), "node").select("a", "b", "side", "class_id", "copies", "vec")

    def visit(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        p, q = (t.filter(pa.array(side == k)) for k in (0, 1))
        return _visit(p, q if q.num_rows else None, threshold)

    visits = cut(sent.groupBy("a", "b").applyInArrow(visit, "class_id long, links long, root long"))
    reach = components(visits.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    first = classes.select("key", "class_id", "copies", "first").join(reach, classes["class_id"] == reach["node"], "left").withColumn("component", F.coalesce("component", "class_id"))
    first = first.join(visits.groupBy("class_id").agg(F.sum("links").alias("links")), "class_id", "left")
    named = first.groupBy("component").agg(F.min("first").alias("component_id"))
    known = first.join(named, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = keyed.where("not fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    joined = keyed.where("fit").select("id", "key").join(known, "key").select("id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    both = joined.unionByName(alone)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _in_cells(classes: DataFrame, cell_rows: int) -> DataFrame:
    """classes (label, dim, class_id, copies, vec) with a cell each, of cell_rows classes or so where vectors can be told apart."""
    rows = classes.select("label", "dim", "class_id", "copies", "vec", F.lit(0).cast("long").alias("cell"))
    done = None
    for level in range(LEVELS):
        key = ["label", "dim", "cell"]
        sizes = cut(rows.groupBy(*key).count())
        large = sizes.where(F.col("count") > cell_rows)
        small = rows.join(large, key, "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        # centres: those of the smallest hashes among about twice as many as wanted
        large = large.select(*key, F.least(F.lit(FAN), F.ceil(F.col("count") / cell_rows)).alias("fan"), F.col("count").alias("rows"), F.ceil(F.col("count") / ROUTED_ROWS).alias("salts"))
        inside = rows.join(large, key)
        mixed = F.xxhash64("class_id", F.lit(level))
        share = F.least(F.lit(1.0), 2.0 * F.col("fan") / F.col("rows") + 64.0 / F.col("rows"))
        some = inside.where(F.pmod(mixed, F.lit(1 << 30)) < share * (1 << 30))
        centres = some.groupBy(*key, "fan", "salts").agg(F.sort_array(F.collect_list(F.struct(mixed.alias("h"), F.col("class_id"), F.col("vec")))).alias("all"))
        centres = centres.select(*(F.col(c).alias(c) for c in key), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.slice("all.vec", F.lit(1), F.col("fan").cast("int")).alias("centres"))
        salted = inside.withColumn("salt", F.pmod(F.xxhash64("class_id", F.lit(99)), F.col("salts"))).drop("fan", "rows", "salts")
        group = [*key, "salt"]
        rows = cut(salted.groupBy(*group).cogroup(centres.groupBy(*group)).applyInArrow(_to_nearest, rows.schema))
    return done.unionByName(rows)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _to_nearest(rows: pa.Table, centres: pa.Table) -> pa.Table:
    """rows of a cell with the cell of their nearest centre."""
    names = ["label", "dim", "class_id", "copies", "vec", "cell"]
    if not rows.num_rows:
        return rows.select(names)
    c = _unit(np.array(centres["centres"][0].as_py()))
    m = _unit(_matrix(rows["vec"]))
    near = np.concatenate([(m[k : k + 4096] @ c.T).argmax(axis=1) for k in range(0, len(m), 4096)])
    cell = pa.array(rows["cell"].to_numpy() * FAN + near + 1)
    return rows.select(names).set_column(names.index("cell"), "cell", cell)


def _node_balls(dealt: DataFrame):
    """Each node's unit centre and the largest angle from it to a member."""
    unit = F.transform("vec", lambda x: x / F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, p: s + p * p)))
    lead = dealt.groupBy("node", "label", "dim").agg(F.min_by(F.col("vec"), F.col("class_id")).alias("vec"))
    centre = lead.select("node", "label", "dim", unit.alias("centre"))
    dot = F.aggregate(F.zip_with(unit, "centre", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))
    return centre, dealt.select("node", "vec").join(centre.select("node", "centre"), "node").groupBy("node").agg((F.max(angle) + 1e-6).alias("radius"))
