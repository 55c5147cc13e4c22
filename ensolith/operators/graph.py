"""Property-graph queries by iterated joins; each round's frontier is cut from its lineage, so plans do not grow with the hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ensolith.lineage import cut


def upsert_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge for each ordered pair: the latest replaces the others with all it carries."""
    w = Window.partitionBy("src", "dst").orderBy(F.col(order).desc())
    return edges.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def within(edges: DataFrame, start: DataFrame, depth: int, reverse: bool = False, both: bool = False) -> DataFrame:
    """(node, hops): nodes reached from start (column node) in ``depth`` hops at most, by fewest hops."""
    step = edges.select(F.col("dst").alias("_from"), F.col("src").alias("_to")) if reverse else edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to"))
    if both:
        step = step.unionByName(edges.select(F.col("dst").alias("_from"), F.col("src").alias("_to")))
    seen = front = cut(start.select("node").distinct().withColumn("hops", F.lit(0)))
    for k in range(1, depth + 1):
        near = front.join(step, front["node"] == step["_from"]).select(F.col("_to").alias("node")).distinct()
        front = cut(near.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(k)))
        seen = cut(seen.unionByName(front))
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select("node")
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    return out.join(into, "node", "full_outer").select("node", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def simple_paths(edges: DataFrame, start: DataFrame, target: DataFrame, hops: int, relations: list[str] | None = None, inside: DataFrame | None = None) -> DataFrame:
    """(path array, hops): simple directed paths from start nodes to target nodes of ``hops`` edges at most.

    relations: the only ones followed. inside: the only nodes (column node) that may stand between the ends.
    """
    steps = (edges if relations is None else edges.where(F.col("relation").isin(relations))).select("src", "dst")
    paths, found = start.select(F.array("node").alias("path")), None
    for k in range(1, hops + 1):
        last = F.element_at("path", -1)
        if k > 1 and inside is not None:
            paths = paths.join(inside.select(F.col("node").alias("_in")), last == F.col("_in"), "left_semi")
        paths = cut(paths.join(steps, last == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path")))
        hit = paths.join(target.select(F.col("node").alias("_t")), F.element_at("path", -1) == F.col("_t"), "left_semi").withColumn("hops", F.lit(k))
        found = hit if found is None else found.unionByName(hit)
    return found


def shortest_paths(edges: DataFrame, start: str, goals: DataFrame, hops: int) -> DataFrame:
    """(node, path, hops): one shortest path, edges taken either way, from a node to each goal it reaches; ties by the path's order."""
    step = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to")).union(edges.select("dst", "src")).distinct()
    spark = edges.sparkSession
    seen = front = cut(spark.createDataFrame([(start, [start], 0)], "node string, path array<string>, hops int"))
    for k in range(1, hops + 1):
        near = front.join(step, front["node"] == step["_from"]).select(F.col("_to").alias("node"), F.array_append("path", F.col("_to")).alias("path"))
        front = cut(near.groupBy("node").agg(F.min("path").alias("path")).join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(k)))
        seen = cut(seen.unionByName(front))
    return seen.join(goals.select("node").distinct(), "node", "left_semi")


def parameter_edges(parameters: DataFrame) -> DataFrame:
    """Edges of parameters (name, groups array, category): each belongs to its groups, its category contains it."""
    belongs = parameters.select(F.col("name").alias("src"), F.explode("groups").alias("dst"), F.lit("belongs_to").alias("relation"))
    return belongs.unionByName(parameters.where("category is not null").select(F.col("category").alias("src"), F.col("name").alias("dst"), F.lit("contains").alias("relation")))


def counts_by_type(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, n) of nodes by type and edges by relation."""
    n = nodes.groupBy(F.lit("node").alias("kind"), F.col("type")).agg(F.count("*").alias("n"))
    return n.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("relation").alias("type")).agg(F.count("*").alias("n")))


def type_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of two ``counts_by_type``; a type that is missing counts zero."""
    zero = F.lit(0).cast("long")
    j = before.withColumnRenamed("n", "before").join(after.withColumnRenamed("n", "after"), ["kind", "type"], "full_outer")
    return j.select("kind", "type", F.coalesce("before", zero).alias("before"), F.coalesce("after", zero).alias("after"), (F.coalesce("after", zero) - F.coalesce("before", zero)).alias("change"))


def neighbours_of_type(edges: DataFrame, nodes: DataFrame, target: DataFrame, kind: str) -> DataFrame:
    """(node, into): nodes of one type with an edge into the targets (column node)."""
    into = edges.join(target.select(F.col("node").alias("dst")), "dst", "left_semi")
    return into.join(nodes.where(F.col("type") == kind).select(F.col("node").alias("src")), "src", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("into")).distinct()


def find(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, node): the node of each name: exact, else a copy named name_<group>, else by any case; all of the best kind."""
    n = nodes.select("node", F.lower("node").alias("_low"), F.regexp_replace("node", r"_\d+$", "").alias("_bare"))
    ask = names.select("name").distinct()
    exact = ask.join(n, F.col("name") == F.col("node")).select("name", "node", F.lit(0).alias("_k"))
    copies = ask.join(n, (F.col("name") == F.col("_bare")) & (F.col("name") != F.col("node"))).select("name", "node", F.lit(1).alias("_k"))
    cased = ask.join(n, F.lower("name") == F.col("_low")).select("name", "node", F.lit(2).alias("_k"))
    every = exact.unionByName(copies).unionByName(cased)
    best = every.groupBy("name").agg(F.min("_k").alias("_b"))
    return every.join(best, "name").where("_k = _b").select("name", "node").distinct()


def edges_around(edges: DataFrame, nodes: DataFrame, leave_out: list[str]) -> DataFrame:
    """Edges with an end among the nodes, without some relations."""
    own = edges.where(~F.col("relation").isin(leave_out))
    n = nodes.select("node").distinct()
    out = own.join(n.withColumnRenamed("node", "src"), "src", "left_semi")
    return out.unionByName(own.join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")).distinct()


def checked_edges(candidates: DataFrame, nodes: DataFrame, known: DataFrame, shapes: DataFrame) -> DataFrame:
    """candidates (src, dst, relation) with a status: no_source, no_target, known, bad_shape (types and relation not allowed) or new."""
    t = nodes.select("node", "type")
    j = candidates.join(t.select(F.col("node").alias("src"), F.col("type").alias("src_type")), "src", "left").join(t.select(F.col("node").alias("dst"), F.col("type").alias("dst_type")), "dst", "left")
    j = j.join(known.select("src", "dst", F.lit(True).alias("_known")).distinct(), ["src", "dst"], "left").join(shapes.select("src_type", "relation", "dst_type", F.lit(True).alias("_fits")), ["src_type", "relation", "dst_type"], "left")
    status = F.when(F.col("src_type").isNull(), "no_source").when(F.col("dst_type").isNull(), "no_target").when(F.col("_known"), "known").when(F.col("_fits"), "new").otherwise("bad_shape")
    return j.select("src", "dst", "relation", status.alias("status"))


def kept_with_copies(curated: DataFrame, nodes: DataFrame, groups: list[int]) -> DataFrame:
    """Curated edges whose ends both exist, and the same between an end's copies for each group where both of these exist."""
    n = nodes.select("node").distinct()
    both = lambda e: e.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")
    copies = curated.withColumn("_g", F.explode(F.array(*map(F.lit, groups)))).select(F.concat_ws("_", "src", "_g").alias("src"), F.concat_ws("_", "dst", "_g").alias("dst"), "relation")
    return both(curated.select("src", "dst", "relation")).unionByName(both(copies))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge leads to."""
    return nodes.select("node").join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def references(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, variable, kind): variables that a text sets (name=, at the start of a line) or reads ($name or ${name})."""
    sets = F.regexp_extract_all(text_col, F.lit(r"(?m)^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)="), F.lit(1))
    reads = F.regexp_extract_all(text_col, F.lit(r"\$\{?([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    out = None
    for kind, found in (("sets", sets), ("reads", reads)):
        one = texts.select(id_col, F.explode(F.array_distinct(found)).alias("variable"), F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out
