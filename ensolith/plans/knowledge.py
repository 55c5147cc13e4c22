"""Queries of the knowledge side: graph, retrieval, text, stores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ensolith.functions import columns as C
from ensolith.operators import graph as G
from ensolith.operators import retrieval as R
from ensolith.plans.registry import query, table

_EDGES = "SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'contains' AS relation FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'belongs' FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'belongs' FROM supplier"


def _edges(spark, d):
    n, c, s = (table(spark, d, t) for t in ("nation", "customer", "supplier"))
    make = lambda t, p, a, q, b, r: t.select(F.concat(F.lit(p), a).alias("src"), F.concat(F.lit(q), b).alias("dst"), F.lit(r).alias("relation"))
    return make(n, "r", "n_regionkey", "n", "n_nationkey", "contains").unionByName(make(c, "n", "c_nationkey", "c", "c_custkey", "belongs")).unionByName(make(s, "n", "s_nationkey", "s", "s_suppkey", "belongs"))


@query("SELECT src, dst, relation, k FROM (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_returnflag AS relation, l_orderkey * 10 + l_linenumber AS k, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey * 10 + l_linenumber DESC, l_returnflag DESC) AS r FROM lineitem) WHERE r = 1")
def g1_upsert_edges(spark, d):
    """G1: the last edge of an ordered pair replaces the others."""
    e = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return G.upsert_edges(e.withColumn("o", F.struct("k", "relation")), "o").drop("o")


@query(f"WITH RECURSIVE e AS ({_EDGES}), b(node, hops) AS (SELECT 'c5', 0 UNION SELECT e.src, hops + 1 FROM b JOIN e ON e.dst = b.node WHERE hops < 3) SELECT node, min(hops) AS hops FROM b GROUP BY 1")
def g3_reverse_bfs(spark, d):
    """What leads to a node within three hops."""
    start = spark.sql("SELECT 'c5' AS node")
    return G.within(_edges(spark, d), start, 3, reverse=True).withColumn("hops", F.col("hops").cast("long"))


@query(f"WITH e AS ({_EDGES}) SELECT dst AS node, relation FROM e WHERE src = 'r1'")
def g4_out_neighbours(spark, d):
    return _edges(spark, d).where("src = 'r1'").select(F.col("dst").alias("node"), "relation")


@query(f"WITH RECURSIVE e AS ({_EDGES}), u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), b(node, hops) AS (SELECT 's1', 0 UNION SELECT u.b, hops + 1 FROM b JOIN u ON u.a = b.node WHERE hops < 2), n AS (SELECT DISTINCT node FROM b) SELECT src, dst, relation FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)")
def g7_subgraph(spark, d):
    """The edges among nodes within two hops, either way."""
    e = _edges(spark, d)
    return G.induced(e, G.within(e, spark.sql("SELECT 's1' AS node"), 2, both=True)).select("src", "dst", "relation")


_NODES = "SELECT 'r' || r_regionkey AS node, 'region' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier"


def _nodes(spark, d):
    out = None
    for t, key in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey")):
        one = table(spark, d, t).select(F.concat(F.lit(t[0]), key).alias("node"), F.lit(t).alias("type"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH e AS ({_EDGES}) SELECT e1.src || '>' || e1.dst || '>' || e2.dst AS path, 2 AS hops FROM e e1 JOIN e e2 ON e2.src = e1.dst WHERE e1.src IN ('r0', 'r1') AND e2.dst LIKE 's%' AND e2.relation IN ('contains', 'belongs')")
def g10_simple_paths(spark, d):
    """Simple directed paths of three edges at most, by relation, through nations only."""
    e = _edges(spark, d)
    start, to = spark.sql("SELECT * FROM VALUES 'r0', 'r1' AS t(node)"), table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return G.simple_paths(e, start, to, 3, ["contains", "belongs"], _nodes(spark, d).where("type = 'nation'")).select(F.array_join("path", ">").alias("path"), "hops")


@query(f"""WITH RECURSIVE e AS ({_EDGES}), u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), p(node, path, hops) AS (SELECT 's1', ['s1'], 0 UNION ALL SELECT u.b, list_append(path, u.b), hops + 1 FROM p JOIN u ON u.a = p.node WHERE hops < 4 AND NOT list_contains(path, u.b)), k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hops, path) AS r FROM p) SELECT node, array_to_string(path, '>') AS path, hops FROM k WHERE r = 1 AND node LIKE 'r%'""")
def g6_shortest_paths(spark, d):
    """Shortest paths, edges taken either way."""
    return G.shortest_paths(_edges(spark, d), "s1", _nodes(spark, d).where("type = 'region'"), 4).select("node", F.array_join("path", ">").alias("path"), "hops")


@query("SELECT 'p' || p_partkey AS src, p_brand AS dst, 'belongs_to' AS relation FROM part UNION ALL SELECT 'p' || p_partkey, p_type, 'belongs_to' FROM part UNION ALL SELECT 'size' || p_size, 'p' || p_partkey, 'contains' FROM part WHERE p_size > 10")
def g2_parameter_edges(spark, d):
    """The edges a parameter's entry brings."""
    p = table(spark, d, "part")
    return G.parameter_edges(p.select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.array("p_brand", "p_type").alias("groups"), F.when(F.col("p_size") > 10, F.concat(F.lit("size"), "p_size")).alias("category")))


@query(f"WITH e AS ({_EDGES}), n AS ({_NODES}) SELECT 'node' AS kind, type, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', relation, count(*) FROM e GROUP BY 2")
def a49_counts_by_type(spark, d):
    """Nodes by type and edges by relation."""
    return G.counts_by_type(_nodes(spark, d), _edges(spark, d))


@query(f"WITH e AS ({_EDGES}), n AS ({_NODES}), a AS (SELECT 'node' AS kind, type, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', relation, count(*) FROM e GROUP BY 2), b AS (SELECT 'node' AS kind, type, count(*) AS n FROM n WHERE type <> 'region' GROUP BY 2 UNION ALL SELECT 'edge', relation, count(*) FROM e WHERE src <> 'n1' GROUP BY 2) SELECT kind, type, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b USING (kind, type)")
def a50_type_changes(spark, d):
    """How two graphs differ in their counts."""
    n, e = _nodes(spark, d), _edges(spark, d)
    return G.type_changes(G.counts_by_type(n, e), G.counts_by_type(n.where("type <> 'region'"), e.where("src <> 'n1'")))


@query(f"WITH e AS ({_EDGES}), n AS ({_NODES}) SELECT DISTINCT src AS node, dst AS into FROM e JOIN n ON n.node = e.src WHERE n.type = 'nation' AND dst IN ('c1', 'c2', 's1')")
def g5_neighbours_of_type(spark, d):
    """Nodes of a type that lead to some nodes."""
    return G.neighbours_of_type(_edges(spark, d), _nodes(spark, d), spark.sql("SELECT * FROM VALUES 'c1', 'c2', 's1' AS t(node)"), "nation")


@query("SELECT name, node FROM (SELECT 'C7' AS name, 'c7' AS node UNION SELECT 'n3', 'n3' UNION SELECT 'x', 'x_1' UNION SELECT 'x', 'x_2')")
def g9_find(spark, d):
    """A name's node, its copies, or one of another case."""
    more = spark.sql("SELECT * FROM VALUES ('x_1', 'copy'), ('x_2', 'copy'), ('X', 'other') AS t(node, type)")
    return G.find(_nodes(spark, d).unionByName(more), spark.sql("SELECT * FROM VALUES 'C7', 'n3', 'x', 'nothing' AS t(name)"))


@query(f"WITH e AS ({_EDGES}) SELECT src, dst, relation FROM e WHERE relation <> 'contains' AND (src IN ('n1', 's1', 'c3') OR dst IN ('n1', 's1', 'c3'))")
def g9_edges_around(spark, d):
    """A neighbourhood without some relations."""
    return G.edges_around(_edges(spark, d), spark.sql("SELECT * FROM VALUES 'n1', 's1', 'c3' AS t(node)"), ["contains"])


@query(f"WITH e AS ({_EDGES}), c AS (SELECT 'n' || (c_nationkey + c_custkey % 3) AS src, 'c' || c_custkey AS dst, CASE WHEN c_custkey % 5 = 0 THEN 'owns' ELSE 'belongs' END AS relation FROM customer) SELECT c.src, c.dst, c.relation, CASE WHEN substring(c.src, 2)::INT > 24 THEN 'no_source' WHEN e.src IS NOT NULL THEN 'known' WHEN c.relation = 'belongs' THEN 'new' ELSE 'bad_shape' END AS status FROM c LEFT JOIN e ON e.src = c.src AND e.dst = c.dst")
def g12_checked_edges(spark, d):
    """Candidate edges against the graph and the shapes allowed."""
    c = table(spark, d, "customer")
    src = F.concat(F.lit("n"), F.col("c_nationkey") + F.pmod("c_custkey", F.lit(3)))
    cand = c.select(src.alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), F.when(F.col("c_custkey") % 5 == 0, "owns").otherwise("belongs").alias("relation"))
    return G.checked_edges(cand, _nodes(spark, d), _edges(spark, d), spark.sql("SELECT 'nation' AS src_type, 'belongs' AS relation, 'customer' AS dst_type"))


@query("WITH n AS (SELECT 's_' || s_suppkey AS node FROM supplier), c AS (SELECT 's' AS src, 's' AS dst, 'affects' AS relation UNION ALL SELECT 's_1', 's_2', 'affects' UNION ALL SELECT 's_3', 'gone', 'affects') SELECT src, dst, relation FROM c WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n) UNION ALL SELECT c.src || '_' || g, c.dst || '_' || g, relation FROM c, (VALUES (4), (5)) v(g) WHERE c.src || '_' || g IN (SELECT node FROM n) AND c.dst || '_' || g IN (SELECT node FROM n)")
def j7_curated_edges(spark, d):
    """Curated edges whose ends exist, and their copies for each group."""
    n = table(spark, d, "supplier").select(F.concat(F.lit("s_"), "s_suppkey").alias("node"))
    return G.kept_with_copies(spark.sql("SELECT * FROM VALUES ('s', 's', 'affects'), ('s_1', 's_2', 'affects'), ('s_3', 'gone', 'affects') AS t(src, dst, relation)"), n, [4, 5])


@query("SELECT 'r' || r_regionkey AS node FROM region")
def g14_orphans(spark, d):
    """Nodes that nothing leads to."""
    return G.orphans(_nodes(spark, d), _edges(spark, d))


@query("SELECT 's' || s_suppkey AS file, 'A' || s_nationkey AS variable, 'sets' AS kind FROM supplier UNION ALL SELECT 's' || s_suppkey, 'B' || (s_nationkey % 3), 'reads' FROM supplier")
def g13_references(spark, d):
    """Which files set and read a variable."""
    s = table(spark, d, "supplier")
    text = F.concat(F.lit("# x\nexport A"), "s_nationkey", F.lit("=1\nrun ${B"), F.pmod("s_nationkey", F.lit(3)), F.lit("} $B"), F.pmod("s_nationkey", F.lit(3)), F.lit("\n"))
    return G.references(s.select(F.concat(F.lit("s"), "s_suppkey").alias("file"), text.alias("text")), "file", "text")


@query(f"WITH e AS ({_EDGES}), n AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM n GROUP BY 1")
def a49_graph_stats(spark, d):
    """Degrees (nodes of no inbound edge are the orphans)."""
    return G.degrees(_edges(spark, d))


@query("SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS missing FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)")
def j7_edges_without_ends(spark, d):
    """Candidate edges whose end does not exist."""
    known = table(spark, d, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(F.broadcast(known), "c_nationkey", "left_anti").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("missing"))


_Q = "SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0"


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    return e.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).where("query_id % 20 = 0"), e.withColumnRenamed("vec_id", "item_id")


@query(f"WITH q AS ({_Q}), s AS (SELECT query_id, vec_id AS item_id, round(list_dot_product(q, CAST(embedding AS DOUBLE[])) / sqrt(list_dot_product(q, q) * list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS similarity FROM q, embeddings WHERE label < 5) SELECT query_id, item_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM s) WHERE rank <= 5")
def t12_vector_search(spark, d):
    """Nearest items under a filter, for every query of a stated set."""
    q, items = _vectors(spark, d)
    return R.nearest(q, items, 5, F.col("label") < 5, digits=6)


@query("SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1")
def t13_first_per_source(spark, d):
    """One hit for each source, the first in order."""
    return R.first_seen(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), "doc_id"])


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<!--[\s\S]*?-->', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS text FROM pages")
def f1_clean_text(spark, d):
    """Markup and blank lines out."""
    return table(spark, d, "pages").select("page_id", C.clean_text(F.col("html")).alias("text"))


@query()
def f3_chunk_documents(spark, d):
    """Recursive chunks (rows only: the tests check sizes and coverage)."""
    return R.chunks(table(spark, d, "documents"), "doc_id", "text")


@query("WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard FROM t a JOIN t b ON b.item_id = a.item_id + 1")
def f5_jaccard(spark, d):
    """Token overlap of neighbouring items."""
    t = table(spark, d, "benchmark").select("item_id", C.tokens(F.col("text")).alias("w"))
    j = t.alias("a").join(t.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1)
    return j.select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.round(C.jaccard(F.col("a.w"), F.col("b.w")), 6).alias("jaccard"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'BRASS') THEN 'brass' WHEN regexp_matches(p_type, 'STEEL|TIN') THEN 'hard' ELSE 'other' END AS category, regexp_replace(lower(p_name), '_\\d+$', '') AS base_name FROM part")
def f13_categories(spark, d):
    """First-match categories and bare names."""
    return table(spark, d, "part").select("p_partkey", C.first_match(F.col("p_type"), [("BRASS", "brass"), ("STEEL|TIN", "hard")], "other").alias("category"), C.strip_group_suffix(F.col("p_name")).alias("base_name"))


@query("SELECT doc_id, sha256(text) AS h FROM documents")
def f23_hash_identity(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f24_flatten_json(spark, d):
    """nested properties as columns, by a declared schema."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'assistant') AS n_assistant, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1")
def k1_phase_events(spark, d):
    """Counts and last state of each log."""
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))


@query("SELECT doc_id, coalesce(l.quality, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) AS quality, l.doc_id IS NOT NULL AS updated FROM documents FULL JOIN labels l USING (doc_id)")
def k2_store_upsert(spark, d):
    """Knowledge store upsert: updates win, the rest stays."""
    store = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("quality"))
    updates = table(spark, d, "labels").select("doc_id", F.col("quality").alias("new"), F.lit(True).alias("updated"))
    return store.join(updates, "doc_id", "full_outer").select("doc_id", F.coalesce("new", "quality").alias("quality"), F.coalesce("updated", F.lit(False)).alias("updated"))


@query("SELECT item_id, doc_id FROM (SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS k FROM (SELECT item_id, split_part(lower(text), ' ', 3) AS w FROM benchmark) b JOIN (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS w FROM documents) d USING (w)) WHERE k <= 5")
def j14_name_hits(spark, d):
    """Documents that hold a name as a word, the first five each; an equi join on words."""
    b = table(spark, d, "benchmark").select("item_id", F.split_part(F.lower("text"), F.lit(" "), F.lit(3)).alias("w"))
    w = table(spark, d, "documents").select("doc_id", F.explode(C.tokens(F.col("text"))).alias("w"))
    k = Window.partitionBy("item_id").orderBy("doc_id")
    return w.join(b, "w").withColumn("k", F.row_number().over(k)).where("k <= 5").select("item_id", "doc_id")
