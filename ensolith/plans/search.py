"""Queries of expected improvement, batches, nearest neighbours and the gate around training points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ensolith.operators import acquisition as A
from ensolith.operators import neighbours as N
from ensolith.plans.registry import query, table

#: What the candidates' means and deviations are held against, and what has been reached.
TARGETS = [A.Band("quantity", 25.0, 0.1), A.Band("price", 38_000.0, 0.2, "log")]
BEST = 0.6


def candidates(spark, d):
    """Parts as candidates: means and deviations of two targets, the second in logarithms, and a chance of being viable."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"))
    g = li.agg(F.avg("l_quantity").alias("m1"), (F.stddev_pop("l_quantity") / F.sqrt(F.count("*"))).alias("s1"), F.avg(F.ln("l_extendedprice")).alias("m2"), (F.stddev_pop(F.ln("l_extendedprice")) / F.sqrt(F.count("*"))).alias("s2"), F.avg((F.col("l_returnflag") != "R").cast("double")).alias("viable"))
    return g


@query()
def m24_band_probability(spark, d):
    """Chance of a normal value in a band (rows only: the tests hold it against the normal distribution)."""
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", A.band_probability(q, F.col("l_linenumber") / 4.0, F.lit(20.0), F.lit(30.0)).alias("p"))


@query()
def m28_scored_candidates(spark, d):
    """Expected improvement over what has been reached, times the chance of being viable (rows only: the tests hold it against dense sums)."""
    s = A.score_candidates(candidates(spark, d), ["m1", "m2"], ["s1", "s2"], "viable", TARGETS, BEST)
    return s.select("p_partkey", "ei", "alpha", "v_mean", "binding")


_APART = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
_PICKS = ", ".join(
    f"p{k} AS MATERIALIZED (SELECT {k} AS pick, arg_max(id, (near, -id)) AS id, max(near) AS distance FROM d{k - 1} WHERE ok), "
    f"d{k} AS MATERIALIZED (SELECT a.id, a.x, a.y, a.ok AND a.id <> b.id AS ok, least(a.near, {_APART}) AS near FROM d{k - 1} a, (SELECT d.id, x, y FROM d{k - 1} d JOIN p{k} ON d.id = p{k}.id) b)"
    for k in range(1, 6)
)


@query(f"WITH c AS (SELECT c_custkey AS id, c_acctbal / 10000 AS x, c_nationkey / 25.0 AS y, c_mktsegment <> 'BUILDING' AS ok FROM customer), s AS (SELECT s_acctbal / 10000 AS x, s_nationkey / 25.0 AS y FROM supplier), d0 AS MATERIALIZED (SELECT a.id, a.x, a.y, a.ok, min({_APART}) AS near FROM c a, s b GROUP BY ALL), {_PICKS} SELECT CAST(pick AS INTEGER) AS pick, id, round(distance, 9) AS distance FROM ({' UNION ALL '.join(f'SELECT * FROM p{k}' for k in range(1, 6))})")
def m27_maximin_batch(spark, d):
    """Five customers, each as far as can be from all suppliers and the ones before."""
    point = lambda balance, nation: F.array(F.col(balance) / 10000, F.col(nation) / 25.0)
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), point("c_acctbal", "c_nationkey").alias("u"), F.lit(1.0).alias("weight"), (F.col("c_mktsegment") != "BUILDING").alias("admissible"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), point("s_acctbal", "s_nationkey").alias("u"))
    return A.maximin_batch(c, s, 5).select("pick", "id", F.round("distance", 9).alias("distance"))


_DAMPED = ", ".join(
    f"p{k} AS MATERIALIZED (SELECT {k} AS pick, arg_max(id, (alpha, -id)) AS id, max(alpha) AS alpha FROM d{k - 1} WHERE alpha IS NOT NULL), "
    f"e{k} AS MATERIALIZED (SELECT a.*, {_APART} AS d, b.id AS pick FROM d{k - 1} a, (SELECT d.id, x, y FROM d{k - 1} d JOIN p{k} ON d.id = p{k}.id) b), "
    f"d{k} AS MATERIALIZED (SELECT id, x, y, CASE WHEN d > 0.1 AND id <> pick THEN alpha * (1 - exp(-0.5 * (d / greatest(m, 1e-9)) ** 2)) END AS alpha FROM e{k}, (SELECT median(d) AS m FROM e{k}))"
    for k in range(1, 5)
)


@query(f"WITH d0 AS MATERIALIZED (SELECT p_partkey AS id, p_size / 50.0 AS x, p_retailprice / 1000 AS y, CASE WHEN p_brand <> 'Brand#11' THEN p_retailprice / (1000 + p_size) END AS alpha FROM part), {_DAMPED} SELECT CAST(pick AS INTEGER) AS pick, id, round(alpha, 8) AS alpha FROM ({' UNION ALL '.join(f'SELECT * FROM p{k}' for k in range(1, 5))})")
def m27_penalised_batch(spark, d):
    """Four parts of the largest value, what is near a pick damped."""
    p = table(spark, d, "part")
    c = p.select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 1000).alias("u"), F.when(F.col("p_brand") != "Brand#11", F.col("p_retailprice") / (1000 + F.col("p_size"))).alias("alpha"))
    return A.penalised_batch(c, 4, 0.1).select("pick", "id", F.round("alpha", 8).alias("alpha"))


_VEC = "t0 AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label = 1), q0 AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0)"
_UNIT = (
    f"{_VEC}, st AS (SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS s FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS i FROM t0) GROUP BY i), ml AS (SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM st), "
    "t AS MATERIALIZED (SELECT vec_id, [(z[1] - z[2]) / z[3] FOR z IN list_zip(v, m, s)] AS v FROM t0, ml), q AS MATERIALIZED (SELECT vec_id, [(z[1] - z[2]) / z[3] FOR z IN list_zip(v, m, s)] AS v FROM q0, ml), "
    "s AS (SELECT a.vec_id, list_distance(a.v, b.v) AS x, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM t a JOIN t b ON a.vec_id <> b.vec_id), "
    "g AS (SELECT quantile_cont(x, 0.99) AS limit_ FROM s WHERE r = 5), "
    "p AS (SELECT q.vec_id, list_distance(q.v, t.v) AS x, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) AS r FROM q, t)"
)


def _training(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    return e.where("label = 1").select(F.col("vec_id").alias("item_id"), "v"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


@query(f"WITH {_UNIT} SELECT vec_id AS query_id, round(x, 5) AS distance, x <= limit_ AS inside FROM p, g WHERE r = 5")
def m3_hull_gate(spark, d):
    """M3: is a point as near to the training points as these are to each other, on standardised axes."""
    return N.hull_gate(*_training(spark, d)).select("query_id", F.round("distance", 5).alias("distance"), "inside")


@query(f"WITH {_UNIT} SELECT round(avg((x <= limit_)::INT), 9) AS on_manifold, count(*) AS n FROM p, g WHERE r = 5")
def m15_share_inside(spark, d):
    """The share of predicted vectors that the training vectors reach."""
    return N.share_inside(*_training(spark, d)).select(F.round("on_manifold", 9).alias("on_manifold"), "n")


@query(f"WITH {_VEC} SELECT vec_id AS query_id, arg_min(item, (x, item)) AS item_id, round(min(x), 5) AS distance FROM (SELECT q.vec_id, t.vec_id AS item, list_max(list_transform(range(1, 65), lambda i: abs(q.v[i] - t.v[i]))) AS x FROM q0 q, t0 t) GROUP BY 1")
def m26_min_distance(spark, d):
    """Nearest training point by the largest difference of any component."""
    t, q = _training(spark, d)
    return N.nearest(q, t, 1, "largest").select("query_id", "item_id", F.round("distance", 5).alias("distance"))


@query("WITH p AS (SELECT p_partkey AS id, p_size / 50.0 AS x, p_retailprice / 1000 AS y FROM part), s AS (SELECT a.id, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS d FROM p a JOIN p b ON a.id <> b.id), k AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS r FROM s) SELECT round(median(d), 9) AS radius FROM k WHERE r = 10")
def m26_density_radius(spark, d):
    """The median distance to the tenth nearest other part."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 1000).alias("v"))
    return N.density_radius(p).select(F.round("radius", 9).alias("radius"))
