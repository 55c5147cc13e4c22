"""Queries of budgets, competition, limitation, fidelity and store cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ensolith.operators import budgets as B
from ensolith.plans.registry import query, table


def _round(df, digits, *names):
    return df.withColumns({c: F.round(c, digits) for c in names})


_BUDGET = "h AS (SELECT l_suppkey AS case_id, year(l_shipdate) * 12 + month(l_shipdate) AS m, l_quantity AS flow, CASE l_returnflag WHEN 'N' THEN 'in' WHEN 'A' THEN 'out' ELSE 'other' END AS kind, l_extendedprice / 1000 AS pool FROM lineitem), mo AS (SELECT case_id, m, coalesce(sum(flow) FILTER (kind = 'in'), 0) AS i, coalesce(sum(flow) FILTER (kind = 'out'), 0) AS o, avg(pool) AS pool FROM h GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY m) AS k, count(*) OVER (PARTITION BY case_id) AS n FROM mo), b AS (SELECT case_id, avg(i) * 12 AS inflow, avg(o) * 12 AS outflow, (avg(pool) FILTER (k > n - 12) - avg(pool) FILTER (k <= 12)) / greatest(1.0, any_value(n) / 12) AS change FROM p GROUP BY 1), r AS (SELECT *, inflow - outflow - change AS residual, CASE WHEN inflow > 0 THEN (inflow - outflow - change) / inflow WHEN abs(inflow - outflow - change) < 1e-10 THEN 0 ELSE 'inf'::DOUBLE END AS relative FROM b)"


@query(f"WITH {_BUDGET} SELECT case_id, round(inflow, 4) AS inflow, round(outflow, 4) AS outflow, round(change, 9) AS change, round(residual, 8) AS residual, round(relative, 6) AS relative, abs(relative) < 0.1 AS closed FROM r")
def a36_budget_closure(spark, d):
    """Flows against the change of the pool, both per year."""
    kind = F.when(F.col("l_returnflag") == "N", "in").when(F.col("l_returnflag") == "A", "out").otherwise("other")
    h = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("m"), F.col("l_quantity").alias("flow"), kind.alias("kind"), (F.col("l_extendedprice") / 1000).alias("pool"))
    out = B.closure(B.budget(h, ["case_id"], "m", "flow", "kind", "pool"))
    return _round(_round(_round(_round(out, 4, "inflow", "outflow"), 6, "relative"), 9, "change"), 8, "residual")


@query("WITH g AS (SELECT l_suppkey AS case_id, l_returnflag AS grp, sum(l_quantity) AS uptake, sum(l_linenumber * 8.0) AS demand FROM lineitem GROUP BY ALL), s AS (SELECT *, uptake / sum(uptake) OVER (PARTITION BY case_id) AS share, uptake / nullif(demand, 0) AS met FROM g) SELECT case_id, grp, round(share, 6) AS share, round(met, 6) AS met, row_number() OVER (PARTITION BY case_id ORDER BY share DESC NULLS LAST, grp) = 1 AS dominant, row_number() OVER (PARTITION BY case_id ORDER BY met NULLS LAST, grp) = 1 AND met IS NOT NULL AS most_limited FROM s")
def a37_competition(spark, d):
    """Shares of uptake, supply of demand, the dominant and the most limited group."""
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_returnflag").alias("grp"), "l_quantity", (F.col("l_linenumber") * 8.0).alias("demand"))
    return _round(B.competition(s, ["case_id"], "grp", "l_quantity", "demand"), 6, "share", "met").select("case_id", "grp", "share", "met", "dominant", "most_limited")


@query("WITH g AS (SELECT l_suppkey AS case_id, avg(l_quantity) AS mean, stddev_pop(l_quantity) / abs(avg(l_quantity)) AS cv, avg(l_discount * 16) AS n, avg(l_tax * 20) AS p FROM lineitem GROUP BY 1) SELECT case_id, round(mean, 6) AS mean, round(cv, 6) AS cv, cv < 0.1 AS fixed, CASE WHEN n < p AND n < 0.95 THEN 'N' WHEN p < n AND p < 0.95 THEN 'P' WHEN n < 0.95 AND p < 0.95 THEN 'co-limited' ELSE 'none' END AS limitation FROM g")
def a40_allocation(spark, d):
    """Allocation, its variation, and what limits it."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), "l_quantity", (F.col("l_discount") * 16).alias("n"), (F.col("l_tax") * 20).alias("p"))
    return _round(B.allocation(li, ["case_id"], "l_quantity", "n", "p"), 6, "mean", "cv")


#: The tail of Student's density in the angle whose tangent is t over the root of the freedom, by Simpson's rule.
_TAIL = "SELECT g.nation, sum(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * cos(a + (pi() / 2 - a) * i / 4000) ** (f - 1)) * (any_value(pi() / 2 - a)) / 12000 * 2 * exp(any_value(lgamma((f + 1) / 2) - lgamma(f / 2))) / sqrt(pi()) AS p FROM g, (SELECT unnest(range(4001)) AS i) GROUP BY 1"


@query(f"WITH c AS (SELECT c_nationkey AS nation, count(*) AS n, corr(c_acctbal, c_custkey) AS r FROM customer GROUP BY 1), s AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c), g AS (SELECT nation, n - 2.0::DOUBLE AS f, atan(abs(t) / sqrt(n - 2)) AS a FROM s WHERE n > 2), p AS ({_TAIL}) SELECT nation, n, round(r, 6) AS r, CASE WHEN n > 2 THEN round(t, 5) END AS t, round(p, 6) AS p, coalesce(n >= 10 AND abs(r) > 0.3 AND p < 0.05, false) AS supported FROM s LEFT JOIN p USING (nation)")
def a45_correlation_test(spark, d):
    """Hypotheses of a link, tested by correlation, one for each nation."""
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "nation")
    return _round(_round(B.correlation_test(c, "c_acctbal", "c_custkey", ["nation"]), 6, "r", "p"), 5, "t")


@query("WITH s AS (SELECT p_partkey AS k, p_retailprice AS t, p_size * 20.0 AS p FROM part), r AS (SELECT k, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS b, row_number() OVER (ORDER BY t, k) AS x, row_number() OVER (ORDER BY p, k) AS y FROM s) SELECT count(*) AS n, round(corr(a, b), 6) AS spearman, round(count(*) FILTER (x <= 20 AND y <= 20) / 20.0, 6) AS recall FROM r")
def m13_ranking_fidelity(spark, d):
    """Spearman and recall of the best twenty."""
    s = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("t"), (F.col("p_size") * 20.0).alias("p"))
    return _round(B.ranking_fidelity(s, "k", "t", "p", 20), 6, "spearman", "recall")


@query("WITH f AS (SELECT o_custkey % 7 AS approach, o_orderkey AS experiment_id, 'known' AS why FROM orders WHERE o_orderkey % 5 = 0), n AS (SELECT o_custkey % 7 AS approach, o_orderkey AS experiment_id, o_orderpriority AS why FROM orders WHERE o_orderstatus = 'P') SELECT * FROM f UNION ALL SELECT * FROM n WHERE experiment_id % 5 <> 0")
def k1_cascade(spark, d):
    """K1: catastrophic experiments become failed approaches."""
    o = table(spark, d, "orders").select(F.pmod("o_custkey", F.lit(7)).alias("approach"), F.col("o_orderkey").alias("experiment_id"), F.when(F.col("o_orderstatus") == "P", "CATASTROPHIC").otherwise("OK").alias("outcome"), F.col("o_orderpriority").alias("lesson"))
    return B.cascaded(o, o.where("experiment_id % 5 = 0").select("approach", "experiment_id", F.lit("known").alias("why")))


@query("WITH s AS (SELECT n_nationkey AS k, ['a', 'b'] AS notes FROM nation WHERE n_nationkey < 20), n AS (SELECT s_nationkey AS k, list_sort(list(DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'b' ELSE 'c' || (s_suppkey % 3) END)) AS m FROM supplier GROUP BY 1) SELECT k, array_to_string(CASE WHEN notes IS NULL THEN m WHEN m IS NULL THEN notes ELSE list_concat(notes, list_filter(m, lambda x: NOT list_contains(notes, x))) END, ',') AS notes FROM s FULL JOIN n USING (k)")
def k4_appended_notes(spark, d):
    """K4, K5: notes added behind those an entry has, each once."""
    store = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("k"), F.array(F.lit("a"), F.lit("b")).alias("notes"))
    key = F.col("s_suppkey") % 3
    notes = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.when(key == 0, "b").otherwise(F.concat(F.lit("c"), key.cast("string"))).alias("note"))
    return B.appended(store, notes, "k").select("k", F.array_join("notes", ",").alias("notes"))


@query("SELECT p_partkey, p_brand AS \"id.brand\", p_size AS \"id.size\", p_type || ',' || p_name AS \"names\" FROM part")
def f24_flattened(spark, d):
    """nested metadata as scalar columns by dotted names."""
    m = table(spark, d, "part").select("p_partkey", F.struct(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("id"), F.array("p_type", "p_name").alias("names")).alias("m"))
    return m.select("p_partkey", *(c.alias(n) for n, c in B.flattened(F.col("m"), m.schema["m"].dataType).items()))


@query("SELECT p_partkey, 'name: ' || p_partkey || '; units: ' || p_brand || '; range: ' || p_size || ' to ' || (p_size + 5) || CASE WHEN p_partkey % 4 = 0 THEN '; note: ' || p_type ELSE '' END AS text FROM part")
def s31_described(spark, d):
    """A text for each catalog entry with its curated note."""
    p = table(spark, d, "part")
    return B.described(p.select("p_partkey", F.col("p_brand").alias("units"), F.col("p_size").alias("low"), (F.col("p_size") + 5).alias("high")), p.where("p_partkey % 4 = 0").select("p_partkey", F.col("p_type").alias("note")), "p_partkey")
