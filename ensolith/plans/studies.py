"""Queries of rounds, cases and names compared with each other.

Stand-ins: a round is a return flag, a case a supplier or an order, a parameter a line number or a size.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ensolith.operators import rounds as R
from ensolith.plans.registry import query, table

_ROUNDS = "a AS (SELECT l_suppkey AS case_id, l_linenumber AS target, avg(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey % 3 <> 0 GROUP BY ALL), b AS (SELECT l_suppkey AS case_id, l_linenumber AS target, avg(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 5 <> 0 GROUP BY ALL)"


def _pairs(spark, d):
    li = table(spark, d, "lineitem")
    pick = lambda c: li.where(c).groupBy(F.col("l_suppkey").alias("case_id"), F.col("l_linenumber").alias("nr")).agg(F.avg("l_quantity").alias("v"))
    return R.paired_rounds(pick("l_returnflag = 'A' AND l_orderkey % 3 <> 0"), pick("l_returnflag = 'R' AND l_orderkey % 5 <> 0"), ["case_id", "nr"], "v")


@query(f"WITH {_ROUNDS} SELECT case_id, target, round(a.v, 6) AS source, round(b.v, 6) AS target_value, CASE WHEN a.v IS NULL THEN 'src_missing' WHEN b.v IS NULL THEN 'tgt_missing' ELSE 'ok' END AS status FROM a FULL JOIN b USING (case_id, target)")
def j4_paired_rounds(spark, d):
    """Source and target round by case and target, with a status."""
    return _pairs(spark, d).select("case_id", F.col("nr").alias("target"), F.round("source", 6).alias("source"), F.round("target", 6).alias("target_value"), "status")


@query(f"WITH {_ROUNDS}, p AS (SELECT target, a.v AS s, b.v AS t, b.v - a.v AS d FROM a JOIN b USING (case_id, target)) SELECT target, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(stddev_pop(d), 6) AS sd, round(min(d), 6) AS low, round(max(d), 6) AS high, count(*) FILTER (d < 0) AS improved, count(*) FILTER (d > 0) AS degraded, count(*) FILTER (t < 20 AND NOT s < 20) AS gained, count(*) FILTER (NOT t < 20 AND s < 20) AS lost FROM p GROUP BY 1")
def a32_round_changes(spark, d):
    """Statistics of the changes between two rounds."""
    out = R.round_changes(_pairs(spark, d), ["nr"], F.col("target") < 20, F.col("source") < 20)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "sd", "low", "high")}).withColumnRenamed("nr", "target")


_DIFF = "g AS (SELECT l_orderkey AS case_id, l_linenumber AS parameter, avg(l_quantity) AS value FROM lineitem GROUP BY ALL), s AS (SELECT parameter, min(value) AS low, max(value) AS high FROM g GROUP BY 1), r AS (SELECT min(case_id) AS r FROM g WHERE case_id IN (SELECT case_id FROM g WHERE parameter = 5)), f AS (SELECT g.case_id, g.parameter, g.value - b.value AS diff, 100 * (g.value - b.value) / (high - low) AS pct FROM g JOIN (SELECT parameter, value FROM g, r WHERE case_id = r) b USING (parameter) JOIN s USING (parameter), r WHERE g.case_id <> r)"


def _differences(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("parameter")).agg(F.avg("l_quantity").alias("value"))
    reference = g.where("parameter = 5").agg(F.min("case_id")).first()[0]
    return R.case_differences(g, g.groupBy("parameter").agg(F.min("value").alias("low"), F.max("value").alias("high")), F.col("case_id") == reference)


@query(f"WITH {_DIFF} SELECT case_id, parameter, round(diff, 6) AS diff, round(pct, 6) AS pct FROM f")
def j5_case_differences(spark, d):
    """Each case's parameters against a reference case, in percent of the range."""
    return _differences(spark, d).select("case_id", "parameter", F.round("diff", 6).alias("diff"), F.round("pct", 6).alias("pct"))


@query(f"WITH {_DIFF} SELECT case_id, parameter, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(abs(pct), 9) DESC, parameter) AS rank FROM f WHERE round(abs(pct), 9) >= 20) WHERE rank <= 2")
def t8_largest_differences(spark, d):
    """The two largest differences of each case."""
    f = _differences(spark, d).withColumn("pct", F.round("pct", 9))
    return R.largest_differences(f, 2, 20.0).select("case_id", "parameter", "rank")


@query(f"WITH {_DIFF} SELECT parameter, count(*) AS n, round(avg(pct), 6) AS mean_pct FROM f WHERE round(abs(pct), 9) >= 20 GROUP BY 1")
def a33_consistent_differences(spark, d):
    """Parameters that many cases differ in."""
    f = _differences(spark, d).withColumn("pct", F.round("pct", 9))
    return R.consistent_differences(f, 20.0).withColumn("mean_pct", F.round("mean_pct", 6))


@query("WITH g AS (SELECT p_type AS parameter, p_brand AS grp, max(p_size) AS v FROM part GROUP BY ALL) SELECT parameter, max(v) FILTER (grp = 'Brand#11') AS b11, max(v) FILTER (grp = 'Brand#12') AS b12, round((max(v) FILTER (grp = 'Brand#11') + max(v) FILTER (grp = 'Brand#12')) / 2.0, 4) AS mean FROM g GROUP BY 1 HAVING max(v) FILTER (grp = 'Brand#11') IS NOT NULL AND max(v) FILTER (grp = 'Brand#12') IS NOT NULL")
def j3_combined_rankings(spark, d):
    """The groups' tables merged on the parameters all of them have."""
    g = table(spark, d, "part").groupBy(F.col("p_type").alias("parameter"), F.col("p_brand").alias("grp")).agg(F.max("p_size").alias("v"))
    out = R.combined_rankings(g, ["Brand#11", "Brand#12"], "v").withColumn("mean", F.round("mean", 4))
    return out.withColumnsRenamed({"Brand#11": "b11", "Brand#12": "b12"})


@query("WITH s AS (SELECT e AS estimator, p_type AS input, CASE e WHEN 'a' THEN avg(p_size) WHEN 'b' THEN max(p_size) ELSE sum(p_size) END AS v FROM part, (VALUES ('a'), ('b'), ('c')) t(e) GROUP BY e, p_type) SELECT input, round(avg(r), 6) AS rank FROM (SELECT input, row_number() OVER (PARTITION BY estimator ORDER BY v DESC, input) AS r FROM s WHERE estimator IN ('a', 'b')) GROUP BY 1")
def w11_consensus_ranks(spark, d):
    """Mean of the ranks that estimators give."""
    g = table(spark, d, "part").groupBy(F.col("p_type").alias("input")).agg(F.avg("p_size").alias("a"), F.max("p_size").cast("double").alias("b"), F.sum("p_size").cast("double").alias("c"))
    s = g.select("input", F.explode(F.map_from_arrays(F.array(*map(F.lit, "abc")), F.array("a", "b", "c"))).alias("estimator", "value"))
    return R.consensus_ranks(s, ["a", "b"]).withColumn("rank", F.round("rank", 6))


_NAMES = "a AS (SELECT DISTINCT c_mktsegment || '_' || n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey), b AS (SELECT DISTINCT replace(c_mktsegment, 'I', 'Y') || n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 0), ga AS (SELECT name AS a, unnest(list_distinct([substring('  ' || lower(name) || ' ', CAST(i AS INT), 3) FOR i IN range(1, length(name) + 2)])) AS g FROM a), gb AS (SELECT name AS b, unnest(list_distinct([substring('  ' || lower(name) || ' ', CAST(i AS INT), 3) FOR i IN range(1, length(name) + 2)])) AS g FROM b), m AS (SELECT a, b, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS ratio FROM (SELECT DISTINCT a, b FROM ga JOIN gb USING (g)) WHERE 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.7)"


def _names(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    a = c.select(F.concat_ws("_", "c_mktsegment", "n_name").alias("name")).distinct()
    return a, c.where("n_nationkey % 2 = 0").select(F.concat(F.replace("c_mktsegment", F.lit("I"), F.lit("Y")), "n_name").alias("name")).distinct()


@query(f"WITH {_NAMES} SELECT a, b, round(ratio, 6) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY ratio DESC, b) AS x, row_number() OVER (PARTITION BY b ORDER BY ratio DESC, a) AS y FROM m) WHERE x = 1 AND y = 1")
def j9_renames(spark, d):
    """Names that are each other's best match."""
    return R.renames(*_names(spark, d), 0.7).withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {_NAMES} SELECT a, b, round(ratio, 6) AS ratio, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY ratio DESC, b) AS rank FROM m) WHERE rank <= 2")
def t15_suggestions(spark, d):
    """The closest known names of each missing one."""
    return R.suggestions(*_names(spark, d), 2, 0.7).withColumn("ratio", F.round("ratio", 6))


@query("WITH p AS (SELECT p_brand AS profile, p_size AS name, list(DISTINCT lower(trim(p_type))) AS t FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY ALL), g AS (SELECT name, count(DISTINCT list_sort(t)) AS n_kinds, count(DISTINCT profile) AS n_profiles FROM p GROUP BY 1) SELECT name, n_kinds, n_profiles, CASE WHEN n_profiles < (SELECT count(DISTINCT profile) FROM p) THEN 'missing' ELSE 'drift' END AS status FROM g WHERE n_profiles < (SELECT count(DISTINCT profile) FROM p) OR n_kinds > 1")
def u6_tag_drift(spark, d):
    """Entries whose tags differ between profiles."""
    p = table(spark, d, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13"))
    return R.tag_drift(p.groupBy(F.col("p_brand").alias("profile"), F.col("p_size").alias("name")).agg(F.collect_set("p_type").alias("tags")))


@query("WITH a AS (SELECT o_orderkey AS t, o_totalprice AS v FROM orders WHERE o_orderkey < 500), b AS (SELECT o_orderkey AS t, o_totalprice AS v FROM orders WHERE o_orderkey BETWEEN 1 AND 900) SELECT t, v, 'spinup' AS phase FROM a UNION ALL SELECT t + (SELECT max(t) + 1 FROM a), v, 'transient' FROM b")
def s14_phases_joined(spark, d):
    """One series over several phases."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("t"), F.col("o_totalprice").alias("v"))
    return R.phases_joined([("spinup", o.where("t < 500")), ("transient", o.where("t BETWEEN 1 AND 900"))], "t")


@query("WITH r AS (SELECT n_nationkey AS round, n_regionkey AS source_round, n_nationkey % 2 = 1 AS has FROM nation) SELECT r.round, CASE WHEN r.has THEN r.round WHEN s.has THEN r.source_round END AS use_round, CASE WHEN r.has THEN 'own' WHEN s.has THEN 'source' ELSE 'none' END AS origin FROM r LEFT JOIN r s ON s.round = r.source_round")
def s15_resolved_rounds(spark, d):
    """A round's own results, or those of its source round."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("round"), F.col("n_regionkey").alias("source_round"), (F.col("n_nationkey") % 2 == 1).alias("has_results"))
    return R.resolved_rounds(n)


@query("SELECT s_suppkey, s_nationkey AS nation, CASE WHEN s_suppkey % 2 = 0 THEN -1.0 ELSE s_acctbal END AS acctbal, CASE WHEN s_suppkey % 2 = 0 THEN 7.0 END AS extra FROM supplier")
def u3_merged_maps(spark, d):
    """Stored entries with updates over them."""
    s = table(spark, d, "supplier")
    base = F.create_map(F.lit("acctbal"), F.col("s_acctbal"))
    updates = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("acctbal"), F.lit(-1.0), F.lit("extra"), F.lit(7.0))).otherwise(F.create_map().cast("map<string,double>"))
    m = s.select("s_suppkey", F.col("s_nationkey").alias("nation"), R.merged_maps(base, updates).alias("m"))
    return m.select("s_suppkey", "nation", F.try_element_at("m", F.lit("acctbal")).alias("acctbal"), F.try_element_at("m", F.lit("extra")).alias("extra"))


@query("WITH p AS (SELECT DISTINCT p_type AS parameter FROM part WHERE p_size < 25), c AS (SELECT DISTINCT p_type AS parameter FROM part WHERE p_size < 3), l AS (SELECT p_type AS parameter, count(*) AS n_proposed FROM part WHERE p_size > 30 GROUP BY 1) SELECT parameter, n_proposed FROM p JOIN l USING (parameter) WHERE n_proposed >= 2 AND parameter NOT IN (SELECT parameter FROM c)")
def u8_dropped_parameters(spark, d):
    """U8: parameters dropped though they were proposed before."""
    p = table(spark, d, "part").withColumnRenamed("p_type", "parameter")
    return R.dropped_parameters(p.where("p_size < 25").select("parameter").distinct(), p.where("p_size < 3").select("parameter").distinct(), p.where("p_size > 30").groupBy("parameter").agg(F.count("*").alias("n_proposed")))
