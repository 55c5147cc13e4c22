"""Queries of designs, splits, profiles, stores, run states and citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ensolith.operators import designs as D
from ensolith.operators import screening as S
from ensolith.operators import stores as K
from ensolith.operators import validation as V
from ensolith.plans.calibration import _SC, _scored
from ensolith.plans.registry import query, table


@query("WITH n AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, greatest(1, round_even(count(*) * 0.2, 0)) AS k FROM orders) SELECT o_orderkey, o_orderkey > hi - k AS held_out FROM orders, n")
def d9_block_split(spark, d):
    """The tail of the sequence held out."""
    return D.hold_out_end(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2)


@query("SELECT p_partkey, p_retailprice >= (SELECT quantile_cont(p_retailprice, 0.8) FROM part) AS held_out FROM part")
def d9_axis_split(spark, d):
    """The upper tail of one parameter held out."""
    return D.hold_out(table(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("p_retailprice"), 0.2).select("p_partkey", "held_out")


@query("WITH b AS (SELECT min(p_size) AS a, max(p_size) AS z, min(p_retailprice) AS c, max(p_retailprice) AS e FROM part), r AS (SELECT p_partkey, round((abs((p_size - a) / (z - a) - 0.5) + abs((p_retailprice - c) / (e - c) - 0.5)) / 2, 12) AS radius FROM part, b) SELECT p_partkey, round(radius, 6) AS radius, radius >= (SELECT quantile_cont(radius, 0.8) FROM r) AS held_out FROM r")
def d9_shell_split(spark, d):
    """The outer shell of the box held out."""
    s = D.hold_out(D.with_radius(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]), F.col("radius"), 0.2)
    return s.select("p_partkey", F.round("radius", 6).alias("radius"), "held_out")


@query("SELECT s_suppkey, x AS scale, round(s_acctbal * x, 4) AS value FROM supplier, (VALUES (0.5), (1.0), (2.0)) v(x)")
def d11_sweep(spark, d):
    """A design crossed with a sweep."""
    s = D.sweep(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "scale", [0.5, 1.0, 2.0])
    return s.select("s_suppkey", "scale", F.round(F.col("s_acctbal") * F.col("scale"), 4).alias("value"))


@query("WITH p AS (SELECT l_orderkey AS k, l_linenumber AS z, avg(l_extendedprice * (1 - l_discount)) - avg(l_quantity * 1500.0) AS e FROM lineitem GROUP BY ALL), w AS (SELECT *, z - lag(z, 1, 0) OVER (PARTITION BY k ORDER BY z) AS t, exp(-z / (max(z) OVER (PARTITION BY k))::DOUBLE) AS x FROM p) SELECT k AS profile, round(sqrt(avg(e * e)), 7) AS uniform, round(sqrt(sum(t * e * e) / sum(t)), 7) AS thickness, round(sqrt(sum(x * e * e) / sum(x)), 7) AS exponential FROM w GROUP BY 1")
def a22_profile_cost(spark, d):
    """Errors over depth, layers weighted alike, by thickness and by depth."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("profile"), F.col("l_linenumber").alias("depth")).agg(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sim"), F.avg(F.col("l_quantity") * 1500.0).alias("obs"))
    costs = V.profile_costs(p, ["profile"], "depth", F.col("sim"), F.col("obs"))
    return costs.select("profile", *(F.round(c, 7).alias(c) for c in ("uniform", "thickness", "exponential")))


@query("WITH s AS (SELECT l_extendedprice AS x, abs(l_extendedprice - l_quantity * 1500) AS e FROM lineitem), q AS (SELECT quantile_cont(x, [0, 0.25, 0.5, 0.75, 1.0]) AS q FROM s), b AS (SELECT (x >= q[2])::INT + (x >= q[3])::INT + (x >= q[4])::INT AS bin, x, e, q FROM s, q) SELECT CAST(bin AS BIGINT) AS bin, round(any_value(q[bin + 1]), 3) AS low, round(any_value(q[bin + 2]), 3) AS high, count(*) AS n, round(avg(e), 4) AS mean_error, round(median(e), 4) AS median_error FROM b GROUP BY 1")
def w14_boundary_profile(spark, d):
    """Errors by quartile of distance, the last bin closed."""
    s = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("x"), F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1500).alias("e"))
    p = V.boundary_profile(s, "x", "e", 4)
    return p.select("bin", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"), "n", F.round("mean_error", 4).alias("mean_error"), F.round("median_error", 4).alias("median_error"))


@query(f"WITH {_SC}, r AS (SELECT *, row_number() OVER (ORDER BY round(c, 9), case_id) AS k FROM rk), t AS (SELECT case_id FROM r WHERE k <= 20), x AS (SELECT s_suppkey AS case_id, s_acctbal AS x FROM supplier) SELECT round(avg(x) FILTER (case_id IN (SELECT case_id FROM t)), 4) AS best_mean, round(avg(x), 4) AS all_mean, round((avg(x) FILTER (case_id IN (SELECT case_id FROM t)) - avg(x)) / nullif(stddev_pop(x), 0), 6) AS z FROM x")
def a46_threshold_test(spark, d):
    """A parameter's mean among the twenty best cases against all, in standard deviations."""
    best = S.rank_cases(S.score_targets(*_scored(spark, d), tolerance=0.05)).where("rank <= 20").select("case_id", F.lit(True).alias("best"))
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("case_id"), F.col("s_acctbal").alias("x")).join(best, "case_id", "left")
    g = p.agg(F.avg(F.when(F.col("best"), F.col("x"))).alias("b"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return g.select(F.round("b", 4).alias("best_mean"), F.round("m", 4).alias("all_mean"), F.round(F.try_divide(F.col("b") - F.col("m"), F.col("s")), 6).alias("z"))


@query(f"WITH {_SC}, r AS (SELECT *, row_number() OVER (ORDER BY round(c, 9), case_id) AS k FROM rk), b AS (SELECT *, max(n) OVER () AS m, row_number() OVER (ORDER BY n DESC, k) AS p FROM r WHERE k <= 10) SELECT case_id, n AS n_satisfied FROM b WHERE n = m AND p > 1")
def j6_tied_alternatives(spark, d):
    """Of the ten cheapest cases, those that satisfy as many targets as the best one."""
    top = S.rank_cases(S.score_targets(*_scored(spark, d), tolerance=0.05)).where("rank <= 10")
    w = Window.orderBy(F.desc("n_satisfied"), "rank")  # ten rows
    return top.withColumn("p", F.row_number().over(w)).withColumn("m", F.first("n_satisfied").over(w)).where("p > 1 and n_satisfied = m").select("case_id", "n_satisfied")


@query("SELECT arg_min(c_custkey, (c_acctbal, c_custkey)) AS incumbent, min(c_acctbal) AS value FROM customer WHERE c_mktsegment <> 'BUILDING'")
def m25_incumbent(spark, d):
    """The lowest value among viable cases, the lowest index of equal ones."""
    c = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'")
    return c.agg(F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("incumbent"), F.min("c_acctbal").alias("value"))


@query("SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 6) AS log_price, round(ln((l_discount + 0.01) / (0.99 - l_discount)), 6) AS logit, round((l_quantity - avg(l_quantity) OVER w) / stddev_pop(l_quantity) OVER w, 6) AS z, round(l_quantity / max(abs(l_quantity)) OVER w, 6) AS share FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
def f16_transforms(spark, d):
    """Log and logit, standard scores and shares of the largest, by case."""
    li, q = table(spark, d, "lineitem"), F.col("l_quantity")
    # one row for each case, joined back: a window would hold a whole case in one task
    stats = li.groupBy("l_suppkey").agg(F.avg(q).alias("m"), F.stddev_pop(q).alias("s"), F.max(F.abs(q)).alias("top"))
    logit = F.ln((F.col("l_discount") + 0.01) / (0.99 - F.col("l_discount")))
    z, share = F.try_divide(q - F.col("m"), F.col("s")), F.try_divide(q, F.col("top"))
    return li.join(stats, "l_suppkey").select("l_orderkey", "l_linenumber", F.round(F.ln("l_extendedprice"), 6).alias("log_price"), F.round(logit, 6).alias("logit"), F.round(z, 6).alias("z"), F.round(share, 6).alias("share"))


@query("WITH s AS (SELECT l_partkey AS part, l_suppkey AS supp, max(l_quantity) AS value FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL), u AS (SELECT l_partkey AS part, l_suppkey AS supp, arg_max(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) SELECT coalesce(s.part, u.part) AS part, coalesce(s.supp, u.supp) AS supp, CASE WHEN u.part IS NOT NULL THEN u.value ELSE s.value END AS value FROM s FULL JOIN u ON s.part = u.part AND s.supp = u.supp")
def k3_composite_upsert(spark, d):
    """The last update of a composite key replaces its row."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("value"), "l_orderkey", "l_linenumber", "l_returnflag")
    store = li.where("l_returnflag <> 'R'").groupBy("part", "supp").agg(F.max("value").alias("value"))
    return K.upsert(store, li.where("l_returnflag = 'R'"), ["part", "supp"], ["l_orderkey", "l_linenumber", "value"])


@query("SELECT event_id, value AS confidence, event_type = 'click' AS verified FROM events WHERE value >= 60")
def k6_promote(spark, d):
    """K6, K7: staged entries of enough confidence; verified only where somebody vouches."""
    staged = table(spark, d, "events").select("event_id", "value", F.when(F.col("event_type") == "click", F.col("user_id")).alias("verified_by"))
    return K.promote(staged, ["event_id"], F.col("value"), 60)


@query("WITH o AS (SELECT l_orderkey, bool_and(l_linestatus = 'F') AS complete FROM lineitem GROUP BY 1), s AS (SELECT CASE WHEN o_orderstatus = 'F' AND coalesce(complete, false) THEN 'COMPLETED' WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'RUNNING' END AS state FROM orders LEFT JOIN o ON o_orderkey = l_orderkey) SELECT state, count(*) AS n FROM s GROUP BY 1")
def a52_run_states(spark, d):
    """Scheduler states held against the outputs."""
    outputs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.bool_and(F.col("l_linestatus") == "F").alias("complete"))
    states = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderstatus") == "F").alias("terminal"))
    return K.reconcile(states, outputs, "case_id").groupBy("state").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS v FROM lineitem), b AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity * (1 + l_tax) AS v FROM lineitem WHERE l_returnflag <> 'A') SELECT a.k, a.n, CASE WHEN b.v IS NULL THEN 'missing' ELSE 'changed' END AS status FROM a LEFT JOIN b ON a.k = b.k AND a.n = b.n WHERE b.v IS NULL OR abs(a.v - b.v) > 1.005")
def u5_compare_results(spark, d):
    """Results that another run lacks or holds with another value; the left run drives."""
    li = table(spark, d, "lineitem")
    pick = lambda t, v: t.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), v.alias("v"))
    return K.differing(pick(li, F.col("l_quantity")), pick(li.where("l_returnflag <> 'A'"), F.col("l_quantity") * (1 + F.col("l_tax"))), ["k", "n"], "v", 1.005)


@query("WITH c AS (SELECT DISTINCT l_orderkey AS doc, 'part/' || l_partkey || '.src' AS path, CAST(l_quantity AS BIGINT) AS line FROM lineitem) SELECT doc, path, line, CASE WHEN p.p_partkey IS NULL THEN 'missing' WHEN line < 1 OR line > p_size THEN 'out_of_bounds' ELSE 'ok' END AS status FROM c LEFT JOIN (SELECT * FROM part WHERE p_brand <> 'Brand#11') p ON path = 'part/' || p_partkey || '.src'")
def b1_citations(spark, d):
    """B1, B2: cited places taken from texts and held against the files and their lengths."""
    cite = F.concat(F.lit("see (part/"), "l_partkey", F.lit(".src:"), F.col("l_quantity").cast("long"), F.lit(")"))
    texts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), cite.alias("c")).groupBy("doc").agg(F.array_join(F.collect_list("c"), ", ").alias("text"))
    files = table(spark, d, "part").where("p_brand <> 'Brand#11'").select(F.concat(F.lit("part/"), "p_partkey", F.lit(".src")).alias("path"), F.col("p_size").alias("n_lines"))
    return K.check_citations(K.citations(texts, "doc", "text"), files)


@query("WITH h AS (SELECT doc_id, len(regexp_extract_all(lower(text), 'license')) AS a, len(regexp_extract_all(lower(text), 'the')) AS b, len(regexp_extract_all(lower(text), 'apache')) AS c FROM documents) SELECT doc_id, CAST((a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS BIGINT) AS n_matched, a + b + c AS n_hits FROM h WHERE a + b + c > 0")
def b4_keyword_hits(spark, d):
    """Logs by how many keywords they hold, and how often."""
    return K.keyword_hits(table(spark, d, "documents"), "doc_id", "text", ["license", "the", "apache"])
