"""Queries of case evaluation: points from monthly series, costs by target, composites, gates and pools.

Stand-ins: a case is a supplier, a target a return flag, a series the monthly quantities since
January 1995, an observed point the mean over all cases times a factor.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ensolith.operators import evaluation as E
from ensolith.plans.registry import query, table

_SERIES = "s AS (SELECT l_suppkey AS case_id, l_returnflag AS target, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS BIGINT) AS i, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"
_WINDOWS = "w AS (SELECT target, point, (y - 1995) * 12 + unnest(m) - 1 AS i FROM (VALUES ('A', 1, 1996, [6, 7, 8]), ('A', 2, 1997, [6, 7, 8]), ('R', 1, 1996, [1, 2]), ('N', 1, 1999, [4]), ('N', 2, 2000, [4, 5])) v(target, point, y, m))"
_POINTS = f"{_SERIES}, {_WINDOWS}, need AS (SELECT target, count(*) AS n FROM w GROUP BY 1), pp AS (SELECT case_id, w.target, point, avg(value) * 0.5 AS sim, count(value) AS n FROM w JOIN s ON s.target = w.target AND s.i = w.i GROUP BY ALL), whole AS (SELECT case_id, pp.target FROM pp JOIN need USING (target) GROUP BY case_id, pp.target HAVING sum(pp.n) = any_value(need.n)), p AS (SELECT case_id, target, point, sim FROM pp JOIN whole USING (case_id, target))"


def _series(spark, d):
    li = table(spark, d, "lineitem")
    index = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("long")
    return E.group_series(li.select(F.col("l_suppkey").alias("case_id"), F.col("l_returnflag").alias("target"), index.alias("index"), F.col("l_quantity").alias("value")), ["case_id", "target", "index"])


def _windows(spark):
    rows = [("A", 1, 1996, [6, 7, 8]), ("A", 2, 1997, [6, 7, 8]), ("R", 1, 1996, [1, 2]), ("N", 1, 1999, [4]), ("N", 2, 2000, [4, 5])]
    return E.monthly_indices(spark.createDataFrame(rows, "target string, point int, year int, months array<int>"), 1995)


def _points(spark, d):
    return E.window_points(_series(spark, d), _windows(spark), 0.5)


@query(f"WITH {_WINDOWS} SELECT target, CAST(point AS INT) AS point, CAST(i AS BIGINT) AS index FROM w")
def p5_observation_windows(spark, d):
    """P5: years and months to indices of a monthly series."""
    return _windows(spark)


@query(f"WITH {_POINTS} SELECT case_id, target, CAST(point AS INT) AS point, round(sim, 6) AS sim FROM p")
def a8_window_points(spark, d):
    """Sums over groups, means over windows; targets with a gap in any window drop out."""
    return _points(spark, d).withColumn("sim", F.round("sim", 6))


@query("WITH r(alias, variable, level, factor) AS (VALUES ('A', 'biomass', 'group', 0.5), ('ECO', 'carbon', 'site', 2.0), ('R', 'roots', 'group', 1.0)) SELECT l_returnflag AS key, count(*) AS n, any_value(variable) AS variable, any_value(level) AS level, round(sum(l_quantity * factor), 2) AS total FROM lineitem JOIN r ON alias = l_returnflag GROUP BY 1")
def p7_resolved_targets(spark, d):
    """Names resolved by a registry, unknown ones dropped."""
    registry = spark.createDataFrame([("A", "biomass", "group", 0.5), ("ECO", "carbon", "site", 2.0), ("R", "roots", "group", 1.0)], "alias string, variable string, level string, factor double")
    t = E.resolved(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("key"), "l_quantity"), registry)
    return t.groupBy("key", "variable", "level").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity") * F.col("factor")), 2).alias("total"))


@query("WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, l_linenumber * 0.3 AS z, avg(CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity END) AS v FROM lineitem GROUP BY ALL) SELECT k AS profile, max(v) FILTER (i = 2) AS by_index, arg_min_null(v, (abs(z - 1.0), i)) AS nearest, arg_min_null(v, CASE WHEN v IS NOT NULL THEN i END) AS first_known, arg_max_null(v, i) AS last FROM l GROUP BY 1")
def p8_profile_layers(spark, d):
    """A layer by number, nearest depth, first known value, last."""
    li = table(spark, d, "lineitem")
    p = li.groupBy(F.col("l_orderkey").alias("profile"), F.col("l_linenumber").alias("layer")).agg(F.avg(F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))).alias("v")).withColumn("depth", F.col("layer") * 0.3)
    out = None
    for name, how, at in (("by_index", "index", 2), ("nearest", "nearest", 1.0), ("first_known", "first", None), ("last", "last", None)):
        one = E.profile_layer(p, ["profile"], "layer", "depth", "v", how, at).withColumnRenamed("value", name)
        out = one if out is None else out.join(one, "profile")
    return out


@query(f"WITH {_POINTS}, q AS (SELECT case_id, target, point, sim * 2 AS sim FROM p WHERE target = 'A') SELECT case_id, target, CAST(point AS INT) AS point, round(coalesce(q.sim, p.sim), 6) AS sim FROM p LEFT JOIN q USING (case_id, target, point)")
def a10_levels_merged(spark, d):
    """Levels merged, the later one wins."""
    p = _points(spark, d)
    return E.first_level(p, p.where("target = 'A'").withColumn("sim", F.col("sim") * 2)).withColumn("sim", F.round("sim", 6))


_EVAL = f"""{_POINTS}, o AS (SELECT target, point, avg(sim) * 1.1 AS obs FROM p GROUP BY ALL), t(target, method, weight, scored) AS (VALUES ('A', 'rmse', 2.0, true), ('N', NULL, NULL, true), ('R', NULL, 5.0, false)),
b AS (SELECT case_id, p.target, any_value(coalesce(method, 'relative_error')) AS method, any_value(coalesce(weight, 1.0)) AS weight, any_value(scored) AS scored, avg(abs(sim - obs) / abs(obs)) AS re, sqrt(avg((sim - obs) ** 2)) AS rmse, count(*) AS n FROM p JOIN o USING (target, point) JOIN t ON t.target = p.target GROUP BY case_id, p.target),
e AS (SELECT case_id, b.target, CASE method WHEN 'rmse' THEN rmse ELSE re END AS cost, re, re <= 0.2 AS ok, weight, scored FROM b JOIN (SELECT target, count(*) AS n FROM o GROUP BY 1) k ON k.target = b.target AND k.n = b.n)"""


def _scores(spark, d):
    p = _points(spark, d)
    o = p.groupBy("target", "point").agg((F.avg("sim") * 1.1).alias("obs"))
    t = spark.createDataFrame([("A", "rmse", 2.0, True), ("N", None, None, True), ("R", None, 5.0, False)], "target string, method string, weight double, scored boolean")
    return E.target_scores(p, o, t)


@query(f"WITH {_EVAL} SELECT case_id, target, round(cost, 6) AS cost, round(re, 6) AS relative_error, ok AS satisfied, CAST(weight AS DOUBLE) AS weight, scored FROM e")
def a24_target_scores(spark, d):
    """Each target by its own method, weight and tolerance."""
    s = _scores(spark, d)
    return s.withColumns({"cost": F.round("cost", 6), "relative_error": F.round("relative_error", 6)})


@query(f"WITH {_EVAL}, g AS (SELECT case_id, sum(weight * cost) / sum(weight) AS c, count(*) FILTER (ok) AS m, count(*) AS n FROM e WHERE scored GROUP BY 1) SELECT c.case_id, round(coalesce(c, 'inf'::DOUBLE), 6) AS composite, coalesce(m, 0) AS n_met, coalesce(n, 0) AS n_targets FROM (SELECT s_suppkey AS case_id FROM supplier UNION SELECT -1) c LEFT JOIN g USING (case_id)")
def a23_case_scores(spark, d):
    """Weighted composites over the scored targets; a case without any costs infinity."""
    cases = table(spark, d, "supplier").select(F.col("s_suppkey").alias("case_id")).unionByName(spark.sql("SELECT -1L AS case_id"))
    return E.case_scores(cases, _scores(spark, d), "weighted_mean").withColumn("composite", F.round("composite", 6))


@query(f"WITH {_EVAL}, g AS (SELECT case_id, CASE WHEN count(cost) = 3 THEN sqrt(avg(cost * cost)) END AS c FROM e GROUP BY 1) SELECT case_id, round(c, 6) AS composite FROM g")
def a27_composite_unless_missing(spark, d):
    """Root mean square over all targets, null unless each has a cost."""
    from ensolith.functions import metrics as M

    return _scores(spark, d).groupBy("case_id").agg(F.round(M.composite_unless_missing(F.col("cost"), 3), 6).alias("composite"))


_BANDS = "v AS (SELECT l_suppkey AS case_id, l_returnflag AS target, avg(l_quantity) AS value, max(l_tax) > 0 AS completed FROM lineitem GROUP BY ALL), b AS (SELECT target, avg(value) * 0.97 AS low, avg(value) * 1.03 AS high FROM v GROUP BY 1)"


def _bands(spark, d):
    v = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("case_id"), F.col("l_returnflag").alias("target")).agg(F.avg("l_quantity").alias("value"), (F.max("l_tax") > 0).alias("completed"))
    return v, v.groupBy("target").agg((F.avg("value") * 0.97).alias("low"), (F.avg("value") * 1.03).alias("high"))


@query(f"WITH {_BANDS}, h AS (SELECT case_id, v.target, value BETWEEN low AND high AS ok FROM v JOIN b USING (target) WHERE completed) SELECT (SELECT coalesce(max(k), 0) FROM (SELECT count(*) FILTER (ok) AS k FROM h GROUP BY case_id)) AS k_max, (SELECT count(*) FROM b WHERE target NOT IN (SELECT target FROM h WHERE ok)) AS unreachable, (SELECT coalesce(max(k), 0) FROM (SELECT count(*) FILTER (ok) AS k FROM h GROUP BY case_id)) = 3 AS open")
def a51_band_gate(spark, d):
    """Most targets in band at once, unreachable targets, the gate."""
    return E.band_gate(*_bands(spark, d), 3)


@query(f"WITH {_BANDS} SELECT case_id, bool_and(value BETWEEN low AND high) AS all_in_band, bool_and(value * 0.98 <= high AND value * 1.02 >= low) AS reachable FROM v JOIN b USING (target) GROUP BY 1")
def p12_in_band(spark, d):
    """All values in band, and all intervals reaching it."""
    v, b = _bands(spark, d)
    j, x = v.join(b, "target"), F.col("value")
    return j.groupBy("case_id").agg(F.every(E.in_band(x, F.col("low"), F.col("high"))).alias("all_in_band"), F.every(E.band_reachable(x * 0.98, x * 1.02, F.col("low"), F.col("high"))).alias("reachable"))


@query(f"WITH {_BANDS}, o AS (SELECT target, avg(value) AS obs FROM v GROUP BY 1) SELECT case_id, target, CASE WHEN (value - obs) / abs(obs) IS NULL THEN 'unknown' WHEN abs((value - obs) / abs(obs)) <= 0.02 THEN 'within' WHEN value > obs THEN 'above' ELSE 'below' END AS status FROM v JOIN o USING (target)")
def a30_deviation_status(spark, d):
    """Within, above or below the uncertainty of each target."""
    v, _ = _bands(spark, d)
    o = v.groupBy("target").agg(F.avg("value").alias("obs"))
    return v.join(o, "target").select("case_id", "target", E.deviation_status(F.col("value"), F.col("obs"), F.lit(0.02)).alias("status"))


@query("WITH c AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') AS met, count(*) AS total, max(o_shippriority) AS p FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 2 END AS o_shippriority FROM orders) GROUP BY 1) SELECT k AS case_id, CASE WHEN met >= total THEN 'converge' WHEN met > coalesce(p, -1) THEN 'iterate' ELSE 'revise' END AS action FROM c")
def p26_refinement_action(spark, d):
    """Converge, iterate or revise."""
    before = F.when(F.col("o_orderkey") % 3 != 0, 2)
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("met"), F.count("*").alias("total"), F.max(before).alias("p"))
    return c.select("case_id", E.refinement_action(F.col("met"), F.col("total"), F.col("p")).alias("action"))


@query("SELECT s.s_suppkey AS case_id, s.s_suppkey - 1 AS row, p_size, round(s_acctbal, 2) AS y FROM supplier s JOIN part ON p_partkey - 1 = s.s_suppkey - 1 WHERE s.s_suppkey <> 3")
def j1_pool(spark, d):
    """Results joined to the design row of their case, the baseline left out, strays refused."""
    x = table(spark, d, "part").select((F.col("p_partkey") - 1).alias("row"), "p_size")
    y = table(spark, d, "supplier").select(F.col("s_suppkey").alias("case_id"), F.round("s_acctbal", 2).alias("y"))
    return E.pooled(x, y, 3).select("case_id", "row", "p_size", "y")


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_brand <> 'Brand#11' AND p_size % 5 <> 0")
def p16_complete_for_target(spark, d):
    """Rows one target can be fitted on."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", F.when(F.col("p_brand") != "Brand#11", "COMPLETED").otherwise("FAILED").alias("status"), F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice")).otherwise(float("nan")).alias("target"))
    return E.complete_for(p, "target").select("p_partkey", "p_size", "p_retailprice")


@query("SELECT s_suppkey AS case_id, CAST(s_nationkey AS DOUBLE) AS x FROM supplier")
def s28_strict_rows(spark, d):
    """Unique keys, finite values, bounds; anything else is refused."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("case_id"), F.col("s_nationkey").cast("double").alias("x"))
    return E.strict(s, ["case_id"], {"x": (0.0, 24.0)}).select("case_id", "x")


@query("WITH e AS (SELECT o_custkey AS experiment, count(*) FILTER (o_orderstatus = 'F') AS met, CASE o_custkey % 7 WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' ELSE 'extracted' END AS status, CASE WHEN o_custkey % 11 = 0 THEN 'no file' END AS error, count(*) FILTER (o_totalprice > 250000) AS n_metrics FROM orders GROUP BY 1), x AS (SELECT *, CASE WHEN met >= 12 THEN 'SUCCESS' WHEN met >= 9 THEN 'PARTIAL_SUCCESS' WHEN met <= 3 THEN 'FAILED' ELSE 'MARGINAL' END AS outcome, status = 'extracted' AND error IS NULL AND n_metrics > 0 AS reliable FROM e WHERE status <> 'skipped') SELECT experiment, met, outcome, reliable, experiment = (SELECT arg_max(experiment, (met, -experiment)) FROM x WHERE met > 0) AS best FROM x")
def a47_experiment_outcomes(spark, d):
    """Outcomes, the gate of data reliability, the first best marked."""
    k = F.col("o_custkey")
    g = table(spark, d, "orders").groupBy(k.alias("experiment")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("met"), F.count_if(F.col("o_totalprice") > 250000).alias("n_metrics"))
    e = g.withColumn("status", F.when(F.col("experiment") % 7 == 0, "skipped").when(F.col("experiment") % 7 == 1, "failed").otherwise("extracted")).withColumn("error", F.when(F.col("experiment") % 11 == 0, "no file"))
    return E.experiment_outcomes(e, 12).select("experiment", "met", "outcome", "reliable", "best")
