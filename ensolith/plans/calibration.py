"""Queries of the calibration side: reductions, metrics, screening, sensitivity, rules.

Stand-ins on the driver's tables: a case is a supplier, its history the line items by ship
date, a group the line status, a target a return flag; simulated is the discounted price,
observed a price of 1500 a unit.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ensolith.functions import columns as C
from ensolith.functions import metrics as M
from ensolith.operators import reducers as R
from ensolith.operators import screening as S
from ensolith.operators import sensitivity as V
from ensolith.plans.registry import query, table


def _sim():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _obs():
    return F.col("l_quantity") * 1500.0


_PAIR = "SELECT l_suppkey AS case_id, l_returnflag AS target, l_extendedprice * (1 - l_discount) AS s, l_quantity * 1500.0 AS o FROM lineitem"


def _history(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_linestatus").alias("grp"), F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("rec"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("value"))


#: Rows of complete years: the case's record neither begins in them after their first day nor ends before their last.
_W = "w AS (SELECT h.* FROM h JOIN (SELECT case_id, min(ts) AS a, max(ts) AS z FROM h GROUP BY 1) USING (case_id) WHERE (year(ts) < year(z) OR strftime(z, '%m-%d') = '12-31') AND (year(ts) > year(a) OR strftime(a, '%m-%d') = '01-01'))"
_H = "SELECT l_suppkey AS case_id, l_linestatus AS grp, l_shipdate AS ts, l_orderkey AS rec, l_linenumber AS n, l_quantity AS value FROM lineitem"


def _r(df, *names, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query(f"WITH h AS ({_H} WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01') SELECT case_id, grp, count(*) AS n_records, min(value) AS low, max(value) AS high FROM h GROUP BY ALL")
def s1_history_scan(spark, d):
    """Named columns and a time range reach the scan."""
    h = _history(spark, d).where((F.col("ts") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("ts") < F.lit("1998-01-01").cast("timestamp")))
    return h.groupBy("case_id", "grp").agg(F.count("*").alias("n_records"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT o_custkey AS case_id, count(*) AS n_new FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def s12_resume_remaining(spark, d):
    """Only the cases that no finished run covers."""
    o = table(spark, d, "orders")
    done = o.where("o_orderstatus = 'F'").select("o_custkey")
    return o.where("o_orderstatus <> 'F'").join(done, "o_custkey", "left_anti").groupBy(F.col("o_custkey").alias("case_id")).agg(F.count("*").alias("n_new"))


@query("SELECT (id - 1) // 500 AS chunk, min(id) AS first, max(id) AS last FROM (SELECT unnest(range(1, (SELECT max(o_orderkey) + 1 FROM orders))) AS id) GROUP BY 1")
def s16_chunk_bounds(spark, d):
    """An inclusive range dealt into chunks without gap or overlap."""
    last = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    return spark.range(1, last + 1).groupBy(F.floor((F.col("id") - 1) / 500).alias("chunk")).agg(F.min("id").alias("first"), F.max("id").alias("last"))


@query(f"WITH h AS ({_H}), {_W}, s AS (SELECT case_id, year(ts) AS y, month(ts) AS m, sum(value) AS v FROM w GROUP BY ALL), a AS (SELECT case_id, y, max(v) AS v FROM s GROUP BY ALL) SELECT case_id, round(avg(v), 4) AS value, count(*) AS n_years, 'OK' AS status FROM a GROUP BY 1")
def a2_group_sum_peak(spark, d):
    """A2 sum_pft_peak: groups summed at each step, the year's peak, its mean."""
    return _r(R.peak_of_group_sum(_history(spark, d), ["case_id"], F.month("ts")), "value")


@query(f"WITH h AS ({_H}), {_W}, a AS (SELECT case_id, year(ts) AS y, avg(abs(value)) AS v FROM w WHERE month(ts) BETWEEN 5 AND 9 GROUP BY ALL) SELECT case_id, round(avg(v), 4) AS value, count(*) AS n_years, 'OK' AS status FROM a GROUP BY 1")
def a2_season_mean_abs(spark, d):
    """Mean of absolute values in season months, per year, then over years."""
    return _r(R.season_mean_abs(_history(spark, d), ["case_id"]), "value")


@query(f"WITH h AS ({_H}), {_W}, a AS (SELECT case_id, year(ts) AS y, sum(value) * 24 AS v FROM w GROUP BY ALL) SELECT case_id, round(avg(v), 4) AS value, count(*) AS n_years, 'OK' AS status FROM a GROUP BY 1")
def a2_annual_integral(spark, d):
    return _r(R.annual_integral(_history(spark, d), ["case_id"]), "value")


@query(f"WITH h AS ({_H}), {_W}, a AS (SELECT case_id, year(ts) AS y, arg_max(value, (ts, rec, n)) AS v FROM w GROUP BY ALL) SELECT case_id, round(avg(v), 4) AS value, count(*) AS n_years, 'OK' AS status FROM a GROUP BY 1")
def a2_year_end(spark, d):
    """A2 year_end: each year's last record."""
    return _r(R.year_end(_history(spark, d), ["case_id"], ["ts", "rec", "n"]), "value")


@query(f"WITH h AS ({_H}), {_W}, a AS (SELECT case_id, year(ts) AS y, CASE WHEN month(ts) IN (12, 1, 2) THEN 'DJF' WHEN month(ts) < 6 THEN 'MAM' WHEN month(ts) < 9 THEN 'JJA' ELSE 'SON' END AS season, sum(value) AS v FROM w GROUP BY ALL) SELECT case_id, season, round(avg(v), 4) AS value FROM a GROUP BY ALL")
def a2_season_sums(spark, d):
    """A2 season_sum: December belongs to the winter of its own year."""
    return _r(R.season_sums(_history(spark, d), ["case_id"]), "value")


@query(f"WITH h AS ({_H}) SELECT case_id, rec, n, ts, value - coalesce(lag(value) OVER (PARTITION BY case_id, year(ts) ORDER BY ts, rec, n), 0) AS step FROM h")
def w8_decumulate(spark, d):
    """Differences within the year, the first record kept."""
    return R.decumulate(_history(spark, d), ["case_id"], ["ts", "rec", "n"]).select("case_id", "rec", "n", "ts", "step")


@query(f"WITH h AS ({_H}), c AS (SELECT DISTINCT case_id, year(ts) AS year FROM h), e AS (SELECT case_id, min(ts) AS a, max(ts) AS z FROM h GROUP BY 1), f AS (SELECT case_id, (year < year(z) OR strftime(z, '%m-%d') = '12-31') AND (year > year(a) OR strftime(a, '%m-%d') = '01-01') AS ok FROM c JOIN e USING (case_id)) SELECT case_id, count(*) FILTER (ok) AS n_complete, count(*) FILTER (NOT ok) AS n_partial FROM f GROUP BY 1")
def a5_coverage_guard(spark, d):
    """A5: years that a case's record does not cover are named, not averaged."""
    y = R.complete_years(_history(spark, d), ["case_id"]).select("case_id", "year", "complete").distinct()
    return y.groupBy("case_id").agg(F.count_if("complete").alias("n_complete"), F.count_if(~F.col("complete")).alias("n_partial"))


@query(f"WITH h AS ({_H}), {_W}, a AS (SELECT case_id, year(ts) AS y, avg(abs(value)) AS v FROM w WHERE month(ts) BETWEEN 5 AND 9 AND hour(ts) IN (0, 6, 12) GROUP BY ALL) SELECT case_id, round(avg(v), 4) AS value, count(*) AS n_years, 'OK' AS status FROM a GROUP BY 1")
def a6_daytime_season_mean_abs(spark, d):
    """A2 growing season by daytime, A6."""
    return _r(R.daytime_season_mean_abs(_history(spark, d), ["case_id"], [0, 6, 12]), "value")


@query("SELECT o_orderkey, CAST(year(t) AS INT) AS year, CAST(month(t) AS INT) AS month, CAST(hour(t) AS INT) AS hour FROM (SELECT o_orderkey, TIMESTAMP '2000-01-01' + to_hours(CAST(o_orderkey AS INT)) AS t FROM orders)")
def w9_hourly_tags(spark, d):
    """Year, month and hour of hourly record numbers."""
    return R.hourly_tags(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 2000)


@query("SELECT y AS year, CAST(dayofyear(make_date(y, 5, 1)) - 1 AS INT) AS first_day, CAST(dayofyear(make_date(y, 10, 1)) - 1 AS INT) AS end_day FROM (SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS y FROM lineitem)")
def w9_season_days(spark, d):
    """The season's days of the year."""
    return R.season_days(table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year")).distinct(), "year")


@query("WITH n AS (SELECT max(o_orderkey) + 1 AS n FROM orders), y AS (SELECT CAST(y AS INT) AS year, CAST(date_diff('day', DATE '1992-01-01', make_date(y, 1, 1)) AS BIGINT) AS lo, CAST(date_diff('day', DATE '1992-01-01', make_date(y + 1, 1, 1)) AS BIGINT) AS hi FROM (SELECT unnest(range(1992, 1992 + (SELECT n FROM n) // 365 + 2)) AS y)) SELECT year, lo, hi FROM y, n WHERE hi <= n")
def w9_year_blocks(spark, d):
    """Whole calendar years of a daily record."""
    return R.year_blocks(table(spark, d, "orders"), "o_orderkey", 1992)


@query(f"WITH h AS ({_H}), {_W}, a AS (SELECT case_id, year(ts) AS y, sum(value) AS v FROM w WHERE year(ts) BETWEEN 1996 AND 1999 GROUP BY ALL) SELECT case_id, round(avg(v), 4) AS value, count(*) AS n_years, CASE WHEN count(*) = 4 THEN 'OK' ELSE 'PARTIAL' END AS status FROM a GROUP BY 1")
def a55_annual_mean_sum(spark, d):
    """Mean over a window of years of the sum within each."""
    years = R.by_year(_history(spark, d), ["case_id"], F.sum("value"), where=F.year("ts").between(1996, 1999))
    return _r(R.mean_over_years(years, ["case_id"], 1996, 1999), "value")


@query("WITH n AS (SELECT l_suppkey AS case_id, l_quantity AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS r FROM lineitem) SELECT case_id, arg_max(v, r) AS last, round(avg(v), 4) AS mean, max(v) AS high, min(v) AS low, round(sum(v), 4) AS total FROM n WHERE r BETWEEN 100 AND 400 GROUP BY 1")
def a1_window_reducers(spark, d):
    """Last, mean, max, min and sum over an inclusive window of record numbers."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_quantity").alias("value"), "l_orderkey", "l_linenumber")
    h = R.numbered(li, ["case_id"], ["l_orderkey", "l_linenumber", "value"])
    return _r(R.window_reductions(h, ["case_id"], "record", 100, 400, {"last": "last", "mean": "mean", "high": "max", "low": "min", "total": "sum"}), "mean", "total")


@query("SELECT l_suppkey AS case_id, round(avg(CASE WHEN l_tax <> 0 THEN l_discount / (l_tax / 1000.0 * 1000) END) FILTER (l_linenumber BETWEEN 2 AND 5), 6) AS value, CASE WHEN max(l_linenumber) >= 2 AND max(l_linenumber) < 5 THEN 'PARTIAL' ELSE 'OK' END AS status FROM lineitem GROUP BY 1")
def a3_ratio_reducer(spark, d):
    """A3: mean ratio in a window of time, rows without flow left out."""
    li = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "case_id")
    return _r(R.ratio_in_window(li, ["case_id"], F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber"), 2, 5), "value", digits=6)


@query(f"WITH p AS ({_PAIR}) SELECT case_id, round(avg(abs(s - o) / abs(o)), 6) AS relative_error, round(avg((s - o) / o), 6) AS relative_bias, round(sqrt(avg((s - o) * (s - o))), 4) AS rmse, round(avg(abs(s - o)), 4) AS mae, round(avg(s - o), 4) AS bias FROM p GROUP BY 1")
def a11_error_metrics(spark, d):
    """The error metrics of every case in one aggregation."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("case_id"))
    return g.agg(*(F.round(M.metric(n, _sim(), _obs()), 6 if n.startswith("relative") else 4).alias(n) for n in ("relative_error", "relative_bias", "rmse", "mae", "bias")))


@query(f"WITH p AS ({_PAIR}), a AS (SELECT case_id, sqrt(avg((s - o) * (s - o))) AS e, max(o) - min(o) AS r, avg(o) AS m, stddev_pop(o) AS sd FROM p GROUP BY 1) SELECT case_id, round(e / CASE WHEN r <> 0 THEN r ELSE abs(m) END, 6) AS nrmse_range, round(e / abs(m), 6) AS nrmse_mean, round(e / CASE WHEN sd <> 0 THEN sd ELSE abs(m) END, 6) AS nrmse_std FROM a")
def a14_nrmse(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("case_id"))
    return g.agg(*(F.round(M.nrmse(_sim(), _obs(), k), 6).alias(f"nrmse_{k}") for k in ("range", "mean", "std")))


@query(f"WITH p AS ({_PAIR}), a AS (SELECT case_id, 1 - sum((s - o) * (s - o)) / (var_pop(o) * count(*)) AS nse, corr(s, o) AS r, stddev_pop(s) / stddev_pop(o) AS al, avg(s) / avg(o) AS be FROM p GROUP BY 1) SELECT case_id, round(nse, 6) AS nse, round(r, 6) AS correlation, round(1 - sqrt((r - 1) * (r - 1) + (al - 1) * (al - 1) + (be - 1) * (be - 1)), 6) AS kge FROM a")
def a15_skill_scores(spark, d):
    """Nash-Sutcliffe, correlation and Kling-Gupta, guarded for constant sides."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("case_id"))
    return g.agg(*(F.round(f(_sim(), _obs()), 6).alias(n) for n, f in (("nse", M.nse), ("correlation", M.correlation), ("kge", M.kge))))


def _scored(spark, d):
    li = table(spark, d, "lineitem")
    sim = li.groupBy(F.col("l_suppkey").alias("case_id"), F.col("l_returnflag").alias("target")).agg(F.avg(_sim()).alias("sim"))
    targets = li.groupBy(F.col("l_returnflag").alias("target")).agg(F.avg(_obs()).alias("observed"), F.lit(0.05).alias("uncertainty"))
    return sim, targets


_SC = f"""p AS ({_PAIR}), sim AS (SELECT case_id, target, avg(s) AS sim FROM p GROUP BY ALL), tg AS (SELECT target, avg(o) AS observed FROM p GROUP BY 1),
sc AS (SELECT case_id, target, sim, observed, abs(sim - observed) / abs(observed) AS cost, abs(sim - observed) <= 0.05 * abs(observed) AS ok FROM sim JOIN tg USING (target)),
rk AS (SELECT case_id, sqrt(avg(cost * cost)) AS c, count(*) FILTER (ok) AS n FROM sc GROUP BY 1)"""


@query(f"WITH {_SC} SELECT case_id, target, round(cost, 6) AS cost, ok AS satisfied FROM sc")
def a21_target_costs(spark, d):
    """Each case's cost and tolerance check against each target."""
    return _r(S.score_targets(*_scored(spark, d), tolerance=0.05), "cost", digits=6)


@query(f"WITH {_SC} SELECT case_id, round(c, 6) AS composite, n AS n_satisfied, row_number() OVER (ORDER BY round(c, 9), case_id) AS rank FROM rk")
def t1_optimize_ensemble(spark, d):
    """Cases ranked by their composite error over all targets (the flagship query)."""
    ranked = S.rank_cases(S.score_targets(*_scored(spark, d), tolerance=0.05))
    return _r(ranked, "composite", digits=6).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_SC}, r AS (SELECT *, row_number() OVER (ORDER BY round(c, 9), case_id) AS k FROM rk) SELECT arg_max(case_id, (n, -c, -case_id)) AS best_case, arg_min(case_id, k) AS lowest_cost_case FROM r WHERE k <= 10")
def t5_best_cases(spark, d):
    """T5: most satisfied among the ten cheapest, and the cheapest."""
    return S.best_cases(S.rank_cases(S.score_targets(*_scored(spark, d), tolerance=0.05)))


@query(f"WITH {_SC} SELECT b.n AS n_satisfied, count(rk.case_id) AS n_cases FROM (SELECT unnest(range(4)) AS n) b LEFT JOIN rk ON rk.n = b.n GROUP BY 1")
def a31_satisfied_distribution(spark, d):
    """The histogram of satisfied targets, empty bins included."""
    return S.satisfied_distribution(S.rank_cases(S.score_targets(*_scored(spark, d), tolerance=0.05)), 3)


@query(f"WITH {_SC} SELECT case_id, CASE WHEN count(*) = 3 THEN round(max(cost / 0.05), 6) END AS v, CASE WHEN count(*) = 3 THEN arg_max(target, (cost / 0.05, target)) END AS binding FROM sc GROUP BY 1")
def a26_violation(spark, d):
    """The largest violation of a case and the target that binds."""
    return _r(S.violation(*_scored(spark, d), 3), "v", digits=6)


@query(f"WITH {_SC}, v AS (SELECT case_id, round(max(cost), 9) AS a, round(sqrt(avg(cost * cost)), 9) AS b FROM sc GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb, row_number() OVER (ORDER BY a, case_id) AS ka, row_number() OVER (ORDER BY b, case_id) AS kb FROM v) SELECT count(*) FILTER (ka <= 20 AND kb <= 20) AS overlap, round(corr(ra, rb), 6) AS spearman, arg_min(case_id, ka) = arg_min(case_id, kb) AS same_best FROM r")
def a28_compare_rankings(spark, d):
    """Two rankings of the same cases."""
    s = S.score_targets(*_scored(spark, d)).groupBy("case_id").agg(F.round(F.max("cost"), 9).alias("a"), F.round(M.composite(F.col("cost")), 9).alias("b"))
    return _r(S.compare_rankings(s, "a", "b", 20), "spearman", digits=6)


@query("SELECT o_orderkey // 8 AS block, o_orderkey, o_totalprice FROM (SELECT *, count(*) OVER (PARTITION BY o_orderkey // 8) AS n FROM orders) WHERE n = 8")
def p21_complete_blocks(spark, d):
    """Blocks of consecutive rows kept only if whole."""
    return S.complete_blocks(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 8, "o_totalprice").select("block", "o_orderkey", "o_totalprice")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'failed' WHEN n_chars < 200 THEN 'excluded' WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 'viable' ELSE 'nonviable' END AS label FROM documents JOIN labels USING (doc_id)")
def p15_label_rows(spark, d):
    """Rows labelled by the first rule that holds."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    rules = [(F.col("quality").isNull(), "failed"), (F.col("n_chars") < 200, "excluded"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), "viable")]
    return rows.select("doc_id", S.labelled(rows, rules, "nonviable").alias("label"))


@query("SELECT p_partkey, round(100 * (p_size - lo) / (hi - lo), 4) AS pct, CASE WHEN p_size <= lo + 0.05 * (hi - lo) THEN 'low' ELSE 'high' END AS edge FROM part JOIN (SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1) b USING (p_brand) WHERE hi > lo AND (p_size <= lo + 0.05 * (hi - lo) OR p_size >= hi - 0.05 * (hi - lo))")
def p22_parameters_at_edge(spark, d):
    """Values within a share of their range of a bound."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    b = p.groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi")).where("hi > lo")
    j, near = p.join(b, "p_brand"), 0.05 * (F.col("hi") - F.col("lo"))
    j = j.where((F.col("p_size") <= F.col("lo") + near) | (F.col("p_size") >= F.col("hi") - near))
    return j.select("p_partkey", F.round(100 * C.to_unit(F.col("p_size"), F.col("lo"), F.col("hi")), 4).alias("pct"), F.when(F.col("p_size") <= F.col("lo") + near, "low").otherwise("high").alias("edge"))


@query("WITH c AS (SELECT l_suppkey AS case_id, avg(l_discount) * 100 AS v, count(*) FILTER (l_returnflag = 'R') AS met, count(*) AS total FROM lineitem GROUP BY 1) SELECT case_id, CASE WHEN v > 7.5 THEN 'CONFIRMED' WHEN v > 4 THEN 'PARTIAL' ELSE 'REJECTED' END AS verdict, CASE WHEN met >= total THEN 'SUCCESS' WHEN met >= 0.75 * total THEN 'PARTIAL_SUCCESS' WHEN met <= 0.25 * total THEN 'FAILED' ELSE 'MARGINAL' END AS outcome FROM c")
def p24_verdicts(spark, d):
    """Threshold verdicts and outcome classes."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("case_id")).agg((F.avg("l_discount") * 100).alias("v"), F.count_if(F.col("l_returnflag") == "R").alias("met"), F.count("*").alias("total"))
    return c.select("case_id", C.threshold_verdict(F.col("v"), F.lit(5.0)).alias("verdict"), C.outcome(F.col("met"), F.col("total")).alias("outcome"))


@query("SELECT coalesce(a.k, b.k) AS name, a.n AS left_value, b.n AS right_value, CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS status FROM (SELECT p_type AS k, count(*) AS n FROM part WHERE p_size <= 25 GROUP BY 1) a FULL JOIN (SELECT p_type AS k, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1) b ON a.k = b.k")
def j8_compare_inventories(spark, d):
    """What stands on the left, the right, or differs."""
    p = table(spark, d, "part")
    a = p.where("p_size <= 25").groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("left_value"))
    b = p.where("p_size > 25").groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("right_value"))
    status = F.when(F.col("right_value").isNull(), "only_left").when(F.col("left_value").isNull(), "only_right").when(F.col("left_value") != F.col("right_value"), "changed").otherwise("same")
    return a.join(b, "name", "full_outer").withColumn("status", status)


@query("WITH c AS (SELECT c_custkey AS k, c_nationkey AS g, c_acctbal AS x FROM customer), m AS (SELECT median(x) AS m FROM c) SELECT g AS nation, round(avg(x) FILTER (x > m), 4) AS above, round(avg(x) FILTER (x <= m), 4) AS below, count(*) AS n FROM c, m GROUP BY 1")
def a44_split_at_median(spark, d):
    """Groups split at the exact median and compared."""
    s = S.split_at_median(table(spark, d, "customer"), "c_acctbal", F.col("c_acctbal"), ["c_nationkey"])
    return _r(s, "above", "below", digits=4).select(F.col("c_nationkey").alias("nation"), "above", "below", "n")


@query("WITH m AS (SELECT median(l_quantity) AS m FROM lineitem), g AS (SELECT l_returnflag AS output, avg(l_extendedprice) FILTER (l_quantity > m) AS h, avg(l_extendedprice) FILTER (l_quantity <= m) AS l FROM lineitem, m GROUP BY 1), d AS (SELECT output, CASE WHEN l = 0 THEN 0 ELSE (h - l) / l * 100 END AS d FROM g) SELECT output, round(d, 6) AS difference_pct, d > 10 AS supported, CASE WHEN d > 10 THEN round(least(0.9, abs(d) / 100), 6) ELSE 0 END AS confidence FROM d")
def a44_case_comparison(spark, d):
    """Whether an outcome is more than a tenth higher where a parameter is above its median."""
    s = S.compared_cases(S.split_at_median(table(spark, d, "lineitem"), "l_quantity", F.col("l_extendedprice"), ["l_returnflag"]), "increase")
    return _r(s, "difference_pct", "confidence", digits=6).select(F.col("l_returnflag").alias("output"), "difference_pct", "supported", "confidence")


@query(f"WITH {_SC}, r AS (SELECT *, row_number() OVER (ORDER BY round(c, 9), case_id) AS rank FROM rk) SELECT r.case_id, rank, round(c, 6) AS composite, n AS n_satisfied, target, round(cost, 6) AS cost, round(sim, 6) AS sim FROM r JOIN sc USING (case_id) WHERE rank <= 10")
def t4_top_cases(spark, d):
    """The ten best cases with their values and costs at every target."""
    sim, targets = _scored(spark, d)
    scored = S.score_targets(sim, targets, tolerance=0.05)
    ranked = S.rank_cases(scored)
    return _r(S.top_cases(ranked, scored, sim, 10), "composite", "cost", "sim", digits=6)


def _effects(spark, d):
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("t"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("changed"), (F.col("o_orderkey") / 1000.0).alias("x"), F.col("o_totalprice").alias("y"))
    return V.elementary_effects(s, "t", "k", "changed", "x", "y")


@query("WITH s AS (SELECT o_custkey AS t, o_orderkey AS k, o_orderstatus AS changed, o_orderkey / 1000.0 AS x, o_totalprice AS y FROM orders), e AS (SELECT changed, (y - lag(y) OVER w) / nullif(x - lag(x) OVER w, 0) AS e FROM s WINDOW w AS (PARTITION BY t ORDER BY k)) SELECT changed, round(avg(e), 2) AS mu, round(avg(abs(e)), 2) AS mu_star, round(stddev_samp(e), 2) AS sigma, count(*) AS n FROM e WHERE e IS NOT NULL GROUP BY 1")
def w10_elementary_effects(spark, d):
    """Elementary effects along trajectories."""
    return _r(_effects(spark, d).drop("mu_star_conf"), "mu", "mu_star", "sigma", digits=2)


@query("WITH s AS (SELECT o_custkey AS t, o_orderkey AS k, o_orderstatus AS changed, o_orderkey / 1000.0 AS x, o_totalprice AS y FROM orders), e AS (SELECT changed, (y - lag(y) OVER w) / nullif(x - lag(x) OVER w, 0) AS e FROM s WINDOW w AS (PARTITION BY t ORDER BY k)) SELECT changed, round(avg(abs(e)), 2) AS mu_star, round(1.959963984540054 * stddev_pop(abs(e)) / sqrt(count(*)), 2) AS mu_star_conf FROM e WHERE e IS NOT NULL GROUP BY 1")
def w10_effect_confidence(spark, d):
    """Mean absolute elementary effects with their confidence."""
    return _r(_effects(spark, d).select("changed", "mu_star", "mu_star_conf"), "mu_star", "mu_star_conf", digits=2)


@query("WITH s AS (SELECT l_returnflag AS g, abs(l_extendedprice - l_quantity * 1500) AS e FROM lineitem), r AS (SELECT g, e, row_number() OVER (PARTITION BY g ORDER BY e) AS k, count(*) OVER (PARTITION BY g) AS n FROM s) SELECT g, round(coalesce(max(e) FILTER (k = ceil((n + 1) * 0.9)), 'inf'::DOUBLE), 4) AS radius, max(n) AS n FROM r GROUP BY 1")
def m4_conformal_radius(spark, d):
    """M4: split-conformal radius of each group."""
    s = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1500).alias("e"))
    return _r(V.conformal_radius(s, "e", 0.1, ["g"]), "radius")


@query("SELECT round(avg((l_extendedprice BETWEEN l_quantity * 1000 AND l_quantity * 2000)::INT), 6) AS coverage, round(avg(l_quantity * 1000), 4) AS width FROM lineitem")
def m14_interval_coverage(spark, d):
    q = F.col("l_quantity")
    return _r(_r(V.coverage(table(spark, d, "lineitem"), F.col("l_extendedprice"), q * 1000, q * 2000), "coverage", digits=6), "width")


@query("SELECT l_suppkey AS case_id, round(1 - sum((l_extendedprice - l_quantity * 1500) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2, count(*) AS n FROM lineitem GROUP BY 1")
def m17_case_r2(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), "l_extendedprice", _obs().alias("p"))
    return _r(V.r2(li, "l_extendedprice", "p", ["case_id"]), "r2", digits=6)


@query("WITH s AS (SELECT l_quantity AS y, ntile(10) OVER (ORDER BY l_extendedprice, l_quantity) AS slice FROM lineitem), g AS (SELECT v.y, k.slice FROM (SELECT DISTINCT y FROM s) v, (SELECT unnest(range(1, 11)) AS slice) k), c AS (SELECT g.y, g.slice, count(s.y) AS c FROM g LEFT JOIN s ON s.y = g.y AND s.slice = g.slice GROUP BY ALL), a AS (SELECT y, sum(c) AS a FROM c GROUP BY 1), d AS (SELECT c.slice, abs(sum(c) OVER w / sum(c) OVER p - sum(a) OVER w / sum(a) OVER p) AS gap FROM c JOIN a USING (y) WINDOW w AS (PARTITION BY c.slice ORDER BY c.y ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY c.slice)) SELECT round(median(ks), 6) AS pawn FROM (SELECT slice, max(gap) AS ks FROM d GROUP BY 1)")
def m1_pawn(spark, d):
    """M1: PAWN index of one input."""
    return _r(V.pawn(table(spark, d, "lineitem").select("l_extendedprice", "l_quantity"), "l_extendedprice", "l_quantity", 10), "pawn", digits=6)


@query("SELECT o_custkey AS case_id, o_orderkey AS eval, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS best FROM orders")
def w12_best_so_far(spark, d):
    """The best value up to each evaluation."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("eval"), F.min("o_totalprice").over(w).alias("best"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def a_grouping_sets(spark, d):
    return table(spark, d, "lineitem").groupingSets([[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_returnflag")], []], "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


@query("SELECT case_id, max(v) FILTER (target = 'A') AS a, max(v) FILTER (target = 'N') AS n, max(v) FILTER (target = 'R') AS r FROM (SELECT l_suppkey AS case_id, l_returnflag AS target, round(avg(l_quantity), 4) AS v FROM lineitem GROUP BY ALL) GROUP BY 1")
def s10_wide_outputs(spark, d):
    """The case by target matrix; the targets are named, so no pass looks for them."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("case_id")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.avg("l_quantity"), 4))
    return p.withColumnsRenamed({"A": "a", "N": "n", "R": "r"})
