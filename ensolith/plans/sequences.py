"""Queries over event sequences: running sums, deficits, collapses, mortality, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ensolith.operators import events as E
from ensolith.plans.registry import query, table

_ISL = "SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN h AND NOT coalesce(lag(h) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) THEN 1 ELSE 0 END AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS z FROM x)"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")


@query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def w1_cumulative(spark, d):
    """Running sums."""
    return E.running(_events(spark, d), ["user_id"], ["ts", "event_id"], F.col("value"), "total").select("event_id", "user_id", F.round("total", 4).alias("total"))


@query(f"WITH x AS (SELECT user_id, ts, event_id, 50 - value AS dd, coalesce(50 - value > 0, false) AS h FROM events), i AS ({_ISL}) SELECT user_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS n, round(max(dd), 4) AS largest, round((arg_max(dd, (ts, event_id)) - arg_min(dd, (ts, event_id))) / (count(*) - 1), 4) AS mean_daily, bool_or(z) AS ongoing FROM i WHERE h GROUP BY user_id, island HAVING count(*) >= 2")
def w2_deficit_periods(spark, d):
    """Runs of deficit."""
    out = E.deficit_periods(_events(spark, d), ["user_id"], ["ts", "event_id"], "ts", 50 - F.col("value"), 2)
    return out.withColumns({c: F.round(c, 4) for c in ("largest", "mean_daily")})


@query("WITH r AS (SELECT user_id, dayofyear(ts) AS doy, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) OVER w AS a, sum(CASE WHEN event_type <> 'click' THEN value ELSE 0 END) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT user_id, min(doy) FILTER (a > b) AS crossover FROM r GROUP BY 1")
def w3_crossover(spark, d):
    """The first day on which one running sum exceeds the other."""
    click, v = F.col("event_type") == "click", F.col("value")
    out = E.crossover(_events(spark, d), ["user_id"], ["ts", "event_id"], F.dayofyear("ts"), F.when(click, v).otherwise(0.0), F.when(~click, v).otherwise(0.0))
    return out.withColumn("crossover", F.col("crossover").cast("long"))


_DAY = "SELECT user_id, dayofyear(ts) AS doy, coalesce(sum(value) FILTER (event_type = 'click'), 0) AS gain, coalesce(sum(value) FILTER (event_type <> 'click'), 0) AS loss FROM events GROUP BY ALL"


def _days(spark, d):
    v = lambda c: F.coalesce(F.sum(F.when(c, F.col("value"))), F.lit(0.0))
    return _events(spark, d).groupBy("user_id", F.dayofyear("ts").alias("doy")).agg(v(F.col("event_type") == "click").alias("gain"), v(F.col("event_type") != "click").alias("loss"))


@query(f"WITH e AS ({_DAY}), r AS (SELECT *, sum(gain) OVER w AS g, sum(loss) OVER w AS l FROM e WINDOW w AS (PARTITION BY user_id ORDER BY doy ROWS UNBOUNDED PRECEDING)), a AS (SELECT user_id, arg_min(l - g, (abs(doy - 10), doy)) AS deficit, max(l - g) AS largest, min(doy) FILTER (g > l) AS crossover FROM r GROUP BY 1) SELECT user_id, round(deficit, 4) AS deficit, round(largest, 4) AS largest, CAST(crossover AS INT) AS crossover, deficit > 10 OR coalesce(crossover > 40, false) AS bottleneck FROM a")
def w4_carbon_balance(spark, d):
    """Running deficit on the nearest day, the largest, crossover and the rule for a bottleneck."""
    out = E.carbon_balance(_days(spark, d), ["user_id"], "doy", "gain", "loss", 10)
    return out.withColumns({c: F.round(c, 4) for c in ("deficit", "largest")})


@query(f"WITH e AS ({_DAY}) SELECT user_id, round(avg(gain), 7) AS mean_gain, round(avg(loss), 7) AS mean_loss, count(*) AS n FROM e WHERE doy BETWEEN 5 AND 20 GROUP BY 1")
def a41_slice_means(spark, d):
    """Means over a slice of days of the year."""
    out = E.within_days(_days(spark, d), ["user_id"], "doy", 5, 20, ["gain", "loss"])
    return out.withColumns({c: F.round(c, 7) for c in ("mean_gain", "mean_loss")})


@query(f"WITH e AS ({_DAY}) SELECT user_id, doy, (gain > loss)::INT + (loss > 200)::INT + (gain > 200)::INT AS n_signs, CASE (gain > loss)::INT + (loss > 200)::INT + (gain > 200)::INT WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'none' END AS level FROM e")
def w7_co_occurrence(spark, d):
    """How many signs hold at once, and the level that makes."""
    out = E.warnings(_days(spark, d), [F.col("gain") > F.col("loss"), F.col("loss") > 200, F.col("gain") > 200])
    return out.select("user_id", "doy", "n_signs", "level")


@query("WITH l AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS p FROM events) SELECT event_id, user_id, round(CASE WHEN p > 0 THEN 100 * (p - value) / p ELSE 0 END, 4) AS loss_pct FROM l")
def w5_collapse_loss(spark, d):
    """Loss against the rolling maximum."""
    return E.collapse(_events(spark, d), ["user_id"], ["ts", "event_id"], "value", 12).select("event_id", "user_id", F.round("loss_pct", 4).alias("loss_pct"))


_COLLAPSE = f"l AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS p FROM events), x AS (SELECT user_id, ts, event_id, CASE WHEN p > 0 THEN 100 * (p - value) / p ELSE 0 END AS loss, coalesce(CASE WHEN p > 0 THEN 100 * (p - value) / p ELSE 0 END > 80, false) AS h FROM l), i AS ({_ISL}), c AS (SELECT user_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS n, max(loss) AS loss, bool_or(z) AS ongoing FROM i WHERE h GROUP BY user_id, island)"


def _collapses(spark, d):
    return E.collapse_events(_events(spark, d), ["user_id"], ["ts", "event_id"], "ts", "value", 12, 80.0)


@query(f"WITH {_COLLAPSE} SELECT user_id, start, \"end\", n, round(loss, 4) AS loss_pct, ongoing FROM c")
def w5_collapse_events(spark, d):
    """Runs of loss above a limit, open ones marked."""
    return _collapses(spark, d).select("user_id", "start", "end", "n", F.round("loss_pct", 4).alias("loss_pct"), "ongoing")


@query(f"WITH {_COLLAPSE}, v AS (SELECT user_id, island, min(ts) AS start, arg_min(p, (ts, event_id)) AS start_value, arg_max(value, (ts, event_id)) AS end_value, min(value) AS least_value FROM (SELECT i.*, l.p, l.value FROM i JOIN l USING (user_id, ts, event_id) WHERE h) GROUP BY ALL) SELECT user_id, start, start_value, end_value, least_value, NOT ongoing AND end_value > 1.1 * least_value AS recovery FROM c JOIN v USING (user_id, start)")
def w5_collapse_recovery(spark, d):
    """From where each collapse fell, to where, and whether it recovered."""
    return _collapses(spark, d).select("user_id", "start", "start_value", "end_value", "least_value", "recovery")


@query(f"WITH {_COLLAPSE} SELECT c.user_id, c.start, event_type, round(avg(value), 4) AS mean, max(value) AS high, count(*) AS n FROM c JOIN events e ON e.user_id = c.user_id AND e.ts BETWEEN c.start AND c.\"end\" GROUP BY ALL")
def a42_collapse_causes(spark, d):
    """Statistics by cause inside each collapse."""
    return E.causes_within(_events(spark, d), _collapses(spark, d), ["user_id"], "ts", "event_type", "value").withColumn("mean", F.round("mean", 4))


@query(f"WITH s AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1), x AS (SELECT e.user_id, ts, event_id, value, s, coalesce(value > m + 2 * s, false) AS h FROM events e JOIN s USING (user_id)), i AS ({_ISL}) SELECT user_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS n, round(max(value), 4) AS peak, round(avg(value), 4) AS mean, round(coalesce(max(value) / nullif(max(s), 0), 0), 4) AS severity FROM i WHERE h GROUP BY user_id, island")
def w6_mortality_events(spark, d):
    """Runs above the mean plus two standard deviations."""
    out = E.exceedances(_events(spark, d), ["user_id"], ["ts", "event_id"], "ts", "value")
    return out.withColumns({c: F.round(c, 4) for c in ("peak", "mean", "severity")})


@query("WITH g AS (SELECT user_id, event_type, avg(value) AS m, max(value) AS h, stddev_pop(value) AS s, sum(value) AS t FROM events GROUP BY ALL) SELECT user_id, event_type, round(m, 7) AS mean, round(h, 4) AS high, round(s, 7) AS sd, round(t, 4) AS total, round(t / nullif(sum(t) OVER w, 0), 6) AS share, row_number() OVER (PARTITION BY user_id ORDER BY t DESC NULLS LAST, event_type) AS rank, row_number() OVER (PARTITION BY user_id ORDER BY t DESC NULLS LAST, event_type) = 1 AS dominant FROM g WINDOW w AS (PARTITION BY user_id)")
def a34_cause_shares(spark, d):
    """Statistics, shares and ranks of causes, the dominant one marked."""
    out = E.cause_shares(_events(spark, d), ["user_id"], "event_type", "value")
    return out.withColumns({"mean": F.round("mean", 7), "high": F.round("high", 4), "sd": F.round("sd", 7), "total": F.round("total", 4), "share": F.round("share", 6), "rank": F.col("rank").cast("long")})


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM events), g AS (SELECT user_id, avg(value) FILTER (a <= 12) AS f, avg(value) FILTER (z <= 12) AS l FROM n GROUP BY 1) SELECT user_id, round(f, 4) AS first, round(l, 4) AS last, round(100 * (l - f) / f, 4) AS change_pct, CASE WHEN l / f < 0.5 THEN 'severe' WHEN l / f < 0.8 THEN 'moderate' WHEN l / f < 0.95 THEN 'mild' ELSE 'met' END AS band FROM g")
def a39_depletion(spark, d):
    """First and last twelve records, the change and its band."""
    out = E.depletion(_events(spark, d), ["user_id"], ["ts", "event_id"], "value")
    band = E.supply_band(F.try_divide(F.col("last"), F.col("first")))
    return out.select("user_id", F.round("first", 4).alias("first"), F.round("last", 4).alias("last"), F.round("change_pct", 4).alias("change_pct"), band.alias("band"))


@query("SELECT o_custkey AS case_id, min(k) FILTER (best <= 30000) AS hit FROM (SELECT o_custkey, o_orderkey AS k, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS best FROM orders) GROUP BY 1")
def w13_first_hit(spark, d):
    """The first evaluation at which the best value reaches a bar."""
    from ensolith.plans.calibration import w12_best_so_far

    return E.first_hit(w12_best_so_far(spark, d), ["case_id"], "eval", "best", F.lit(30000.0))


@query("""WITH s AS (SELECT user_id, epoch(ts) AS t, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY ALL), o AS (SELECT DISTINCT user_id, epoch(ts) AS t FROM events WHERE event_type = 'view'),
b AS (SELECT o.user_id, o.t, s.t AS ta, s.v AS va FROM o ASOF LEFT JOIN s ON o.user_id = s.user_id AND o.t >= s.t), c AS (SELECT b.*, s.t AS tb, s.v AS vb FROM b ASOF LEFT JOIN s ON b.user_id = s.user_id AND b.t <= s.t)
SELECT user_id, CAST(round(t) AS BIGINT) AS t, round(CASE WHEN ta = t THEN va WHEN ta IS NOT NULL AND tb IS NOT NULL THEN va + (vb - va) * (t - ta) / (tb - ta) END, 4) AS value FROM c""")
def j11_interpolate(spark, d):
    """A simulated series interpolated at observed times."""
    e = table(spark, d, "events").withColumn("t", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) / 1e6"))
    out = E.interpolate_at(e.where("event_type = 'click'"), e.where("event_type = 'view'").select("user_id", "t").distinct(), ["user_id"], "t", "value")
    return out.select("user_id", F.round("t").cast("long").alias("t"), F.round("value", 4).alias("value"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x_tumbling_days(spark, d):
    """Tumbling windows; ``ensolith.streaming`` runs the same on a stream."""
    return table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")
