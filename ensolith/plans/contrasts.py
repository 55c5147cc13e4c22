"""Queries of contrasts between the ends of a parameter, by return flag of the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ensolith.operators import contrasts as N
from ensolith.plans.registry import query, table

_TIE = ["l_orderkey", "l_linenumber", "l_extendedprice"]  # order and line alone are not unique


def _rows(spark, d, *columns):
    return table(spark, d, "lineitem").select("l_returnflag", *dict.fromkeys([*_TIE, *columns]))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


_RANKED = "SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS ry FROM lineitem"


@query(f"WITH r AS ({_RANKED}), q AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM lineitem GROUP BY 1) SELECT l_returnflag, count(*) AS n, round(corr(rx, ry), 6) AS rho, round(avg(l_extendedprice) FILTER (l_quantity <= a), 6) AS low, round(avg(l_extendedprice) FILTER (l_quantity >= b), 6) AS high, round(avg(l_extendedprice) FILTER (l_quantity <= a) / (avg(l_extendedprice) FILTER (l_quantity >= b) + 1e-10), 6) AS ratio FROM r JOIN q USING (l_returnflag) GROUP BY 1")
def v9_quartile_contrast(spark, d):
    """V9: rank correlation and quartile contrast of prices by quantity."""
    out = N.quartile_contrast(_rows(spark, d, "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice", _TIE)
    return _rounded(out, "rho", "low", "high", "ratio").drop("p", "link")


@query("WITH p AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem), g AS (SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_extendedprice) AS r, avg(l_extendedprice) FILTER (k <= floor(n * 0.1)) AS low, avg(l_extendedprice) FILTER (k > n - floor(n * 0.1)) AS high FROM p GROUP BY 1) SELECT l_returnflag, n, round(r, 6) AS r, round(low, 6) AS low, round(high, 6) AS high, round(high / (low + 1e-10), 6) AS ratio FROM g")
def v8_tail_contrast(spark, d):
    """V8: prices of the tenth of line items with the smallest and with the largest quantity."""
    out = N.tail_contrast(_rows(spark, d, "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice", _TIE)
    return _rounded(out, "r", "low", "high", "ratio")


@query("WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q FROM lineitem GROUP BY 1), f AS (SELECT l_returnflag, l_quantity < 10 AS f, CASE WHEN l_extendedprice < q THEN 1.0 ELSE 0.0 END AS x FROM lineitem JOIN q USING (l_returnflag)), g AS (SELECT l_returnflag, count(*) AS n, count(*) FILTER (f) AS n_flagged, coalesce(avg(x) FILTER (f), 0) AS a, coalesce(avg(x) FILTER (NOT f), 0) AS b FROM f GROUP BY 1) SELECT l_returnflag, n, n_flagged, round(a, 6) AS rate_flagged, round(b, 6) AS rate_rest, b > 0 AND a > 1.5 * b AS raised FROM g")
def v8_failure_rates(spark, d):
    """V8: how often small quantities fall into the lowest quarter of prices, against the rest."""
    out = N.failure_rates(_rows(spark, d, "l_quantity", "l_extendedprice"), ["l_returnflag"], F.col("l_quantity") < 10, "l_extendedprice")
    return _rounded(out, "rate_flagged", "rate_rest")
