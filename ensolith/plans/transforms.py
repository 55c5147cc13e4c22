"""Queries of transforms, units, splits, sensitivity and validation measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ensolith.functions import columns as C
from ensolith.operators import retrieval as R
from ensolith.operators import sensitivity as V
from ensolith.plans.registry import query, table


def _mixed(key: str, salt: str, buckets: int) -> str:
    return f"(((({key}) * 48271 + ({salt}) * 30269 + 12345) % 2147483647) * 16807 % 2147483647 % {buckets})"


def _round(df, digits, *names):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("SELECT p_partkey, round(ln(p_retailprice), 8) AS z, round(p_retailprice, 6) AS back, round(ln((p_size / 60.0) / (1 - p_size / 60.0)), 8) AS logit, round(log10(p_size), 8) AS sampled, CASE WHEN ((p_size / 7.0) % 2) > 1 THEN round(2 - (p_size / 7.0) % 2, 8) ELSE round((p_size / 7.0) % 2, 8) END AS folded FROM part")
def f16_invertible_transforms(spark, d):
    """Transforms with their inverses, log columns, reflection into the box."""
    price, share = F.col("p_retailprice"), F.col("p_size") / 60.0
    z = C.transformed(price, "log")
    out = table(spark, d, "part").select("p_partkey", z.alias("z"), C.untransformed(z, "log").alias("back"), C.transformed(share, "logit").alias("logit"), C.sampling_space(F.col("p_size").cast("double"), True).alias("sampled"), C.reflect_unit(F.col("p_size") / 7.0).alias("folded"))
    return _round(_round(out, 8, "z", "logit", "sampled", "folded"), 6, "back")


@query("SELECT l_orderkey, l_linenumber, round(l_discount * l_quantity, 6) AS first, round((1 - l_discount) * l_quantity, 6) AS second FROM lineitem")
def f20_parts_of_total(spark, d):
    """a share and a total to the native pair."""
    a, b = C.parts_of_total(F.col("l_discount"), F.col("l_quantity"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(a, 6).alias("first"), F.round(b, 6).alias("second"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_size END, 9) AS a, coalesce(CASE WHEN p_partkey % 3 = 1 THEN p_size END, 8) AS b, CASE WHEN p_brand = 'Brand#11' AND p_size > 20 THEN round(p_retailprice * 1.1, 4) ELSE round(p_retailprice, 4) END AS price FROM part")
def f21_defaults_and_changes(spark, d):
    """active columns widened by defaults; a value changed where its key holds."""
    k = F.col("p_partkey") % 3
    here = (F.col("p_brand") == "Brand#11") & (F.col("p_size") > 20)
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.when(k == 0, F.col("p_size")), F.lit(9)).alias("a"), F.coalesce(F.when(k == 1, F.col("p_size")), F.lit(8)).alias("b"), F.round(C.modified(F.col("p_retailprice"), here, percent=F.lit(10.0)), 4).alias("price"))


@query("SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS nitrogen, 'true' AS verbose, 'x' || s_suppkey AS deck FROM supplier")
def f8_options(spark, d):
    """Option strings as maps."""
    text = F.concat(F.lit("-nitrogen "), "s_nationkey", F.lit(" -verbose -deck=x"), "s_suppkey")
    m = table(spark, d, "supplier").select("s_suppkey", C.options(text).alias("m"))
    return m.select("s_suppkey", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("nitrogen", "verbose", "deck")))


@query("SELECT l_suppkey AS case_id, round(sum(l_quantity) / sum(l_linenumber * 8.0), 6) AS supply_demand_ratio, round(sum(l_linenumber * 8.0) - sum(l_quantity), 4) AS deficit, round((sum(l_linenumber * 8.0) - sum(l_quantity)) / sum(l_linenumber * 8.0), 6) AS relative_deficit, round(sum(l_discount) / sum(l_quantity), 6) AS loss_fraction, round(sum(l_discount) / greatest(0, 1e-10), 0) AS turnover, round(sum(l_quantity) - sum(l_discount), 4) AS net FROM lineitem GROUP BY 1")
def f11_measures(spark, d):
    """Named measures with a guarded divisor."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("case_id")).agg(F.sum("l_quantity").alias("s"), F.sum(F.col("l_linenumber") * 8.0).alias("d"), F.sum("l_discount").alias("l"))
    digits = {"deficit": 4, "net": 4, "turnover": 0}
    return g.select("case_id", *(F.round(f(F.col("s"), F.col("d"), F.col("l"), F.lit(0.0)), digits.get(n, 6)).alias(n) for n, f in C.MEASURES.items()))


@query("SELECT l_suppkey AS case_id, round(sum(l_discount * 365 * 86400), 2) AS from_seconds, round(sum(l_discount * 12), 4) AS from_months, round(sum(l_discount * 86400 * [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][month(l_shipdate)] * 1000), 0) AS grams FROM lineitem GROUP BY 1")
def f14_fluxes(spark, d):
    """Fluxes per year, and over each month's own days without leap days."""
    x = F.col("l_discount")
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("case_id"))
    return g.agg(F.round(F.sum(C.flux_a_year(x, "s")), 2).alias("from_seconds"), F.round(F.sum(C.flux_a_year(x, "month")), 4).alias("from_months"), F.round(F.sum(C.flux_a_month(x, F.month("l_shipdate"), 1000.0)), 0).alias("grams"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority = '1-URGENT' ELSE true END AS speed_fast, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority = '2-HIGH' ELSE true END AS speed_slow FROM orders")
def p18_applies_in(spark, d):
    """Named tags as flags for all values of an axis."""
    tag = F.when(F.col("o_orderpriority") == "1-URGENT", "fast").when(F.col("o_orderpriority") == "2-HIGH", "slow").otherwise("none")
    tags = F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("speed"), F.array(tag))).otherwise(F.create_map().cast("map<string,array<string>>"))
    m = table(spark, d, "orders").select("o_orderkey", C.applies_in(tags, {"speed": ["fast", "slow"]}).alias("m"))
    return m.select("o_orderkey", *(F.element_at("m", k).alias(k) for k in ("speed_fast", "speed_slow")))


@query(f"SELECT o_orderkey, {_mixed('o_orderkey', '7', 1000)} < 200 AS held_out, o_orderstatus IN ('P') AS held_level FROM orders")
def d9_random_split(spark, d):
    """A random fifth, and all rows of a level."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", (V.mixed(k, 7, 1000) < 200).alias("held_out"), F.col("o_orderstatus").isin("P").alias("held_level"))


_BIN = "least(9, CAST(floor((l_extendedprice - lo) / (hi - lo) * 10) AS INT))"


@query(f"WITH s AS (SELECT l_quantity AS y, {_BIN} AS b, l_orderkey * 8 + l_linenumber AS k FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)), m AS (SELECT b, count(*) AS n, avg(y) AS m FROM s GROUP BY 1), t AS (SELECT turn, {_mixed('k', 'turn', 10)} AS b, count(*) AS n, avg(y) AS m FROM s, (SELECT unnest(range(1, 9)) AS turn) GROUP BY ALL), v AS (SELECT var_pop(y) AS v, avg(y) AS a FROM s) SELECT round((SELECT sum(n * (m - a) ** 2) / sum(n) / any_value(v) FROM m, v), 6) AS effect, round((SELECT max(e) FROM (SELECT sum(n * (m - a) ** 2) / sum(n) / any_value(v) AS e FROM t, v GROUP BY turn)), 6) AS floor")
def m2_noise_floor(spark, d):
    """M1, M2: a first-order effect by bins, and the largest that random bins show."""
    li = table(spark, d, "lineitem")
    ends = li.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    s = li.crossJoin(F.broadcast(ends))  # one row
    b = F.least(F.lit(9), F.floor((F.col("l_extendedprice") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10).cast("int"))
    effect = V.binned_effect(s, b, "l_quantity")
    floor = V.noise_floor(li, F.col("l_orderkey") * 8 + F.col("l_linenumber"), "l_quantity", 10, 8)
    return _round(effect.crossJoin(F.broadcast(floor)), 6, "effect", "floor")  # one row each


@query("WITH s AS (SELECT l_quantity / 50.0 AS p, l_discount * 10 > 0.5 AS t FROM lineitem) SELECT round(avg(((p >= 0.5) = t)::INT), 6) AS accuracy, count(*) AS n, round(avg(((p >= 0.5) = t)::INT) FILTER (abs(p - 0.5) <= 0.25), 6) AS boundary_accuracy, count(*) FILTER (abs(p - 0.5) <= 0.25) AS n_boundary FROM s")
def m16_classifier_report(spark, d):
    """Accuracy overall and near the boundary."""
    s = table(spark, d, "lineitem").select((F.col("l_quantity") / 50.0).alias("p"), (F.col("l_discount") * 10 > 0.5).alias("t"))
    return _round(V.boundary_report(s, "p", F.col("t")), 6, "accuracy", "boundary_accuracy")


@query("WITH c AS (SELECT l_partkey AS k, 1 - sum((l_extendedprice - l_quantity * 1500) ** 2) / nullif(var_pop(l_extendedprice) * count(*), 0) AS r, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 8) SELECT count(r) AS n_cases, round(quantile_cont(r, 0.1), 4) AS p10, round(quantile_cont(r, 0.5), 4) AS p50, round(quantile_cont(r, 0.9), 4) AS p90, round(avg((r >= 0.5)::INT), 6) AS share FROM c WHERE r IS NOT NULL")
def m17_r2_summary(spark, d):
    """Quantiles of R2 within cases of eight pairs or more."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1500).alias("p"))
    return _round(_round(V.case_r2_summary(li, "k", "t", "p"), 4, "p10", "p50", "p90"), 6, "share")


@query("SELECT l_returnflag AS target, round(avg((l_extendedprice BETWEEN l_quantity * 1200 AND l_quantity * 1700)::INT), 6) AS hit_rate, count(*) AS n FROM lineitem GROUP BY 1")
def m21_confirmed(spark, d):
    """How often observations fell into their interval."""
    q = F.col("l_quantity")
    return _round(V.confirmed(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "target"), ["target"], F.col("l_extendedprice"), q * 1200, q * 1700), 6, "hit_rate")


@query(f"WITH s AS (SELECT l_extendedprice AS t, l_quantity * 1500 AS p, turn, {_mixed('l_orderkey * 8 + l_linenumber', 'turn', 1000000)} / 1e6 AS u FROM lineitem, (SELECT unnest(range(1, 21)) AS turn)), w AS (SELECT *, (u >= 0.367879)::INT + (u >= 0.735759)::INT + (u >= 0.919699)::INT + (u >= 0.981012)::INT + (u >= 0.996340)::INT AS w FROM s), r AS (SELECT turn, 1 - sum(w * (t - p) ** 2) / (sum(w * t * t) - sum(w * t) ** 2 / sum(w)) AS r FROM w GROUP BY 1) SELECT round(avg((r >= 0.55)::INT), 6) AS pass_rate, round(min(r), 5) AS low, round(median(r), 5) AS middle, round(max(r), 5) AS high FROM r")
def m19_bootstrap(spark, d):
    """Acceptance by R2 over bootstrap turns."""
    li = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1500).alias("p"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    return _round(_round(V.bootstrap_r2(li, F.col("k"), "t", "p", 20, 0.55), 6, "pass_rate"), 5, "low", "middle", "high")


@query("WITH q(id, t) AS (SELECT o_orderkey, 'How does leaf_c' || (o_orderkey % 3) || ' respond in PFT #' || (o_orderkey % 12) || ' under drought?' FROM orders) SELECT id AS o_orderkey, 'parameter' AS kind, 'leaf_c' || (id % 3) AS entity FROM q UNION ALL SELECT id, 'group', 'pft' || (id % 12) FROM q UNION ALL SELECT id, 'mechanism', 'water' FROM q")
def f4_entities(spark, d):
    """parameters, groups and mechanisms named in a question."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("How does leaf_c"), k % 3, F.lit(" respond in PFT #"), k % 12, F.lit(" under drought?"))
    return R.entities(table(spark, d, "orders").select("o_orderkey", text.alias("t")), "o_orderkey", "t", {"drought": "water", "frost": "cold"})


@query("WITH h AS (SELECT lang AS query_no, source, doc_id, n_chars AS similarity, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS pos FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY query_no, pos) AS k FROM h WHERE pos <= 10) SELECT source, doc_id, similarity FROM f WHERE k = 1 ORDER BY similarity DESC, doc_id LIMIT 5")
def t13_several_queries(spark, d):
    """The lists of several queries in one, the first hit of each source."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_no").orderBy(F.desc("similarity"), "doc_id")
    h = table(spark, d, "documents").select(F.col("lang").alias("query_no"), "source", "doc_id", F.col("n_chars").alias("similarity")).withColumn("pos", F.row_number().over(w)).where("pos <= 10")
    return R.nearest_of_each_query(h, "source", ["doc_id"], 5).select("source", "doc_id", "similarity")


@query("WITH s AS (SELECT o_custkey AS k, o_orderstatus AS section, 'order ' || o_orderkey AS t, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), h AS (SELECT k, section, string_agg(t, chr(10) ORDER BY r) AS t FROM s WHERE r <= 3 GROUP BY k, section), g AS (SELECT k, section, '## ' || section || chr(10) || t AS t FROM h) SELECT k AS o_custkey, substring(string_agg(t, chr(10) || chr(10) ORDER BY section), 1, 60) AS context FROM g GROUP BY 1")
def r4_context(spark, d):
    """A context of capped sections, cut to a length."""
    s = table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("section"), F.concat(F.lit("order "), "o_orderkey").alias("text"), F.col("o_totalprice").alias("p"), "o_orderkey")
    return R.context(s, "o_custkey", [F.desc("p"), "o_orderkey"], 3, 60)
