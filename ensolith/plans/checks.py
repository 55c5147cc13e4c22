"""Queries of checks: proposals against rules, constraints and evidence, texts against catalogs and golden answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ensolith.functions import columns as C
from ensolith.operators import checks as K
from ensolith.plans.registry import query, table


@query("WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS current, p_size * CASE WHEN p_partkey % 7 = 0 THEN 1.05 ELSE 1 END AS stated, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size * (1 + (p_partkey % 13) / 20.0) END AS proposed, 2.0 AS low, 60.0 AS high FROM part) SELECT p_partkey, unnest(list_filter([CASE WHEN 100 * abs((stated - current) / current) > 1 THEN 'stated_value_off' END, CASE WHEN proposed IS NULL THEN 'not_a_number' END, CASE WHEN NOT (proposed BETWEEN low AND high) THEN 'out_of_bounds' END, CASE WHEN 100 * abs((proposed - current) / current) < 0.1 THEN 'no_change' END, CASE WHEN 100 * abs((proposed - current) / current) > 50 THEN 'great_change' END], lambda x: x IS NOT NULL)) AS rule FROM p")
def p27_proposal_findings(spark, d):
    """Rules that a proposal breaks, a row each."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    p = table(spark, d, "part").select(k, size.alias("current"), (size * F.when(k % 7 == 0, 1.05).otherwise(1.0)).alias("stated"), F.when(k % 11 != 0, size * (1 + (k % 13) / 20.0)).alias("proposed"), F.lit(2.0).alias("low"), F.lit(60.0).alias("high"))
    return K.findings(p, ["p_partkey"], K.proposal_rules())


@query("WITH p AS (SELECT p_partkey, p_type AS parameter, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size END AS value FROM part), c AS (SELECT lower(p_type) AS name, 'max' AS direction, 30 AS bound FROM part WHERE p_partkey % 4 = 0 GROUP BY ALL UNION ALL SELECT lower(p_type), 'min', 10 FROM part WHERE p_partkey % 4 = 1 GROUP BY ALL) SELECT p_partkey, direction, CASE WHEN value IS NULL THEN 'unevaluable' ELSE 'repeats' END AS warning FROM p JOIN c ON lower(parameter) = name WHERE value IS NULL OR (direction = 'max' AND value >= bound) OR (direction = 'min' AND value <= bound)")
def p28_do_not_repeat(spark, d):
    """Proposals that a stored bound forbids."""
    p = table(spark, d, "part")
    stored = lambda r, direction, bound: p.where(F.col("p_partkey") % 4 == r).select(F.concat(F.upper("p_type"), F.lit("_3")).alias("parameter"), F.lit(direction).alias("direction"), F.lit(bound).alias("bound")).distinct()
    asked = p.select("p_partkey", F.col("p_type").alias("parameter"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_size")).alias("value"))
    out = K.do_not_repeat(asked, stored(0, "max", 30).unionByName(stored(1, "min", 10)), C.same_parameter(F.col("parameter")))
    return out.select("p_partkey", "direction", "warning")


@query("WITH m AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS name FROM lineitem), g AS (SELECT doc, count(*) AS n, count(*) FILTER (name IN (SELECT p_partkey FROM part WHERE p_size < 40)) AS k FROM m GROUP BY 1) SELECT doc, n, k AS n_known, round(k / n, 6) AS share, CASE WHEN k / n >= 0.9 THEN 'ok' WHEN k / n >= 0.7 THEN 'warning' ELSE 'failed' END AS status FROM g")
def b2_mention_coverage(spark, d):
    """B2: shares of what is mentioned that exist, with status bands."""
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("name"))
    out = K.mention_coverage(m, table(spark, d, "part").where("p_size < 40").select(F.col("p_partkey").alias("name")), ["doc"], "name")
    return out.withColumn("share", F.round("share", 6))


@query("WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS name FROM benchmark WHERE item_id % 2 = 0), c AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS name FROM benchmark WHERE item_id % 2 = 1) SELECT name FROM n WHERE name NOT IN (SELECT name FROM c)")
def b3_absent_entries(spark, d):
    """Entries that no text mentions."""
    b = table(spark, d, "benchmark")
    entries = b.where("item_id % 2 = 0").select(F.explode(C.tokens(F.col("text"))).alias("name")).distinct()
    return K.absent_entries(entries, b.where("item_id % 2 = 1"), "name", C.tokens(F.col("text")))


@query("WITH c AS (SELECT DISTINCT l_suppkey AS path, l_linenumber * 10 AS a, l_linenumber * 10 + 5 AS b FROM lineitem), h AS (SELECT s_suppkey AS path, 22 AS start, 4 AS n_old, s_nationkey AS n_new FROM supplier WHERE s_suppkey % 3 <> 0) SELECT c.path, a, b, a + coalesce(CASE WHEN start + n_old <= a THEN n_new - n_old END, 0) AS new_a, b + coalesce(CASE WHEN start + n_old <= a THEN n_new - n_old END, 0) AS new_b, CASE WHEN coalesce(start < b + 1 AND start + n_old > a, false) THEN 'stale' WHEN coalesce(CASE WHEN start + n_old <= a THEN n_new - n_old END, 0) <> 0 THEN 'moved' ELSE 'same' END AS status FROM c LEFT JOIN h USING (path)")
def b5_shifted_ranges(spark, d):
    """Cited line ranges moved through a diff."""
    n = F.col("l_linenumber") * 10
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("path"), n.alias("a"), (n + 5).alias("b")).distinct()
    h = table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("path"), F.lit(22).alias("start"), F.lit(4).alias("n_old"), F.col("s_nationkey").alias("n_new"))
    return K.shifted_ranges(c, h)


@query("WITH c AS (SELECT event_type AS tag, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1), g AS (SELECT event_type AS tag, count(*) * CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS golden FROM events WHERE event_type <> 'login' GROUP BY 1, event_type) SELECT tag, n, golden, CASE WHEN n IS NULL THEN 'missing' WHEN golden IS NULL THEN 'extra' WHEN abs(n - golden) > 0.1 * golden THEN 'off' ELSE 'ok' END AS status FROM c FULL JOIN g USING (tag)")
def b6_against_golden(spark, d):
    """A distribution of tags held against golden counts."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("tag")).agg(F.count("*").alias("n"))
    golden = e.where("tag <> 'login'").withColumn("n", F.col("n") * F.when(F.col("tag") == "click", 2).otherwise(1))
    return K.against_golden(e.where("tag <> 'view'"), golden, "tag", 0.1)


@query("WITH x AS (SELECT doc_id, text IS NULL OR text = '' AS e, n_chars <> length(coalesce(text, '')) AS l, lang NOT IN ('en', 'de', 'es', 'fr') AS u FROM documents) SELECT doc_id, unnest(list_filter([CASE WHEN e THEN 'empty' END, CASE WHEN l THEN 'wrong_length' END, CASE WHEN u THEN 'unknown_language' END], lambda y: y IS NOT NULL)) AS rule FROM x")
def b7_invariants(spark, d):
    """Invariants of entries and their metadata, the violations as rows."""
    t = F.coalesce("text", F.lit(""))
    return K.findings(table(spark, d, "documents"), ["doc_id"], {"empty": t == "", "wrong_length": F.col("n_chars") != F.length(t), "unknown_language": ~F.col("lang").isin("en", "de", "es", "fr")})


@query("WITH h AS (SELECT lang AS name, lower(text) AS t FROM documents), g(name, must, must_not, anyof) AS (VALUES ('en', ['the'], ['zzzzqq'], []), ('de', ['zzzzqq'], [], []), ('es', [], [], ['zzzzqq', 'a']), ('xx', ['a'], [], [])) SELECT name, (SELECT bool_and(coalesce((SELECT bool_or(contains(t, w)) FROM h WHERE h.name = g.name), false)) FROM (SELECT unnest(must) AS w)) IS NOT FALSE AND (SELECT bool_or(coalesce((SELECT bool_or(contains(t, w)) FROM h WHERE h.name = g.name), false)) FROM (SELECT unnest(must_not) AS w)) IS NOT TRUE AND (len(anyof) = 0 OR (SELECT bool_or(coalesce((SELECT bool_or(contains(t, w)) FROM h WHERE h.name = g.name), false)) FROM (SELECT unnest(anyof) AS w))) AS passed FROM g")
def b9_golden_queries(spark, d):
    """Golden assertions over what a query returns."""
    golden = spark.createDataFrame([("en", ["the"], ["zzzzqq"], []), ("de", ["zzzzqq"], [], []), ("es", [], [], ["zzzzqq", "a"]), ("xx", ["a"], [], [])], "name string, must array<string>, must_not array<string>, any array<string>")
    return K.golden_queries(table(spark, d, "documents").select(F.col("lang").alias("name"), "text"), golden)


@query("""WITH l AS (SELECT o_custkey AS parameter, year(o_orderdate) * 12 + month(o_orderdate) AS cycle, min(o_orderpriority) AS value, bool_or(o_orderstatus = 'F') AS supported FROM orders GROUP BY ALL),
c AS (SELECT cycle, row_number() OVER (ORDER BY cycle) AS i, lead(cycle) OVER (ORDER BY cycle) AS next FROM (SELECT DISTINCT cycle FROM l)),
p AS (SELECT l.*, i, next, lag(value) OVER w AS before, row_number() OVER w AS k, lead(i) OVER w AS then_ FROM l JOIN c USING (cycle) WINDOW w AS (PARTITION BY parameter ORDER BY cycle)),
e AS (SELECT parameter, cycle, CASE WHEN k = 1 THEN 'proposed' WHEN value IS NOT DISTINCT FROM before THEN 'kept' ELSE 'refined' END AS action FROM p UNION ALL SELECT parameter, next, 'dropped' FROM p WHERE next IS NOT NULL AND (then_ IS NULL OR then_ > i + 1)),
t AS (SELECT parameter, string_agg(action || '@' || cycle, '>' ORDER BY cycle) AS trail FROM (SELECT *, row_number() OVER (PARTITION BY parameter ORDER BY cycle DESC) AS r FROM e) WHERE r <= 20 GROUP BY 1)
SELECT parameter, min(cycle) AS first_cycle, max(cycle) AS last_cycle, count(*) AS n_proposed, count(*) FILTER (supported) AS n_supported, CASE WHEN max(i) = (SELECT max(i) FROM c) THEN 'active' ELSE 'dropped' END AS status, any_value(trail) AS trail FROM p JOIN t USING (parameter) GROUP BY 1""")
def k9_evidence(spark, d):
    """K9: each parameter's evidence over cycles, the trail capped."""
    cycle = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("parameter"), cycle.cast("long").alias("cycle"))
    return K.evidence(o.agg(F.min("o_orderpriority").alias("value"), F.bool_or(F.col("o_orderstatus") == "F").alias("supported")))


@query("WITH e AS (SELECT p_partkey AS entry, p_name AS name, p_type AS text, p_retailprice AS confidence, p_size > 25 AS verified FROM part), w(word) AS (VALUES ('part'), ('BLUE'), ('xyz'), ('z'), ('1')) SELECT entry, name, substring(text, 1, 8) AS text, confidence, verified FROM (SELECT *, row_number() OVER (ORDER BY verified DESC, confidence DESC, entry) AS k FROM e WHERE EXISTS (SELECT 1 FROM w WHERE contains(lower(name), lower(word)) OR contains(lower(word), lower(name)))) WHERE k <= 5")
def w15_relevant(spark, d):
    """Entries about the wanted words, verified and surest first."""
    e = table(spark, d, "part").select(F.col("p_partkey").alias("entry"), F.col("p_name").alias("name"), F.col("p_type").alias("text"), F.col("p_retailprice").alias("confidence"), (F.col("p_size") > 25).alias("verified"))
    return K.relevant(e, spark.sql("SELECT * FROM VALUES 'part', 'BLUE', 'xyz', 'z', '1' AS t(word)"), 5, 8)


@query("WITH v AS (SELECT s_suppkey AS version, s_nationkey AS major, s_suppkey % 10 AS minor, s_suppkey % 2 = 0 AS canonical, s_suppkey AS published FROM supplier) SELECT version, abs(100 * (major - 12) + minor - 3) AS distance, CASE WHEN abs(100 * (major - 12) + minor - 3) > 0 THEN 'T3' WHEN canonical THEN 'T1' ELSE 'T2' END AS tier FROM v ORDER BY distance, NOT canonical, published, version LIMIT 1")
def t14_nearest_version(spark, d):
    """The nearest registered version and its tier."""
    k = F.col("s_suppkey")
    v = table(spark, d, "supplier").select(k.alias("version"), F.col("s_nationkey").alias("major"), F.pmod(k, F.lit(10)).alias("minor"), (k % 2 == 0).alias("canonical"), k.alias("published"))
    out = K.nearest_version(v, 12, 3)
    return out.select("version", "distance", K.bump_tier(F.col("distance"), F.col("canonical")).alias("tier"))
