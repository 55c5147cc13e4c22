"""Preference formatting of chosen and rejected conversations.

The longest common turn prefix of the two is rendered once as the prompt; what follows it on
each side is a completion with the spans to learn from: the contents of assistant turns. Only
DataFrame functions run; conversations are gathered by id and the two sides of a pair by its
key, so no group is larger than the turns of two conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TURN = "array<struct<turn:bigint,role:string,text:string>>"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the distinct turns of each conversation by number, then role and text.

    Null roles and texts are empty strings, turns without a number come first; rows without a
    conversation id belong to none and are left out. Repeated turns count once, very long ones are
    kept whole. Other columns are ignored; an empty table gives an empty result.
    """
    row = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    return row.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))


def _filled(turns: Column) -> Column:
    """Turns with empty strings for null roles and texts."""
    return F.transform(turns, lambda t: F.struct(t["turn"].alias("turn"), F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def _head(turn) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit("<|end|>\n"))), "")


def _spans(turns: Column) -> Column:
    """'from-to' character spans of the assistant contents in the rendered turns, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(s, t):
        a = s["at"] + F.length(_head(t))
        b = a + F.length(t["text"])
        span = F.concat(a.cast("string"), F.lit("-"), b.cast("string"))
        return F.struct((b + F.length(F.lit("<|end|>\n"))).alias("at"), F.when(t["role"] == "assistant", F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) of turn arrays to training rows.

    Columns: pair_id, n_common, prompt, chosen and rejected (completions), chosen_spans and
    rejected_spans (what is learnt; all else is masked), status: paired, identical (no turn
    differs: both completions are empty), or unpaired (a side is missing: no prompt, the side's
    whole conversation is its completion, the other is null). Turns are equal if role and text are;
    null roles and texts are empty strings. Very long turns are kept whole, repeated pairs stay
    rows. Other columns are ignored; an empty table gives an empty result.
    """
    pairs = pairs.select("pair_id", _filled(F.col("chosen")).alias("chosen"), _filled(F.col("rejected")).alias("rejected"))
    a, b = F.col("chosen"), F.col("rejected")
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    differs = F.array_position(same, F.lit(False))
    common = F.when(a.isNull() | b.isNull(), 0).when(differs == 0, n).otherwise(differs - 1).cast("int")
    cut = pairs.withColumn("n_common", common)
    after = lambda c: F.when(F.col(c).isNotNull(), F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0))))
    cut = cut.withColumn("_prompt", F.slice(F.coalesce(a, b), F.lit(1), F.col("n_common"))).withColumn("_a", after("chosen")).withColumn("_b", after("rejected"))
    status = F.when(a.isNull() | b.isNull(), "unpaired").when((F.size("_a") == 0) & (F.size("_b") == 0), "identical").otherwise("paired")
    return cut.select(
        "pair_id", F.col("n_common").cast("long").alias("n_common"), _render(F.col("_prompt")).alias("prompt"), _render(F.col("_a")).alias("chosen"), _render(F.col("_b")).alias("rejected"),
        _spans(F.col("_a")).alias("chosen_spans"), _spans(F.col("_b")).alias("rejected_spans"), status.alias("status"),
    )


def neighbours_as_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): conversation 2k is the chosen, 2k + 1 the rejected side of pair k."""
    convs = conversations(turns)
    side = F.pmod(F.col("conv_id"), F.lit(2))
    key = F.floor(F.col("conv_id") / 2).cast("long")
    return convs.groupBy(key.alias("pair_id")).agg(F.max(F.when(side == 0, F.col("turns"))).alias("chosen"), F.max(F.when(side == 1, F.col("turns"))).alias("rejected"))


def oracle() -> str:
    """The same for DuckDB, by joining turns by their place."""
    end = "length('<|end|>' || chr(10))"
    return f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, conv_id // 2 AS pair_id, conv_id % 2 AS side, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
      '<|' || role || '|>' || chr(10) AS head FROM t),
s AS (SELECT pair_id, count(*) FILTER (side = 0) AS na, count(*) FILTER (side = 1) AS nb FROM n GROUP BY pair_id),
d AS (SELECT a.pair_id, min(a.k) AS k FROM n a JOIN n b ON a.pair_id = b.pair_id AND a.k = b.k AND a.side = 0 AND b.side = 1 WHERE a.role <> b.role OR a.text <> b.text GROUP BY 1),
c AS (SELECT s.pair_id, na, nb, CASE WHEN na = 0 OR nb = 0 THEN 0 WHEN d.k IS NULL THEN least(na, nb) ELSE d.k - 1 END AS n_common FROM s LEFT JOIN d USING (pair_id)),
r AS (SELECT n.*, n_common, sum(length(head) + length(text) + {end}) OVER (PARTITION BY n.conv_id, k > n_common ORDER BY k) - length(text) - {end} AS a FROM n JOIN c USING (pair_id)),
g AS (SELECT pair_id,
  string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY k) FILTER (k <= n_common AND side = 0) AS prompt,
  string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY k) FILTER (k > n_common AND side = 0) AS chosen,
  string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY k) FILTER (k > n_common AND side = 1) AS rejected,
  string_agg(CAST(a AS BIGINT) || '-' || CAST(a + length(text) AS BIGINT), ',' ORDER BY k) FILTER (k > n_common AND side = 0 AND role = 'assistant') AS chosen_spans,
  string_agg(CAST(a AS BIGINT) || '-' || CAST(a + length(text) AS BIGINT), ',' ORDER BY k) FILTER (k > n_common AND side = 1 AND role = 'assistant') AS rejected_spans
  FROM r GROUP BY pair_id)
SELECT c.pair_id, CAST(n_common AS BIGINT) AS n_common, coalesce(prompt, '') AS prompt,
  CASE WHEN na > 0 THEN coalesce(chosen, '') END AS chosen, CASE WHEN nb > 0 THEN coalesce(rejected, '') END AS rejected,
  CASE WHEN na > 0 THEN coalesce(chosen_spans, '') END AS chosen_spans, CASE WHEN nb > 0 THEN coalesce(rejected_spans, '') END AS rejected_spans,
  CASE WHEN na = 0 OR nb = 0 THEN 'unpaired' WHEN chosen IS NULL AND rejected IS NULL THEN 'identical' ELSE 'paired' END AS status
FROM c JOIN g USING (pair_id)"""
