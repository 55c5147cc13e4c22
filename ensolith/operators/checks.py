"""Checks of texts, entries and proposals: rules as columns, findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ensolith.operators.ranks import numbered


def findings(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule) for each rule that a row breaks; a rule that cannot be told is not broken."""
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items())), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(broken).alias("rule"))


def proposal_rules(current_tolerance: float = 1.0, least_change: float = 0.1, great_change: float = 50.0) -> dict[str, Column]:
    """Rules over (current, stated, proposed, low, high): stated value off the current one, not a number, out of bounds, no change, a great one."""
    now, said, new, low, high = (F.col(c) for c in ("current", "stated", "proposed", "low", "high"))
    change = 100 * F.abs(F.try_divide(new - now, now))
    return {
        "stated_value_off": 100 * F.abs(F.try_divide(said - now, now)) > current_tolerance, "not_a_number": new.isNull() | F.isnan(new),
        "out_of_bounds": ~new.between(low, high), "no_change": change < least_change, "great_change": change > great_change,
    }


def do_not_repeat(proposals: DataFrame, constraints: DataFrame, name: Column) -> DataFrame:
    """proposals (parameter, value) with a warning: repeats, where a stored bound (parameter, direction, bound) forbids it, or unevaluable.

    Names are normalised on both sides; a bound itself is forbidden.
    """
    c = constraints.withColumn("_name", name).select("_name", "direction", "bound")
    j = proposals.withColumn("_name", name).join(c, "_name")
    hit = F.when(F.col("value").isNull() | F.col("bound").isNull(), "unevaluable").when((F.col("direction") == "max") & (F.col("value") >= F.col("bound")), "repeats").when((F.col("direction") == "min") & (F.col("value") <= F.col("bound")), "repeats")
    return j.withColumn("warning", hit).where("warning is not null").drop("_name")


def mention_coverage(mentions: DataFrame, known: DataFrame, keys: list[str], name: str, good: float = 0.9, fair: float = 0.7) -> DataFrame:
    """Share of each text's distinct mentions that exist, with a status: ok, warning or failed; texts without any are ok."""
    m = mentions.select(*keys, name).distinct()
    j = m.join(known.select(name, F.lit(True).alias("_known")).distinct(), name, "left")
    g = j.groupBy(*keys).agg(F.count(name).alias("n"), F.count_if(F.col("_known") & F.col(name).isNotNull()).alias("n_known"))
    share = F.coalesce(F.try_divide(F.col("n_known"), F.col("n")), F.lit(1.0))
    return g.withColumn("share", share).withColumn("status", F.when(share >= good, "ok").when(share >= fair, "warning").otherwise("failed"))


def absent_entries(entries: DataFrame, corpus: DataFrame, name: str, words: Column) -> DataFrame:
    """Entries whose name is no word of any text of the corpus."""
    seen = corpus.select(F.explode(words).alias(name)).distinct()
    return entries.join(seen, name, "left_anti")


def shifted_ranges(citations: DataFrame, hunks: DataFrame) -> DataFrame:
    """citations (path, a, b) moved through a diff's hunks (path, start, n_old, n_new): (a, b, status).

    A hunk wholly before a range moves it by its growth; one that overlaps makes it stale.
    """
    j = citations.join(hunks, "path", "left")
    before = F.col("start") + F.col("n_old") <= F.col("a")
    over = (F.col("start") < F.col("b") + 1) & (F.col("start") + F.col("n_old") > F.col("a"))
    g = j.groupBy("path", "a", "b").agg(F.coalesce(F.sum(F.when(before, F.col("n_new") - F.col("n_old"))), F.lit(0)).alias("_by"), F.coalesce(F.bool_or(over), F.lit(False)).alias("_over"))
    return g.select("path", "a", "b", (F.col("a") + F.col("_by")).alias("new_a"), (F.col("b") + F.col("_by")).alias("new_b"), F.when(F.col("_over"), "stale").when(F.col("_by") != 0, "moved").otherwise("same").alias("status"))


def against_golden(counts: DataFrame, golden: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Counts (key, n) held against golden ones: missing, extra, off by more than the tolerance, or ok."""
    j = counts.join(golden.withColumnRenamed("n", "golden"), key, "full_outer")
    off = F.abs(F.col("n") - F.col("golden")) > tolerance * F.col("golden")
    return j.withColumn("status", F.when(F.col("n").isNull(), "missing").when(F.col("golden").isNull(), "extra").when(off, "off").otherwise("ok"))


def golden_queries(hits: DataFrame, golden: DataFrame) -> DataFrame:
    """(name, passed) of golden queries (name, must, must_not, any arrays) over hits (name, text).

    All of must in some text, none of must_not in any, one of any in some (if there are any).
    """
    none = F.array().cast("array<string>")
    words = golden.select("name", F.explode(F.concat(*(F.coalesce(c, none) for c in ("must", "must_not", "any")))).alias("_w")).where("_w is not null").distinct()
    wanted = F.broadcast(words.groupBy("name").agg(F.collect_list("_w").alias("_w")))  # golden queries: a short list
    own = hits.withColumn("_t", F.lower("text")).join(wanted, "name")
    found = own.select("name", F.explode(F.filter("_w", lambda w: F.contains(F.col("_t"), F.lower(w)))).alias("_w")).distinct()
    seen_words = found.groupBy("name").agg(F.collect_list("_w").alias("_found"))  # of the golden words only, so no text is kept
    j = golden.join(seen_words, "name", "left").withColumn("_found", F.coalesce("_found", none))
    seen = lambda w: F.coalesce(F.array_contains("_found", w), F.lit(False))
    ok = F.forall("must", seen) & ~F.exists("must_not", seen) & ((F.size("any") == 0) | F.exists("any", seen))
    return j.select("name", ok.alias("passed"))


def evidence(ledger: DataFrame, cap: int = 20) -> DataFrame:
    """Each parameter's fold over cycles of proposals (parameter, cycle, value, supported): (parameter, first_cycle, last_cycle, n_proposed, n_supported, status, trail).

    A parameter is active while the cycle proposes it and dropped once a cycle leaves it out. Its trail
    says proposed at first, then refined or kept by whether its value changed, and dropped, each with the
    cycle; the last ``cap`` entries stay. A parameter stands once in a cycle.
    """
    cycles = numbered(ledger.select("cycle").distinct(), [F.col("cycle")], "_at")
    last = cycles.agg(F.max("_at").alias("_last"))
    following = cycles.select((F.col("_at") - 1).alias("_at"), F.col("cycle").alias("_next"))
    w = Window.partitionBy("parameter").orderBy("_at")  # one parameter's proposals
    placed = ledger.join(cycles, "cycle").join(following, "_at", "left")
    placed = placed.withColumns({"_k": F.row_number().over(w), "_before": F.lag("value").over(w), "_then": F.lead("_at").over(w)})
    action = F.when(F.col("_k") == 1, "proposed").when(F.col("value").eqNullSafe(F.col("_before")), "kept").otherwise("refined")
    left_out = F.col("_next").isNotNull() & (F.col("_then").isNull() | (F.col("_then") > F.col("_at") + 1))
    entry = lambda cycle, what: F.struct(cycle.alias("cycle"), what.alias("action"))
    entries = F.array_compact(F.array(entry(F.col("cycle"), action), F.when(left_out, entry(F.col("_next"), F.lit("dropped")))))
    each = placed.select("parameter", F.explode(entries).alias("_e")).select("parameter", "_e.*")
    newest = each.withColumn("_r", F.row_number().over(Window.partitionBy("parameter").orderBy(F.desc("cycle")))).where(F.col("_r") <= cap)
    trails = newest.groupBy("parameter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cycle", "action"))), lambda e: F.concat(e["action"], F.lit("@"), e["cycle"].cast("string"))), ">").alias("trail"))
    g = placed.groupBy("parameter").agg(F.min("cycle").alias("first_cycle"), F.max("cycle").alias("last_cycle"), F.count("*").alias("n_proposed"), F.count_if("supported").alias("n_supported"), F.max("_at").alias("_at"))
    g = g.crossJoin(F.broadcast(last)).withColumn("status", F.when(F.col("_at") == F.col("_last"), "active").otherwise("dropped"))  # one row
    return g.join(trails, "parameter").select("parameter", "first_cycle", "last_cycle", "n_proposed", "n_supported", "status", "trail")


def relevant(entries: DataFrame, words: DataFrame, top: int, max_chars: int) -> DataFrame:
    """Entries (entry, name, text, confidence, verified) whose name holds, or is held by, a wanted word (column word).

    The shorter of the two is looked for among the other's letter runs: by its first three letters, or
    whole if it has but one or two; empty ones find nothing. Verified ones first, then the surest,
    ``top`` in all, texts cut to max_chars.
    """

    def runs(c, size):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(c, i, F.lit(size))))

    a = entries.select("entry", F.lower("name").alias("_name"))
    b = words.select(F.lower("word").alias("_word"))
    found = None
    for size in (1, 2, 3):
        own = (lambda c: F.length(c) >= 3) if size == 3 else (lambda c, n=size: F.length(c) == n)
        for inner, outer, name, other in ((a, b, "_name", "_word"), (b, a, "_word", "_name")):
            short = inner.where(own(name)).withColumn("_g", F.substring(name, 1, size))
            long = outer.where(F.length(other) >= size).withColumn("_g", F.explode(runs(F.col(other), size)))
            hit = short.join(long, "_g").where(F.contains(F.col(other), F.col(name))).select("entry")
            found = hit if found is None else found.unionByName(hit)
    picked = entries.join(found.distinct(), "entry", "left_semi").orderBy(F.desc("verified"), F.desc("confidence"), "entry").limit(top)
    return picked.select("entry", "name", F.substring("text", 1, max_chars).alias("text"), "confidence", "verified")


def nearest_version(versions: DataFrame, major: int, minor: int) -> DataFrame:
    """The registered version (version, major, minor, canonical, published) nearest by 100 major + minor; canonical, then older ones first."""
    apart = F.abs(100 * (F.col("major") - major) + F.col("minor") - minor)
    return versions.withColumn("distance", apart).orderBy("distance", ~F.col("canonical"), "published", "version").limit(1)


def bump_tier(distance: Column, same_file: Column) -> Column:
    """T1 for the same version and parameter file, T2 for the same version and another file, T3 for any other version."""
    return F.when(distance != 0, "T3").when(same_file, "T1").otherwise("T2")
