"""Runs found on a stream: equal to plain scans of each series, however the rows are dealt into batches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ensolith.operators import events as E
from ensolith.streaming import runs as R

START = datetime.datetime(2001, 1, 1)
SCHEMA = "k int, at timestamp, v double"


def at(day):
    return START + datetime.timedelta(days=day)


def streamed(spark, tmp_path, name, batches, make):
    """Rows of the stream over one file a micro-batch; a last record of another key moves the watermark past all."""
    folder = f"{tmp_path}/{name}"
    for k, rows in enumerate([*batches, [(-1, at(10_000), 0.0)], [(-1, at(10_001), 0.0)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    q = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.table(name).where("k >= 0").collect())


@pytest.fixture(scope="module")
def series():
    r = random.Random(5)
    rows = [(k, at(d), round(r.uniform(-1, 1) + (0.8 if d // 7 % 2 else -0.8), 3)) for k in range(3) for d in range(40)]
    rows += [(3, at(d), v) for d, v in enumerate((1.0, None, 2.0, 3.0))] + [(4, at(0), 1.0), (4, at(1), 2.0)]
    return rows


def dealt(rows, cut, shuffled):
    """Rows in the order of days, moved by up to two days, in batches."""
    r = random.Random(cut)
    order = sorted(rows, key=lambda x: (x[1] - START).days + (r.uniform(0, 2) if shuffled else 0))
    return [order[i : i + cut] for i in range(0, len(order), cut)]


@pytest.mark.parametrize(("cut", "shuffled"), [(200, False), (23, True), (31, True)])
def test_runs_are_those_of_the_batch(spark, tmp_path, series, cut, shuffled):
    got = streamed(spark, tmp_path, f"runs{cut}", dealt(series, cut, shuffled), lambda s: R.runs(s, ["k"], "at", F.col("v"), F.col("v") > 0, least=2, late="3 days", idle="5 days"))
    df = spark.createDataFrame(series, SCHEMA)
    batch = E.deficit_periods(df, ["k"], ["at"], "at", F.col("v"), 2)
    want = sorted((r["k"], r["start"], r["end"], r["n"], r["largest"], r["mean_daily"], r["ongoing"]) for r in batch.collect())
    assert len(want) > 10 and any(w[-1] for w in want)
    assert [(*g[:5], pytest.approx(g[6]), g[7]) for g in got] == want


def test_a_gap_ends_a_series(spark, tmp_path):
    rows = [(1, at(0), 1.0), (1, at(1), 3.0), (1, at(9), 5.0), (1, at(10), -1.0)]
    for cut in (1, 4):
        got = streamed(spark, tmp_path, f"gap{cut}", dealt(rows, cut, False), lambda s: R.runs(s, ["k"], "at", F.col("v"), F.col("v") > 0, late="1 day", idle="5 days"))
        assert got == [(1, at(0), at(1), 2, 3.0, 2.0, 2.0, True), (1, at(9), at(9), 1, 5.0, 5.0, None, False)]


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    batches = [[(1, at(0), 1.0), (2, at(20), 1.0)], [(2, at(21), -1.0)], [(1, at(1), 9.0), (2, at(22), -1.0)]]
    got = streamed(spark, tmp_path, "behind", batches, lambda s: R.runs(s, ["k"], "at", F.col("v"), F.col("v") > 0, late="1 day", idle="5 days"))
    assert [g[:5] for g in got] == [(1, at(0), at(0), 1, 1.0), (2, at(20), at(20), 1, 1.0)]


def test_collapses(spark, tmp_path):
    values = [10.0, 12.0, 5.0, 4.0, 5.5, 9.0, 3.0, None, 2.0, 1.0]
    rows = [(1, at(d), v) for d, v in enumerate(values)]
    for cut in (2, 10):
        got = streamed(spark, tmp_path, f"fall{cut}", dealt(rows, cut, False), lambda s: R.collapses(s, ["k"], "at", F.col("v"), window=4, late="1 day", idle="30 days"))
        assert [g[1:7] + g[8:] for g in got] == [
            (at(2), at(4), 3, 12.0, 5.5, 4.0, True, False), (at(6), at(6), 1, 9.0, 3.0, 3.0, False, False), (at(8), at(9), 2, 9.0, 1.0, 1.0, False, True)
        ]
        assert [g[7] for g in got] == [pytest.approx(x) for x in (100 * 8 / 12, 100 * 6 / 9, 100 * 8 / 9)]

    batch = E.collapse_events(spark.createDataFrame(rows, SCHEMA), ["k"], ["at"], "at", "v", 4, 50.0).orderBy("start")
    assert [tuple(r) for r in batch.select("k", "start", "end", "n", "start_value", "end_value", "least_value", F.round("loss_pct", 9), "recovery", "ongoing").collect()] == [(*g[:7], round(g[7], 9), *g[8:]) for g in got]
