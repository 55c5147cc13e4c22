"""Runs and collapses found on a stream, with the rows that the batch forms give.

Each key keeps its records beyond the watermark and one open run. Records enter their series in
the order of time once the watermark has passed them, so late ones find their place and no split
into micro-batches changes a row. A gap longer than ``idle`` ends a series; the run open at that
point is sent as ongoing. State of a key: its records within ``late``, the values it looks back
at, and a run; all of it goes when the series ends.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "times array<long>, readings array<double>, flags array<boolean>, recent array<double>, last long, start long, n long, high double, low double, total double, first double, peak double, final double"
_RUN = "start long, end long, n long, high double, low double, total double, first double, peak double, final double, ongoing boolean"


class _Series:
    """The series of one key as far as the watermark: records to come, values looked back at, the open run."""

    def __init__(self, saved: tuple | None):
        t, v, h, recent, self.last, *run = saved or ([], [], [], [], None, *[None] * 8)
        self.pending = list(zip(t, v, h))
        self.recent = list(recent)
        self.run = run if run[0] is not None else None  # start, n, high, low, total, first, peak, final

    def saved(self) -> tuple:
        t, v, h = (list(x) for x in zip(*self.pending)) if self.pending else ([], [], [])
        return (t, v, h, self.recent, self.last, *(self.run or [None] * 8))

    def close(self, ongoing: bool):
        if self.run:
            start, n, *rest = self.run
            yield (start, self.last, n, *rest, ongoing)
        self.run = None

    def end(self):
        yield from self.close(True)
        self.recent, self.last = [], None

    def take(self, t: int, v: float | None, on: bool, level: float | None, peak: float | None):
        """One more record: level is what the run's high is of, peak what it fell from."""
        if not on:
            yield from self.close(False)
        elif self.run is None:
            self.run = [t, 1, level, v, v, v, peak, v]
        else:
            start, n, high, low, total, first, top, _ = self.run
            self.run = [start, n + 1, max(high, level), min(low, v), total + v, first, top, v]
        self.last = t


def _found(events: DataFrame, keys: list[str], time: str, value: Column, holds: Column, late: str, idle: str, judge: Callable) -> DataFrame:
    """Runs of the records that judge takes: (keys, _RUN) as they close."""
    micros = int(pd.Timedelta(idle).total_seconds() * 1e6)
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).where(F.col(time).isNotNull())
    rows = timed.select(*keys, time, F.unix_micros(time).alias("_t"), value.cast("double").alias("_v"), F.coalesce(holds, F.lit(False)).alias("_h"))
    names = [*keys, *(c.split()[0] for c in _RUN.split(", "))]

    def step(key: tuple, batches, state: GroupState):
        series, out = _Series(state.get if state.exists else None), []
        for b in batches:
            readings = [None if pd.isna(v) else float(v) for v in b["_v"]]
            series.pending += zip(b["_t"].tolist(), readings, b["_h"].tolist())
        passed = state.getCurrentWatermarkMs() * 1000
        series.pending.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0.0, r[2]))
        ready = [r for r in series.pending if r[0] <= passed]
        series.pending = series.pending[len(ready) :]
        for t, v, h in ready:
            if series.last is not None and t - series.last > micros:
                out += series.end()
            out += judge(series, t, v, h)
        if series.last is not None and series.last + micros < passed:
            out += series.end()
        if series.pending or series.last is not None:
            state.update(series.saved())
            wake = series.pending[0][0] if series.pending else series.last + micros
            state.setTimeoutTimestamp(max(wake, passed) // 1000 + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=names)

    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    found = rows.groupBy(*keys).applyInPandasWithState(step, f"{fields}, {_RUN}", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("start", F.timestamp_micros("start")).withColumn("end", F.timestamp_micros("end"))


def runs(events: DataFrame, keys: list[str], time: str, value: Column, holds: Column, least: int = 1, late: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """Runs of ``least`` records or more where ``holds`` is true: start, end, n, largest, mean, mean_daily, ongoing.

    With a deficit and ``deficit > 0`` these are deficit periods (mean_daily is the mean step from
    record to record, null for a single one); with a rate and ``rate > level``, mortality events,
    whose level is given as it needs the whole series. A record without value, or whose condition
    is null, ends a run; records without time are left out. Records of one time are taken by
    value; repeated ones count each.
    """

    def judge(series: _Series, t: int, v: float | None, h: bool):
        return series.take(t, v, h and v is not None, v, None)

    found = _found(events, keys, time, value, holds, late, idle, judge).where(F.col("n") >= least)
    step = F.when(F.col("n") > 1, (F.col("final") - F.col("first")) / (F.col("n") - 1))
    return found.select(*keys, "start", "end", "n", F.col("high").alias("largest"), (F.col("total") / F.col("n")).alias("mean"), step.alias("mean_daily"), "ongoing")


def collapses(events: DataFrame, keys: list[str], time: str, value: Column, loss_pct: float = 50.0, window: int = 120, late: str = "1 hour", idle: str = "366 days") -> DataFrame:
    """Runs in which the value is more than ``loss_pct`` percent below its peak over the ``window`` records before it and itself.

    start, end, n, start_value (the peak at the start), end_value, least_value, max_loss_pct,
    recovery (closed, and its last value over 1.1 times the least), ongoing. No loss is counted
    from a peak of zero or below. A record without value ends a run and has no part in a peak.
    """

    def judge(series: _Series, t: int, v: float | None, h: bool):
        series.recent = [*series.recent[-window:], v]
        peak = max((x for x in series.recent if x is not None), default=0.0)
        loss = (peak - v) / peak * 100 if v is not None and peak > 0 else 0.0
        return series.take(t, v, loss > loss_pct, loss, peak)

    found = _found(events, keys, time, value, F.lit(True), late, idle, judge)
    recovered = ~F.col("ongoing") & (F.col("final") > 1.1 * F.col("low"))
    return found.select(*keys, "start", "end", "n", F.col("peak").alias("start_value"), F.col("final").alias("end_value"), F.col("low").alias("least_value"), F.col("high").alias("max_loss_pct"), recovered.alias("recovery"), "ongoing")
