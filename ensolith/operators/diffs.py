"""Differences of two texts by line: the shortest edit script, as hunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUNK = "array<struct<start:int,n_old:int,n_new:int,lines:array<string>>>"


def shortest_script(old: list, new: list) -> list[tuple[int, int]]:
    """Pairs of places that stay the same in a shortest edit script, by the furthest points that d edits reach on each diagonal."""
    first = 0
    while first < min(len(old), len(new)) and old[first] == new[first]:
        first += 1
    last = 0
    while last < min(len(old), len(new)) - first and old[-1 - last] == new[-1 - last]:
        last += 1
    a, b = old[first : len(old) - last], new[first : len(new) - last]
    n, m = len(a), len(b)
    reach, trail = {1: 0}, []
    for d in range(n + m + 1):
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                break
        else:
            continue
        break
    same = []
    x, y = n, m
    for d in range(len(trail) - 1, -1, -1):
        k, before = x - y, trail[d]
        back = k + 1 if k == -d or (k != d and before[k - 1] < before[k + 1]) else k - 1
        px = before[back]
        py = px - back
        while x > px and y > py and x > 0 and y > 0:
            x, y = x - 1, y - 1
            same.append((first + x, first + y))
        x, y = px, py
    head = [(k, k) for k in range(first)]
    tail = [(len(old) - last + k, len(new) - last + k) for k in range(last)]
    return head + same[::-1] + tail


def hunks(old: list[str], new: list[str]) -> list[dict]:
    """(start, n_old, n_new, lines): runs of old lines, from 1 on, and what replaces them; an insertion starts at the line it stands before."""
    out, x, y = [], 0, 0
    for i, j in [*shortest_script(old, new), (len(old), len(new))]:
        if i > x or j > y:
            out.append({"start": x + 1, "n_old": i - x, "n_new": j - y, "lines": new[y:j]})
        x, y = i + 1, j + 1
    return out


def applied(old: list[str], changes: list) -> list[str]:
    """old with its hunks applied."""
    out, x = [], 0
    for h in changes:
        out += old[x : h["start"] - 1] + list(h["lines"])
        x = h["start"] - 1 + h["n_old"]
    return out + old[x:]


def line_hunks(pairs: DataFrame, key: str, old: str = "old", new: str = "new") -> DataFrame:
    """(key, start, n_old, n_new, lines): a row for each hunk from one text to the other; null texts have no lines."""

    @F.pandas_udf(HUNK)
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        lines = lambda t: t.split("\n") if t else []
        return pd.Series([hunks(lines(x), lines(y)) for x, y in zip(a, b)], dtype=object)

    return pairs.select(key, F.inline(of(old, new)))
