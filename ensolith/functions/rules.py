"""Rules given as text: a name, a comparison and a number, nothing else."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_RULE = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_.]*)\s*(>=|<=|>|<)\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*")


class Rule(NamedTuple):
    name: str
    comparison: str
    threshold: float

    def column(self) -> Column:
        """Whether it holds; a value that is null or not finite holds to no rule."""
        v = F.col(f"`{self.name}`").cast("double")
        held = {">": v > self.threshold, ">=": v >= self.threshold, "<": v < self.threshold, "<=": v <= self.threshold}[self.comparison]
        return F.coalesce(held & (F.abs(v) < float("inf")), F.lit(False))


def parsed(texts: list[str], names: list[str]) -> list[Rule]:
    """The rules of the texts; one that is none, or names no column of ``names``, is refused before any is applied, with the place where it fails."""
    out = []
    for text in texts:
        m = _RULE.match(text)
        if m is None or m.end() != len(text):
            at = m.end() if m else next((k for k, c in enumerate(text) if not (c.isalnum() or c in "_. ")), len(text))
            raise ValueError(f"no rule: {text!r} at {at}; a name, one of > >= < <=, and a number")
        name, comparison, number = m.groups()
        if name not in names:
            raise ValueError(f"{text!r}: {name!r} is none of {names}")
        if not math.isfinite(float(number)):
            raise ValueError(f"{text!r}: the threshold is not finite")
        out.append(Rule(name, comparison, float(number)))
    return out


def all_hold(rules: list[Rule]) -> Column:
    """Whether every rule holds; at least one is needed."""
    if not rules:
        raise ValueError("no rule: without one every row would count")
    out = rules[0].column()
    for r in rules[1:]:
        out = out & r.column()
    return out


def applicable(flags: Column, active: dict[str, object]) -> Column:
    """Whether an entry's flags (map of names to booleans) let it pass in a mode: for every axis universal, or flagged for the axis' value."""
    on = lambda key: F.coalesce(flags[key], F.lit(False))
    out = F.lit(True)
    for axis, value in active.items():
        said = str(value).lower() if isinstance(value, bool) else str(value)
        out = out & (on("applies_universal") | on(f"applies_in_{axis}_{said}"))
    return out
