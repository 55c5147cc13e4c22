"""Scalar helpers: text cleaning, names, units, scales and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(c: Column) -> Column:
    """Markup out (HTML comments, image links down to their alternative text), blank lines collapsed, trimmed."""
    c = F.regexp_replace(c, r"<!--[\s\S]*?-->", "")
    c = F.regexp_replace(c, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"(?m)^\.\. (image|figure)::.*$", "")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def steady(c: Column, digits: int = 12) -> Column:
    """A double to that many significant digits: what the order of summing does to its last ones decides no comparison."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits - 1}e", c).cast("double"))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def jaccard_label(j: Column) -> Column:
    return F.when(j < 0.5, "different").when(j < 0.85, "related").otherwise("same")


def strip_group_suffix(c: Column) -> Column:
    """Lower-cased name without one trailing _<digits> or _<name>#..."""
    return F.regexp_replace(F.lower(c), r"_\d+$", "")


def same_parameter(c: Column) -> Column:
    """A parameter's name for comparison: trimmed, lower-cased, without one trailing _<digits> or _-."""
    return F.regexp_replace(F.lower(F.trim(c)), r"_(\d+|-)$", "")


def threshold_verdict(value: Column, limit: Column, kind: str = "above", upper: Column | None = None) -> Column:
    """CONFIRMED, PARTIAL or REJECTED by how far a value is beyond a limit, above or below it, or between two.

    Beyond half the limit again it is confirmed, beyond the limit or a fifth short of it partial.
    """
    if kind == "between":
        if upper is None:
            raise ValueError("between needs an upper limit")
        return F.when(value.between(limit, upper), "CONFIRMED").when(value.between(limit * 0.8, upper * 1.2), "PARTIAL").otherwise("REJECTED")
    if kind == "above":
        strong, weak = value > limit * 1.5, value > limit * 0.8
    elif kind == "below":
        strong, weak = value < limit * 0.5, value < limit * 1.2
    else:
        raise ValueError(f"no such kind of threshold: {kind}")
    return F.when(strong, "CONFIRMED").when(weak, "PARTIAL").otherwise("REJECTED")


def meets_threshold(value: Column, limit: Column, kind: str = "above", upper: Column | None = None) -> Column:
    return {"above": value > limit, "below": value < limit, "between": value.between(limit, upper) if upper is not None else None}[kind]


def outcome(met: Column, total: Column) -> Column:
    return F.when(met >= total, "SUCCESS").when(met >= 0.75 * total, "PARTIAL_SUCCESS").when(met <= 0.25 * total, "FAILED").otherwise("MARGINAL")


def to_unit(x: Column, low: Column, high: Column) -> Column:
    return F.try_divide(x - low, high - low)


def reflect_unit(u: Column) -> Column:
    """Any number folded into 0..1 by reflection at the ends."""
    m = F.pmod(u, F.lit(2.0))
    return F.when(m > 1, 2 - m).otherwise(m)


def first_match(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern that the text matches."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(c.rlike(pattern), label).otherwise(out)
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; null where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def from_unit(u: Column, low: Column, high: Column) -> Column:
    return low + u * (high - low)


def transformed(y: Column, kind: str) -> Column:
    """identity, log or logit; values outside the domain are refused when read."""
    refuse = lambda ok, v: F.when(ok | y.isNull(), v).otherwise(F.raise_error(F.concat(F.lit(f"outside the domain of {kind}: "), y.cast("string"))).cast("double"))
    kinds = {"identity": y, "log": refuse(y > 0, F.when(y > 0, F.ln(y))), "logit": refuse((y > 0) & (y < 1), F.when((y > 0) & (y < 1), F.ln(y / (1 - y))))}
    return kinds[kind]


def untransformed(z: Column, kind: str) -> Column:
    return {"identity": z, "log": F.exp(z), "logit": 1 / (1 + F.exp(-z))}[kind]


def sampling_space(x: Column, is_log: bool) -> Column:
    return F.log10(x) if is_log else x


def native_space(x: Column, is_log: bool) -> Column:
    return F.pow(F.lit(10.0), x) if is_log else x


def parts_of_total(share: Column, total: Column) -> tuple[Column, Column]:
    """Native pair of a share and a total; a share outside 0..1 is refused when read."""
    ok = F.when(share.between(0, 1), share).otherwise(F.raise_error(F.concat(F.lit("share outside 0..1: "), share.cast("string"))).cast("double"))
    return ok * total, (1 - ok) * total


def options(c: Column) -> Column:
    """A string of -name value options as a map; a name without a value maps to true."""
    pairs = F.regexp_extract_all(c, F.lit(r"(-[A-Za-z_]\w*(?:[ =](?!-)\S+)?)"), F.lit(1))
    entry = lambda p: F.struct(F.regexp_extract(p, r"^-(\w+)", 1).alias("k"), F.coalesce(F.nullif(F.regexp_extract(p, r"^-\w+[ =](.+)$", 1), F.lit("")), F.lit("true")).alias("v"))
    return F.map_from_entries(F.transform(pairs, entry))


def guarded_ratio(a: Column, b: Column, least: float = 1e-10) -> Column:
    """a / b with the divisor kept away from zero."""
    return a / F.greatest(F.abs(b), F.lit(least)) * F.when(b < 0, -1).otherwise(1)


#: Named measures of (supply, demand, loss, stock).
MEASURES = {
    "supply_demand_ratio": lambda s, d, l, t: guarded_ratio(s, d),
    "deficit": lambda s, d, l, t: d - s,
    "relative_deficit": lambda s, d, l, t: guarded_ratio(d - s, d),
    "loss_fraction": lambda s, d, l, t: guarded_ratio(l, s),
    "turnover": lambda s, d, l, t: guarded_ratio(l, t),
    "net": lambda s, d, l, t: s - l,
}

SECONDS_A_DAY = 86400.0
# Days of the months of a year without leap days.
MONTH_DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def flux_a_year(flux: Column, per: str) -> Column:
    """A flux per second, hour, day, month or year as one per year of 365 days."""
    return flux * {"s": 365 * SECONDS_A_DAY, "h": 365 * 24.0, "d": 365.0, "month": 12.0, "y": 1.0}[per]


def flux_a_month(flux: Column, month: Column, grams: float = 1.0) -> Column:
    """A flux per second over the month's own days, times ``grams``."""
    return flux * SECONDS_A_DAY * F.get(F.array(*map(F.lit, MONTH_DAYS)), month - 1) * grams


def modified(value: Column, here: Column, to: Column | None = None, percent: Column | None = None) -> Column:
    """value, but where ``here`` holds the new one, or the old changed by a percentage."""
    return F.when(here, to if to is not None else value * (1 + percent / 100)).otherwise(value)


def applies_in(tags: Column, axes: dict[str, list[str]]) -> Column:
    """A flag for each value of each axis: named ones only where the axis is named, all of an axis that is not."""
    flags = []
    for axis, values in axes.items():
        own = F.try_element_at(tags, F.lit(axis))
        flags += [x for v in values for x in (F.lit(f"{axis}_{v}"), F.coalesce(F.array_contains(own, v), F.lit(True)))]
    return F.create_map(*flags)
