"""Sobol points by row number, crossed designs of them and their variance shares.

A point is a column expression of its number: a coordinate is the exclusive or of the direction
numbers of the bits of the number's Gray code. So a design is dealt out as its rows are, grows
without its earlier points changing, and needs no order.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers up to 2^40, coordinates in steps of 2^-40.
BITS = 40
#: The published first direction integers of dimensions 2 to 16, one line a dimension.
FIRST = [
    [1],
    [1, 3],
    [1, 3, 1],
    [1, 1, 1],
    [1, 1, 3, 3],
    [1, 3, 5, 13],
    [1, 1, 5, 5, 17],
    [1, 1, 5, 5, 5],
    [1, 1, 7, 11, 19],
    [1, 1, 5, 1, 1],
    [1, 1, 1, 3, 11],
    [1, 3, 5, 5, 31],
    [1, 3, 3, 9, 7, 49],
    [1, 1, 1, 15, 21, 21],
    [1, 3, 1, 13, 27, 49],
]
MOST = 1 + len(FIRST)


def primitive_polynomials(n: int) -> list[int]:
    """The first n primitive polynomials over two elements (bits from the highest power down), by degree, then as numbers."""
    out, degree = [], 1
    while len(out) < n:
        for p in range((1 << degree) | 1, 2 << degree, 2):
            x, order = 2 if degree > 1 else 1, 1
            if x >> degree & 1:
                x ^= p
            while x != 1 and order < 1 << degree:  # the order of x modulo p
                x <<= 1
                x ^= p if x >> degree & 1 else 0
                order += 1
            if order == (1 << degree) - 1:
                out.append(p)
        degree += 1
    return out[:n]


def direction_numbers(dims: int) -> list[list[int]]:
    """For each dimension its number for each bit, as integers of BITS bits."""
    if not 1 <= dims <= MOST:
        raise ValueError(f"1 to {MOST} dimensions, not {dims}")
    out = [[1 << (BITS - 1 - j) for j in range(BITS)]]
    for p, first in zip(primitive_polynomials(dims - 1), FIRST):
        s = p.bit_length() - 1
        v = [m << (BITS - 1 - j) for j, m in enumerate(first)]
        for j in range(s, BITS):
            x = v[j - s] ^ (v[j - s] >> s)
            for i in range(1, s):
                if p >> (s - i) & 1:
                    x ^= v[j - i]
            v.append(x)
        out.append(v)
    return out


def shifts(dims: int, seed: int | None) -> list[int]:
    """The digital shift of each dimension; none without a seed."""
    draw = random.Random(seed)
    return [0 if seed is None else draw.getrandbits(BITS) for _ in range(dims)]


def coordinates(number: Column, dims: int, seed: int | None = None, bits: int = BITS) -> list[Column]:
    """The coordinates in [0, 1) of the points of these numbers (from 0, below 2^bits); a seed shifts all points digitally."""
    gray = number.cast("long").bitwiseXOR(F.shiftright(number.cast("long"), 1))
    out = []
    for v, shift in zip(direction_numbers(dims), shifts(dims, seed)):
        x = F.lit(shift).cast("long")
        for j in range(bits):
            x = x.bitwiseXOR(F.shiftright(gray, j).bitwiseAND(F.lit(1)) * F.lit(v[j]).cast("long"))
        out.append(x / float(1 << BITS))
    return out


def box(bounds: DataFrame) -> list[tuple[str, float, float]]:
    """(name, lower, upper) of a table of bounds, by name; a row for each parameter, MOST at most."""
    rows = [tuple(r) for r in bounds.select("name", F.col("lower").cast("double"), F.col("upper").cast("double")).orderBy("name").limit(MOST + 1).collect()]
    names = [n for n, _, _ in rows]
    if not rows or len(rows) > MOST or None in names or len(set(names)) < len(rows):
        raise ValueError(f"bounds of 1 to {MOST} parameters with names of their own")
    for name, low, high in rows:
        if low is None or high is None or not low < high or abs(low) == float("inf") or abs(high) == float("inf"):
            raise ValueError(f"{name}: no span from {low} to {high}; a fixed parameter is none of the design")
    return rows


def _power(n: int) -> int:
    if n < 1 or n & (n - 1):
        raise ValueError(f"a Sobol design has a power of two points, not {n}")
    return n.bit_length()


def sequence_points(numbered: DataFrame, number: str, bounds: DataFrame, seed: int | None = None) -> DataFrame:
    """numbered with one column for each parameter of the bounds: the Sobol point of the row's number, in native units."""
    spans = box(bounds)
    unit = coordinates(F.col(number), len(spans), seed)
    return numbered.select("*", *((F.lit(low) + u * (high - low)).alias(name) for u, (name, low, high) in zip(unit, spans)))


def sobol_design(spark: SparkSession, bounds: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """(point, one column for each parameter): the first n points; n a power of two."""
    _power(n)
    return sequence_points(spark.range(n).withColumnRenamed("id", "point"), "point", bounds, seed)


def crossed_design(spark: SparkSession, bounds: DataFrame, n: int, second_order: bool = False, seed: int | None = None) -> DataFrame:
    """(sample, matrix, one column for each parameter): the points of the matrices A and B, and A with one column of B (``A:name``).

    With second_order also B with one column of A (``B:name``). A and B are the two halves of
    points of twice as many dimensions; n is a power of two, at most MOST // 2 parameters.
    """
    bits, spans = _power(n), box(bounds)
    p = len(spans)
    if 2 * p > MOST:
        raise ValueError(f"at most {MOST // 2} parameters, not {p}")
    base = spark.range(n).select(F.col("id").alias("sample"), F.array(*coordinates(F.col("id"), 2 * p, seed, bits)).alias("u"))
    native = lambda k, from_b: F.lit(spans[k][1]) + F.col("u")[k + p * from_b] * (spans[k][2] - spans[k][1])
    rows = [("A", [0] * p), ("B", [1] * p)] + [(f"A:{spans[k][0]}", [int(j == k) for j in range(p)]) for k in range(p)]
    rows += [(f"B:{spans[k][0]}", [int(j != k) for j in range(p)]) for k in range(p)] if second_order else []
    made = [F.struct(F.lit(name).alias("matrix"), *(native(k, b).alias(spans[k][0]) for k, b in enumerate(of))) for name, of in rows]
    return base.select("sample", F.inline(F.array(*made)))


def _wide(evaluated: DataFrame, y: str) -> tuple[DataFrame, Column, Column, Column]:
    """Samples with a map of y by matrix, less the mean of A and B; these two and their variance."""
    held = evaluated.where("matrix in ('A', 'B')").agg(F.avg(y).alias("_m"), F.var_pop(y).alias("_v"))
    wide = evaluated.crossJoin(F.broadcast(held)).groupBy("sample", "_v").agg(F.map_from_entries(F.collect_list(F.struct("matrix", F.col(y) - F.col("_m")))).alias("_y"))  # one row; a matrix each
    return wide, F.col("_y")["A"], F.col("_y")["B"], F.max("_v")


def first_and_total(evaluated: DataFrame, names: list[str], y: str) -> DataFrame:
    """(input, first, total): shares of the variance of an evaluated crossed design; null if it does not vary."""
    wide, a, b, spread = _wide(evaluated, y)
    parts = []
    for x in names:
        c = F.col("_y")[f"A:{x}"]
        parts.append(F.struct(F.lit(x).alias("input"), F.try_divide(F.avg(b * (c - a)), spread).alias("first"), F.try_divide(F.avg((a - c) * (a - c)) / 2, spread).alias("total")))
    return wide.agg(F.array(*parts).alias("i")).select(F.inline("i"))


def second_order(evaluated: DataFrame, names: list[str], y: str) -> DataFrame:
    """(input, other, second): the share of each two inputs' interaction; the design must be of second order."""
    wide, a, b, spread = _wide(evaluated, y)
    of = lambda m, x: F.col("_y")[f"{m}:{x}"]
    alone = lambda x: F.avg(b * (of("A", x) - a))
    parts = []
    for k, x in enumerate(names):
        for z in names[k + 1 :]:
            joint = F.avg(of("B", x) * of("A", z) - a * b)
            parts.append(F.struct(F.lit(x).alias("input"), F.lit(z).alias("other"), F.try_divide(joint - alone(x) - alone(z), spread).alias("second")))
    return wide.agg(F.array(*parts).alias("i")).select(F.inline("i"))


def local_candidates(observed: DataFrame, n: int, k: int = 10, scales: tuple[float, ...] = (0.01, 0.03, 0.1), seed: int = 0) -> DataFrame:
    """(centre, scale, draw, u): normal steps around the k viable rows (id, u, v, viable) of least v, folded back into the unit cube.

    Each of the centres (ties by id) has equally many draws at each scale, n in all at least. Draws are
    hashes of centre, scale, draw and component, so a lost task makes the same ones again.
    """
    if n < 1 or k < 1 or not scales or not all(0 < s < float("inf") for s in scales):
        raise ValueError("candidates, centres and positive scales, one at least")
    known = observed.where("viable and v is not null and not isnan(v) and abs(v) < double('inf')")
    centres = known.orderBy("v", "id").limit(k).select(F.col("id").alias("centre"), F.col("u").cast("array<double>").alias("_u"))  # k rows
    many = centres.count()
    per = -(-n // max(1, many * len(scales)))
    drawn = centres.select("*", F.explode(F.array(*(F.lit(float(s)) for s in scales))).alias("scale")).select("*", F.explode(F.sequence(F.lit(1), F.lit(per))).alias("draw"))

    def even(i: Column, salt: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64("centre", "scale", "draw", i, F.lit(seed), F.lit(salt)), 11).cast("double") + 0.5) / float(1 << 53)

    def moved(x: Column, i: Column) -> Column:
        r = F.pmod(x + F.col("scale") * F.sqrt(-2 * F.ln(even(i, 1))) * F.cos(even(i, 2) * 6.283185307179586), F.lit(2.0))
        return F.when(r > 1, 2 - r).otherwise(r)

    return drawn.select("centre", "scale", "draw", F.transform("_u", moved).alias("u"))
