"""Student's t distribution."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def two_sided(t: float, freedom: float) -> float:
    """P(|T| > |t|): the incomplete beta integral I(freedom / 2, 1/2) at freedom / (freedom + t * t), by its continued fraction."""
    a, b, x = freedom / 2, 0.5, freedom / (freedom + t * t)
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    flip = x > (a + 1) / (a + b + 2)  # the fraction converges fast on one side only
    if flip:
        a, b, x = b, a, 1 - x
    f = 1.0
    for m in range(300, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        f = 1 + odd / (1 + even / f)
    got = front / (a * f)
    return min(1.0, max(0.0, 1 - got if flip else got))


@F.pandas_udf(DoubleType())
def _two_sided(t: pd.Series, freedom: pd.Series) -> pd.Series:
    known = [x == x and n == n and n > 0 for x, n in zip(t, freedom)]
    return pd.Series([two_sided(x, n) if ok else None for x, n, ok in zip(t, freedom, known)], dtype="float64")


def two_sided_p(t: Column, freedom: Column) -> Column:
    """The two-sided p value of t, meant for aggregated rows; null where anything is null or there is no freedom."""
    return _two_sided(t.cast("double"), freedom.cast("double"))
