"""Upper tail of the F distribution, for the few result rows of a variance analysis."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the small helpers below travel inside the UDF, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz scheme)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def f_tail(f: float, between: float, within: float) -> float:
    """P(F > f) with (between, within) degrees of freedom."""
    if any(v is None or math.isnan(v) for v in (f, between, within)) or between <= 0 or within <= 0:
        return math.nan
    if f <= 0:
        return 1.0
    return incomplete_beta(within / 2.0, between / 2.0, within / (within + between * f))


def f_tail_column(f: Column, between: Column, within: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def tail(f: pd.Series, between: pd.Series, within: pd.Series) -> pd.Series:
        return pd.Series(np.array([f_tail(*row) for row in zip(f, between, within)], dtype="float64"))

    return F.nanvl(tail(f, between.cast("double"), within.cast("double")), F.lit(None).cast("double"))
