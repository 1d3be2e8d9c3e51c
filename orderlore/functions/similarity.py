"""Indel similarity of two strings: twice the longest common subsequence over the summed lengths."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the small helpers below travel inside the UDF, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one big-integer step per character of b."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        hit = free & places.get(ch, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2.0 * common_subsequence(a, b) / total if total else 1.0


def indel_ratio_above(a: Column, b: Column, limit: float) -> Column:
    """Whether the ratio exceeds the limit.

    The ratio cannot exceed 2*min/(len a + len b), so only pairs that pass this bound and differ are
    sent to Python; the others arrive there as NULL and cost nothing.
    """
    la, lb = F.char_length(a), F.char_length(b)
    possible = (a != b) & (2.0 * F.least(la, lb) > limit * (la + lb))

    @F.pandas_udf(T.BooleanType())
    def above(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(
            [None if x is None or y is None else indel_ratio(x, y) > limit for x, y in zip(a, b)], dtype="object"
        )

    return (a == b) | F.coalesce(above(F.when(possible, a), F.when(possible, b)), F.lit(False))
