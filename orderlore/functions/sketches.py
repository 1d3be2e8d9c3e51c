"""One-pass summaries of whole columns by mergeable sketches.

Each task summarises its rows of every column and sends one row of sketches on: a heavy-hitter sketch (a map of at most
`tracked` values whose counters fall together when it is full, as Misra and Gries count), HyperLogLog++ for the number of distinct
values and a quantile summary. Nothing is exchanged but these rows, whatever the table holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACKED = 1000
DISTINCT_ERROR = 0.01
QUANTILE_ACCURACY = 10_000


def map_size(tracked: int = TRACKED) -> int:
    """Places of the sketch's map, three quarters of which are used at most."""
    return 1 << math.ceil(math.log2(math.ceil(tracked / 0.75)))


def count_error(rows: int, tracked: int = TRACKED) -> float:
    """By how much the count of a value may be wrong at most."""
    return 3.5 / map_size(tracked) * rows


def can_track(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def heavy_hitters(value: Column, data_type: T.DataType, tracked: int = TRACKED) -> Column:
    """Aggregate: (value as text, count) of the tracked values, commonest first, ties by value; nulls are left out.

    Every value with more than `count_error` of the rows is among them. With up to `tracked` different values all are, with
    their exact counts.
    """
    if not can_track(data_type):
        return F.array().cast("array<struct<value: string, count: bigint>>")
    found = F.call_function("approx_top_k", value, F.lit(tracked), F.lit(tracked))
    named = F.transform(F.filter(found, lambda t: t["item"].isNotNull()), lambda t: F.struct(t["item"].cast("string").alias("value"), t["count"].alias("count")))
    order = F.array_sort(F.transform(named, lambda t: F.struct((-t["count"]).alias("rank"), t["value"].alias("value"))))
    return F.transform(order, lambda t: F.struct(t["value"].alias("value"), (-t["rank"]).alias("count")))


def distinct_values(value: Column, hitters: Column, tracked: int = TRACKED) -> Column:
    """Aggregate: number of distinct values, exact while the heavy-hitter sketch holds them all, else by HyperLogLog++.

    The sketch holds all if its counts add up to the rows; a fallen counter would make them differ, and the estimate is asked, too.
    """
    estimate, held = F.approx_count_distinct(value, DISTINCT_ERROR), F.size(hitters).cast("bigint")
    rows = F.aggregate(hitters, F.lit(0).cast("bigint"), lambda total, t: total + t["count"])
    whole = (held < tracked) & (rows == F.count(value)) & (estimate <= held * 1.1 + 5)
    return F.when(whole, held).otherwise(estimate)
