"""Keyword tests on text; plain built-in expressions that stay inside generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def allow_repeated_keys() -> None:
    """Let JSON with a repeated key parse, its last value counting; else such a text would be no JSON at all."""
    SparkSession.active().conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def has_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the words occurs in the text, also inside other words."""
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur in the text."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def labels_where(conditions: Mapping[str, Column]) -> Column:
    """Array of the labels whose condition holds, in the given order. Labels differ, so NULLs go by array_except, which unlike
    array_compact (a lambda) leaves the conditions in generated code."""
    return F.array_except(F.array(*[F.when(c, F.lit(label)) for label, c in conditions.items()]), F.array(F.lit(None).cast("string")))


def first_label(ladder: Mapping[str, Column], otherwise: str) -> Column:
    """Label of the first condition that holds."""
    steps = iter(ladder.items())
    label, condition = next(steps)
    chain = F.when(condition, F.lit(label))
    for label, condition in steps:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
