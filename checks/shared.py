"""Tables that several registered queries read, written once per session and data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderlore.plans.test_views import documents, response_log
from orderlore.session import materialise

_written: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _written:
        _written[key] = make()
    return _written[key]


def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stored table, as a run of the answering step leaves it."""
    return once(spark, sf_dir, "log", lambda: materialise(response_log(spark, sf_dir), "response-log"))


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a table of several files, as an extraction run leaves them."""
    return once(spark, sf_dir, "documents", lambda: materialise(documents(spark, sf_dir), "documents"))
