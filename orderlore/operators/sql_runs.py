"""Running many SQL texts as few Spark jobs.

Texts can only be submitted from the driver. Each is analysed there, which starts no job; those that analyse become branches of
one plan, and each branch boils its result down to one row of figures. A batch of texts is so one query, whose branches run
side by side. Should it fail, it is halved until the text at fault stands alone, and that one's error is its outcome.

The texts see the table under the name `dataset` in a session of their own, so two runs never see each other's table.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, suppress
from functools import reduce
from itertools import islice

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlore.session import fresh_path

VIEW = "dataset"
BATCH = 32


@contextmanager
def private_session(dataset: DataFrame) -> Iterator[SparkSession]:
    """A session with the same settings in which `dataset` is the given table."""
    spark, name = dataset.sparkSession, f"dataset_{uuid.uuid4().hex}"
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            with suppress(PySparkException):
                own.conf.set(key, value)
    dataset.createGlobalTempView(name)
    try:
        own.sql(f"CREATE TEMPORARY VIEW {VIEW} AS SELECT * FROM global_temp.{name}")
        yield own
    finally:
        spark.catalog.dropGlobalTempView(name)


def as_query(spark: SparkSession, text: str) -> DataFrame:
    """Analyse a text that must be a query: inside brackets nothing but a query parses, so a generated
    statement that would change data is refused before it can run."""
    text = text.strip().rstrip(";")
    spark.sql(f"SELECT * FROM (\n{text}\n)")
    return spark.sql(text)


# words by which a text can read columns it doesn't name; a FROM without a SELECT of its own is another way
_UNNAMED = r"\*|\|>|\b(table|natural|pivot|unpivot|identifier)\b"


def columns_named(texts: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that the texts (first column) can read: those that one of them names, or all if one may read others.

    A name inside a longer text or an alias counts, too, so there may be too many, never too few. One row reaches the driver.
    A text that only counts rows needs some column, which is the first.
    """
    text = F.regexp_replace(F.lower(F.col(f"`{texts.columns[0]}`")), r"\bcount\s*\(\s*\*\s*\)", "")
    bare = F.regexp_count(text, F.lit(r"\bfrom\b")) > F.regexp_count(text, F.lit(r"\bselect\b"))
    # counted, since the optimiser drops a distinct below bool_or and would try the patterns on every row of a log
    every = F.count_if(text.rlike(_UNNAMED) | bare).alias("every")
    named = [F.count_if(text.rlike(rf"\b{re.escape(c.lower())}\b")).alias(f"c{i}") for i, c in enumerate(columns)]
    found = texts.distinct().agg(every, *named).first()
    return [c for i, c in enumerate(columns) if found["every"] or found[f"c{i}"]] or list(columns[:1])


def message_of(error: Exception) -> str:
    """Kind and first line of an error."""
    lines = str(error).strip().splitlines()
    return f"{type(error).__name__}: {lines[0]}" if lines else type(error).__name__


def _over_fewer(result: DataFrame, narrow: SparkSession, text: str) -> DataFrame:
    """The same result from the session with fewer columns, if it has the same columns there."""
    try:
        other = as_query(narrow, text)
    except PySparkException:
        return result
    return other if other.dtypes == result.dtypes else result


def _batches(texts: DataFrame, size: int) -> Iterator[list[str]]:
    rows = texts.toLocalIterator()
    while batch := [r[0] for r in islice(rows, size)]:
        yield batch


class _Results:
    """Where the rows of all branches go, and how long the run that made them took."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.path = spark, f"run int, sql_query string, {schema}", fresh_path(spark, "sql-runs")
        self.runs: list[tuple[int, float, int]] = []
        self.failed: list[tuple[str, bool, str]] = []

    def write(self, branches: list[tuple[str, DataFrame]]) -> None:
        started, run = time.perf_counter(), len(self.runs)
        union = reduce(DataFrame.unionAll, [b.select(F.lit(run).alias("run"), F.lit(t).alias("sql_query"), "*") for t, b in branches])
        try:
            union.coalesce(1).write.parquet(f"{self.path}/run={run:06d}-{uuid.uuid4().hex[:8]}")
        except Exception as error:
            if len(branches) == 1:
                self.failed.append((branches[0][0], True, message_of(error)))
                return
            half = len(branches) // 2
            self.write(branches[:half])
            self.write(branches[half:])
            return
        self.runs.append((run, time.perf_counter() - started, len(branches)))


def run_texts(
    texts: DataFrame, dataset: DataFrame, schema: str, branch: Callable[[DataFrame], DataFrame], execute: bool = True, size: int = BATCH, narrow: DataFrame | None = None
) -> DataFrame:
    """sql_query, valid, done, error, elapsed_seconds, run_texts and the columns of `schema` for each text (first column).

    `branch` turns a text's result into one row of `schema`. A text that doesn't analyse isn't valid; one that fails when it
    runs is not done; its figures are NULL. Texts of one run share its time, and `run_texts` tells how many they are; a text that
    was only analysed has the time of that. Without `execute` nothing runs and all figures are NULL. Texts are analysed against
    `dataset` and run on `narrow`, the same table without columns that no text can read (`columns_named`), if it is given.
    """
    spark = texts.sparkSession
    results = _Results(spark, schema)
    outcomes = fresh_path(spark, "sql-outcomes")
    outcome_schema = "sql_query string, valid boolean, error string, analysed_seconds double"
    spark.createDataFrame([], outcome_schema).write.parquet(outcomes)
    with private_session(dataset) as own, private_session(dataset if narrow is None else narrow) as run:
        for batch in _batches(texts, size):
            branches, known = [], []
            for text in batch:
                started, error = time.perf_counter(), None
                try:
                    branches.append((text, branch(_over_fewer(as_query(own, text), run, text))))
                except Exception as refused:  # the error is the outcome
                    error = message_of(refused)
                known.append((text, error is None, error, time.perf_counter() - started))
            if execute and branches:
                results.write(branches)
                errors = {t: e for t, _, e in results.failed}
                known = [(t, v, errors.get(t, e), s) for t, v, e, s in known]
                results.failed.clear()
            # one row a text of the batch
            spark.createDataFrame(known, outcome_schema).coalesce(1).write.mode("append").parquet(outcomes)
    known = spark.read.schema(outcome_schema).parquet(outcomes)
    times = spark.createDataFrame(results.runs, "run int, elapsed_seconds double, run_texts int")
    if results.runs:
        figures = spark.read.schema(results.schema).option("recursiveFileLookup", "true").parquet(results.path)
    else:
        figures = spark.createDataFrame([], results.schema)
    done = F.col("run").isNotNull().alias("done")
    seconds = F.coalesce("elapsed_seconds", "analysed_seconds").alias("elapsed_seconds")
    names = [n for n in figures.columns if n not in ("run", "sql_query")]
    return known.join(figures, "sql_query", "left").join(times, "run", "left").select("sql_query", "valid", done, "error", seconds, "run_texts", *names)
