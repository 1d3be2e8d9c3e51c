"""Questions in, answers and deployment records out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlore.functions.text import strip
from orderlore.operators.responses import succeeded


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines that are no comments, numbered from 1 in file order.

    A question file is one short hand-written document, so it is read whole; the numbers come from the
    position inside its array of lines, without a global sort.
    """
    return questions_of(spark.read.text(path, wholetext=True))


def questions_of(text: DataFrame) -> DataFrame:
    lines = F.transform(F.split("value", r"\r?\n"), strip)
    kept = F.filter(lines, lambda q: (q != "") & ~F.startswith(q, F.lit("#")))
    return text.select(F.posexplode(kept).alias("_p", "user_query")).select(
        (F.col("_p") + 1).cast("bigint").alias("query_number"), "user_query"
    )


def save_responses(responses: DataFrame, path: str, per_question: bool = False) -> str:
    """One folder per model, the answers inside ordered by question number.

    `per_question` adds a folder per question, which suits a log of a few hundred questions; with more
    of them the folders would outnumber the data. Rows are shuffled by both keys, so a model with most
    of the answers is spread over all writers.
    """
    folders = ["model_name", "query_number"] if per_question else ["model_name"]
    (
        responses.repartition("model_name", "query_number")
        .sortWithinPartitions("model_name", "query_number")
        .write.mode("errorifexists")
        .partitionBy(*folders)
        .json(path)
    )
    return path


def response_summary(responses: DataFrame, ranking: DataFrame | None = None) -> DataFrame:
    """Totals per model, with the selection scores where a ranking is given."""
    ok = succeeded()
    totals = responses.groupBy("model_name").agg(
        F.count("*").alias("total_queries"),
        F.count_if(ok).alias("successful_queries"),
        F.count_if(~ok).alias("failed_queries"),
    )
    if ranking is None:
        return totals
    scores = ranking.select("model_name", "composite_score", "performance_score", "bias_score")
    return totals.join(scores, "model_name", "left")


def response_lines(responses: DataFrame) -> DataFrame:
    """One line per answer."""
    return responses.select(
        "model_name",
        "query_number",
        "user_query",
        "status",
        F.length(F.coalesce("sql_query", F.lit(""))).cast("bigint").alias("sql_length"),
        F.coalesce("visualization.type", F.lit("unknown")).alias("visualization_type"),
    )


def deployment_record(best: DataFrame, at: Column | None = None) -> DataFrame:
    """The row appended to the version history for the selected model."""
    return best.select(
        F.col("model_name").alias("selected_model"),
        (F.current_timestamp() if at is None else at).alias("selection_date"),
        "composite_score",
        "performance_score",
        "bias_score",
        "success_rate",
        F.col("response_time").alias("avg_response_time"),
        F.lit(True).alias("deployment_ready"),
    )
