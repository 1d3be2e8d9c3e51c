"""The two batch flows end to end, with their one-row run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlore.functions.numeric import percent
from orderlore.operators import clean, execution, fairness, profile, responses, selection, stability, validate
from orderlore.session import materialise


def dataset_summary(
    df: DataFrame,
    cleaned: DataFrame,
    name: str,
    attributes: Sequence[str],
    metrics: Sequence[str],
) -> DataFrame:
    """The results of acquisition, validation, cleaning and bias analysis side by side."""
    one = lambda frame, *cols: frame.select(F.struct(*cols)).scalar()
    checks = validate.verdict(df)
    kept = clean.summary(df, cleaned)
    bias = fairness.summarise(df, attributes, metrics)
    return df.agg(F.count("*").alias("rows")).select(
        F.lit(name).alias("dataset_name"),
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        one(checks, "overall_valid", "structure_valid", "nulls_valid", "duplicates_valid").alias("validation"),
        one(kept, "final_rows", "final_columns", "rows_removed", "rows_retained_pct").alias("cleaning"),
        one(bias, "status", "total_tests", "bias_flags", "bias_flag_pct").alias("bias"),
    )


def process_dataset(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Profile, validate, clean and audit a table; returns the clean table and the run summary."""
    roles = materialise(profile.column_roles(df), "roles")
    attributes = fairness.choose_attributes(df, roles)
    metrics = fairness.choose_metrics(df, roles)
    by_column = {r["column"]: r["role"] for r in roles.select("column", "role").collect()}
    cleaned = materialise(clean.clean(df, by_column), "cleaned")
    return cleaned, dataset_summary(df, cleaned, name, attributes, metrics)


def rank_from_log(log: DataFrame, dataset: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Score every model of a log, for quality and for bias, and rank them."""
    results = materialise(responses.evaluate(log, execution.check_sql(log, dataset)), "evaluated")
    return selection.rank_models(
        selection.composite_scores(responses.model_metrics(results), stability.bias_scores(log, columns))
    )


def question_summary(ranking: DataFrame, merged: DataFrame, name: str) -> DataFrame:
    """The chosen model and the accuracy of its executed answers."""
    best = selection.best_model(ranking).select(
        F.struct("model_name", "composite_score", "performance_score", "bias_score")
    )
    models = ranking.select(F.count(F.lit(1))).scalar()
    return execution.accuracy(merged).select(
        F.lit(name).alias("dataset_name"),
        models.alias("models_evaluated"),
        best.scalar().alias("best_model"),
        "total_queries",
        "successfully_executed",
        "valid_results",
        percent(F.col("valid_results"), F.col("total_queries")).alias("overall_accuracy"),
    )


def answer_questions(log: DataFrame, dataset: DataFrame, columns: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rank the models, execute the best one's answers; returns the merged answers and the summary."""
    ranking = materialise(rank_from_log(log, dataset, columns), "ranking")
    best = selection.best_model(ranking).select("model_name")
    answers = log.join(best, "model_name", "left_semi").where(responses.succeeded())
    merged = materialise(execution.merge_outcomes(answers, execution.execute_batch(answers, dataset)), "answers")
    return merged, question_summary(ranking, merged, name)
