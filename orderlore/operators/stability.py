"""Bias and stability of logged answers, per model (L).

A log has few models, so each analysis is one aggregate that folds the answers on the map side, and
limits on the number of answers are applied to its result rows instead of being joined to the log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlore.functions.numeric import percent, ratio
from orderlore.functions.text import first_label, has_any, hits
from orderlore.operators.responses import succeeded

CHART_SHARE, CHART_SHARE_HIGH = 60.0, 80.0
AGGREGATION_SHARE = 70.0
COLUMN_GAP = 50.0
SENTIMENT_SHARE = 70.0
MIN_FOR_BIAS, MIN_FOR_STABILITY = 2, 5

# fixed values: points per severity of a biased category
SEVERITY_POINTS = {"HIGH": 40, "MEDIUM": 25, "LOW": 10}

# fixed values: SQL texts and words looked for
AGGREGATES = ["SUM(", "AVG(", "COUNT(", "MAX(", "MIN("]
POSITIVE_WORDS = ["excellent", "great", "best", "top", "high", "good", "optimal"]
NEGATIVE_WORDS = ["poor", "low", "worst", "bad", "minimal", "least"]
NEUTRAL_WORDS = ["shows", "displays", "indicates", "presents", "analyzes"]
QUESTION_TYPES = {
    "aggregation": ["total", "sum", "average", "count"],
    "sorting": ["top", "best", "highest"],
    "listing": ["list", "show all", "display"],
}


def chart_distribution(log: DataFrame) -> DataFrame:
    """Share of each chart type within its model."""
    kind = F.coalesce("visualization.type", F.lit("unknown")).alias("chart_type")
    counts = log.where(succeeded()).groupBy("model_name", kind).agg(F.count("*").alias("count"))
    whole = F.sum("count").over(Window.partitionBy("model_name"))
    return counts.withColumn("share_pct", percent(F.col("count"), whole))


def chart_bias(log: DataFrame) -> DataFrame:
    top = F.col("max_share")
    return (
        chart_distribution(log)
        .groupBy("model_name")
        .agg(
            F.max("share_pct").alias("max_share"),
            F.min_by("chart_type", F.struct(-F.col("share_pct"), F.col("chart_type"))).alias("top_type"),
        )
        .select(
            "model_name",
            F.lit("Visualization Selection Bias").alias("category"),
            (top > CHART_SHARE).alias("biased"),
            F.when(top > CHART_SHARE_HIGH, "HIGH").when(top > CHART_SHARE, "MEDIUM").otherwise("LOW").alias("severity"),
            top.alias("measure"),
            F.format_string("Model uses %s in %.1f%% of cases", "top_type", top).alias("description"),
        )
    )


def sql_pattern_shares(log: DataFrame) -> DataFrame:
    """Share of answers with each SQL pattern."""
    s = F.upper(F.coalesce("sql_query", F.lit("")))
    grouped = F.contains(s, F.lit("GROUP BY"))
    selects = F.regexp_count(s, F.lit("SELECT"))
    flags = {
        "has_aggregation": has_any(s, AGGREGATES),
        "has_group_by": grouped,
        "has_where": F.contains(s, F.lit("WHERE")),
        "has_join": F.contains(s, F.lit("JOIN")),
        "has_order_by": F.contains(s, F.lit("ORDER BY")),
        "simple_select": (selects == 1) & ~grouped,
    }
    shares = [percent(F.count_if(c), F.count("*")).alias(k) for k, c in flags.items()]
    return log.where(succeeded()).groupBy("model_name").agg(*shares)


def sql_pattern_bias(log: DataFrame) -> DataFrame:
    share = F.col("has_aggregation")
    return sql_pattern_shares(log).select(
        "model_name",
        F.lit("Query Pattern Bias").alias("category"),
        (share > AGGREGATION_SHARE).alias("biased"),
        F.when(share > AGGREGATION_SHARE, "MEDIUM").otherwise("LOW").alias("severity"),
        share.alias("measure"),
        F.format_string("Model uses aggregations in %.1f%% of queries", share).alias("description"),
    )


def column_usage(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of answers whose SQL mentions each column (substring match).

    The column names of the dataset ride along as a constant array, so no join is needed.
    """
    sql = F.coalesce("sql_query", F.lit(""))
    mentioned = F.filter(F.array(*[F.lit(c) for c in columns]), lambda c: F.contains(sql, c))
    # the empty name stands for the answer itself, so one aggregate also counts the answers
    named = F.explode(F.concat(F.array(F.lit("")), mentioned))
    counts = log.where(succeeded()).select("model_name", named.alias("column")).groupBy("model_name", "column").count()
    answers = F.max(F.when(F.col("column") == "", F.col("count"))).over(Window.partitionBy("model_name"))
    return (
        counts.withColumn("_answers", answers)
        .where(F.col("column") != "")
        .select("model_name", "column", "count", percent(F.col("count"), F.col("_answers")).alias("usage_pct"))
    )


def column_bias(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    gap = F.col("gap")
    return (
        column_usage(log, columns)
        .groupBy("model_name")
        .agg((F.max("usage_pct") - F.min("usage_pct")).alias("gap"))
        .select(
            "model_name",
            F.lit("Column Usage Bias").alias("category"),
            (gap > COLUMN_GAP).alias("biased"),
            F.when(gap > COLUMN_GAP, "MEDIUM").otherwise("LOW").alias("severity"),
            gap.alias("measure"),
            F.format_string("Usage gap between most and least used columns: %.1f%%", gap).alias("description"),
        )
    )


def sentiment() -> Column:
    """Class of an explanation by keyword hits; a tie is neutral."""
    text = F.lower(F.coalesce("explanation", F.lit("")))
    pos, neg, neu = hits(text, POSITIVE_WORDS), hits(text, NEGATIVE_WORDS), hits(text, NEUTRAL_WORDS)
    return (
        F.when((pos > neg) & (pos > neu), "positive").when((neg > pos) & (neg > neu), "negative").otherwise("neutral")
    )


def sentiment_shares(log: DataFrame) -> DataFrame:
    classed = log.where(succeeded()).withColumn("_class", sentiment())
    shares = [
        percent(F.count_if(F.col("_class") == k), F.count("*")).alias(k) for k in ("positive", "negative", "neutral")
    ]
    return classed.groupBy("model_name").agg(*shares)


def sentiment_bias(log: DataFrame) -> DataFrame:
    top = F.greatest("positive", "negative", "neutral")
    dominant = first_label({k: F.col(k) == top for k in ("positive", "negative", "neutral")}, "neutral")
    return sentiment_shares(log).select(
        "model_name",
        F.lit("Sentiment Bias").alias("category"),
        (top > SENTIMENT_SHARE).alias("biased"),
        F.lit("LOW").alias("severity"),
        top.alias("measure"),
        F.format_string("Dominant sentiment: %s", dominant).alias("description"),
    )


def bias_categories(log: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All category rows of the models with at least two successful answers."""
    rows = chart_bias(log).unionByName(sql_pattern_bias(log)).unionByName(sentiment_bias(log))
    if columns:
        rows = rows.unionByName(column_bias(log, columns))
    enough = (
        log.groupBy("model_name")
        .agg(F.count_if(succeeded()).alias("successes"))
        .where(F.col("successes") >= MIN_FOR_BIAS)
        .select("model_name")
    )
    return rows.join(enough, "model_name", "left_semi")


def severity_band(score: Column) -> Column:
    """L06."""
    return F.when(score >= 60, "HIGH").when(score >= 30, "MEDIUM").otherwise("LOW")


def bias_scores(log: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per model; too few answers give score 0 and severity UNKNOWN."""
    points = F.when(~F.col("biased"), 0)
    for severity, value in SEVERITY_POINTS.items():
        points = points.when(F.col("severity") == severity, value)
    scores = (
        bias_categories(log, columns)
        .groupBy("model_name")
        .agg(
            F.least(F.sum(points), F.lit(100)).cast("double").alias("bias_score"),
            F.count_if("biased").alias("num_biases"),
        )
    )
    models = log.groupBy("model_name").agg(F.count("*").alias("total_responses"))
    score = F.col("bias_score")
    return models.join(scores, "model_name", "left").select(
        "model_name",
        "total_responses",
        F.coalesce("num_biases", F.lit(0)).cast("bigint").alias("num_biases"),
        (F.coalesce("num_biases", F.lit(0)) > 0).alias("bias_detected"),
        F.coalesce(score, F.lit(0.0)).alias("bias_score"),
        F.when(score.isNull(), "UNKNOWN").otherwise(severity_band(score)).alias("severity"),
    )


def compare_bias(scores: DataFrame) -> DataFrame:
    """Models by ascending bias, ties by name, with the least biased one marked."""
    place = F.row_number().over(Window.orderBy("bias_score", "model_name"))
    return scores.withColumn("rank", place.cast("bigint")).withColumn("is_least_biased", F.col("rank") == 1)


def question_type() -> Column:
    text = F.lower(F.coalesce("user_query", F.lit("")))
    return first_label({k: has_any(text, words) for k, words in QUESTION_TYPES.items()}, "filtering")


def by_question_type(log: DataFrame) -> DataFrame:
    """Answers and mean time per type, for models with at least five successes."""
    rank = F.row_number().over(
        Window.partitionBy("model_name").orderBy(
            F.col("count").desc(),
            F.array_position(F.array(*map(F.lit, ["aggregation", "filtering", "sorting", "listing"])), F.col("question_type")),
        )
    )
    answers = F.sum("count").over(Window.partitionBy("model_name"))
    return (
        log.where(succeeded())
        .groupBy("model_name", question_type().alias("question_type"))
        .agg(F.count("*").alias("count"), F.avg(F.coalesce("response_time", F.lit(0.0))).alias("avg_response_time"))
        .withColumns({"is_most_common": rank == 1, "_answers": answers})
        .where(F.col("_answers") >= MIN_FOR_STABILITY)
        .drop("_answers")
    )


def response_time_stability(log: DataFrame) -> DataFrame:
    """Positive times only; models with fewer than two of them get no rating."""
    time = F.when(F.col("response_time") > 0, F.col("response_time"))
    cv = F.when(F.col("mean_time") > 0, F.col("std_time") / F.col("mean_time")).otherwise(0.0)
    return (
        log.where(succeeded())
        .groupBy("model_name")
        .agg(
            F.count("*").alias("_answers"),
            F.count(time).alias("timed"),
            F.avg(time).alias("mean_time"),
            F.stddev_pop(time).alias("std_time"),
            F.min(time).alias("min_time"),
            F.max(time).alias("max_time"),
        )
        .where((F.col("_answers") >= MIN_FOR_STABILITY) & (F.col("timed") >= 2))
        .drop("_answers")
        .withColumn("time_cv", cv)
        .withColumn(
            "stability_rating",
            F.when(F.col("time_cv") < 0.3, "stable").when(F.col("time_cv") < 0.6, "moderate").otherwise("unstable"),
        )
    )


def output_consistency(log: DataFrame) -> DataFrame:
    """Chart variety and spread of the SQL length."""
    size = F.length(F.coalesce("sql_query", F.lit("")))
    kinds = F.count_distinct(F.coalesce("visualization.type", F.lit("none")))
    return (
        log.where(succeeded())
        .groupBy("model_name")
        .agg(
            F.count("*").alias("_answers"),
            kinds.alias("visualization_variety"),
            F.stddev_pop(size).alias("sql_length_std"),
            F.avg(size).alias("avg_sql_length"),
        )
        .where(F.col("_answers") >= MIN_FOR_STABILITY)
        .drop("_answers")
        .withColumn("consistency_score", 100 - ratio(F.col("sql_length_std"), F.col("avg_sql_length")) * 100)
    )


def stability_report(log: DataFrame) -> DataFrame:
    """One row per model joining the three analyses; absent ones stay NULL."""
    models = log.groupBy("model_name").agg(
        F.count("*").alias("total_responses"), F.count_if(succeeded()).alias("successful_responses")
    )
    common = by_question_type(log).where("is_most_common").select("model_name", F.col("question_type").alias("most_common_type"))
    return (
        models.join(common, "model_name", "left")
        .join(response_time_stability(log).drop("timed"), "model_name", "left")
        .join(output_consistency(log), "model_name", "left")
    )
