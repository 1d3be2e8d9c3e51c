"""Choosing a model, gates on its figures, and comparison with earlier versions (M)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlore.functions.numeric import ratio
from orderlore.functions.text import allow_repeated_keys
from orderlore.operators.responses import unfenced
from orderlore.session import materialise

# fixed values: weights of the composite score
WEIGHTS = {"performance": 0.50, "bias": 0.30, "time": 0.10, "success": 0.10}
SLOWEST_SECONDS = 5.0

# fixed values: minimum figures and the wording of a failed gate
PERFORMANCE_GATE = {
    "overall_score": (75.0, "Overall score", ""),
    "success_rate": (80.0, "Success rate", "%"),
    "syntax_validity_rate": (85.0, "Syntax validity", "%"),
    "intent_matching_rate": (70.0, "Intent matching", "%"),
}
EXECUTION_GATE = {
    "execution_success_rate": (85.0, "Execution success rate", "%"),
    "result_validity_rate": (80.0, "Result validity rate", "%"),
    "overall_accuracy": (75.0, "Overall accuracy", "%"),
}
MAX_BIAS_SCORE, MAX_SEVERITY = 30.0, "MEDIUM"
SEVERITY_LEVELS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}

# fixed values: generation parameters tried
PARAMETER_GRID = {"temperature": [0.2, 0.4, 0.6], "top_p": [0.8, 0.9], "top_k": [40, 60]}


def common_models(evaluation: DataFrame, bias: DataFrame) -> DataFrame:
    """Models that have both reports."""
    return evaluation.join(bias, "model_name")


def composite_scores(evaluation: DataFrame, bias: DataFrame) -> DataFrame:
    """Weighted score; absent figures count as the worst."""
    known = lambda c, worst: F.coalesce(F.col(c), F.lit(worst))
    parts = common_models(evaluation, bias).select(
        "model_name",
        known("overall_score", 0.0).alias("performance_score"),
        known("bias_score", 100.0).alias("bias_score"),
        known("avg_response_time", 10.0).alias("response_time"),
        known("success_rate", 0.0).alias("success_rate"),
    )
    parts = parts.withColumns(
        {
            "normalized_bias": 100 - F.col("bias_score"),
            "normalized_time": F.greatest(F.lit(0.0), 100 - F.col("response_time") / SLOWEST_SECONDS * 100),
        }
    )
    total = (
        F.col("performance_score") * WEIGHTS["performance"]
        + F.col("normalized_bias") * WEIGHTS["bias"]
        + F.col("normalized_time") * WEIGHTS["time"]
        + F.col("success_rate") * WEIGHTS["success"]
    )
    return parts.withColumn("composite_score", total)


def rank_models(scores: DataFrame) -> DataFrame:
    """One row per model, so the unpartitioned window is small."""
    place = F.row_number().over(Window.orderBy(F.col("composite_score").desc(), "model_name"))
    return scores.withColumn("rank", place.cast("bigint"))


def best_model(ranking: DataFrame) -> DataFrame:
    """M04."""
    return ranking.where(F.col("rank") == 1)


def select_best(evaluation: DataFrame, bias: DataFrame) -> DataFrame:
    """M01-M04 with the check that some model has both reports.

    The row is written first, so that the check doesn't compute both reports a second time.
    """
    best = materialise(best_model(rank_models(composite_scores(evaluation, bias))), "best-model")
    if best.isEmpty():
        raise ValueError("no model has both an evaluation and a bias report")
    return best


def top_models(ranking: DataFrame, n: int = 3) -> DataFrame:
    """The first n models with their figures as text."""
    two = lambda c: F.format_string("%.2f", F.col(c))
    return (
        ranking.orderBy("rank")
        .limit(n)
        .select(
            F.col("rank").alias("Rank"),
            F.col("model_name").alias("Model"),
            two("composite_score").alias("Composite Score"),
            two("performance_score").alias("Performance"),
            two("bias_score").alias("Bias Score"),
        )
    )


def _gate(figures: DataFrame, gate: Mapping[str, tuple], thresholds: Mapping[str, float] | None) -> DataFrame:
    errors = []
    for name, (default, label, unit) in gate.items():
        limit = float((thresholds or {}).get(name, default))
        value = F.coalesce(F.col(name), F.lit(0.0))
        text = F.format_string(f"{label} %.2f{unit.replace('%', '%%')} below threshold {limit}{unit.replace('%', '%%')}", value)
        errors.append(F.when(value < limit, text))
    return figures.withColumn("errors", F.array_compact(F.array(*errors))).withColumn("passed", F.size("errors") == 0)


def performance_gate(metrics: DataFrame, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Four minimums on a model's figures."""
    return _gate(metrics, PERFORMANCE_GATE, thresholds)


def execution_gate(accuracy: DataFrame, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Three minimums on the executed answers; no figures at all fail."""
    return _gate(accuracy, EXECUTION_GATE, thresholds)


def bias_gate(
    bias: DataFrame, max_score: float = MAX_BIAS_SCORE, max_severity: str = MAX_SEVERITY
) -> DataFrame:
    """Score and severity of the least biased model."""
    best = bias.orderBy("bias_score", "model_name").limit(1)
    level = F.lit(3)
    for name, value in SEVERITY_LEVELS.items():
        level = F.when(F.col("severity") == name, value).otherwise(level)
    score = F.when(
        F.col("bias_score") > max_score,
        F.format_string(f"Bias score %.2f exceeds threshold {max_score}", F.col("bias_score")),
    )
    severity = F.when(
        level > SEVERITY_LEVELS.get(max_severity, 2),
        F.format_string(f"Bias severity '%s' exceeds threshold '{max_severity}'", F.col("severity")),
    )
    return best.select(
        "model_name", "bias_score", "severity", F.array_compact(F.array(score, severity)).alias("errors")
    ).withColumn("status", F.when(F.size("errors") == 0, "passed").otherwise("failed"))


def previous_version(versions: DataFrame) -> DataFrame:
    """The second newest record, of kind `metadata` where any exists, else of kind `selection`.

    Both newest lists come from a top-k, so the history is never sorted as a whole.
    """
    newest = Window.partitionBy("kind").orderBy(F.col("updated").desc(), "version")
    recent = versions.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= 2)
    has_metadata = versions.where(F.col("kind") == "metadata").select(F.count(F.lit(1)) > 0).scalar()
    wanted = F.when(has_metadata, "metadata").otherwise("selection")
    return recent.where((F.col("kind") == wanted) & (F.col("_n") == 2)).drop("_n")


def with_previous(versions: DataFrame, keys: Sequence[str], slice_by: Column | None = None) -> DataFrame:
    """Each version with the score of the one before it in its history (`keys`).

    `slice_by`, a period of the update time, bounds what one task has to sort: inside a slice the
    previous version is a neighbour, and the first version of a slice takes the last one of the nearest
    earlier slice, found among one row per slice. By default a slice is a month; with keys that bound a history,
    `slice_by=F.lit(0)` leaves it whole.
    """
    order = ["updated", "version"]
    if slice_by is None:
        kind = versions.schema["updated"].dataType
        # numbers are seconds
        slice_by = F.floor(F.col("updated") / 2_592_000) if isinstance(kind, T.NumericType) else F.date_trunc("month", "updated")
    sliced = versions.withColumn("_slice", slice_by)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    rows = sliced.withColumns({"previous_score": F.lag("composite_score").over(inside), "_n": F.row_number().over(inside)})
    lasts = sliced.groupBy(*keys, "_slice").agg(F.max_by("composite_score", F.struct(*order)).alias("_last"))
    carried = lasts.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice"))).drop("_last")
    return (
        rows.join(carried, [*keys, "_slice"])
        .withColumn("previous_score", F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("previous_score")))
        .drop("_n", "_carried", "_slice")
    )


def promotion(
    versions: DataFrame,
    enabled: bool = True,
    min_improvement: float = 0.0,
    keys: Sequence[str] = (),
    slice_by: Column | None = None,
) -> DataFrame:
    """Whether each version may replace the one before it."""
    gain = F.col("improvement")
    allowed = F.col("previous_score").isNull() | F.lit(not enabled) | (gain >= min_improvement)
    reason = (
        F.when(F.col("previous_score").isNull(), "No previous model to compare")
        .when(F.lit(not enabled), "Rollback disabled")
        .when(gain >= min_improvement, F.format_string("Model improved by %.2f points", gain))
        .otherwise(F.format_string("Model degraded by %.2f points", F.abs(gain)))
    )
    return (
        with_previous(versions, keys, slice_by)
        .withColumn("improvement", F.col("composite_score") - F.col("previous_score"))
        .withColumn("should_deploy", allowed)
        .withColumn("reason", reason)
    )


def parameter_grid(trials: DataFrame) -> DataFrame:
    """The grid as rows numbered in the order it is tried."""
    one = trials.sparkSession.range(1)
    for name, values in PARAMETER_GRID.items():
        one = one.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    order = Window.orderBy(*PARAMETER_GRID)
    return one.drop("id").withColumn("trial", F.row_number().over(order).cast("bigint"))


def tune(trials: DataFrame) -> DataFrame:
    """Score of each combination over its logged answers, the first best one marked.

    Half the score is the share of answers that parse as JSON, half the share that also hold a query
    and a chart. Nothing is marked when every score is zero.
    """
    allow_repeated_keys()
    parsed = F.try_parse_json(unfenced(F.coalesce("raw_response", F.lit(""))))
    field = lambda path: F.try_variant_get("_json", path, "variant").isNotNull()
    scored = (
        trials.withColumn("_json", parsed)
        .groupBy(*PARAMETER_GRID)
        .agg(
            F.count("*").alias("answers"),
            F.count_if(F.col("_json").isNotNull()).alias("parsed"),
            F.count_if(field("$.sql_query") & field("$.visualization")).alias("well_formed"),
        )
    )
    share = lambda c: F.coalesce(ratio(F.col(c), F.col("answers")), F.lit(0.0))
    rows = (
        parameter_grid(trials)
        .join(scored, list(PARAMETER_GRID), "left")
        .withColumn("score", share("parsed") * 50 + share("well_formed") * 50)
    )
    first_best: Column = F.row_number().over(Window.orderBy(F.col("score").desc(), "trial")) == 1
    return rows.withColumn("is_best", first_best & (F.col("score") > 0))
