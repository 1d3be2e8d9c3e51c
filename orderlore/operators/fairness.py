"""Differences between the groups of a table (B).

`group_facts` makes one pass for all attributes and metrics: each row is repeated once per attribute
and combined on the map side, so a group holding a third of the rows arrives at its reducer as one
row per task. Every test is then arithmetic on those few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlore.functions.numeric import nan_to_null, percent, ratio
from orderlore.functions.quantiles import exact_quantiles
from orderlore.functions.statistics import f_tail_column
from orderlore.operators.profile import (
    column_roles,
    numeric_columns,
    protected_attributes,
    recommended_metrics,
)

FOUR_FIFTHS = 0.8
SIGNIFICANCE = 0.05
UNDER_REPRESENTED_PCT = 10.0
BROADCAST_GROUPS = 100_000

# fixed values: the wording of the assessment and of the advice
NO_TESTS = "No tests performed"
ASSESSMENT_NONE = "✓ No significant bias detected"
ASSESSMENT_MINOR = "⚠ Minor bias concerns detected"
ASSESSMENT_MODERATE = "⚠⚠ Moderate bias detected - review recommended"
ASSESSMENT_SIGNIFICANT = "⚠⚠⚠ Significant bias detected - immediate action required"
ADVICE_CLEAR = ["Continue monitoring for bias in future data updates"]
ADVICE_FLAGGED = [
    "Review groups with disparate impact ratios below 0.8",
    "Consider data augmentation for under-represented groups",
    "Investigate root causes of statistical differences",
    "Implement fairness constraints in downstream models",
    "Document bias mitigation strategies",
]


def choose_attributes(df: DataFrame, roles: DataFrame | None = None) -> list[str]:
    """The protected attributes that exist in the table; at most one name per column."""
    roles = column_roles(df) if roles is None else roles
    found = {r["column"] for r in protected_attributes(roles).select("column").collect()}
    return [c for c in df.columns if c in found]


def choose_metrics(df: DataFrame, roles: DataFrame | None = None) -> list[str]:
    """B02."""
    roles = column_roles(df) if roles is None else roles
    found = {r["column"] for r in recommended_metrics(roles).select("column").collect()}
    return [c for c in df.columns if c in found]


def unprofiled_metrics(df: DataFrame) -> DataFrame:
    """B02 without a profile: numeric columns whose distinct values are under 95 % of the rows."""
    roles = column_roles(df.select(*numeric_columns(df)))
    return roles.where(ratio(F.col("unique_count"), F.col("row_count")) < 0.95).select("column", "unique_count")


def _by_attribute(df: DataFrame, attributes: Sequence[str], *keep: str) -> DataFrame:
    """Rows repeated per attribute as (attribute, group, kept columns); missing groups are dropped."""
    pairs = [F.struct(F.lit(a).alias("attribute"), F.col(f"`{a}`").cast("string").alias("group")) for a in attributes]
    kept = [F.col(f"`{c}`") for c in dict.fromkeys(keep)]
    return (
        nan_to_null(df)
        .select(F.explode(F.array(*pairs)).alias("_pair"), *kept)
        .select("_pair.attribute", "_pair.group", *kept)
        .where(F.col("group").isNotNull())
    )


def group_facts(df: DataFrame, attributes: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(attribute, group, metric, rows, count, mean, std, var, min, max)."""
    facts = []
    for m in metrics:
        v = F.col(f"`{m}`").cast("double")
        facts.append(
            F.struct(
                F.lit(m).alias("metric"),
                F.count("*").alias("rows"),
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.var_samp(v).alias("var"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
            )
        )
    grouped = _by_attribute(df, attributes, *metrics).groupBy("attribute", "group").agg(F.array(*facts).alias("facts"))
    return grouped.select("attribute", "group", F.explode("facts").alias("f")).select("attribute", "group", "f.*")


def _few_groups(df: DataFrame, attributes: Sequence[str], metrics: Sequence[str]) -> bool:
    """Whether the number of groups is small enough to broadcast one row for each of them."""
    counts = df.agg(*[F.approx_count_distinct(f"`{a}`").alias(str(i)) for i, a in enumerate(attributes)]).first()
    return sum(counts) * max(1, len(metrics)) <= BROADCAST_GROUPS


def group_medians(df: DataFrame, attributes: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(attribute, group, metric, median), exact."""
    rows = _by_attribute(df, attributes, *metrics)
    cells = [F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in metrics]
    values = rows.select("attribute", "group", F.explode(F.array(*cells)).alias("_c")).select(
        "attribute", "group", "_c.metric", "_c.value"
    )
    small = _few_groups(df, attributes, metrics)
    return exact_quantiles(values, ["attribute", "group", "metric"], (0.5,), few_keys=small).select(
        "attribute", "group", "metric", F.col("quantiles")[0].alias("median")
    )


def group_statistics(df: DataFrame, attributes: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Count, mean, median, deviation, minimum and maximum, rounded half to even."""
    facts = group_facts(df, attributes, metrics)
    joined = facts.join(group_medians(df, attributes, metrics), ["attribute", "group", "metric"], "left")
    rounded = [F.bround(c, 2).alias(c) for c in ("mean", "median", "std", "min", "max")]
    return joined.select("attribute", "group", "metric", "count", *rounded)


def anova(facts: DataFrame, nan_policy: str = "propagate") -> DataFrame:
    """One-way analysis of variance over the groups with more than one row.

    With `propagate`, a missing metric anywhere makes the test undefined, hence not significant;
    `omit` ignores missing metrics.
    """
    n = F.col("count")
    usable = facts.where(F.col("rows") > 1)
    pair = ["attribute", "metric"]
    sums = usable.groupBy(*pair).agg(
        F.count("*").alias("groups"),
        F.sum(n).alias("observations"),
        F.sum(F.col("rows") - n).alias("missing"),
        (F.sum(n * F.col("mean")) / F.sum(n)).alias("grand_mean"),
        F.sum((n - 1) * F.col("var")).alias("within"),
    )
    # squares around the grand mean, since subtracting two large squares would lose digits
    offset = F.col("mean") - F.col("grand_mean")
    spread = (
        usable.join(sums.select(*pair, "grand_mean"), pair)
        .groupBy(*pair)
        .agg(F.sum(n * offset * offset).alias("between"))
    )
    sums, between = sums.join(spread, pair), F.col("between")
    df_between, df_within = F.col("groups") - 1, F.col("observations") - F.col("groups")
    f = F.try_divide(F.try_divide(between, df_between), F.try_divide(F.col("within"), df_within))
    if nan_policy == "propagate":
        f = F.when(F.col("missing") == 0, f)
    tested = sums.where(F.col("groups") >= 2).select(
        "attribute", "metric", "groups", df_between.alias("df_between"), df_within.alias("df_within"), f.alias("f_statistic")
    )
    p = f_tail_column(F.col("f_statistic"), F.col("df_between"), F.col("df_within"))
    return tested.withColumn("p_value", p).withColumn(
        "significant", F.coalesce(F.col("p_value") < SIGNIFICANCE, F.lit(False))
    )


def disparate_impact(facts: DataFrame) -> DataFrame:
    """Lowest group mean over highest, and the four-fifths rule."""
    mean = F.col("mean")
    ends = facts.groupBy("attribute", "metric").agg(
        F.count("*").alias("_groups"),
        F.max(mean).alias("privileged_mean"),
        F.min(mean).alias("underprivileged_mean"),
        F.min_by("group", F.when(mean.isNotNull(), F.struct(-mean, "group"))).alias("privileged_group"),
        F.min_by("group", F.when(mean.isNotNull(), F.struct(mean, "group"))).alias("underprivileged_group"),
    )
    share = F.when(
        F.col("privileged_mean") > 0, F.col("underprivileged_mean") / F.col("privileged_mean")
    ).otherwise(0.0)
    return (
        ends.where(F.col("_groups") >= 2)
        .withColumn("ratio", share)
        .select(
            "attribute", "metric", "ratio", (F.col("ratio") >= FOUR_FIFTHS).alias("passes_80_percent_rule"),
            "privileged_group", "underprivileged_group", "privileged_mean", "underprivileged_mean",
        )
    )


def variation(facts: DataFrame) -> DataFrame:
    """Coefficient of variation of the groups."""
    cv = ratio(F.col("std"), F.col("mean"))
    return facts.groupBy("attribute", "metric").agg(
        F.avg(cv).alias("mean_cv"), F.max(cv).alias("max_cv"), F.min(cv).alias("min_cv")
    )


def representation(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Rows per group as a share of all rows, missing groups included in the whole."""
    total = df.select(F.count(F.lit(1))).scalar()
    share = percent(F.col("count"), F.col("_total"))
    return (
        _by_attribute(df, attributes)
        .groupBy("attribute", "group")
        .agg(F.count("*").alias("count"))
        .withColumn("_total", total)
        .select("attribute", "group", "count", share.alias("percentage"), (share < UNDER_REPRESENTED_PCT).alias("under_represented"))
    )


def sweep(df: DataFrame, attributes: Sequence[str], metrics: Sequence[str], nan_policy: str = "propagate") -> DataFrame:
    """One row per attribute and metric with every test."""
    facts = group_facts(df, attributes, metrics)
    pair = ["attribute", "metric"]
    return (
        facts.select(*pair)
        .distinct()
        .join(anova(facts, nan_policy), pair, "left")
        .join(disparate_impact(facts), pair, "left")
        .join(variation(facts), pair, "left")
    )


def assessment(flags: Column, tests: Column) -> Column:
    """B10."""
    share = percent(flags, tests)
    return (
        F.when(tests == 0, NO_TESTS)
        .when(share == 0, ASSESSMENT_NONE)
        .when(share < 20, ASSESSMENT_MINOR)
        .when(share < 50, ASSESSMENT_MODERATE)
        .otherwise(ASSESSMENT_SIGNIFICANT)
    )


def recommendations(flags: Column) -> Column:
    """B11."""
    return F.when(flags == 0, F.array(*map(F.lit, ADVICE_CLEAR))).otherwise(F.array(*map(F.lit, ADVICE_FLAGGED)))


def summarise(df: DataFrame, attributes: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Flags over tests, with assessment and advice; skipped when there is nothing to test."""
    if not attributes or not metrics:
        reason = "No protected attributes detected" if not attributes else "No numerical metrics detected"
        return df.sparkSession.createDataFrame(
            [("skipped", reason, 0, 0, 0.0, NO_TESTS, [])],
            "status string, reason string, total_tests bigint, bias_flags bigint, bias_flag_pct double, "
            "overall_assessment string, recommendations array<string>",
        )
    impact = disparate_impact(group_facts(df, attributes, metrics))
    flagged = (
        representation(df, attributes)
        .groupBy("attribute")
        .agg(F.bool_or("under_represented").alias("biased"))
        .select("biased")
        .unionByName(impact.select((~F.col("passes_80_percent_rule")).alias("biased")))
    )
    tests = F.lit(len(attributes) * len(metrics)).cast("bigint")
    return flagged.agg(F.count_if("biased").alias("bias_flags")).select(
        F.lit("completed").alias("status"),
        F.lit(None).cast("string").alias("reason"),
        tests.alias("total_tests"),
        "bias_flags",
        percent(F.col("bias_flags"), tests).alias("bias_flag_pct"),
        assessment(F.col("bias_flags"), tests).alias("overall_assessment"),
        recommendations(F.col("bias_flags")).alias("recommendations"),
    )
