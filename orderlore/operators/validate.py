"""Structure, null, duplicate and anomaly checks (V)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlore.functions.numeric import nan_to_null, percent, ratio
from orderlore.operators.profile import (
    column_quantiles,
    duplicate_count,
    named,
    null_counts,
    numeric_columns,
)

MIN_ROWS, MIN_COLUMNS = 10, 2
NULL_THRESHOLD = 0.15
DUPLICATE_THRESHOLD = 0.05
IQR_FACTOR = 3.0


def structure(df: DataFrame, min_rows: int = MIN_ROWS, min_columns: int = MIN_COLUMNS) -> DataFrame:
    """V01."""
    width = len(df.columns)
    return df.agg(F.count("*").alias("actual_rows")).select(
        "actual_rows",
        F.lit(width).cast("bigint").alias("actual_columns"),
        ((F.col("actual_rows") >= min_rows) & F.lit(width >= min_columns)).alias("valid"),
    )


def null_shares(df: DataFrame, threshold: float = NULL_THRESHOLD) -> DataFrame:
    """V02, one row per column."""
    share = ratio(F.col("null_count"), F.col("row_count"))
    return named(null_counts(df), df).select(
        "column", "null_count", share.alias("null_share"), F.coalesce(share > threshold, F.lit(False)).alias("exceeds")
    )


def nulls(df: DataFrame, threshold: float = NULL_THRESHOLD) -> DataFrame:
    """V02, one row for the table."""
    share = ratio(F.col("null_count"), F.col("row_count"))
    return null_counts(df).agg(
        F.sum("null_count").alias("total_null_cells"),
        percent(F.sum("null_count"), F.sum("row_count")).alias("null_pct_overall"),
        F.count_if(share > threshold).alias("columns_exceeding"),
        (F.count_if(share > threshold) == 0).alias("valid"),
    )


def duplicates(df: DataFrame, threshold: float = DUPLICATE_THRESHOLD) -> DataFrame:
    """Extra copies as a share of the rows."""
    share = ratio(F.col("duplicate_rows"), F.col("row_count"))
    return duplicate_count(df).select(
        F.col("duplicate_rows").alias("duplicate_count"),
        share.alias("duplicate_share"),
        F.coalesce(share <= threshold, F.lit(True)).alias("valid"),
    )


def iqr_bounds(df: DataFrame, columns: Sequence[str] | None = None, factor: float = IQR_FACTOR) -> DataFrame:
    """(ordinal, lower, upper) of the numeric columns that have a value."""
    q1, q3 = F.col("quantiles")[0], F.col("quantiles")[1]
    return column_quantiles(df, (0.25, 0.75), columns).select(
        "ordinal", (q1 - factor * (q3 - q1)).alias("lower"), (q3 + factor * (q3 - q1)).alias("upper")
    )


def bounds_map(bounds: DataFrame) -> Column:
    """The bounds as one scalar value (ordinal -> bounds) that any plan over the table can read."""
    pairs = F.collect_list(F.struct("ordinal", F.struct("lower", "upper").alias("b")))
    return bounds.agg(F.map_from_entries(pairs).alias("m")).scalar()


def outside(df: DataFrame, column: str, bounds: Column) -> Column:
    """Whether the cell lies outside its column's bounds; a missing cell does not."""
    value = F.col(f"`{column}`").cast("double")
    mine = bounds[F.lit(df.columns.index(column))]
    return F.coalesce((value < mine["lower"]) | (value > mine["upper"]), F.lit(False))


def anomalies(df: DataFrame, columns: Sequence[str] | None = None, factor: float = IQR_FACTOR) -> DataFrame:
    """Columns with values outside Q1 - f*IQR .. Q3 + f*IQR."""
    df = nan_to_null(df)
    columns = numeric_columns(df) if columns is None else list(columns)
    frame = df.withColumn("_bounds", bounds_map(iqr_bounds(df, columns, factor)))
    structs = []
    for i, c in enumerate(df.columns):
        if c in columns:
            value = F.col(f"`{c}`").cast("double")
            structs.append(
                F.struct(
                    F.lit(i).alias("ordinal"),
                    F.count_if(outside(df, c, F.col("_bounds"))).alias("outlier_count"),
                    percent(F.count_if(outside(df, c, F.col("_bounds"))), F.count("*")).alias("outlier_pct"),
                    F.any_value(F.col("_bounds")[F.lit(i)]["lower"]).alias("lower_bound"),
                    F.any_value(F.col("_bounds")[F.lit(i)]["upper"]).alias("upper_bound"),
                    F.min(value).alias("min_value"),
                    F.max(value).alias("max_value"),
                )
            )
    found = frame.agg(F.array(*structs).alias("facts")).select(F.explode("facts").alias("f")).select("f.*")
    return named(found.where(F.col("outlier_count") > 0), df).drop("ordinal", "dtype", "kind")


def anomaly_flags(df: DataFrame, columns: Sequence[str] | None = None, factor: float = IQR_FACTOR) -> DataFrame:
    """The table with one boolean per numeric column and one for the row."""
    columns = numeric_columns(df) if columns is None else list(columns)
    bounds = bounds_map(iqr_bounds(df, columns, factor))
    marked = nan_to_null(df).withColumn("_bounds", bounds)
    marked = marked.withColumns({f"{c}_anomaly": outside(df, c, F.col("_bounds")) for c in columns}).drop("_bounds")
    any_flag = F.lit(False)
    for c in columns:
        any_flag = any_flag | F.col(f"`{c}_anomaly`")
    return marked.withColumn("is_anomaly", any_flag)


def verdict(
    df: DataFrame,
    min_rows: int = MIN_ROWS,
    min_columns: int = MIN_COLUMNS,
    null_threshold: float = NULL_THRESHOLD,
    duplicate_threshold: float = DUPLICATE_THRESHOLD,
) -> DataFrame:
    """One row per check and the overall result; anomalies are reported but never fail it."""
    checks = (
        structure(df, min_rows, min_columns)
        .select(F.lit("structure").alias("check"), "valid")
        .unionByName(nulls(df, null_threshold).select(F.lit("nulls").alias("check"), "valid"))
        .unionByName(duplicates(df, duplicate_threshold).select(F.lit("duplicates").alias("check"), "valid"))
    )
    return checks.agg(
        F.bool_and("valid").alias("overall_valid"),
        *[
            F.bool_or(F.when(F.col("check") == c, F.col("valid"))).alias(f"{c}_valid")
            for c in ("structure", "nulls", "duplicates")
        ],
    )
