"""Names, types, missing values, duplicates, outliers and constant columns (C)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlore.functions.dates import places_of, to_datetime
from orderlore.functions.numeric import is_number, nan_to_null, percent
from orderlore.operators.profile import (
    NUMERIC_ROLES,
    column_quantiles,
    column_roles,
    frequencies,
    numeric_summary,
    table_quality,
)
from orderlore.operators.validate import bounds_map, iqr_bounds, outside
from orderlore.session import materialise

OUTLIER_FACTOR = 3.0
HIGH_NULL_PCT = 15.0


def normal_name(name: str) -> str:
    """Lower case, letters and digits joined by single underscores."""
    return "_".join(re.findall(r"[^\W_]+", name.strip().lower()))


def normal_names(names: Iterable[str]) -> list[str]:
    """The second holder of a name becomes name_1, the third name_2."""
    taken: dict[str, int] = {}
    result = []
    for base in map(normal_name, names):
        repeat = taken.get(base, -1) + 1
        taken[base] = repeat
        result.append(f"{base}_{repeat}" if repeat else base)
    return result


def normalize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*normal_names(df.columns))


def roles_by_column(df: DataFrame, approx: bool = False) -> dict[str, str]:
    """The roles as a driver-side dict: one small row per column, since later steps depend on it."""
    return {r["column"]: r["role"] for r in column_roles(df, approx).select("column", "role").collect()}


def _with_role(df: DataFrame, roles: Mapping[str, str], *wanted: str) -> list[str]:
    return [c for c in df.columns if roles.get(c) in wanted]


def standardize_types(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Parse dates and numbers, tag categories, trim other text. Unparsable cells become NULL.

    A text column of dates is read with the one pattern that fits most of its values.
    """
    dated = [f.name for f in df.schema.fields if roles.get(f.name) == "datetime" and isinstance(f.dataType, T.StringType)]
    places, new = places_of(df, dated), []
    for field in df.schema.fields:
        c, role = F.col(f"`{field.name}`"), roles.get(field.name)
        is_text = isinstance(field.dataType, T.StringType)
        if role == "datetime" and is_text:
            c = to_datetime(c, places[field.name])
        elif role in NUMERIC_ROLES and not is_number(field.dataType):
            c = c.try_cast("double")
        elif is_text and role != "categorical":
            c = F.trim(c)
        new.append(c.alias(field.name, metadata={**field.metadata, "role": role or "unknown"}))
    return df.select(*new)


def drop_missing_identifiers(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """C06."""
    ids = _with_role(df, roles, "identifier")
    return nan_to_null(df).dropna(subset=ids) if ids else df


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(ordinal, mode): the commonest value, the smallest among ties; numbers compare as numbers."""
    order = F.struct(-F.col("count"), F.col("value").try_cast("double"), F.col("value"))
    return (
        frequencies(df, columns)
        .where(F.col("value").isNotNull())
        .groupBy("ordinal")
        .agg(F.min_by("value", order).alias("mode"))
    )


def fill_missing(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Categories get the mode or `Unknown`, continuous the median, discrete the mode or 0."""
    df = nan_to_null(df)
    by_mode = _with_role(df, roles, "categorical", "discrete_numeric")
    by_median = _with_role(df, roles, "continuous_numeric")
    if by_mode:
        pairs = F.map_from_entries(F.collect_list(F.struct("ordinal", "mode")))
        df = df.withColumn("_modes", modes(df, by_mode).agg(pairs).scalar())
    if by_median:
        medians = column_quantiles(df, (0.5,), by_median)
        pairs = F.map_from_entries(F.collect_list(F.struct("ordinal", F.col("quantiles")[0].alias("median"))))
        df = df.withColumn("_medians", medians.agg(pairs).scalar())
    new = []
    for i, field in enumerate(df.schema.fields):
        if field.name in ("_modes", "_medians"):
            continue
        c, role = F.col(f"`{field.name}`"), roles.get(field.name)
        if role in ("categorical", "discrete_numeric"):
            mode = F.col("_modes")[F.lit(i)].cast(field.dataType)
            fallback = F.lit("Unknown" if isinstance(field.dataType, T.StringType) else 0).cast(field.dataType)
            c = F.coalesce(c, mode, fallback)
        elif role == "continuous_numeric":
            c = F.coalesce(c.cast("double"), F.col("_medians")[F.lit(i)])
        new.append(c.alias(field.name, metadata=field.metadata))
    return df.select(*new)


def remove_duplicates(df: DataFrame) -> DataFrame:
    """C10."""
    return df.dropDuplicates()


def zscore_bounds(df: DataFrame, columns: list[str], factor: float) -> DataFrame:
    """Mean plus and minus `factor` sample deviations."""
    return numeric_summary(df, columns).select(
        "ordinal",
        (F.col("mean") - factor * F.col("std")).alias("lower"),
        (F.col("mean") + factor * F.col("std")).alias("upper"),
    )


def _bounds(df: DataFrame, columns: list[str], method: str, factor: float) -> DataFrame | None:
    if method == "iqr":
        return iqr_bounds(df, columns, factor)
    if method == "zscore":
        return zscore_bounds(df, columns, factor)
    return None


def outlier_report(
    df: DataFrame, roles: Mapping[str, str], method: str = "iqr", factor: float = OUTLIER_FACTOR
) -> DataFrame:
    """C11: count, share and bounds of the columns that have outliers."""
    columns = _with_role(df, roles, *NUMERIC_ROLES)
    bounds = _bounds(df, columns, method, factor)
    if not columns or bounds is None:
        schema = "column string, outlier_count bigint, outlier_pct double, lower_bound double, upper_bound double"
        return df.sparkSession.createDataFrame([], schema)
    marked = nan_to_null(df).withColumn("_bounds", bounds_map(bounds))
    facts = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(outside(df, c, F.col("_bounds"))).alias("outlier_count"),
            percent(F.count_if(outside(df, c, F.col("_bounds"))), F.count("*")).alias("outlier_pct"),
            F.any_value(F.col("_bounds")[F.lit(df.columns.index(c))]["lower"]).alias("lower_bound"),
            F.any_value(F.col("_bounds")[F.lit(df.columns.index(c))]["upper"]).alias("upper_bound"),
        )
        for c in columns
    ]
    rows = marked.agg(F.array(*facts).alias("facts")).select(F.explode("facts").alias("f")).select("f.*")
    return rows.where(F.col("outlier_count") > 0)


def cap_outliers(
    df: DataFrame, roles: Mapping[str, str], method: str = "iqr", factor: float = OUTLIER_FACTOR
) -> DataFrame:
    """Clip to the bounds. Missing cells stay missing; an unknown method changes nothing."""
    columns = _with_role(df, roles, *NUMERIC_ROLES)
    bounds = _bounds(df, columns, method, factor)
    if not columns or bounds is None:
        return df
    marked = nan_to_null(df).withColumn("_bounds", bounds_map(bounds))
    new = []
    for i, field in enumerate(df.schema.fields):
        c = F.col(f"`{field.name}`")
        if field.name in columns:
            value, mine = c.cast("double"), F.col("_bounds")[F.lit(i)]
            c = (
                F.when(value < mine["lower"], mine["lower"])
                .when(value > mine["upper"], mine["upper"])
                .otherwise(value)
            )
        new.append(c.alias(field.name, metadata=field.metadata))
    return marked.select(*new)


def constant_columns(df: DataFrame) -> DataFrame:
    """C14: columns with at most one distinct value, from one aggregate without a distinct count."""
    df = nan_to_null(df)
    facts = [
        F.struct(
            F.lit(c).alias("column"),
            (F.count(F.col(f"`{c}`")) == 0).alias("all_missing"),
            F.coalesce(F.min(F.col(f"`{c}`")) == F.max(F.col(f"`{c}`")), F.lit(True)).alias("constant"),
        )
        for c in df.columns
    ]
    rows = df.agg(F.array(*facts).alias("facts")).select(F.explode("facts").alias("f")).select("f.*")
    return rows.where("constant").select("column", "all_missing")


def remove_constant_columns(df: DataFrame) -> DataFrame:
    """The output schema depends on the data, so the names (one per column at most) reach the driver."""
    return df.drop(*[r["column"] for r in constant_columns(df).collect()])


def clean(
    df: DataFrame,
    roles: Mapping[str, str] | None = None,
    method: str = "iqr",
    factor: float = OUTLIER_FACTOR,
) -> DataFrame:
    """C17: the whole chain in the fixed order.

    The roles, the date patterns, the modes, the medians and the filled rows all read the given rows, and the bounds, the
    constant check and the result the deduplicated ones, so both are written once to the shared folder instead of being
    computed again for each of them.
    """
    df = materialise(normalize_column_names(df), "given")
    roles = roles_by_column(df) if roles is None else {normal_name(c): r for c, r in roles.items()}
    typed = standardize_types(df, roles)
    filled = fill_missing(drop_missing_identifiers(typed, roles), roles)
    unique = materialise(remove_duplicates(filled), "deduplicated")
    return remove_constant_columns(cap_outliers(unique, roles, method, factor))


def summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows and columns before and after, and the share kept."""
    old, new = len(before.columns), len(after.columns)
    final = after.select(F.count(F.lit(1))).scalar()
    return before.agg(F.count("*").alias("initial_rows")).select(
        "initial_rows",
        F.lit(old).cast("bigint").alias("initial_columns"),
        final.alias("final_rows"),
        F.lit(new).cast("bigint").alias("final_columns"),
        (F.col("initial_rows") - final).alias("rows_removed"),
        F.lit(old - new).cast("bigint").alias("columns_removed"),
        percent(final, F.col("initial_rows")).alias("rows_retained_pct"),
        percent(final, F.col("initial_rows")).alias("data_quality_score"),
    )


def quality(df: DataFrame) -> DataFrame:
    """C16."""
    return table_quality(df).select("null_pct", "duplicate_pct", (100 - F.col("null_pct")).alias("completeness_score"))


def high_null_alert(quality_row: DataFrame, limit: float = HIGH_NULL_PCT) -> DataFrame:
    """C18."""
    return quality_row.select("null_pct", (F.col("null_pct") > limit).alias("alert"))
