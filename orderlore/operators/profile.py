"""Column roles, counts and statistics (P).

Facts about columns are rows keyed by the column's ordinal. One frequency pass (one shuffle of
distinct cells) gives nulls, distinct counts, modes, top values and date parse rates of all columns;
one aggregate without a shuffle of data gives the numeric statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlore.functions.dates import best_reading, parses
from orderlore.functions.numeric import is_datetime, is_fractional, is_integral, is_number, nan_to_null, percent, ratio
from orderlore.functions.quantiles import exact_quantiles
from orderlore.functions.sketches import QUANTILE_ACCURACY, distinct_values, heavy_hitters
from orderlore.session import materialise

# fixed values: words that mark a column as sensitive
SENSITIVE_KEYWORDS = (
    "gender",
    "age",
    "race",
    "ethnicity",
    "religion",
    "disability",
    "segment",
    "region",
    "income",
    "education",
)

PARSE_RATE = 0.8
IDENTIFIER_RATIO = 0.95
CATEGORICAL_LIMIT = 20
CATEGORICAL_RATIO = 0.5
NUMERIC_ROLES = ("continuous_numeric", "discrete_numeric")


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if is_datetime(data_type):
        return "datetime"
    if is_integral(data_type):
        return "integral"
    if is_fractional(data_type):
        return "fractional"
    return "string"


def named(facts: DataFrame, df: DataFrame) -> DataFrame:
    """Turn ordinals into names, types and kinds, which the driver knows from the schema."""
    fields = df.schema.fields
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("ordinal") + 1)
    return facts.select(
        "ordinal",
        pick([f.name for f in fields]).alias("column"),
        pick([f.dataType.simpleString() for f in fields]).alias("dtype"),
        pick([kind_of(f.dataType) for f in fields]).alias("kind"),
        *[c for c in facts.columns if c != "ordinal"],
    )


def cells(df: DataFrame, columns: Sequence[str] | None = None, as_type: str = "string") -> DataFrame:
    """(ordinal, value) for every cell of the named columns."""
    wanted = set(df.columns if columns is None else columns)
    parts = [
        F.struct(F.lit(i).alias("ordinal"), F.col(f"`{c}`").cast(as_type).alias("value"))
        for i, c in enumerate(df.columns)
        if c in wanted
    ]
    return df.select(F.explode(F.array(*parts)).alias("cell")).select("cell.*")


def frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(ordinal, value, count): the cells pre-aggregated on the map side before they are shuffled."""
    return cells(nan_to_null(df), columns).groupBy("ordinal", "value").agg(F.count("*").alias("count"))


def column_counts(df: DataFrame, approx: bool = False, freq: DataFrame | None = None) -> DataFrame:
    """Rows, nulls, distinct values and best date parse rate per column.

    `approx` takes them from `sketched`, which needs no shuffle of cells; `freq` is a stored `frequencies(df)` that several
    operators share.
    """
    if approx:
        return sketched(df).select("ordinal", "column", "dtype", "kind", "row_count", "null_count", "unique_count", "parse_rate")
    strings = [i for i, f in enumerate(df.schema.fields) if kind_of(f.dataType) == "string"]
    text = F.when(F.col("ordinal").isin(strings), F.col("value")) if strings else F.lit(None).cast("string")
    present = F.col("value").isNotNull()
    weight = F.sum(F.when(present, F.col("count")).otherwise(0))
    rates = [ratio(F.sum(F.when(p.isNotNull(), F.col("count")).otherwise(0)), weight) for p in parses(text)]
    counted = (
        (frequencies(df) if freq is None else freq)
        .groupBy("ordinal")
        .agg(
            F.sum("count").alias("row_count"),
            F.sum(F.when(present, 0).otherwise(F.col("count"))).alias("null_count"),
            F.count("value").alias("unique_count"),
            F.coalesce(F.greatest(*rates), F.lit(0.0)).alias("parse_rate"),
        )
    )
    return named(counted, df)


def sketched(df: DataFrame, k: int = 5) -> DataFrame:
    """All facts of every column from one pass over the rows, by sketches (P04-P07 and the quartiles of F06).

    Distinct counts and top values are exact for columns of at most `sketches.TRACKED` values. Beyond that a count is off by
    at most `sketches.count_error`, the number of distinct values by about a hundredth, a quartile by one rank in ten thousand.
    """
    df = nan_to_null(df)
    structs = []
    for i, f in enumerate(df.schema.fields):
        c, kind = F.col(f"`{f.name}`"), kind_of(f.dataType)
        hitters = heavy_hitters(c, f.dataType)
        v = c.cast("double") if is_number(f.dataType) else F.lit(None).cast("double")
        reading = best_reading(c) if kind == "string" else F.struct(F.lit(0).alias("values"), F.lit(0).alias("place"), *[
            (fold(c).cast("timestamp") if kind == "datetime" else F.lit(None).cast("timestamp")).alias(n) for fold, n in ((F.min, "min_date"), (F.max, "max_date"))
        ])
        structs.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.count("*").alias("row_count"),
                F.count_if(c.isNull()).alias("null_count"),
                distinct_values(c, hitters).alias("unique_count"),
                F.coalesce(ratio(reading["values"], F.count(c)), F.lit(0.0)).alias("parse_rate"),
                F.count(v).alias("present"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                F.percentile_approx(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(QUANTILE_ACCURACY)).alias("quartiles"),
                F.slice(hitters, 1, k).alias("top_values"),
                reading["min_date"].alias("min_date"), reading["max_date"].alias("max_date"),
            )
        )
    facts = df.agg(F.array(*structs).alias("facts")).select(F.explode("facts").alias("f")).select("f.*")
    quartile = {n: F.col("quartiles")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))}
    return named(facts.select(*[c for c in facts.columns if c != "quartiles"], *quartile.values()), df)


def role_of() -> Column:
    """Role ladder over the columns of `column_counts`.

    An integral column with missing cells is read as continuous, as a file reader without nullable
    integers would see it. Boolean and timestamp columns get their own roles.
    """
    present = F.col("row_count") - F.col("null_count")
    distinct_ratio = ratio(F.col("unique_count"), present)
    kind = F.col("kind")
    numeric = kind.isin("integral", "fractional")
    whole = (kind == "integral") & (F.col("null_count") == 0)
    return (
        F.when(present == 0, "unknown")
        .when(kind == "datetime", "datetime")
        .when(kind == "boolean", "boolean")
        .when((kind == "string") & (F.col("parse_rate") > PARSE_RATE), "datetime")
        .when(numeric & (distinct_ratio > IDENTIFIER_RATIO), "identifier")
        .when(whole & (F.col("unique_count") < CATEGORICAL_LIMIT), "categorical")
        .when(numeric & ~whole, "continuous_numeric")
        .when(numeric, "discrete_numeric")
        .when(distinct_ratio < CATEGORICAL_RATIO, "categorical")
        .otherwise("text")
    )


def with_roles(counts: DataFrame) -> DataFrame:
    """Columns of `column_counts` with role and shares."""
    return counts.select(
        "*",
        role_of().alias("role"),
        percent(F.col("null_count"), F.col("row_count")).alias("null_pct"),
        percent(F.col("unique_count"), F.col("row_count")).alias("unique_pct"),
    )


def column_roles(df: DataFrame, approx: bool = False, freq: DataFrame | None = None) -> DataFrame:
    return with_roles(column_counts(df, approx, freq))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """min, max, mean and sample deviation of every numeric column: one aggregate, one result row."""
    df = nan_to_null(df)
    columns = numeric_columns(df) if columns is None else list(columns)
    structs = []
    for i, c in enumerate(df.columns):
        if c in columns:
            v = F.col(f"`{c}`").cast("double")
            structs.append(
                F.struct(
                    F.lit(i).alias("ordinal"),
                    F.count(v).alias("present"),
                    F.min(v).alias("min"),
                    F.max(v).alias("max"),
                    F.avg(v).alias("mean"),
                    F.stddev_samp(v).alias("std"),
                )
            )
    return df.agg(F.array(*structs).alias("facts")).select(F.explode("facts").alias("f")).select("f.*")


def column_quantiles(df: DataFrame, probabilities: Sequence[float], columns: Sequence[str] | None = None) -> DataFrame:
    """(ordinal, n, quantiles) of the numeric columns."""
    columns = numeric_columns(df) if columns is None else list(columns)
    return exact_quantiles(cells(nan_to_null(df), columns, "double"), ["ordinal"], probabilities, few_keys=True)


def numeric_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The summary with the median; F06 adds the quartiles."""
    quartiles = column_quantiles(df, (0.25, 0.5, 0.75), columns).select(
        "ordinal",
        F.col("quantiles")[0].alias("q25"),
        F.col("quantiles")[1].alias("median"),
        F.col("quantiles")[2].alias("q75"),
    )
    return named(numeric_summary(df, columns).join(quartiles, "ordinal", "left"), df)


def _of_columns(df: DataFrame, columns: Sequence[str] | None, freq: DataFrame | None) -> DataFrame:
    if freq is None:
        return frequencies(df, columns)
    return freq if columns is None else freq.where(F.col("ordinal").isin([df.columns.index(c) for c in columns]))


def top_values(
    df: DataFrame, k: int = 5, columns: Sequence[str] | None = None, freq: DataFrame | None = None, approx: bool = False
) -> DataFrame:
    """(column, value, count, place) of the k commonest values, ties by value (P06, F05); by sketches if `approx`.

    The filter on row_number becomes a partial top-k before the shuffle, so no column's distinct
    values meet in one task.
    """
    if approx:
        found = sketched(df if columns is None else df.select(*[F.col(f"`{c}`") for c in columns]), k)
        placed = found.select("ordinal", "column", "dtype", "kind", F.posexplode("top_values").alias("place", "t"))
        return placed.select("ordinal", "column", "dtype", "kind", "t.value", "t.count", (F.col("place") + 1).cast("bigint").alias("place"))
    order = Window.partitionBy("ordinal").orderBy(F.col("count").desc(), "value")
    best = (
        _of_columns(df, columns, freq)
        .where(F.col("value").isNotNull())
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k)
    )
    return named(best.withColumn("place", F.col("place").cast("bigint")), df)


def date_ranges(df: DataFrame, columns: Sequence[str] | None = None, freq: DataFrame | None = None) -> DataFrame:
    """First and last moment of the date columns, text dates parsed once per distinct value, with one pattern a column."""
    read = _of_columns(df, columns, freq).groupBy("ordinal").agg(best_reading(F.col("value"), F.col("count")).alias("r"))
    found = read.select("ordinal", "r.min_date", "r.max_date")
    return named(found.where(F.col("min_date").isNotNull()), df)


def columns_by_role(roles: DataFrame) -> DataFrame:
    """P08."""
    return roles.groupBy("role").agg(F.sort_array(F.collect_list("column")).alias("columns"))


def protected_attributes(roles: DataFrame, keywords: Sequence[str] = SENSITIVE_KEYWORDS) -> DataFrame:
    """Sensitive by name (substring match), or text with 2 to 20 distinct values."""
    by_name = F.lower("column").rlike("|".join(keywords))
    by_values = (F.col("kind") == "string") & F.col("unique_count").between(2, 20)
    return roles.where(by_name | by_values).select("ordinal", "column", by_name.alias("by_keyword"), "unique_count")


def recommended_metrics(roles: DataFrame) -> DataFrame:
    """P10."""
    return roles.where(F.col("role").isin(*NUMERIC_ROLES)).select("ordinal", "column", "role")


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows and extra copies. Equal rows are combined on the map side before the shuffle."""
    groups = nan_to_null(df).groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_copies"))
    return groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """(ordinal, row_count, null_count) from one aggregate without a shuffle of data."""
    df = nan_to_null(df)
    structs = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.count("*").alias("row_count"),
            F.count_if(F.col(f"`{c}`").isNull()).alias("null_count"),
        )
        for i, c in enumerate(df.columns)
    ]
    return df.agg(F.array(*structs).alias("facts")).select(F.explode("facts").alias("f")).select("f.*")


def table_quality(df: DataFrame) -> DataFrame:
    """Total nulls and duplicate rows with their shares of cells and rows."""
    width = len(df.columns)
    nulls = null_counts(df).select(F.sum("null_count")).scalar()
    return duplicate_count(df).select(
        "row_count",
        F.lit(width).cast("bigint").alias("column_count"),
        nulls.alias("total_nulls"),
        percent(nulls, F.col("row_count") * width).alias("null_pct"),
        "duplicate_rows",
        percent(F.col("duplicate_rows"), F.col("row_count")).alias("duplicate_pct"),
    )


def dtype_counts(df: DataFrame) -> DataFrame:
    """How many columns have each type, with the shape and quality of the table."""
    types = df.sparkSession.createDataFrame([(f.dataType.simpleString(),) for f in df.schema.fields], "dtype string")
    kinds = types.groupBy("dtype").agg(F.count("*").alias("columns_of_type"))
    quality = table_quality(df)
    return kinds.select("dtype", "columns_of_type", quality.select(F.struct("*")).scalar().alias("q")).select(
        "dtype", "columns_of_type", "q.*"
    )


def _exact_facts(df: DataFrame) -> DataFrame:
    """The facts of `sketched`, exact. The frequencies feed counts, top values and date ranges, so they are written once."""
    freq = materialise(frequencies(df), "frequencies")
    stats = numeric_statistics(df).select("ordinal", "min", "max", "mean", "median", "std")
    top = (
        top_values(df, freq=freq)
        .groupBy("ordinal")
        .agg(F.array_sort(F.collect_list(F.struct("place", "value", "count"))).alias("top"))
        .select("ordinal", F.transform("top", lambda t: F.struct(t["value"].alias("value"), t["count"].alias("count"))).alias("top_values"))
    )
    texts = [f.name for f in df.schema.fields if kind_of(f.dataType) in ("string", "datetime")]
    dates = date_ranges(df, texts, freq).select("ordinal", "min_date", "max_date")
    return column_counts(df, freq=freq).join(stats, "ordinal", "left").join(top, "ordinal", "left").join(dates, "ordinal", "left")


def profile(df: DataFrame, dataset_name: str, approx: bool = False) -> DataFrame:
    """One row per column with everything above; store it with `sources.stages.write_report`.

    With `approx` all comes from one aggregate: the rows are read once, no cell is exchanged and nothing is written.
    """
    roles = with_roles(sketched(df) if approx else _exact_facts(df))
    numeric, dated = F.col("role").isin(*NUMERIC_ROLES), F.col("role") == "datetime"
    protected = F.lower("column").rlike("|".join(SENSITIVE_KEYWORDS)) | (
        (F.col("kind") == "string") & F.col("unique_count").between(2, 20)
    )
    return roles.select(
        F.lit(dataset_name).alias("dataset_name"),
        "ordinal", "column", "dtype", "kind", "row_count", "null_count", "unique_count", "parse_rate", "role", "null_pct", "unique_pct",
        *[F.when(numeric, F.col(c)).alias(c) for c in ("min", "max", "mean", "median", "std")],
        F.when(F.col("role") == "categorical", F.col("top_values")).alias("top_values"),
        F.when(dated, F.col("min_date")).alias("min_date"),
        F.when(dated, F.col("max_date")).alias("max_date"),
        protected.alias("is_protected"),
        numeric.alias("is_recommended_metric"),
    )
