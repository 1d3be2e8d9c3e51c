"""Metadata of a table and the text that describes it to a question answerer (F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlore.functions.numeric import ratio
from orderlore.functions.text import allow_repeated_keys, first_label, has_any
from orderlore.operators.profile import (
    column_roles,
    date_ranges,
    frequencies,
    kind_of,
    numeric_statistics,
    numeric_summary,
    sketched,
    top_values,
    with_roles,
)
from orderlore.session import materialise

LOW_CARDINALITY = 50
SAMPLE_VALUES = 10
DIMENSION_LIMIT = 100
PAIR_LIMIT = 20
CONTEXT_COLUMNS, CONTEXT_VALUES, CONTEXT_PATTERNS = 5, 3, 5

# fixed values: name parts and the word a description gets for them
MONEY_NAMES = ["amount", "price", "cost", "profit", "revenue", "sales"]
COUNT_NAMES = ["quantity", "count", "qty"]
PLACE_NAMES = ["city", "state", "country", "region"]
AGGREGATIONS = ["SUM", "AVG", "COUNT", "MIN", "MAX"]


def parse_profile(profiles: DataFrame, text: str = "profile") -> DataFrame:
    """(name, description) of the columns of a stored JSON profile, which lists them as objects,
    as names, or as an object keyed by name."""
    allow_repeated_keys()
    rows = profiles.select(F.try_parse_json(text).alias("_j"))
    listed = F.try_variant_get("_j", "$.columns", "array<variant>")
    keyed = F.try_variant_get("_j", "$.columns", "map<string,variant>")
    get = lambda v, path: F.try_variant_get(v, path, "string")
    from_list = F.transform(
        listed,
        lambda v: F.struct(
            F.coalesce(get(v, "$.name"), F.when(F.schema_of_variant(v) == "STRING", get(v, "$"))).alias("name"),
            get(v, "$.description").alias("description"),
        ),
    )
    from_map = F.transform(
        F.map_entries(keyed),
        lambda e: F.struct(e["key"].alias("name"), get(e["value"], "$.description").alias("description")),
    )
    return rows.select(F.explode(F.coalesce(from_list, from_map)).alias("c")).select("c.*").where("name IS NOT NULL")


def description(name: Column, given: Column | None = None) -> Column:
    """the stored description, else one built from the name."""
    lower = F.lower(name)
    title = lambda c: F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    cut = F.when(F.endswith(name, F.lit("ID")), 2).otherwise(3)
    base = F.substring(name, F.lit(1), F.greatest(F.length(name) - cut, F.lit(0)))
    built = (
        F.when(F.endswith(lower, F.lit("id")), F.concat(title(base), F.lit(" Identifier")))
        .when(has_any(lower, ["date", "time"]), F.concat(title(name), F.lit(" Timestamp")))
        .when(has_any(lower, MONEY_NAMES), F.concat(title(name), F.lit(" Amount")))
        .when(has_any(lower, COUNT_NAMES), F.concat(title(name), F.lit(" Count")))
        .when(has_any(lower, PLACE_NAMES), F.concat(title(name), F.lit(" Location")))
        .otherwise(title(name))
    )
    if given is None:
        return built
    return F.coalesce(F.when((given != "") & (given != name), given), built)


def data_class() -> Column:
    return (
        F.when(F.col("kind").isin("integral", "fractional"), "numeric")
        .when(F.col("kind") == "datetime", "datetime")
        .otherwise("categorical")
    )


def low_cardinality() -> Column:
    """F04."""
    return (F.col("kind") == "string") | (F.col("unique_count") < LOW_CARDINALITY)


def primary_key() -> Column:
    """F07."""
    name = F.lower("column")
    named = F.endswith(name, F.lit("_id")) | name.isin("id", "row_id")
    return named & (F.col("unique_count") == F.col("row_count")) & (F.col("null_count") == 0)


def foreign_key() -> Column:
    """F08."""
    name = F.lower("column")
    named = F.endswith(name, F.lit("_id")) & (name != "row_id") & ~primary_key()
    return named & F.coalesce(ratio(F.col("unique_count"), F.col("row_count")) < 0.9, F.lit(False))


def cardinality_band() -> Column:
    """F09."""
    share = F.coalesce(ratio(F.col("unique_count"), F.col("row_count")), F.lit(0.0))
    return first_label(
        {"high": share > 0.95, "medium-high": share > 0.5, "medium": share > 0.1, "low": share > 0.01}, "very-low"
    )


def column_facts(df: DataFrame, approx: bool = False, freq: DataFrame | None = None, descriptions: DataFrame | None = None) -> DataFrame:
    """One row per column. `descriptions` (name, description), as `parse_profile` reads them from a stored
    profile, come before what is built from the names; of several for one name the first in order counts."""
    return described(column_roles(df, approx, freq), descriptions)


def described(roles: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """The columns of `column_facts` from roles."""
    if descriptions is None:
        roles = roles.withColumn("_given", F.lit(None).cast("string"))
    else:
        given = descriptions.groupBy("name").agg(F.min("description").alias("_given"))
        roles = roles.join(given, roles["column"] == given["name"], "left").drop("name")
    return roles.select(
        "ordinal",
        "column",
        "dtype",
        "kind",
        "row_count",
        "null_count",
        "null_pct",
        "unique_count",
        data_class().alias("data_class"),
        description(F.col("column"), F.col("_given")).alias("description"),
        low_cardinality().alias("is_low_cardinality"),
        primary_key().alias("is_primary_key"),
        foreign_key().alias("is_foreign_key"),
        cardinality_band().alias("cardinality"),
    )


def column_ranges(df: DataFrame) -> DataFrame:
    """smallest and largest value of numeric and datetime columns, as text."""
    numbers = numeric_summary(df).select(
        "ordinal", F.col("min").cast("string").alias("range_min"), F.col("max").cast("string").alias("range_max")
    )
    moments = [f.name for f in df.schema.fields if kind_of(f.dataType) == "datetime"]
    if not moments:
        return numbers
    dates = date_ranges(df, moments).select(
        "ordinal", F.col("min_date").cast("string").alias("range_min"), F.col("max_date").cast("string").alias("range_max")
    )
    return numbers.unionByName(dates)


def sample_values(
    df: DataFrame, facts: DataFrame, k: int = SAMPLE_VALUES, freq: DataFrame | None = None
) -> DataFrame:
    """the commonest values of the low-cardinality columns."""
    wanted = facts.where("is_low_cardinality").select("ordinal")
    return top_values(df, k, freq=freq).join(wanted, "ordinal").select("ordinal", "column", "value", "count", "place")


def statistics(df: DataFrame) -> DataFrame:
    """numeric statistics with quartiles; columns without a value have none."""
    return (
        numeric_statistics(df)
        .where(F.col("present") > 0)
        .select("ordinal", "column", "min", "max", "mean", "median", "std", "q25", "q75")
    )


def column_lists(facts: DataFrame) -> DataFrame:
    """one row with the date, numeric and categorical columns in table order."""
    listed = lambda cond: F.transform(
        F.array_sort(F.collect_list(F.when(cond, F.struct("ordinal", "column")))), lambda s: s["column"]
    )
    return facts.agg(
        listed(F.col("kind") == "datetime").alias("date_columns"),
        listed(F.col("data_class") == "numeric").alias("numeric_columns"),
        listed(F.col("is_low_cardinality")).alias("categorical_columns"),
    )


def relationships(facts: DataFrame, limit: int = PAIR_LIMIT) -> DataFrame:
    """the first `limit` pairs of a dimension with at most 100 values and a measure, in table order.

    Only the first `limit` dimensions and measures can take part in them, so the pairs are built from
    two lists of that length.
    """
    plain = facts.where(~F.endswith(F.lower("column"), F.lit("_id")))
    dimensions = (
        plain.where(F.col("is_low_cardinality") & (F.col("unique_count") <= DIMENSION_LIMIT)).orderBy("ordinal").limit(limit)
    )
    measures = plain.where(F.col("data_class") == "numeric").orderBy("ordinal").limit(limit)
    array = measures.agg(F.array_sort(F.collect_list(F.struct("ordinal", "column"))).alias("m")).scalar()
    pairs = dimensions.select("ordinal", "column", F.explode(array).alias("m"))
    order = F.row_number().over(Window.orderBy("ordinal", "m.ordinal"))
    return (
        pairs.select(order.cast("bigint").alias("place"), F.col("column").alias("dimension"), F.col("m.column").alias("measure"))
        .where(F.col("place") <= limit)
        .withColumn("suggested_aggregations", F.array(*map(F.lit, AGGREGATIONS)))
    )


def _sketched_parts(df: DataFrame, descriptions: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, sample values and statistics from one pass; its result, a row for each column, goes through the driver."""
    found = sketched(df, SAMPLE_VALUES)
    local = df.sparkSession.createDataFrame(found.collect(), found.schema)
    facts = described(with_roles(local), descriptions)
    samples = local.join(facts.where("is_low_cardinality").select("ordinal"), "ordinal").select("ordinal", "column", F.posexplode("top_values").alias("place", "t"))
    samples = samples.select("ordinal", "column", "t.value", "t.count", (F.col("place") + 1).cast("bigint").alias("place"))
    numbers = local.where(F.col("kind").isin("integral", "fractional") & (F.col("present") > 0))
    return facts, samples, numbers.select("ordinal", "column", "min", "max", "mean", "median", "std", "q25", "q75")


def metadata(df: DataFrame, dataset_name: str, approx: bool = False, descriptions: DataFrame | None = None) -> DataFrame:
    """one row with every part; frequencies and column facts are computed once and written.

    With `approx` they come from sketches: one pass over the rows, no exchange of cells, nothing written.
    """
    if approx:
        facts, samples, stats = _sketched_parts(df, descriptions)
    else:
        freq = materialise(frequencies(df), "frequencies")
        facts = materialise(column_facts(df, freq=freq, descriptions=descriptions), "column-facts")
        samples, stats = sample_values(df, facts, freq=freq), statistics(df)
    ordered = lambda frame, *cols: frame.agg(
        F.array_sort(F.collect_list(F.struct(*cols))).alias("a")
    ).scalar()
    return facts.agg(F.max("row_count").alias("row_count"), F.count("*").alias("column_count")).select(
        F.lit(dataset_name).alias("table_name"),
        "row_count",
        "column_count",
        ordered(facts, "ordinal", "column", "dtype", "description", "unique_count", "null_count", "null_pct",
                "data_class", "is_primary_key", "is_foreign_key", "cardinality").alias("columns"),
        ordered(samples, "ordinal", "place", "column", "value", "count").alias("sample_values"),
        ordered(stats, "ordinal", "column", "min", "max", "mean", "median", "std", "q25", "q75").alias("statistics"),
        ordered(relationships(facts), "place", "dimension", "measure").alias("relationships"),
        column_lists(facts).select(F.struct("*")).scalar().alias("lists"),
    )


def context(meta: DataFrame) -> DataFrame:
    """the text block that goes into a prompt."""
    head = F.array(
        F.concat(F.lit("Dataset: "), F.col("table_name")),
        F.concat(F.lit("Description: Business data table with "), F.format_number("row_count", 0), F.lit(" records")),
        F.concat(F.lit("Total Records: "), F.format_number("row_count", 0)),
        F.concat(F.lit("Total Columns: "), F.col("column_count").cast("string")),
        F.lit("\nColumn Definitions:"),
    )
    columns = F.transform(
        "columns",
        lambda c: F.concat(
            F.lit("\n- "), c["column"], F.lit(": "), c["description"], F.lit(" ("), c["data_class"], F.lit(", "),
            c["unique_count"].cast("string"), F.lit(" unique values)"),
        ),
    )
    sampled = F.slice(F.array_distinct(F.transform("sample_values", lambda s: s["column"])), 1, CONTEXT_COLUMNS)
    shown = lambda name: F.transform(
        F.filter("sample_values", lambda s: (s["column"] == name) & (s["place"] <= CONTEXT_VALUES)),
        lambda s: F.concat(s["value"], F.lit(" ("), s["count"].cast("string"), F.lit(")")),
    )
    samples = F.transform(sampled, lambda n: F.concat(F.lit("\n- "), n, F.lit(": "), F.array_join(shown(n), ", ")))
    patterns = F.transform(
        F.slice("relationships", 1, CONTEXT_PATTERNS),
        lambda r: F.concat(F.lit("\n- Analyze "), r["measure"], F.lit(" by "), r["dimension"]),
    )
    block = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.array(F.lit(title)), lines)).otherwise(
        F.array().cast("array<string>")
    )
    parts = F.concat(
        head,
        columns,
        block("\n\nKey Categories and Sample Values:", samples),
        block("\n\nCommon Analysis Patterns:", patterns),
    )
    return meta.select(F.col("table_name").alias("dataset_name"), F.array_join(parts, "\n").alias("llm_context"))


def feature_summary(facts: DataFrame, dataset_name: str) -> DataFrame:
    """F14."""
    pairs = relationships(facts).select(F.count(F.lit(1))).scalar()
    return facts.agg(
        F.max("row_count").alias("total_rows"),
        F.count("*").alias("total_columns"),
        F.count_if(F.col("data_class") == "numeric").alias("numeric_columns"),
        F.count_if("is_low_cardinality").alias("categorical_columns"),
        F.count_if(F.col("kind") == "datetime").alias("date_columns"),
        F.count_if("is_primary_key").alias("primary_keys"),
        F.count_if("is_foreign_key").alias("foreign_keys"),
    ).select(F.lit(dataset_name).alias("dataset"), "*", pairs.alias("relationships_found"))
