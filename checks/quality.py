"""Registered queries for profiling, validation, cleaning and group bias, over the dirty orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlore.operators import clean, fairness, profile, validate
from orderlore.plans.pipelines import dataset_summary
from orderlore.plans.test_views import DIRTY_SQL, dirty_orders

COLUMNS = {
    "order_id": "integral",
    "customer_id": "integral",
    "segment": "string",
    "priority": "string",
    "region": "string",
    "order_date": "string",
    "total": "fractional",
    "balance": "fractional",
    "item_count": "integral",
    "points": "integral",
    "remark": "string",
    "channel": "string",
    "gift": "boolean",
}
ROLES = {
    "order_id": "identifier",
    "customer_id": "continuous_numeric",
    "segment": "categorical",
    "priority": "categorical",
    "region": "categorical",
    "order_date": "datetime",
    "total": "continuous_numeric",
    "balance": "continuous_numeric",
    "item_count": "categorical",
    "points": "discrete_numeric",
    "remark": "text",
    "channel": "categorical",
    "gift": "boolean",
}
NUMBERS = [c for c, k in COLUMNS.items() if k in ("integral", "fractional")]
ATTRIBUTES = ["segment", "priority", "region"]
METRICS = ["customer_id", "total", "balance", "points"]
TESTS = len(ATTRIBUTES) * len(METRICS)
MESSY = [
    "Order ID", "Customer-ID", " Segment ", "Priority!", "Region", "Order  Date", "Total ($)", "Balance", "Item Count",
    "Points", "points", "Channel", "Gift?",
]


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _numeric_text(df: DataFrame) -> DataFrame:
    text = F.when(F.col("points") % 50 == 0, "n/a").otherwise(F.col("total").cast("string"))
    return df.select("order_id", text.alias("amount"))


def _gappy_points(df: DataFrame) -> DataFrame:
    return df.select("order_id", F.when(F.col("order_id") % 13 != 0, F.col("points")).alias("points"))


def _as_text(df: DataFrame, column: str = "order_date") -> DataFrame:
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd"))


def _day_first(df: DataFrame) -> DataFrame:
    """The order dates as an export with the day in front has them."""
    return df.withColumn("order_date", F.date_format(F.to_date("order_date"), "d/M/yyyy"))


def _summary(df: DataFrame) -> DataFrame:
    return clean.summary(df, clean.clean(df, ROLES))


def _run_summary(df: DataFrame) -> DataFrame:
    row = dataset_summary(df, clean.clean(df, ROLES), "dirty_orders", ATTRIBUTES, METRICS)
    return row.select(
        "dataset_name", "rows", "columns", "validation.overall_valid", "cleaning.final_rows", "cleaning.final_columns",
        "bias.total_tests", "bias.bias_flags",
    )


OPERATORS = {
    "P01": lambda d: profile.column_roles(d).select("column", "role"),
    "P02": lambda d: profile.column_roles(d).where("dtype = 'boolean'").select("column", "role", "unique_count"),
    "P03": lambda d: _rounded(
        profile.column_counts(d).where("kind = 'string'").select("column", "parse_rate"), 8, "parse_rate"
    ),
    "P04": lambda d: _rounded(
        profile.column_roles(d).select("column", "null_count", "null_pct", "unique_count", "unique_pct"),
        8, "null_pct", "unique_pct",
    ),
    "P05": lambda d: _rounded(
        profile.numeric_statistics(d).select("column", "min", "max", "mean", "median", "std"), 4, "mean", "median", "std"
    ),
    "P06": lambda d: profile.top_values(d, 5).select("column", "value", "count", "place"),
    "P06.sketch": lambda d: profile.top_values(d, 5, ["segment", "priority", "region", "item_count", "channel"], approx=True).select(
        "column", "value", "count", "place"
    ),
    "P12.sketch": lambda d: profile.profile(d, "dirty_orders", approx=True).select(
        "column", "role", "null_count", "min", "max",
        F.array_join(F.transform("top_values", lambda t: F.concat_ws("=", t["value"], t["count"])), ";").alias("top_values"),
        F.date_format("min_date", "yyyy-MM-dd").alias("min_date"), F.date_format("max_date", "yyyy-MM-dd").alias("max_date"),
    ),
    "P07": lambda d: profile.date_ranges(d, ["order_date"]).select(
        "column",
        F.date_format("min_date", "yyyy-MM-dd").alias("min_date"),
        F.date_format("max_date", "yyyy-MM-dd").alias("max_date"),
    ),
    "P08": lambda d: profile.columns_by_role(profile.column_roles(d)).select(
        "role", F.array_join("columns", ",").alias("columns")
    ),
    "P09": lambda d: profile.protected_attributes(profile.column_roles(d)).select("column", "by_keyword", "unique_count"),
    "P10": lambda d: profile.recommended_metrics(profile.column_roles(d)).select("column", "role"),
    "P11": lambda d: _rounded(profile.table_quality(d), 8, "null_pct", "duplicate_pct"),
    "P12": lambda d: _rounded(
        profile.profile(d, "dirty_orders").select(
            "dataset_name", "column", "role", "null_count", "unique_count", "min", "max", "mean", "median", "std",
            F.array_join(F.transform("top_values", lambda t: F.concat_ws("=", t["value"], t["count"])), ";").alias("top_values"),
            F.date_format("min_date", "yyyy-MM-dd").alias("min_date"),
            F.date_format("max_date", "yyyy-MM-dd").alias("max_date"),
            "is_protected", "is_recommended_metric",
        ),
        4, "mean", "median", "std",
    ),
    "P14": lambda d: _rounded(profile.dtype_counts(d), 8, "null_pct", "duplicate_pct"),
    "V01": validate.structure,
    "V02": lambda d: _rounded(validate.null_shares(d), 8, "null_share"),
    "V02.table": lambda d: _rounded(validate.nulls(d), 8, "null_pct_overall"),
    "V03": lambda d: _rounded(validate.duplicates(d), 8, "duplicate_share"),
    "V04": lambda d: _rounded(validate.anomalies(d, NUMBERS), 6, "outlier_pct", "lower_bound", "upper_bound"),
    "V05": validate.verdict,
    "V06": lambda d: validate.anomaly_flags(d, NUMBERS).select(
        "order_id", *[f"{c}_anomaly" for c in NUMBERS], "is_anomaly"
    ),
    "C01": lambda d: clean.normalize_column_names(d.toDF(*MESSY)),
    "C02.day_first": lambda d: _as_text(clean.standardize_types(_day_first(d), ROLES).select("order_id", "order_date")),
    "P07.day_first": lambda d: profile.date_ranges(_day_first(d), ["order_date"]).select(
        "column", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("min_date", "max_date")]
    ),
    "C02": lambda d: _as_text(clean.standardize_types(d, ROLES).select("order_id", "order_date")),
    "C03": lambda d: clean.standardize_types(_numeric_text(d), {"amount": "continuous_numeric"}),
    "C04": lambda d: profile.column_roles(clean.standardize_types(d, ROLES))
    .where("role = 'categorical'")
    .select("column", "unique_count"),
    "C05": lambda d: clean.standardize_types(d, {"segment": "text"}).select("order_id", "segment"),
    "C06": lambda d: clean.drop_missing_identifiers(d, {"customer_id": "identifier"}).select("order_id", "customer_id"),
    "C07": lambda d: clean.fill_missing(d.select("order_id", "segment", "priority", "region", "item_count", "channel"), ROLES),
    "C08": lambda d: clean.fill_missing(d.select("order_id", "customer_id", "balance", "total"), ROLES),
    "C09": lambda d: clean.fill_missing(_gappy_points(d), ROLES),
    "C10": clean.remove_duplicates,
    "C11": lambda d: _rounded(clean.cap_outliers(d.select("order_id", *METRICS), ROLES), 6, *METRICS),
    "C11.report": lambda d: _rounded(
        clean.outlier_report(d, ROLES), 6, "outlier_pct", "lower_bound", "upper_bound"
    ),
    "C12": lambda d: _rounded(
        clean.cap_outliers(d.select("order_id", *METRICS), ROLES, "zscore"), 4, *METRICS
    ),
    "C14": lambda d: clean.constant_columns(d),
    "C15": lambda d: _rounded(_summary(d), 8, "rows_retained_pct", "data_quality_score"),
    "C16": lambda d: _rounded(clean.quality(d), 8, "null_pct", "duplicate_pct", "completeness_score"),
    "C17": lambda d: _rounded(_as_text(clean.clean(d, ROLES)), 6, "total", "balance", "points", "customer_id"),
    "C17.detected": lambda d: _rounded(_as_text(clean.clean(d)), 6, "total", "balance", "points", "customer_id"),
    "C18": lambda d: _rounded(clean.high_null_alert(clean.quality(d)), 8, "null_pct"),
    "B01": lambda d: profile.column_roles(d.select(*fairness.choose_attributes(d))).select("column", "unique_count"),
    "B02": lambda d: fairness.unprofiled_metrics(d),
    "B03": lambda d: fairness.group_statistics(d, ATTRIBUTES, METRICS),
    "B04": lambda d: _rounded(
        fairness.anova(fairness.group_facts(d, ATTRIBUTES, METRICS), "omit").select(
            "attribute", "metric", "groups", "df_between", "df_within", "f_statistic"
        ),
        6, "f_statistic",
    ),
    "B05": lambda d: _rounded(
        fairness.disparate_impact(fairness.group_facts(d, ATTRIBUTES, METRICS)),
        6, "ratio", "privileged_mean", "underprivileged_mean",
    ),
    "B06": lambda d: _rounded(
        fairness.variation(fairness.group_facts(d, ATTRIBUTES, METRICS)), 8, "mean_cv", "max_cv", "min_cv"
    ),
    "B07": lambda d: _rounded(fairness.representation(d, ATTRIBUTES), 8, "percentage"),
    "B08": lambda d: _rounded(
        fairness.sweep(d, ATTRIBUTES, METRICS, "omit").select("attribute", "metric", "groups", "f_statistic", "ratio", "mean_cv"),
        6, "f_statistic", "ratio", "mean_cv",
    ),
    "B09": lambda d: _rounded(
        fairness.summarise(d, ATTRIBUTES, METRICS).select("status", "total_tests", "bias_flags", "bias_flag_pct"),
        8, "bias_flag_pct",
    ),
    "B10": lambda d: fairness.summarise(d, ATTRIBUTES, METRICS).select("bias_flags", "overall_assessment"),
    "B11": lambda d: fairness.summarise(d, ATTRIBUTES, METRICS).select(
        "bias_flags", F.explode("recommendations").alias("recommendation")
    ),
    "X20.dataset": _run_summary,
}


def queries() -> dict:
    return {k: (lambda spark, sf_dir, run=run: run(dirty_orders(spark, sf_dir))) for k, run in OPERATORS.items()}


# --- reference SQL ---------------------------------------------------------------------------------

_STRING_DATES = (
    "%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%d-%m-%Y", "%Y/%m/%d"
)


def _union(template, columns) -> str:
    return " UNION ALL ".join(template(c) for c in columns)


def _parse_rate(c: str) -> str:
    tries = [f"count(try_strptime({c}, '{p}'))" for p in _STRING_DATES] + [f"count(TRY_CAST({c} AS TIMESTAMP))"]
    return f"greatest({', '.join(tries)}) / count({c})"


def _counts(c: str) -> str:
    rate = _parse_rate(c) if COLUMNS[c] == "string" else "0.0"
    return (
        f"SELECT '{c}' AS \"column\", '{COLUMNS[c]}' AS kind, count(*) AS row_count, count(*) - count({c}) AS null_count, "
        f"count(DISTINCT {c}) AS unique_count, {rate} AS parse_rate FROM dirty"
    )


def _stats(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
        f"round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std FROM dirty"
    )


def _top(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", value, count, place FROM (SELECT value, count, row_number() OVER "
        f"(ORDER BY count DESC, value) AS place FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS count FROM dirty "
        f"WHERE {c} IS NOT NULL GROUP BY 1)) WHERE place <= 5"
    )


_DIRTY = f"WITH dirty AS ({DIRTY_SQL}), counts AS ({_union(_counts, COLUMNS)}), roles AS (SELECT *, CASE " + """
 WHEN null_count = row_count THEN 'unknown' WHEN kind = 'boolean' THEN 'boolean'
 WHEN kind = 'string' AND parse_rate > 0.8 THEN 'datetime'
 WHEN kind <> 'string' AND unique_count / (row_count - null_count) > 0.95 THEN 'identifier'
 WHEN kind = 'integral' AND null_count = 0 AND unique_count < 20 THEN 'categorical'
 WHEN kind = 'fractional' OR (kind = 'integral' AND null_count > 0) THEN 'continuous_numeric'
 WHEN kind = 'integral' THEN 'discrete_numeric'
 WHEN unique_count / (row_count - null_count) < 0.5 THEN 'categorical' ELSE 'text' END AS role FROM counts)
"""
_STATS = f"({_union(_stats, NUMBERS)})"
_TOP = f"({_union(_top, [c for c in COLUMNS if c != 'gift'])})"
_DATES = (
    "(SELECT 'order_date' AS \"column\", strftime(min(CAST(order_date AS TIMESTAMP)), '%Y-%m-%d') AS min_date, "
    "strftime(max(CAST(order_date AS TIMESTAMP)), '%Y-%m-%d') AS max_date FROM dirty)"
)
_KEYWORD = "regexp_matches(\"column\", 'gender|age|race|ethnicity|religion|disability|segment|region|income|education')"
_PROTECTED = f"({_KEYWORD} OR (kind = 'string' AND unique_count BETWEEN 2 AND 20))"
_METRIC = "role IN ('continuous_numeric', 'discrete_numeric')"
_QUALITY = """(SELECT row_count, CAST(13 AS BIGINT) AS column_count, CAST(total_nulls AS BIGINT) AS total_nulls,
 total_nulls / (row_count * 13) * 100 AS null_pct, row_count - distinct_rows AS duplicate_rows,
 (row_count - distinct_rows) / row_count * 100 AS duplicate_pct
 FROM (SELECT count(*) AS row_count FROM dirty), (SELECT sum(null_count) AS total_nulls FROM counts),
 (SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT * FROM dirty)))"""


def _bounds(c: str, source: str = "dirty") -> str:
    return (
        f"(SELECT q[1] - 3 * (q[2] - q[1]) AS lo, q[2] + 3 * (q[2] - q[1]) AS hi FROM "
        f"(SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM {source}))"
    )


def _anomaly(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} < lo OR {c} > hi) AS outlier_count, "
        f"round(count(*) FILTER ({c} < lo OR {c} > hi) / count(*) * 100, 6) AS outlier_pct, round(any_value(lo), 6) AS lower_bound, "
        f"round(any_value(hi), 6) AS upper_bound, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value "
        f"FROM dirty, {_bounds(c)} HAVING count(*) FILTER ({c} < lo OR {c} > hi) > 0"
    )


def _cap(c: str, bounds: str) -> str:
    return (
        f"CASE WHEN {c} < (SELECT lo FROM {bounds}) THEN (SELECT lo FROM {bounds}) "
        f"WHEN {c} > (SELECT hi FROM {bounds}) THEN (SELECT hi FROM {bounds}) ELSE CAST({c} AS DOUBLE) END"
    )


def _mode(c: str, source: str = "dirty") -> str:
    return f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def _median(c: str) -> str:
    return f"(SELECT quantile_cont({c}, 0.5) FROM dirty)"


def _zscore(c: str) -> str:
    return f"(SELECT avg({c}) - 3 * stddev_samp({c}) AS lo, avg({c}) + 3 * stddev_samp({c}) AS hi FROM dirty)"


_FILLED = f"""SELECT DISTINCT order_id, coalesce(CAST(customer_id AS DOUBLE), {_median('customer_id')}) AS customer_id,
 coalesce(segment, {_mode('segment')}) AS segment, priority, region, order_date, total,
 coalesce(balance, {_median('balance')}) AS balance, item_count, points, trim(remark) AS remark, channel, gift FROM dirty"""

_FACTS = "facts AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, {a} AS \"group\", '{m}' AS metric, count(*) AS rows, count({m}) AS count, avg({m}) AS mean, "
    f"stddev_samp({m}) AS std, var_samp({m}) AS var, CAST(min({m}) AS DOUBLE) AS min, CAST(max({m}) AS DOUBLE) AS max, "
    f"quantile_cont({m}, 0.5) AS median FROM dirty WHERE {a} IS NOT NULL GROUP BY {a}"
    for a in ATTRIBUTES
    for m in METRICS
) + ")"
_BIAS = _DIRTY + ", " + _FACTS
_ANOVA = """(SELECT attribute, metric, count(*) AS groups, count(*) - 1 AS df_between, CAST(sum(count) - count(*) AS BIGINT) AS df_within,
 round((sum(count * (mean - grand) * (mean - grand)) / (count(*) - 1)) / (sum((count - 1) * var) / (sum(count) - count(*))), 6) AS f_statistic
 FROM (SELECT *, sum(count * mean) OVER w / sum(count) OVER w AS grand FROM facts WHERE rows > 1 WINDOW w AS (PARTITION BY attribute, metric))
 GROUP BY ALL)"""
_IMPACT = """(SELECT attribute, metric, round(CASE WHEN max(mean) > 0 THEN min(mean) / max(mean) ELSE 0 END, 6) AS ratio,
 CASE WHEN max(mean) > 0 THEN min(mean) / max(mean) ELSE 0 END >= 0.8 AS passes_80_percent_rule,
 first("group" ORDER BY mean DESC, "group") AS privileged_group, first("group" ORDER BY mean, "group") AS underprivileged_group,
 round(max(mean), 6) AS privileged_mean, round(min(mean), 6) AS underprivileged_mean FROM facts GROUP BY ALL)"""
_VARIATION = """(SELECT attribute, metric, round(avg(std / mean), 8) AS mean_cv, round(max(std / mean), 8) AS max_cv,
 round(min(std / mean), 8) AS min_cv FROM facts GROUP BY ALL)"""
_REPRESENTATION = "(" + " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, {a} AS \"group\", count(*) AS count, count(*) / (SELECT count(*) FROM dirty) * 100 AS percentage "
    f"FROM dirty WHERE {a} IS NOT NULL GROUP BY {a}"
    for a in ATTRIBUTES
) + ")"
_FLAGS = f"""(SELECT (SELECT count(DISTINCT attribute) FROM {_REPRESENTATION} WHERE percentage < 10)
 + (SELECT count(*) FROM {_IMPACT} WHERE NOT passes_80_percent_rule) AS bias_flags)"""

_ADVICE = "SELECT bias_flags, unnest(CASE WHEN bias_flags = 0 THEN [{clear}] ELSE [{flagged}] END) AS recommendation FROM {flags}".format(
    clear=", ".join(f"'{a}'" for a in fairness.ADVICE_CLEAR),
    flagged=", ".join(f"'{a}'" for a in fairness.ADVICE_FLAGGED),
    flags=_FLAGS,
)
_TYPES = {
    "order_id": "bigint", "customer_id": "bigint", "segment": "string", "priority": "string", "region": "string",
    "order_date": "string", "total": "double", "balance": "double", "item_count": "int", "points": "bigint",
    "remark": "string", "channel": "string", "gift": "boolean",
}
_CLEAN_NAMES = [
    "order_id", "customer_id", "segment", "priority", "region", "order_date", "total", "balance", "item_count",
    "points", "points_1", "channel", "gift",
]

_SQL = {
    "P01": 'SELECT "column", role FROM roles',
    "P02": "SELECT \"column\", role, unique_count FROM roles WHERE kind = 'boolean'",
    "P03": "SELECT \"column\", round(parse_rate, 8) AS parse_rate FROM counts WHERE kind = 'string'",
    "P04": 'SELECT "column", null_count, round(null_count / row_count * 100, 8) AS null_pct, unique_count, '
    "round(unique_count / row_count * 100, 8) AS unique_pct FROM counts",
    "P05": f"SELECT * FROM {_STATS}",
    "P06": _union(_top, COLUMNS),
    "P06.sketch": _union(_top, ["segment", "priority", "region", "item_count", "channel"]),
    "P12.sketch": f"""SELECT "column", role, null_count, CASE WHEN {_METRIC} THEN min END AS min, CASE WHEN {_METRIC} THEN max END AS max,
 CASE WHEN role = 'categorical' THEN tops END AS top_values, min_date, max_date
 FROM roles LEFT JOIN {_STATS} USING ("column")
 LEFT JOIN (SELECT "column", string_agg(value || '=' || count, ';' ORDER BY place) AS tops FROM {_TOP} GROUP BY 1) USING ("column")
 LEFT JOIN {_DATES} USING ("column")""",
    "P07": f"SELECT * FROM {_DATES}",
    "P07.day_first": f"SELECT * FROM {_DATES}",
    "P08": "SELECT role, string_agg(\"column\", ',' ORDER BY \"column\") AS columns FROM roles GROUP BY role",
    "P09": f'SELECT "column", {_KEYWORD} AS by_keyword, unique_count FROM roles WHERE {_PROTECTED}',
    "P10": f'SELECT "column", role FROM roles WHERE {_METRIC}',
    "P11": f"SELECT * REPLACE (round(null_pct, 8) AS null_pct, round(duplicate_pct, 8) AS duplicate_pct) FROM {_QUALITY}",
    "P12": f"""SELECT 'dirty_orders' AS dataset_name, "column", role, null_count, unique_count,
 CASE WHEN {_METRIC} THEN min END AS min, CASE WHEN {_METRIC} THEN max END AS max, CASE WHEN {_METRIC} THEN mean END AS mean,
 CASE WHEN {_METRIC} THEN median END AS median, CASE WHEN {_METRIC} THEN std END AS std,
 CASE WHEN role = 'categorical' THEN tops END AS top_values, min_date, max_date,
 {_PROTECTED} AS is_protected, {_METRIC} AS is_recommended_metric
 FROM roles LEFT JOIN {_STATS} USING ("column")
 LEFT JOIN (SELECT "column", string_agg(value || '=' || count, ';' ORDER BY place) AS tops FROM {_TOP} GROUP BY 1) USING ("column")
 LEFT JOIN {_DATES} USING ("column")""",
    "P14": "SELECT dtype, columns_of_type, row_count, column_count, total_nulls, round(null_pct, 8) AS null_pct, duplicate_rows, "
    "round(duplicate_pct, 8) AS duplicate_pct FROM (VALUES "
    + ", ".join(f"('{t}', CAST({list(_TYPES.values()).count(t)} AS BIGINT))" for t in dict.fromkeys(_TYPES.values()))
    + f") t(dtype, columns_of_type), {_QUALITY}",
    "V01": "SELECT count(*) AS actual_rows, CAST(13 AS BIGINT) AS actual_columns, count(*) >= 10 AS valid FROM dirty",
    "V02": 'SELECT "column", null_count, round(null_count / row_count, 8) AS null_share, null_count / row_count > 0.15 AS exceeds FROM counts',
    "V02.table": "SELECT CAST(sum(null_count) AS BIGINT) AS total_null_cells, round(sum(null_count) / sum(row_count) * 100, 8) AS null_pct_overall, "
    "count(*) FILTER (null_count / row_count > 0.15) AS columns_exceeding, count(*) FILTER (null_count / row_count > 0.15) = 0 AS valid FROM counts",
    "V03": f"SELECT duplicate_rows AS duplicate_count, round(duplicate_rows / row_count, 8) AS duplicate_share, "
    f"duplicate_rows / row_count <= 0.05 AS valid FROM {_QUALITY}",
    "V04": _union(_anomaly, NUMBERS),
    "V05": f"SELECT s AND n AND d AS overall_valid, s AS structure_valid, n AS nulls_valid, d AS duplicates_valid FROM "
    f"(SELECT row_count >= 10 AS s, duplicate_rows / row_count <= 0.05 AS d, "
    f"(SELECT count(*) FILTER (null_count / row_count > 0.15) = 0 FROM counts) AS n FROM {_QUALITY})",
    "V06": "SELECT order_id, " + ", ".join(f"{c[0]} AS {c}_anomaly" for c in NUMBERS) + ", " + " OR ".join(c[0] for c in NUMBERS)
    + " AS is_anomaly FROM (SELECT order_id, " + ", ".join(
        f"coalesce({c} < (SELECT lo FROM {_bounds(c)}) OR {c} > (SELECT hi FROM {_bounds(c)}), false) AS {c[0]}" for c in NUMBERS
    )
    + " FROM dirty)",
    "C01": "SELECT " + ", ".join(f"{old} AS {new}" for old, new in zip(COLUMNS, _CLEAN_NAMES)) + " FROM dirty",
    "C02": "SELECT order_id, order_date FROM dirty",
    "C02.day_first": "SELECT order_id, order_date FROM dirty",
    "C03": "SELECT order_id, CASE WHEN points % 50 <> 0 THEN total END AS amount FROM dirty",
    "C04": "SELECT \"column\", unique_count FROM roles WHERE role = 'categorical'",
    "C05": "SELECT order_id, trim(segment) AS segment FROM dirty",
    "C06": "SELECT order_id, customer_id FROM dirty WHERE customer_id IS NOT NULL",
    "C07": f"SELECT order_id, coalesce(segment, {_mode('segment')}) AS segment, priority, region, item_count, channel FROM dirty",
    "C08": f"SELECT order_id, coalesce(CAST(customer_id AS DOUBLE), {_median('customer_id')}) AS customer_id, "
    f"coalesce(balance, {_median('balance')}) AS balance, total FROM dirty",
    "C09": "SELECT order_id, CASE WHEN order_id % 13 <> 0 THEN points ELSE "
    + _mode("points", "(SELECT * FROM dirty WHERE order_id % 13 <> 0)")
    + " END AS points FROM dirty",
    "C10": "SELECT DISTINCT * FROM dirty",
    "C11": "SELECT order_id, " + ", ".join(f"round({_cap(c, _bounds(c))}, 6) AS {c}" for c in METRICS) + " FROM dirty",
    "C11.report": f"SELECT \"column\", outlier_count, outlier_pct, lower_bound, upper_bound FROM ({_union(_anomaly, ['customer_id', 'total', 'balance', 'points'])})",
    "C12": "SELECT order_id, " + ", ".join(f"round({_cap(c, _zscore(c))}, 4) AS {c}" for c in METRICS) + " FROM dirty",
    "C14": _union(
        lambda c: f"SELECT '{c}' AS \"column\", count({c}) = 0 AS all_missing FROM dirty HAVING count(DISTINCT {c}) <= 1", COLUMNS
    ),
    "C15": """SELECT a AS initial_rows, CAST(13 AS BIGINT) AS initial_columns, b AS final_rows, 13 - k AS final_columns, a - b AS rows_removed,
 k AS columns_removed, round(b / a * 100, 8) AS rows_retained_pct, round(b / a * 100, 8) AS data_quality_score
 FROM (SELECT count(*) AS a FROM dirty), (SELECT count(*) AS b FROM (SELECT DISTINCT * FROM dirty)),
 (SELECT count(*) AS k FROM counts WHERE unique_count <= 1)""",
    "C16": f"SELECT round(null_pct, 8) AS null_pct, round(duplicate_pct, 8) AS duplicate_pct, round(100 - null_pct, 8) AS completeness_score FROM {_QUALITY}",
    "C17": f", filled AS MATERIALIZED ({_FILLED}) SELECT order_id, segment, priority, region, order_date, item_count, remark, gift, "
    + ", ".join(f"round({_cap(c, _bounds(c, 'filled'))}, 6) AS {c}" for c in ("customer_id", "total", "balance", "points"))
    + " FROM filled",
    "C17.detected": f", filled AS MATERIALIZED ({_FILLED}) SELECT order_id, segment, priority, region, order_date, item_count, remark, gift, "
    + ", ".join(f"round({_cap(c, _bounds(c, 'filled'))}, 6) AS {c}" for c in ("customer_id", "total", "balance", "points"))
    + " FROM filled",
    "C18": f"SELECT round(null_pct, 8) AS null_pct, null_pct > 15 AS alert FROM {_QUALITY}",
    "B01": f'SELECT "column", unique_count FROM roles WHERE {_PROTECTED}',
    "B02": "SELECT \"column\", unique_count FROM counts WHERE kind IN ('integral', 'fractional') AND unique_count / row_count < 0.95",
    "B03": 'SELECT attribute, "group", metric, count, round_even(mean, 2) AS mean, round_even(median, 2) AS median, round_even(std, 2) AS std, '
    "round_even(min, 2) AS min, round_even(max, 2) AS max FROM facts",
    "B04": f"SELECT * FROM {_ANOVA}",
    "B05": f"SELECT * FROM {_IMPACT}",
    "B06": f"SELECT * FROM {_VARIATION}",
    "B07": f'SELECT attribute, "group", count, round(percentage, 8) AS percentage, percentage < 10 AS under_represented FROM {_REPRESENTATION}',
    "B08": f"SELECT attribute, metric, groups, f_statistic, ratio, round(mean_cv, 6) AS mean_cv FROM {_ANOVA} JOIN {_IMPACT} USING (attribute, metric) "
    f"JOIN {_VARIATION} USING (attribute, metric)",
    "B09": f"SELECT 'completed' AS status, CAST({TESTS} AS BIGINT) AS total_tests, bias_flags, round(bias_flags / {TESTS} * 100, 8) AS bias_flag_pct FROM {_FLAGS}",
    "B10": f"SELECT bias_flags, CASE WHEN bias_flags = 0 THEN '{fairness.ASSESSMENT_NONE}' WHEN bias_flags / 9 < 0.2 THEN '{fairness.ASSESSMENT_MINOR}' "
    f"WHEN bias_flags / 9 < 0.5 THEN '{fairness.ASSESSMENT_MODERATE}' ELSE '{fairness.ASSESSMENT_SIGNIFICANT}' END AS overall_assessment FROM {_FLAGS}",
    "B11": _ADVICE,
    "X20.dataset": f"SELECT 'dirty_orders' AS dataset_name, row_count AS rows, CAST(13 AS BIGINT) AS columns, row_count >= 10 AND "
    f"duplicate_rows / row_count <= 0.05 AND (SELECT count(*) FILTER (null_count / row_count > 0.15) = 0 FROM counts) AS overall_valid, "
    f"row_count - duplicate_rows AS final_rows, 13 - (SELECT count(*) FROM counts WHERE unique_count <= 1) AS final_columns, "
    f"CAST({TESTS} AS BIGINT) AS total_tests, bias_flags FROM {_QUALITY}, {_FLAGS}",
}

SQL = {k: (_BIAS if k[0] in "BX" else _DIRTY) + body for k, body in _SQL.items()}
