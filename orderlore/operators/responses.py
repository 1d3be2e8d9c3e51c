"""Prompts, parsing and scoring of logged answers (R).

The log has one row per model and question: model_name, query_number, user_query, raw_response,
sql_query, visualization, explanation, response_time, status, error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlore.functions.numeric import percent, ratio
from orderlore.functions.text import allow_repeated_keys, first_label, has_any, labels_where, strip

# fixed values: chart types and the fields each needs
CHART_FIELDS = {
    "bar_chart": ["x_axis", "y_axis", "title"],
    "line_chart": ["x_axis", "y_axis", "title"],
    "pie_chart": ["labels", "values", "title"],
    "scatter_plot": ["x_axis", "y_axis", "title"],
    "table": ["title"],
}
VISUALIZATION_FIELDS = ["type", "title", "x_axis", "y_axis", "x_label", "y_label", "labels", "values"]

# fixed values: texts used where an answer lacks a part
DEFAULT_SQL = "SELECT * FROM dataset LIMIT 100;"
DEFAULT_TYPE = "table"
DEFAULT_TITLE = "Query Results"
PREVIEW_TITLE = "Data Preview"
DEFAULT_EXPLANATION = "Query generated successfully"
EXTRACTED_EXPLANATION = "Generated query (visualization defaulted to table)"
PREVIEW_EXPLANATION = "Fallback query to show data preview"

# fixed values: words that signal what a question wants
INTENT_KEYWORDS = {
    "aggregation": ["sum", "total", "count", "average", "avg", "max", "min", "how many", "how much", "total number"],
    "filtering": ["where", "filter", "specific", "only", "show me", "for", "in", "with", "having"],
    "sorting": ["top", "bottom", "best", "worst", "highest", "lowest", "rank", "order", "sort"],
    "grouping": ["by", "per", "each", "group", "breakdown", "category", "segment", "across"],
    "temporal": ["trend", "over time", "daily", "monthly", "yearly", "date", "time", "when", "period"],
    "comparison": ["compare", "versus", "vs", "difference", "between", "against", "relative to"],
    "listing": ["list", "show", "display", "all", "details", "records"],
}
CATEGORY_KEYWORDS = {
    "top_n": ["top", "best", "highest", "lowest"],
    "time_series": ["trend", "over time", "monthly", "daily", "yearly"],
    "comparison": ["compare", "vs", "versus", "comparison"],
    "aggregation": ["total", "sum", "average", "count"],
}

# fixed values: weights of the overall score
SCORE_WEIGHTS = {
    "success_rate": 0.20,
    "syntax_validity_rate": 0.20,
    "executability_rate": 0.20,
    "format_compliance_rate": 0.15,
    "intent_matching_rate": 0.25,
}

PROMPT_TEMPLATE = """You write one SQL query over the table `dataset` and pick a chart for its result.

About the data:
{dataset_context}

Charts: bar_chart, line_chart, pie_chart, scatter_plot, table.
Answer with one JSON object: sql_query, visualization (type, title, x_axis, y_axis, x_label, y_label), explanation.

Examples:
{few_shot_examples}

Question: "{user_query}"
"""


def succeeded() -> Column:
    return F.coalesce(F.col("status") == "success", F.lit(False))


# --- prompts and parsing ---------------------------------------------------------------------------


def build_prompts(
    questions: DataFrame, metadata: DataFrame, dataset_name: str, examples: str = "", template: str = PROMPT_TEMPLATE
) -> DataFrame:
    """The template filled with the dataset's context, the examples and each question.

    The template is cut at its placeholders, so braces inside a filled-in text are left alone.
    """
    context = metadata.where(F.col("dataset_name") == dataset_name).select(F.max("llm_context")).scalar()
    filled = {"{dataset_context}": context, "{few_shot_examples}": F.lit(examples), "{user_query}": F.col("user_query")}
    pieces = re.split("(" + "|".join(map(re.escape, filled)) + ")", template)
    return questions.withColumn("prompt", F.concat(*[filled.get(p, F.lit(p)) for p in pieces]))


def unfenced(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"```json\s*", ""), r"```\s*", ""))


def lenient_json(text: Column) -> Column:
    """The whole text as JSON, else its outermost braces, else NULL; code fences are removed."""
    allow_repeated_keys()
    clean = unfenced(text)
    return F.coalesce(F.try_parse_json(clean), F.try_parse_json(F.regexp_extract(clean, r"(?s)\{.*\}", 0)))


def sql_in_text(text: Column) -> Column:
    """First SELECT over `dataset`, else any SELECT, else NULL."""
    patterns = [r"(?is)SELECT\s+.*?FROM\s+dataset.*?(?:;|$)", r"(?is)SELECT\s+.*?FROM\s+.*?(?:;|$)"]
    return F.coalesce(*[F.nullif(strip(F.regexp_extract(text, p, 0)), F.lit("")) for p in patterns])


def parse_responses(log: DataFrame) -> DataFrame:
    """parsed_by (json, sql or default) and the fields found, absent ones NULL."""
    raw = F.coalesce(F.col("raw_response"), F.lit(""))
    rows = log.withColumn("_json", lenient_json(raw)).withColumn("_sql", sql_in_text(unfenced(raw)))
    is_json, has_sql = F.col("_json").isNotNull(), F.col("_sql").isNotNull()
    field = lambda path: F.try_variant_get("_json", path, "string")
    fallback = {"type": F.lit(DEFAULT_TYPE), "title": F.when(has_sql, DEFAULT_TITLE).otherwise(PREVIEW_TITLE)}
    chart = F.struct(
        *[
            F.when(is_json, field(f"$.visualization.{f}")).otherwise(fallback.get(f, F.lit(None).cast("string"))).alias(f)
            for f in VISUALIZATION_FIELDS
        ]
    )
    has_chart = ~is_json | F.try_variant_get("_json", "$.visualization", "variant").isNotNull()
    return rows.select(
        "model_name",
        "query_number",
        F.when(is_json, "json").when(has_sql, "sql").otherwise("default").alias("parsed_by"),
        F.when(is_json, field("$.sql_query")).otherwise(F.coalesce("_sql", F.lit(DEFAULT_SQL))).alias("sql_query"),
        F.when(has_chart, chart).alias("visualization"),
        F.when(is_json, field("$.explanation"))
        .otherwise(F.when(has_sql, EXTRACTED_EXPLANATION).otherwise(PREVIEW_EXPLANATION))
        .alias("explanation"),
    )


def fill_defaults(parsed: DataFrame) -> DataFrame:
    """Absent parts get defaults. Of type and title only the first absent one is repaired."""
    chart = F.col("visualization")
    no_chart, no_type = chart.isNull(), F.col("visualization.type").isNull()
    repaired = (
        F.when(no_chart | no_type, chart.withField("type", F.lit(DEFAULT_TYPE)))
        .when(F.col("visualization.title").isNull(), chart.withField("title", F.lit(DEFAULT_TITLE)))
        .otherwise(chart)
    )
    whole = F.struct(
        *[
            F.lit({"type": DEFAULT_TYPE, "title": DEFAULT_TITLE}.get(f)).cast("string").alias(f)
            for f in VISUALIZATION_FIELDS
        ]
    )
    return parsed.withColumns(
        {
            "sql_query": F.coalesce("sql_query", F.lit(DEFAULT_SQL)),
            "visualization": F.when(no_chart, whole).otherwise(repaired),
            "explanation": F.coalesce("explanation", F.lit(DEFAULT_EXPLANATION)),
        }
    )


# --- checks of one answer --------------------------------------------------------------------------


def known_chart() -> Column:
    chart = F.col("visualization")
    return F.coalesce(chart["type"].isin(*CHART_FIELDS) & chart["title"].isNotNull(), F.lit(False))


def has_required_fields() -> Column:
    """All three parts are there, with a titled chart of a known type."""
    return F.col("sql_query").isNotNull() & F.col("explanation").isNotNull() & known_chart()


def is_compliant() -> Column:
    """As R05, with at least ten characters of SQL and of explanation."""
    long_enough = lambda c: F.length(strip(F.coalesce(F.col(c), F.lit("")))) >= 10
    return long_enough("sql_query") & known_chart() & long_enough("explanation")


def missing_chart_fields() -> Column:
    """Fields the chart type needs and the answer leaves empty; unknown types need a title."""
    needed = F.create_map(*[x for k, v in CHART_FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    chart = F.col("visualization")
    given = labels_where({f: F.coalesce(chart[f] != "", F.lit(False)) for f in VISUALIZATION_FIELDS})
    return F.array_except(F.coalesce(needed[chart["type"]], F.array(F.lit("title"))), given)


def question_category(question: Column) -> Column:
    """R08."""
    q = F.lower(question)
    return first_label({k: has_any(q, words) for k, words in CATEGORY_KEYWORDS.items()}, "other")


def question_intents(question: Column) -> Column:
    """R09."""
    return _intents(F.lower(question))


def _intents(q: Column) -> Column:
    return labels_where({k: has_any(q, words) for k, words in INTENT_KEYWORDS.items()})


def sql_patterns(sql: Column) -> Column:
    """R10."""
    return _patterns(F.upper(sql))


def _patterns(s: Column) -> Column:
    grouped = F.contains(s, F.lit("GROUP BY"))
    return labels_where(
        {
            "aggregation": s.rlike(r"\b(SUM|AVG|COUNT|MAX|MIN)\s*\("),
            "filtering": F.contains(s, F.lit("WHERE")),
            "sorting": F.contains(s, F.lit("ORDER BY")),
            "grouping": grouped,
            "temporal": s.rlike(r"\b(DATE|TIME|YEAR|MONTH|DAY)\b"),
            "comparison": s.rlike(r"\b(CASE|WHEN|THEN)\b"),
            "listing": F.contains(s, F.lit("SELECT")) & ~grouped,
        }
    )


def match_intents(log: DataFrame) -> DataFrame:
    """Intents of the question that the SQL serves, and those it misses.

    Both texts are folded to one case in a step of their own, once a row and not once a keyword.
    """
    rows = log.withColumns({"_q": F.lower(F.coalesce("user_query", F.lit(""))), "_s": F.upper(F.coalesce("sql_query", F.lit("")))})
    rows = rows.withColumns({"intents": _intents(F.col("_q")), "patterns": _patterns(F.col("_s"))}).drop("_q", "_s")
    return rows.withColumns(
        {
            "matched_intents": F.array_intersect("intents", "patterns"),
            "missing_intents": F.array_except("intents", "patterns"),
        }
    ).withColumn("intent_matched", (F.size("intents") > 0) & (F.size("missing_intents") == 0))


def ground_truth_scores(log: DataFrame, truth: DataFrame, on: str = "user_query") -> DataFrame:
    """Share of the required SQL fragments that occur, ignoring case."""
    sql = F.upper("sql_query")
    found = F.filter("expected_sql_contains", lambda part: F.contains(sql, F.upper(part)))
    score = ratio(F.size(found), F.size("expected_sql_contains"))
    return log.join(truth, on).withColumn("truth_score", score)


# --- results per answer and per model --------------------------------------------------------------


def evaluate(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per answer; failed answers keep their error.

    `outcomes` has one row per distinct SQL text (sql_query, syntax_valid, executable, error), see
    `operators.execution.check_sql`.
    """
    checked = outcomes.select("sql_query", "syntax_valid", "executable", F.col("error").alias("sql_error"))
    rows = match_intents(log).join(checked, "sql_query", "left")
    ok = succeeded()
    flag = lambda c: ok & F.coalesce(c, F.lit(False))
    compliant = flag(is_compliant())
    rows = rows.withColumns(
        {
            "syntax_valid": flag(F.col("syntax_valid")),
            "executable": flag(F.col("executable")),
            "format_compliant": compliant,
            "intent_matched": flag(F.col("intent_matched")),
        }
    )
    errors = labels_where({"Response format non-compliant": ~F.col("format_compliant")})
    return rows.select(
        "model_name",
        "query_number",
        "user_query",
        "status",
        "syntax_valid",
        "executable",
        "format_compliant",
        "intent_matched",
        F.when(ok, F.length("sql_query")).cast("bigint").alias("sql_length"),
        F.when(ok, F.length("explanation")).cast("bigint").alias("explanation_length"),
        F.when(ok, F.coalesce("visualization.type", F.lit("unknown"))).alias("visualization_type"),
        F.when(ok, F.col("matched_intents")).alias("matched_intents"),
        F.when(ok, F.col("missing_intents")).alias("missing_intents"),
        F.when(ok, F.array_compact(F.concat(F.array("sql_error"), errors)))
        .otherwise(F.array(F.coalesce("error", F.lit("Unknown error"))))
        .alias("errors"),
        F.when(ok, F.coalesce("response_time", F.lit(0.0))).alias("response_time"),
    )


def failed_responses(log: DataFrame) -> DataFrame:
    """R20."""
    return log.where(~succeeded()).select(
        "model_name",
        "query_number",
        "user_query",
        F.lit("failed").alias("status"),
        F.coalesce("error", F.lit("Unknown error")).alias("error"),
    )


def overall_score() -> Column:
    """Weighted sum of the rates, an absent rate counting as zero."""
    return sum(
        (F.coalesce(F.col(name), F.lit(0.0)) * weight for name, weight in SCORE_WEIGHTS.items()), start=F.lit(0.0)
    )


def model_metrics(results: DataFrame) -> DataFrame:
    """Counts, rates over the successful answers, and the overall score per model.

    Every answer is folded into its model's row on the map side, so a model with a third of the log
    is no heavier for its reducer than any other.
    """
    success = F.col("status") == "success"
    counts = results.groupBy("model_name").agg(
        F.count("*").alias("total_queries"),
        F.count_if(success).alias("successful"),
        F.count_if("syntax_valid").alias("syntax_valid"),
        F.count_if("executable").alias("executable"),
        F.count_if("format_compliant").alias("format_compliant"),
        F.count_if("intent_matched").alias("intent_matched"),
        F.avg(F.when(success, F.col("response_time"))).alias("avg_response_time"),
    )
    over_success = lambda c: percent(F.col(c), F.col("successful"))
    return counts.withColumns(
        {
            "success_rate": percent(F.col("successful"), F.col("total_queries")),
            "syntax_validity_rate": over_success("syntax_valid"),
            "executability_rate": over_success("executable"),
            "format_compliance_rate": over_success("format_compliant"),
            "intent_matching_rate": over_success("intent_matched"),
        }
    ).withColumn("overall_score", overall_score())


def compare_models(metrics: DataFrame) -> DataFrame:
    """Models by score, ties by name, with the best one marked."""
    place = F.row_number().over(Window.orderBy(F.col("overall_score").desc(), "model_name"))
    return metrics.withColumn("rank", place.cast("bigint")).withColumn("is_best", F.col("rank") == 1)


def query_log_rows(log: DataFrame, at: Column | None = None) -> DataFrame:
    """The answers as rows of the stored query log."""
    at = F.current_timestamp() if at is None else at
    ok = succeeded()
    return log.select(
        F.concat_ws("_", F.lit("query"), F.date_format(at, "yyyyMMdd_HHmmss"), F.col("model_name"), F.col("query_number")).alias(
            "query_id"
        ),
        "user_query",
        F.col("sql_query").alias("generated_sql"),
        F.to_json("visualization").alias("visualization"),
        "explanation",
        ok.alias("execution_success"),
        (F.col("result_rows") if "result_rows" in log.columns else F.lit(0)).cast("bigint").alias("result_rows"),
        F.coalesce("error", F.lit("")).alias("error_message"),
        at.alias("created_at"),
    )
