"""Registered queries for the response log: scoring, bias, selection, execution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.shared import once, response_rows
from checks.workload_sql import VIEW
from orderlore.operators import execution, responses, selection, stability
from orderlore.plans.pipelines import question_summary
from orderlore.plans.star import SALES_COLUMNS, read_table, sales_view
from orderlore.plans.test_views import RESPONSE_LOG_SQL
from orderlore.session import fresh_path, materialise
from orderlore.sources import responses as stored

COLUMNS = list(SALES_COLUMNS)
TRUTH = [
    ("What is the total sales by region?", ["SUM(sales)", "FROM"]),
    ("Top 5 products by revenue", ["ORDER BY", "DESC", "LIMIT 5"]),
    ("How many orders in 1999?", ["COUNT", "1999", "WHERE"]),
]
TEMPLATE = "Context: {dataset_context} Examples: {few_shot_examples} Question: {user_query}"
INVALID = ["SELECT missing_column FROM dataset", "SELEC region FORM dataset"]
STAMP = "2024-02-01 00:00:00"

def _dataset(spark, sf_dir) -> DataFrame:
    """The table the generated SQL is analysed against."""
    return sales_view(spark, sf_dir)


def _stored_dataset(spark, sf_dir) -> DataFrame:
    """What the logged texts run over: the columns they can read, loaded once as a warehouse table would be."""
    columns = execution.columns_read(response_rows(spark, sf_dir), COLUMNS)
    return once(spark, sf_dir, "dataset", lambda: materialise(sales_view(spark, sf_dir, *columns), "dataset"))


def _dataset_for(spark, sf_dir, text: str) -> DataFrame:
    """The table with the columns that one text can read."""
    columns = execution.columns_read(spark.createDataFrame([(text,)], "sql_query string"), COLUMNS)
    return sales_view(spark, sf_dir, *columns)


def _checked(spark, sf_dir) -> DataFrame:
    return once(
        spark, sf_dir, "checked",
        lambda: execution.check_sql(response_rows(spark, sf_dir), _dataset(spark, sf_dir), narrow=_stored_dataset(spark, sf_dir)),
    )


def _successful(spark, sf_dir) -> DataFrame:
    return response_rows(spark, sf_dir).where(responses.succeeded())


def _executed(spark, sf_dir) -> DataFrame:
    return once(
        spark, sf_dir, "executed",
        lambda: execution.execute_batch(_successful(spark, sf_dir), _dataset(spark, sf_dir), narrow=_stored_dataset(spark, sf_dir)),
    )


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


def _evaluated(s, d) -> DataFrame:
    return responses.evaluate(response_rows(s, d), _checked(s, d))


def _metrics(s, d) -> DataFrame:
    return responses.model_metrics(_evaluated(s, d))


RATES = ["success_rate", "syntax_validity_rate", "executability_rate", "format_compliance_rate", "intent_matching_rate"]


def _bias(s, d) -> DataFrame:
    return stability.bias_scores(response_rows(s, d), COLUMNS)


def _ranking(s, d) -> DataFrame:
    return selection.rank_models(selection.composite_scores(_metrics(s, d), _bias(s, d)))


def _prompts(s, d) -> DataFrame:
    meta = read_table(s, d, "orders").agg(F.concat(F.lit("orders {x}, rows: "), F.count("*").cast("string")).alias("llm_context"))
    meta = meta.withColumn("dataset_name", F.lit("orders"))
    questions = response_rows(s, d).select("query_number", "user_query")
    return responses.build_prompts(questions, meta, "orders", "none", TEMPLATE)


def _flat_parse(df: DataFrame) -> DataFrame:
    return df.select(
        "model_name", "query_number", "parsed_by", "sql_query", "explanation",
        F.col("visualization.type").alias("viz_type"), F.col("visualization.title").alias("viz_title"),
    )


def _truth(s, d) -> DataFrame:
    truth = s.createDataFrame(TRUTH, "user_query string, expected_sql_contains array<string>")
    scored = responses.ground_truth_scores(response_rows(s, d), truth)
    return _rounded(scored.select("model_name", "query_number", "truth_score"), 8, "truth_score")


def _versions(s, d) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "metadata").otherwise("selection")
    return read_table(s, d, "events").select(
        "user_id", F.col("event_id").alias("version"), kind.alias("kind"), F.col("ts").alias("updated"),
        F.col("value").alias("composite_score"),
    )


def _trials(s, d) -> DataFrame:
    n = F.col("query_number")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.floor(n / k) % len(values) + 1).cast("int"))
    grid = selection.PARAMETER_GRID
    return response_rows(s, d).select(
        pick(grid["temperature"], 1).alias("temperature"), pick(grid["top_p"], 3).alias("top_p"),
        pick(grid["top_k"], 6).alias("top_k"), "raw_response",
    )


def _limited(s, d) -> DataFrame:
    text = "SELECT order_id, product_id, round(sales, 4) AS sales FROM dataset ORDER BY order_id, product_id, sales;"
    execution.bind_dataset(_dataset_for(s, d, text))
    return execution.run_query(s, text)


def _bound(s, d) -> DataFrame:
    text = "SELECT region, COUNT(*) AS line_count FROM dataset GROUP BY region"
    execution.bind_dataset(_dataset_for(s, d, text))
    return execution.as_query(s, text)


def _merged(s, d) -> DataFrame:
    return execution.merge_outcomes(response_rows(s, d), _executed(s, d))


def _saved(s, d) -> DataFrame:
    path = fresh_path(s, "execution-results")
    _executed(s, d).write.json(path)
    return s.read.schema(execution.OUTCOME).json(path).select("user_query", "sql_query", "chart", "result_count")


def _saved_responses(s, d) -> DataFrame:
    path = stored.save_responses(response_rows(s, d), fresh_path(s, "responses"))
    schema = "query_number bigint, user_query string, sql_query string, status string, model_name string"
    return s.read.schema(schema).json(path).groupBy("model_name", "status").agg(
        F.count("*").alias("answers"), F.max("query_number").alias("last_query")
    )


def _flags(*names: str):
    return lambda s, d: _executed(s, d).select("user_query", "sql_query", "chart", *names)


def _check(name: str):
    """Verdict and message of one check."""
    return lambda s, d: _executed(s, d).select("user_query", "sql_query", "chart", name, F.col(f"messages.{name}").alias("message"))


def _answers(kind: str):
    return lambda s, d: _executed(s, d).where(F.col("answer_kind") == kind).select("user_query", "sql_query", "chart", "answer")


def _on_log(run):
    return lambda s, d: run(response_rows(s, d))


def _deployment(s, d) -> DataFrame:
    record = stored.deployment_record(selection.best_model(_ranking(s, d)), F.lit(STAMP).cast("timestamp"))
    record = record.withColumn("selection_date", F.date_format("selection_date", "yyyy-MM-dd"))
    return _rounded(record, 6, "composite_score", "performance_score", "success_rate", "avg_response_time")


QUERIES = {
    "R01": _prompts,
    "R02": _on_log(lambda r: _flat_parse(responses.parse_responses(r))),
    "R03": _on_log(
        lambda r: responses.parse_responses(r).where("parsed_by <> 'json'").select("model_name", "query_number", "sql_query")
    ),
    "R04": _on_log(lambda r: _flat_parse(responses.fill_defaults(responses.parse_responses(r)))),
    "R05": _on_log(
        lambda r: responses.parse_responses(r).select("model_name", "query_number", responses.has_required_fields().alias("ok"))
    ),
    "R06": _on_log(lambda r: r.select("model_name", "query_number", responses.is_compliant().alias("ok"))),
    "R07": _on_log(
        lambda r: _joined(r.select("model_name", "query_number", responses.missing_chart_fields().alias("missing")), "missing")
    ),
    "R08": _on_log(lambda r: r.select("query_number", responses.question_category(F.col("user_query")).alias("category"))),
    "R09": _on_log(
        lambda r: _joined(r.select("query_number", responses.question_intents(F.col("user_query")).alias("intents")), "intents")
    ),
    "R10": _on_log(
        lambda r: _joined(r.select("query_number", responses.sql_patterns(F.col("sql_query")).alias("patterns")), "patterns")
    ),
    "R11": _on_log(
        lambda r: _joined(
            responses.match_intents(r).select("query_number", "matched_intents", "missing_intents", "intent_matched"),
            "matched_intents", "missing_intents",
        )
    ),
    "R12": _truth,
    "R13": lambda s, d: _checked(s, d).select("sql_query", "syntax_valid"),
    "R14": lambda s, d: _checked(s, d).select("sql_query", "executable"),
    "R15": lambda s, d: _evaluated(s, d).select(
        "model_name", "query_number", "status", "syntax_valid", "executable", "format_compliant", "intent_matched",
        "sql_length", "explanation_length", "visualization_type", F.size("errors").cast("bigint").alias("error_count"),
    ),
    "R16": lambda s, d: _rounded(
        _metrics(s, d).select("model_name", "total_queries", "successful", "avg_response_time", *RATES),
        6, "avg_response_time", *RATES,
    ),
    "R17": lambda s, d: _rounded(_metrics(s, d).select("model_name", "overall_score"), 6, "overall_score"),
    "R18": lambda s, d: _rounded(
        responses.compare_models(_metrics(s, d)).select("model_name", "overall_score", "rank", "is_best"), 6, "overall_score"
    ),
    "R19": _on_log(
        lambda r: responses.query_log_rows(r, F.lit(STAMP).cast("timestamp")).select(
            "query_id", "user_query", "generated_sql", "explanation", "execution_success", "result_rows", "error_message",
            F.get_json_object("visualization", "$.type").alias("viz_type"),
        )
    ),
    "R20": _on_log(responses.failed_responses),
    "L01": _on_log(lambda r: _rounded(stability.chart_distribution(r), 8, "share_pct")),
    "L01.bias": _on_log(lambda r: _rounded(stability.chart_bias(r).drop("description"), 8, "measure")),
    "L02": _on_log(
        lambda r: _rounded(
            stability.sql_pattern_shares(r),
            8, "has_aggregation", "has_group_by", "has_where", "has_join", "has_order_by", "simple_select",
        )
    ),
    "L03": _on_log(lambda r: _rounded(stability.column_usage(r, COLUMNS), 8, "usage_pct")),
    "L04": _on_log(lambda r: _rounded(stability.sentiment_shares(r), 8, "positive", "negative", "neutral")),
    "L05": lambda s, d: _bias(s, d).select("model_name", "num_biases", "bias_score"),
    "L06": lambda s, d: _bias(s, d).select("model_name", "bias_score", "severity"),
    "L07": _on_log(lambda r: _rounded(stability.bias_categories(r, COLUMNS).drop("description"), 8, "measure")),
    "L08": lambda s, d: stability.compare_bias(_bias(s, d)).select(
        "model_name", "bias_detected", "bias_score", "severity", "num_biases", "rank", "is_least_biased"
    ),
    "L09": _on_log(lambda r: _rounded(stability.by_question_type(r), 8, "avg_response_time")),
    "L10": _on_log(lambda r: _rounded(stability.response_time_stability(r), 8, "mean_time", "std_time", "time_cv", "min_time", "max_time")),
    "L11": _on_log(
        lambda r: _rounded(stability.output_consistency(r), 8, "sql_length_std", "avg_sql_length", "consistency_score")
    ),
    "L12": _on_log(
        lambda r: _rounded(
            stability.stability_report(r).select(
                "model_name", "total_responses", "successful_responses", "most_common_type", "stability_rating",
                "visualization_variety", "consistency_score",
            ),
            8, "consistency_score",
        )
    ),
    "M01": lambda s, d: selection.common_models(_metrics(s, d), _bias(s, d)).select("model_name"),
    "M02": lambda s, d: _rounded(
        selection.composite_scores(_metrics(s, d), _bias(s, d)),
        6, "composite_score", "performance_score", "response_time", "success_rate", "normalized_time",
    ),
    "M03": lambda s, d: _rounded(_ranking(s, d).select("rank", "model_name", "composite_score"), 6, "composite_score"),
    "M04": lambda s, d: _rounded(
        selection.select_best(_metrics(s, d), _bias(s, d)).select("model_name", "composite_score"), 6, "composite_score"
    ),
    "M05": lambda s, d: selection.top_models(_ranking(s, d), 2).toDF("rank", "model", "composite", "performance", "bias"),
    "M07": lambda s, d: _joined(selection.performance_gate(_metrics(s, d)).select("model_name", "errors", "passed"), "errors"),
    "M08": lambda s, d: _joined(
        selection.execution_gate(execution.accuracy(_merged(s, d).where("execution_status IS NOT NULL"))).select("errors", "passed"),
        "errors",
    ),
    "M09": lambda s, d: _joined(selection.bias_gate(_bias(s, d)), "errors"),
    "M11": lambda s, d: selection.previous_version(_versions(s, d)).select("version", "kind", "composite_score"),
    "M12": lambda s, d: _rounded(
        selection.promotion(_versions(s, d), keys=("user_id",), slice_by=F.date_trunc("hour", "updated")).select(
            "user_id", "version", "previous_score", "improvement", "should_deploy",
            F.regexp_extract("reason", r"^(Model \w+|\w+ \w+)", 1).alias("reason"),
        ),
        6, "improvement",
    ),
    "M13": lambda s, d: _rounded(selection.tune(_trials(s, d)), 6, "score"),
    "X01": _bound,
    "X02": lambda s, d: _executed(s, d).select(
        "sql_query", "execution_status", "result_count", (F.col("elapsed_seconds") > 0).alias("timed"),
        F.coalesce(F.json_array_length("first_rows"), F.lit(0)).cast("bigint").alias("kept_rows"),
    ).distinct(),
    "X03": _limited,
    "X04": _check("not_empty"),
    "X05": _check("reasonable_count"),
    "X06": _check("visualization_compatible"),
    "X07": _check("values_reasonable"),
    "X08": _check("intent_aligned"),
    "X09": _flags("results_valid"),
    "X10": _on_log(lambda r: r.select("query_number", execution.answer_kind(F.col("user_query")).alias("kind"))),
    "X11": _answers("aggregation"),
    "X12": _answers("ranking"),
    "X13": _answers("comparison"),
    "X14": _answers("trend"),
    "X15": lambda s, d: _executed(s, d)
    .where("answer_kind IN ('listing', 'general')")
    .select("user_query", "sql_query", "chart", "answer"),
    "X16": lambda s, d: _executed(s, d).agg(
        F.count("*").alias("texts"),
        F.count_if(F.col("execution_status") == "success").alias("successful"),
        F.count_if("results_valid").alias("valid"),
    ),
    "X17": _saved,
    "X18": lambda s, d: _rounded(
        execution.accuracy(_merged(s, d).where("execution_status IS NOT NULL")),
        6, "execution_success_rate", "result_validity_rate", "overall_accuracy",
    ),
    "X19": lambda s, d: _merged(s, d).select(
        "model_name", "query_number", "status", "execution_status", "results_valid", "result_count"
    ),
    "X20": lambda s, d: _rounded(
        question_summary(_ranking(s, d), _merged(s, d).where("execution_status IS NOT NULL"), "orders").withColumn(
            "best_model", F.col("best_model.model_name")
        ),
        6, "overall_accuracy",
    ),
    "S32": _saved_responses,
    "S33": _on_log(stored.response_lines),
    "S33.totals": _on_log(stored.response_summary),
    "S34": _deployment,
}


def queries() -> dict:
    return dict(QUERIES)


# --- reference SQL ---------------------------------------------------------------------------------


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _hits(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words) + ")"


_Q, _S, _E = "lower(user_query)", "upper(sql_query)", "lower(explanation)"
_INTENTS = {k: _any(_Q, w) for k, w in responses.INTENT_KEYWORDS.items()}
_PATTERNS = {
    "aggregation": f"regexp_matches({_S}, '\\b(SUM|AVG|COUNT|MAX|MIN)\\s*\\(')",
    "filtering": f"contains({_S}, 'WHERE')",
    "sorting": f"contains({_S}, 'ORDER BY')",
    "grouping": f"contains({_S}, 'GROUP BY')",
    "temporal": f"regexp_matches({_S}, '\\b(DATE|TIME|YEAR|MONTH|DAY)\\b')",
    "comparison": f"regexp_matches({_S}, '\\b(CASE|WHEN|THEN)\\b')",
    "listing": f"(contains({_S}, 'SELECT') AND NOT contains({_S}, 'GROUP BY'))",
}


def _list(conditions: dict[str, str]) -> str:
    parts = [f"CASE WHEN {c} THEN '{k}' END" for k, c in conditions.items()]
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def _case(conditions: dict[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in conditions.items()) + f" ELSE '{otherwise}' END"


_INVALID = ", ".join(f"'{t}'" for t in INVALID)
_KNOWN = "viz_type IN ('bar_chart', 'line_chart', 'pie_chart', 'scatter_plot', 'table')"
_COMPLIANT = f"(length(trim(sql_query)) >= 10 AND {_KNOWN} AND length(trim(explanation)) >= 10)"
_MATCHED = "(len(intents) > 0 AND len(list_filter(intents, lambda x: NOT list_contains(patterns, x))) = 0)"
_POS, _NEG, _NEU = (_hits(_E, w) for w in (stability.POSITIVE_WORDS, stability.NEGATIVE_WORDS, stability.NEUTRAL_WORDS))
_AGG = "(" + " OR ".join(f"contains({_S}, '{a}')" for a in stability.AGGREGATES) + ")"
_TYPE = _case({k: _any(_Q, w) for k, w in stability.QUESTION_TYPES.items()}, "filtering")

_LOG = f"""WITH log AS ({RESPONSE_LOG_SQL}), good AS (SELECT * FROM log WHERE status = 'success'),
matched AS (SELECT *, {_list(_INTENTS)} AS intents, {_list(_PATTERNS)} AS patterns FROM log),
evaluated AS (SELECT *, status = 'success' AS ok, status = 'success' AND sql_query NOT IN ({_INVALID}) AS syntax_valid,
 status = 'success' AND {_COMPLIANT} AS format_compliant, status = 'success' AND {_MATCHED} AS intent_matched FROM matched),
rates AS (SELECT model_name, count(*) AS total_queries, count(*) FILTER (ok) AS successful,
 avg(response_time) FILTER (ok) AS avg_response_time, count(*) FILTER (ok) / count(*) * 100 AS success_rate,
 count(*) FILTER (syntax_valid) / count(*) FILTER (ok) * 100 AS syntax_validity_rate,
 count(*) FILTER (syntax_valid) / count(*) FILTER (ok) * 100 AS executability_rate,
 count(*) FILTER (format_compliant) / count(*) FILTER (ok) * 100 AS format_compliance_rate,
 count(*) FILTER (intent_matched) / count(*) FILTER (ok) * 100 AS intent_matching_rate FROM evaluated GROUP BY 1),
metrics AS (SELECT *, 0.2 * success_rate + 0.2 * syntax_validity_rate + 0.2 * executability_rate + 0.15 * format_compliance_rate
 + 0.25 * intent_matching_rate AS overall_score FROM rates),
charts AS (SELECT *, count / sum(count) OVER (PARTITION BY model_name) * 100 AS share_pct FROM
 (SELECT model_name, viz_type AS chart_type, count(*) AS count FROM good GROUP BY ALL)),
pattern_shares AS (SELECT model_name, count(*) FILTER ({_AGG}) / count(*) * 100 AS has_aggregation,
 count(*) FILTER (contains({_S}, 'GROUP BY')) / count(*) * 100 AS has_group_by,
 count(*) FILTER (contains({_S}, 'WHERE')) / count(*) * 100 AS has_where,
 count(*) FILTER (contains({_S}, 'JOIN')) / count(*) * 100 AS has_join,
 count(*) FILTER (contains({_S}, 'ORDER BY')) / count(*) * 100 AS has_order_by,
 count(*) FILTER (len(regexp_extract_all({_S}, 'SELECT')) = 1 AND NOT contains({_S}, 'GROUP BY')) / count(*) * 100 AS simple_select
 FROM good GROUP BY 1),
usage AS (SELECT model_name, c AS "column", count(*) AS count,
 count(*) / any_value(n) * 100 AS usage_pct FROM (SELECT *, count(*) OVER (PARTITION BY model_name) AS n FROM good)
 JOIN (SELECT unnest({COLUMNS!r}) AS c) ON contains(sql_query, c) GROUP BY ALL),
sentiments AS (SELECT model_name, count(*) FILTER (s = 'positive') / count(*) * 100 AS positive,
 count(*) FILTER (s = 'negative') / count(*) * 100 AS negative, count(*) FILTER (s = 'neutral') / count(*) * 100 AS neutral
 FROM (SELECT *, CASE WHEN {_POS} > {_NEG} AND {_POS} > {_NEU} THEN 'positive' WHEN {_NEG} > {_POS} AND {_NEG} > {_NEU} THEN 'negative'
 ELSE 'neutral' END AS s FROM good) GROUP BY 1),
chart_rows AS (SELECT model_name, 'Visualization Selection Bias' AS category, max(share_pct) > 60 AS biased,
 CASE WHEN max(share_pct) > 80 THEN 'HIGH' WHEN max(share_pct) > 60 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 max(share_pct) AS measure FROM charts GROUP BY 1),
categories AS (SELECT * FROM chart_rows UNION ALL
 SELECT model_name, 'Query Pattern Bias', has_aggregation > 70, CASE WHEN has_aggregation > 70 THEN 'MEDIUM' ELSE 'LOW' END,
 has_aggregation FROM pattern_shares UNION ALL
 SELECT model_name, 'Column Usage Bias', max(usage_pct) - min(usage_pct) > 50,
 CASE WHEN max(usage_pct) - min(usage_pct) > 50 THEN 'MEDIUM' ELSE 'LOW' END, max(usage_pct) - min(usage_pct) FROM usage GROUP BY 1 UNION ALL
 SELECT model_name, 'Sentiment Bias', greatest(positive, negative, neutral) > 70, 'LOW', greatest(positive, negative, neutral) FROM sentiments),
bias AS (SELECT model_name, num_biases, num_biases > 0 AS bias_detected, bias_score,
 CASE WHEN bias_score >= 60 THEN 'HIGH' WHEN bias_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS severity
 FROM (SELECT model_name, count(*) FILTER (biased) AS num_biases, CAST(least(sum(CASE WHEN NOT biased THEN 0 WHEN severity = 'HIGH' THEN 40
 WHEN severity = 'MEDIUM' THEN 25 ELSE 10 END), 100) AS DOUBLE) AS bias_score FROM categories GROUP BY 1)),
scores AS (SELECT *, row_number() OVER (ORDER BY composite_score DESC, model_name) AS rank FROM (
 SELECT model_name, overall_score AS performance_score, bias_score, avg_response_time AS response_time, success_rate,
 100 - bias_score AS normalized_bias, greatest(0.0, 100 - avg_response_time / 5 * 100) AS normalized_time,
 overall_score * 0.5 + (100 - bias_score) * 0.3 + greatest(0.0, 100 - avg_response_time / 5 * 100) * 0.1 + success_rate * 0.1 AS composite_score
 FROM metrics JOIN bias USING (model_name))),
types AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY count DESC,
 list_position(['aggregation', 'filtering', 'sorting', 'listing'], question_type)) = 1 AS is_most_common FROM (
 SELECT model_name, {_TYPE} AS question_type, count(*) AS count, avg(response_time) AS avg_response_time FROM good GROUP BY ALL)),
times AS (SELECT model_name, count(*) AS timed, avg(response_time) AS mean_time, stddev_pop(response_time) AS std_time,
 min(response_time) AS min_time, max(response_time) AS max_time, stddev_pop(response_time) / avg(response_time) AS time_cv,
 CASE WHEN stddev_pop(response_time) / avg(response_time) < 0.3 THEN 'stable'
 WHEN stddev_pop(response_time) / avg(response_time) < 0.6 THEN 'moderate' ELSE 'unstable' END AS stability_rating
 FROM good WHERE response_time > 0 GROUP BY 1),
consistency AS (SELECT model_name, count(DISTINCT viz_type) AS visualization_variety, stddev_pop(length(sql_query)) AS sql_length_std,
 avg(length(sql_query)) AS avg_sql_length, 100 - stddev_pop(length(sql_query)) / avg(length(sql_query)) * 100 AS consistency_score
 FROM good GROUP BY 1)
"""


def _log_sql(body: str) -> str:
    return _LOG + body


def _round_all(columns: str, names: list[str], source: str, digits: int = 8) -> str:
    rounded = ", ".join(f"round({n}, {digits}) AS {n}" for n in names)
    return f"SELECT {columns}{', ' if columns else ''}{rounded} FROM {source}"


_PARSE = r"""parsed AS (SELECT *, CASE WHEN j IS NOT NULL THEN 'json' WHEN s <> '' THEN 'sql' ELSE 'default' END AS parsed_by FROM (
 SELECT *, CASE WHEN json_valid(t) THEN t WHEN json_valid(regexp_extract(t, '(?s)\{.*\}', 0)) THEN regexp_extract(t, '(?s)\{.*\}', 0) END AS j,
 trim(CASE WHEN regexp_extract(t, '(?is)SELECT\s+.*?FROM\s+dataset.*?(?:;|$)', 0) <> ''
  THEN regexp_extract(t, '(?is)SELECT\s+.*?FROM\s+dataset.*?(?:;|$)', 0) ELSE regexp_extract(t, '(?is)SELECT\s+.*?FROM\s+.*?(?:;|$)', 0) END) AS s
 FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(coalesce(raw_response, ''), '```json\s*', '', 'g'), '```\s*', '', 'g'),
 '^\s+|\s+$', '', 'g') AS t FROM log))),
fields AS (SELECT model_name, query_number, parsed_by,
 CASE parsed_by WHEN 'json' THEN json_extract_string(j, '$.sql_query') WHEN 'sql' THEN s ELSE 'SELECT * FROM dataset LIMIT 100;' END AS sql_query,
 CASE parsed_by WHEN 'json' THEN json_extract_string(j, '$.explanation') WHEN 'sql' THEN 'Generated query (visualization defaulted to table)'
  ELSE 'Fallback query to show data preview' END AS explanation,
 CASE parsed_by WHEN 'json' THEN json_extract_string(j, '$.visualization.type') ELSE 'table' END AS viz_type,
 CASE parsed_by WHEN 'json' THEN json_extract_string(j, '$.visualization.title') WHEN 'sql' THEN 'Query Results' ELSE 'Data Preview' END AS viz_title
 FROM parsed)
"""
_PARSED = f"WITH log AS ({RESPONSE_LOG_SQL}), " + _PARSE
_MISSING = (
    "CASE WHEN viz_type IN ('bar_chart', 'line_chart', 'scatter_plot') AND viz_x = '' THEN 'x_axis' "
    "WHEN viz_type = 'pie_chart' THEN 'labels,values' ELSE '' END"
)
_CATEGORY = _case({k: _any(_Q, w) for k, w in responses.CATEGORY_KEYWORDS.items()}, "other")
_KIND = _case({k: _any(_Q, w) for k, w in execution.ANSWER_KINDS.items()}, "general")


def _truth_score() -> str:
    cases = []
    for question, parts in TRUTH:
        found = " + ".join(f"CAST(contains({_S}, '{p.upper()}') AS INT)" for p in parts)
        cases.append(f"WHEN user_query = '{question}' THEN ({found}) / {len(parts)}")
    return "CASE " + " ".join(cases) + " END"


_TEXTS = {
    "SELECT region, SUM(sales) AS total_sales FROM dataset GROUP BY region ORDER BY total_sales DESC, region": 2,
    "SELECT year(order_date) AS year, SUM(profit) AS profit FROM dataset GROUP BY year(order_date) ORDER BY year": 2,
    "SELECT product_name, SUM(sales) AS sales FROM dataset GROUP BY product_name ORDER BY sales DESC LIMIT 5": 2,
    "SELECT order_id, sales, profit FROM dataset ORDER BY order_id LIMIT 100": 3,
    "SELECT COUNT(*) AS order_count FROM dataset WHERE year(order_date) = 1999": 1,
    "SELECT segment, SUM(sales) AS sales FROM dataset GROUP BY segment": 2,
    "SELECT category, AVG(discount) AS avg_discount FROM dataset GROUP BY category": 2,
    "SELECT order_id, sales FROM dataset WHERE sales > 90000": 2,
    "SELECT month(order_date) AS month, MAX(profit) AS profit FROM dataset GROUP BY month(order_date) ORDER BY profit DESC": 2,
    "SELECT quantity, AVG(discount) AS discount FROM dataset GROUP BY quantity": 2,
}
_RUN = ", dataset AS (SELECT * FROM sales), runs AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS sql_query, count(*) AS result_count, {n} AS width FROM ({t})" for t, n in _TEXTS.items()
) + f"), log AS ({RESPONSE_LOG_SQL}), " + f"""
work AS (SELECT DISTINCT user_query, sql_query, viz_type AS chart, {_KIND} AS answer_kind FROM log WHERE status = 'success'),
outcomes AS (SELECT *, CASE WHEN width IS NULL THEN 'failed' ELSE 'success' END AS execution_status, coalesce(result_count, 0) AS n,
 CASE WHEN width IS NOT NULL THEN result_count > 0 END AS not_empty,
 CASE WHEN width IS NOT NULL THEN NOT (contains(user_query, 'Top 5') AND result_count < 5) AND result_count <= 100000 END AS reasonable_count,
 CASE WHEN width IS NOT NULL THEN (chart NOT IN ('bar_chart', 'line_chart', 'scatter_plot') OR width >= 2) AND (chart <> 'pie_chart' OR width = 2) END AS visualization_compatible,
 CASE WHEN width IS NOT NULL THEN true END AS values_reasonable,
 CASE WHEN width IS NOT NULL THEN NOT (contains(lower(user_query), 'details') AND width < 3) END AS intent_aligned
 FROM work LEFT JOIN runs USING (sql_query)),
judged AS (SELECT *, coalesce(not_empty AND reasonable_count AND visualization_compatible AND values_reasonable AND intent_aligned, false) AS results_valid FROM outcomes),
answers AS (SELECT log.*, execution_status, results_valid, result_count, n FROM log LEFT JOIN judged
 ON log.user_query = judged.user_query AND log.sql_query = judged.sql_query AND log.viz_type = judged.chart)
"""
_EXEC = VIEW.rstrip() + _RUN
_TRIAL = f""", tried AS (SELECT [0.2, 0.4, 0.6][CAST(query_number % 3 AS INT) + 1] AS temperature, [0.8, 0.9][CAST(query_number // 3 % 2 AS INT) + 1] AS top_p,
 [40, 60][CAST(query_number // 6 % 2 AS INT) + 1] AS top_k, t FROM parsed),
grid AS (SELECT temperature, top_p, top_k, count(*) AS answers, count(*) FILTER (json_valid(t)) AS parsed,
 count(*) FILTER (CASE WHEN json_valid(t) THEN json_extract(t, '$.sql_query') IS NOT NULL AND json_extract(t, '$.visualization') IS NOT NULL ELSE false END) AS well_formed
 FROM tried GROUP BY ALL),
scored AS (SELECT *, row_number() OVER (ORDER BY temperature, top_p, top_k) AS trial, parsed / answers * 50 + well_formed / answers * 50 AS score FROM grid)
SELECT CAST(temperature AS DOUBLE) AS temperature, CAST(top_p AS DOUBLE) AS top_p, top_k, answers, parsed, well_formed, trial, round(score, 6) AS score,
 row_number() OVER (ORDER BY score DESC, trial) = 1 AND score > 0 AS is_best FROM scored"""


def _gate_sql(gate: dict, thresholds_from: str) -> str:
    parts = []
    for name, (limit, label, unit) in gate.items():
        parts.append(f"CASE WHEN {name} < {limit} THEN '{label} ' || printf('%.2f', {name}) || '{unit} below threshold {limit}{unit}' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


_ACCURACY = """(SELECT count(*) AS total_queries, count(*) FILTER (execution_status = 'success') AS successfully_executed,
 count(*) FILTER (results_valid) AS valid_results, count(*) FILTER (execution_status = 'success') / count(*) * 100 AS execution_success_rate,
 count(*) FILTER (results_valid) / count(*) FILTER (execution_status = 'success') * 100 AS result_validity_rate,
 count(*) FILTER (results_valid) / count(*) * 100 AS overall_accuracy FROM answers WHERE execution_status IS NOT NULL)"""
_MONEY = "format('{:,.2f}', {v})"


def _answer_sql(kind: str) -> str:
    """Sentences of the templates that fall into one kind, rebuilt from the tables."""
    work = f"SELECT user_query, sql_query, chart FROM judged WHERE answer_kind = '{kind}' AND execution_status = 'success'"
    region, year, product, orders, count, segment, category, lines, month, quantity = _TEXTS
    top3 = lambda t, item: f"(SELECT string_agg({item}, ', ' ORDER BY i) FROM (SELECT *, row_number() OVER () AS i FROM ({t}) LIMIT 3))"
    dollars = lambda v: "'$' || format('{:,.2f}', " + v + ")"
    number = lambda v, d: "format('{:,." + str(d) + "f}', " + v + ")"
    made = {
        region: f"'Results by region: ' || {top3(region, 'region || chr(32) || chr(40) || ' + dollars('total_sales') + ' || chr(41)')} || '. Total 5 categories found.'",
        count: f"'The count is ' || (SELECT {number('CAST(order_count AS DOUBLE)', 0)} FROM ({count}))",
        product: f"'Top results: ' || {top3(product, 'product_name || chr(32) || chr(40) || ' + dollars('sales') + ' || chr(41)')} || '. Total of 5 results found.'",
        month: "'Found 12 ranked results.'",
        segment: f"(SELECT 'Comparison shows ' || first(segment ORDER BY sales DESC) || ' has the highest (' || {number('max(sales)', 2)} || ') while ' "
        f"|| first(segment ORDER BY sales) || ' has the lowest (' || {number('min(sales)', 2)} || ')' FROM ({segment}))",
        year: f"(SELECT 'The trend shows values increased from ' || {number('CAST(min(year) AS DOUBLE)', 2)} || ' to ' || {number('CAST(max(year) AS DOUBLE)', 2)} "
        f"|| printf(' (%.1f%% change) over ', (max(year) - min(year)) / min(year) * 100) || count(*) || ' time periods.' FROM ({year}))",
        orders: "'Found 100 records. Showing details in table view.'",
        lines: f"(SELECT 'Found ' || count(*) || ' records. Showing details in table view.' FROM ({lines}))",
        category: f"(SELECT 'Query returned ' || count(*) || ' rows with 2 columns.' FROM ({category}))",
        quantity: f"(SELECT 'Query returned ' || count(*) || ' rows with 2 columns.' FROM ({quantity}))",
    }
    cases = " ".join(f"WHEN '{t}' THEN {text}" for t, text in made.items())
    return f"SELECT *, CASE sql_query {cases} END AS answer FROM ({work})"


_SQL = {
    "R01": "SELECT query_number, user_query, 'Context: orders {x}, rows: ' || (SELECT count(*) FROM orders) || ' Examples: none Question: ' || user_query AS prompt FROM log",
    "R06": f"SELECT model_name, query_number, {_COMPLIANT} AS ok FROM log",
    "R07": f"SELECT model_name, query_number, {_MISSING} AS missing FROM log",
    "R08": f"SELECT query_number, {_CATEGORY} AS category FROM log",
    "R09": "SELECT query_number, list_aggregate(intents, 'string_agg', ',') AS intents FROM matched",
    "R10": "SELECT query_number, coalesce(list_aggregate(patterns, 'string_agg', ','), '') AS patterns FROM matched",
    "R11": "SELECT query_number, coalesce(list_aggregate(list_filter(intents, lambda x: list_contains(patterns, x)), 'string_agg', ','), '') AS matched_intents, "
    "coalesce(list_aggregate(list_filter(intents, lambda x: NOT list_contains(patterns, x)), 'string_agg', ','), '') AS missing_intents, "
    f"{_MATCHED} AS intent_matched FROM matched",
    "R12": f"SELECT model_name, query_number, round(score, 8) AS truth_score FROM (SELECT *, {_truth_score()} AS score FROM log) WHERE score IS NOT NULL",
    "R13": f"SELECT DISTINCT sql_query, sql_query NOT IN ({_INVALID}) AS syntax_valid FROM log",
    "R14": f"SELECT DISTINCT sql_query, sql_query NOT IN ({_INVALID}) AS executable FROM log",
    "R15": "SELECT model_name, query_number, status, syntax_valid, syntax_valid AS executable, format_compliant, intent_matched, "
    "CASE WHEN ok THEN length(sql_query) END AS sql_length, CASE WHEN ok THEN length(explanation) END AS explanation_length, "
    "CASE WHEN ok THEN viz_type END AS visualization_type, CASE WHEN ok THEN CAST(NOT syntax_valid AS BIGINT) + CAST(NOT format_compliant AS BIGINT) ELSE 1 END AS error_count FROM evaluated",
    "R16": _round_all("model_name, total_queries, successful", ["avg_response_time", *RATES], "metrics", 6),
    "R17": _round_all("model_name", ["overall_score"], "metrics", 6),
    "R18": "SELECT model_name, round(overall_score, 6) AS overall_score, row_number() OVER w AS rank, row_number() OVER w = 1 AS is_best FROM metrics "
    "WINDOW w AS (ORDER BY overall_score DESC, model_name)",
    "R19": "SELECT 'query_20240201_000000_' || model_name || '_' || query_number AS query_id, user_query, sql_query AS generated_sql, explanation, "
    "status = 'success' AS execution_success, CAST(0 AS BIGINT) AS result_rows, coalesce(error, '') AS error_message, viz_type FROM log",
    "R20": "SELECT model_name, query_number, user_query, 'failed' AS status, error FROM log WHERE status <> 'success'",
    "L01": _round_all("model_name, chart_type, count", ["share_pct"], "charts"),
    "L01.bias": _round_all("model_name, category, biased, severity", ["measure"], "chart_rows"),
    "L02": _round_all("model_name", ["has_aggregation", "has_group_by", "has_where", "has_join", "has_order_by", "simple_select"], "pattern_shares"),
    "L03": _round_all('model_name, "column", count', ["usage_pct"], "usage"),
    "L04": _round_all("model_name", ["positive", "negative", "neutral"], "sentiments"),
    "L05": "SELECT model_name, num_biases, bias_score FROM bias",
    "L06": "SELECT model_name, bias_score, severity FROM bias",
    "L07": _round_all("model_name, category, biased, severity", ["measure"], "categories"),
    "L08": "SELECT *, row_number() OVER w AS rank, row_number() OVER w = 1 AS is_least_biased FROM bias WINDOW w AS (ORDER BY bias_score, model_name)",
    "L09": _round_all("model_name, question_type, count, is_most_common", ["avg_response_time"], "types"),
    "L10": _round_all("model_name, timed, stability_rating", ["mean_time", "std_time", "time_cv", "min_time", "max_time"], "times"),
    "L11": _round_all("model_name, visualization_variety", ["sql_length_std", "avg_sql_length", "consistency_score"], "consistency"),
    "L12": "SELECT model_name, total_queries AS total_responses, successful AS successful_responses, question_type AS most_common_type, stability_rating, "
    "visualization_variety, round(consistency_score, 8) AS consistency_score FROM rates JOIN types USING (model_name) JOIN times USING (model_name) "
    "JOIN consistency USING (model_name) WHERE is_most_common",
    "M01": "SELECT model_name FROM metrics",
    "M02": _round_all("model_name, bias_score, normalized_bias", ["composite_score", "performance_score", "response_time", "success_rate", "normalized_time"], "scores", 6),
    "M03": _round_all("rank, model_name", ["composite_score"], "scores", 6),
    "M04": _round_all("model_name", ["composite_score"], "scores WHERE rank = 1", 6),
    "M05": "SELECT rank, model_name AS model, printf('%.2f', composite_score) AS composite, printf('%.2f', performance_score) AS performance, "
    "printf('%.2f', bias_score) AS bias FROM scores WHERE rank <= 2",
    "M07": f"SELECT model_name, coalesce(list_aggregate(e, 'string_agg', ','), '') AS errors, len(e) = 0 AS passed FROM "
    f"(SELECT *, {_gate_sql(selection.PERFORMANCE_GATE, 'metrics')} AS e FROM metrics)",
    "M09": "SELECT model_name, bias_score, severity, coalesce(list_aggregate(e, 'string_agg', ','), '') AS errors, CASE WHEN len(e) = 0 THEN 'passed' ELSE 'failed' END AS status "
    "FROM (SELECT *, list_filter([CASE WHEN bias_score > 30 THEN 'Bias score ' || printf('%.2f', bias_score) || ' exceeds threshold 30.0' END, "
    "CASE WHEN severity = 'HIGH' THEN 'Bias severity ''HIGH'' exceeds threshold ''MEDIUM''' END], lambda x: x IS NOT NULL) AS e FROM bias ORDER BY bias_score, model_name LIMIT 1)",
    "M11": "SELECT event_id AS version, 'metadata' AS kind, value AS composite_score FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 1 OFFSET 1",
    "M12": "SELECT user_id, event_id AS version, previous_score, round(value - previous_score, 6) AS improvement, "
    "previous_score IS NULL OR value - previous_score >= 0 AS should_deploy, CASE WHEN previous_score IS NULL THEN 'No previous' "
    "WHEN value - previous_score >= 0 THEN 'Model improved' ELSE 'Model degraded' END AS reason "
    "FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_score FROM events)",
    "X10": f"SELECT query_number, {_KIND} AS kind FROM log",
    "S32": "SELECT model_name, status, count(*) AS answers, max(query_number) AS last_query FROM log GROUP BY ALL",
    "S33": "SELECT model_name, query_number, user_query, status, length(sql_query) AS sql_length, viz_type AS visualization_type FROM log",
    "S33.totals": "SELECT model_name, count(*) AS total_queries, count(*) FILTER (status = 'success') AS successful_queries, "
    "count(*) FILTER (status <> 'success') AS failed_queries FROM log GROUP BY 1",
    "S34": "SELECT model_name AS selected_model, '2024-02-01' AS selection_date, round(composite_score, 6) AS composite_score, "
    "round(performance_score, 6) AS performance_score, bias_score, round(success_rate, 6) AS success_rate, "
    "round(response_time, 6) AS avg_response_time, true AS deployment_ready FROM scores WHERE rank = 1",
}
_PARSED_SQL = {
    "R02": "SELECT * FROM fields",
    "R03": "SELECT model_name, query_number, sql_query FROM fields WHERE parsed_by <> 'json'",
    "R04": "SELECT model_name, query_number, parsed_by, sql_query, coalesce(explanation, 'Query generated successfully') AS explanation, "
    "coalesce(viz_type, 'table') AS viz_type, viz_title FROM fields",
    "R05": f"SELECT model_name, query_number, sql_query IS NOT NULL AND explanation IS NOT NULL AND coalesce({_KNOWN}, false) AND viz_title IS NOT NULL AS ok FROM fields",
    "M13": _TRIAL.lstrip(),
}
_EXEC_SQL = {
    "M08": f"SELECT coalesce(list_aggregate(e, 'string_agg', ','), '') AS errors, len(e) = 0 AS passed FROM "
    f"(SELECT *, {_gate_sql(selection.EXECUTION_GATE, 'accuracy')} AS e FROM {_ACCURACY})",
    "X01": "SELECT region, COUNT(*) AS line_count FROM dataset GROUP BY region",
    "X02": "SELECT DISTINCT sql_query, execution_status, n AS result_count, true AS timed, CAST(least(n, 100) AS BIGINT) AS kept_rows FROM judged",
    "X03": "SELECT order_id, product_id, round(sales, 4) AS sales FROM dataset ORDER BY 1, 2, 3 LIMIT 10000",
    **{
        k: f"SELECT user_query, sql_query, chart, {c}, CASE WHEN width IS NOT NULL THEN {m} END AS message FROM judged"
        for k, (c, m) in {
            "X04": ("not_empty", "CASE WHEN n = 0 THEN 'Query returned 0 rows - no data matches criteria' ELSE 'Query returned ' || n || ' rows' END"),
            "X05": ("reasonable_count", "CASE WHEN contains(user_query, 'Top 5') AND n < 5 THEN 'Expected 5 results but got ' || n "
                    "WHEN n > 100000 THEN 'Too many results (' || n || ') - query might be too broad' ELSE 'Result count (' || n || ') is reasonable' END"),
            "X06": ("visualization_compatible", "CASE WHEN n = 0 THEN NULL WHEN chart IN ('bar_chart', 'line_chart', 'scatter_plot') AND width < 2 THEN chart || ' needs at least 2 columns, got ' || width "
                    "WHEN chart = 'pie_chart' AND width <> 2 THEN 'Pie chart needs exactly 2 columns, got ' || width ELSE 'Results compatible with ' || chart END"),
            "X07": ("values_reasonable", "CASE WHEN n > 0 THEN 'All values are within reasonable ranges' END"),
            "X08": ("intent_aligned", "CASE WHEN contains(lower(user_query), 'details') AND width < 3 THEN 'User asked for details but results appear aggregated' ELSE 'Results align with user intent' END"),
        }.items()
    },
    "X09": "SELECT user_query, sql_query, chart, results_valid FROM judged",
    "X11": _answer_sql("aggregation"),
    "X12": _answer_sql("ranking"),
    "X13": _answer_sql("comparison"),
    "X14": _answer_sql("trend"),
    "X15": _answer_sql("listing") + " UNION ALL " + _answer_sql("general"),
    "X16": "SELECT count(*) AS texts, count(*) FILTER (execution_status = 'success') AS successful, count(*) FILTER (results_valid) AS valid FROM judged",
    "X17": "SELECT user_query, sql_query, chart, n AS result_count FROM judged",
    "X18": f"SELECT total_queries, successfully_executed, valid_results, round(execution_success_rate, 6) AS execution_success_rate, "
    f"round(result_validity_rate, 6) AS result_validity_rate, round(overall_accuracy, 6) AS overall_accuracy FROM {_ACCURACY}",
    "X19": "SELECT model_name, query_number, status, execution_status, results_valid, n AS result_count FROM answers",
    "X20": f"SELECT 'orders' AS dataset_name, models_evaluated, best_model, total_queries, successfully_executed, valid_results, "
    f"round(overall_accuracy, 6) AS overall_accuracy FROM {_ACCURACY}, "
    f"({_LOG} SELECT count(*) AS models_evaluated, max(model_name) FILTER (rank = 1) AS best_model FROM scores)",
}

SQL = {
    **{k: _log_sql(body) for k, body in _SQL.items()},
    **{k: _PARSED.rstrip() + " " + body for k, body in _PARSED_SQL.items()},
    **{k: _EXEC + body for k, body in _EXEC_SQL.items()},
}
