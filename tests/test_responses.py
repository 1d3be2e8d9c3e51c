"""Response log scoring, stability, selection, execution."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from orderlore.operators import execution, responses, selection, stability

LOG = (
    "model_name string, query_number bigint, user_query string, raw_response string, sql_query string, "
    "visualization struct<type:string,title:string,x_axis:string,y_axis:string,x_label:string,y_label:string,labels:string,values:string>, "
    "explanation string, response_time double, status string, error string"
)


def answer(number, question, sql, chart="bar_chart", explanation="Shows excellent performance of top products", time=1.0,
           status="success", raw=None, model="m"):
    return (model, number, question, raw, sql, (chart, "Title", "x", "y", None, None, None, None), explanation, time, status, None)


def log(spark, *answers):
    return spark.createDataFrame(list(answers), LOG)


TOP = "SELECT product_name, SUM(sales) as total FROM dataset GROUP BY product_name ORDER BY total DESC LIMIT 5"


@pytest.mark.parametrize(
    "raw, source, sql, chart, title",
    [
        ('{"sql_query": "S", "visualization": {"type": "table", "title": "T"}, "explanation": "E"}', "json", "S", "table", "T"),
        ('```json\n{"sql_query": "S"}\n```', "json", "S", "table", "Query Results"),
        ('Answer: {"sql_query": "S", "visualization": {"title": "T"}} done', "json", "S", "table", "T"),
        ('{"sql_query": "S", "visualization": {"type": "pie_chart"}}', "json", "S", "pie_chart", "Query Results"),
        ('{"sql_query": "S", "visualization": {"x_axis": "a"}}', "json", "S", "table", None),
        ("Use SELECT a\nFROM dataset WHERE b; thanks", "sql", "SELECT a\nFROM dataset WHERE b;", "table", "Query Results"),
        ("select 1 from other", "sql", "select 1 from other", "table", "Query Results"),
        ("no idea", "default", responses.DEFAULT_SQL, "table", "Data Preview"),
    ],
)
def test_parsing_and_defaults(spark, raw, source, sql, chart, title):
    parsed = responses.fill_defaults(responses.parse_responses(log(spark, answer(1, "q", None, raw=raw))))
    r = parsed.first()
    assert (r["parsed_by"], r["sql_query"], r["visualization"]["type"], r["visualization"]["title"]) == (source, sql, chart, title)
    assert r["explanation"]


def test_prompt_keeps_braces_of_inserted_text(spark):
    meta = spark.createDataFrame([("d", "has {user_query} inside")], "dataset_name string, llm_context string")
    q = spark.createDataFrame([(1, "why?")], "query_number bigint, user_query string")
    r = responses.build_prompts(q, meta, "d", "none", "C:{dataset_context} E:{few_shot_examples} Q:{user_query}").first()
    assert r["prompt"] == "C:has {user_query} inside E:none Q:why?"


def test_intents_and_patterns(spark):
    r = responses.match_intents(log(spark, answer(1, "What are the top 5 products by sales?", TOP))).first()
    assert r["intents"] == ["sorting", "grouping"] and r["intent_matched"]
    assert r["patterns"] == ["aggregation", "sorting", "grouping"]


def test_compliance(spark):
    df = log(spark, answer(1, "q", TOP), answer(2, "q", "short"), answer(3, "q", TOP, chart="heatmap"), answer(4, "q", TOP, explanation="brief"))
    assert rows(df.select("query_number", responses.is_compliant())) == [(1, True), (2, False), (3, False), (4, False)]


def test_model_metrics_and_ranking(spark):
    df = log(
        spark, answer(1, "top 5 products by sales", TOP), answer(2, "total", "SELEC x"), answer(3, "total", None, status="failed"),
        answer(1, "list", None, status="failed", model="n"),
    )
    checked = spark.createDataFrame(
        [(TOP, True, True, None), ("SELEC x", False, False, "Syntax error")],
        "sql_query string, syntax_valid boolean, executable boolean, error string",
    )
    got = {r["model_name"]: r for r in responses.compare_models(responses.model_metrics(responses.evaluate(df, checked))).collect()}
    assert got["m"]["success_rate"] == pytest.approx(200 / 3) and got["m"]["syntax_validity_rate"] == 50.0
    assert got["n"]["overall_score"] == 0.0 and got["m"]["is_best"] and not got["n"]["is_best"]


def test_bias_of_uniform_answers(spark):
    df = log(spark, *[answer(i, "q", f"SELECT category, SUM(sales) FROM dataset WHERE {i} GROUP BY category") for i in range(3)])
    r = stability.bias_scores(df, ["category", "sales", "profit"]).first()
    # one chart type (HIGH 40), aggregation only (MEDIUM 25), positive wording only (LOW 10)
    assert (r["bias_score"], r["severity"], r["num_biases"]) == (75.0, "HIGH", 3)
    single = stability.bias_scores(log(spark, answer(1, "q", TOP)), None).first()
    assert (single["bias_score"], single["severity"]) == (0.0, "UNKNOWN")


def test_stability_needs_five_answers(spark):
    few = stability.stability_report(log(spark, *[answer(i, "total", TOP) for i in range(4)])).first()
    assert few["stability_rating"] is None and few["total_responses"] == 4
    enough = stability.stability_report(log(spark, *[answer(i, "total", TOP, time=1.0 + i) for i in range(5)])).first()
    assert (enough["most_common_type"], enough["stability_rating"]) == ("aggregation", "moderate")
    assert enough["consistency_score"] == 100.0


def test_composite_scores(spark):
    evaluation = spark.createDataFrame(
        [("2.0-flash", 85.5, 90.0, 1.2), ("1.5-pro", 92.0, 95.0, 2.5), ("1.5-flash", 80.0, 85.0, 0.8), ("alone", 99.0, 99.0, 0.1)],
        "model_name string, overall_score double, success_rate double, avg_response_time double",
    )
    bias = spark.createDataFrame(
        [("2.0-flash", 25.0), ("1.5-pro", 15.0), ("1.5-flash", 40.0)], "model_name string, bias_score double"
    )
    ranking = selection.rank_models(selection.composite_scores(evaluation, bias)).orderBy("rank").collect()
    assert [(r["model_name"], round(r["composite_score"], 6)) for r in ranking] == [
        ("1.5-pro", 86.0), ("2.0-flash", 81.85), ("1.5-flash", 74.9),
    ]
    with pytest.raises(ValueError):
        selection.select_best(evaluation, bias.where("model_name = 'x'"))


def test_gates(spark):
    metrics = spark.createDataFrame(
        [("m", 70.0, 90.0, 99.0, 71.0)],
        "model_name string, overall_score double, success_rate double, syntax_validity_rate double, intent_matching_rate double",
    )
    r = selection.performance_gate(metrics).first()
    assert r["errors"] == ["Overall score 70.00 below threshold 75.0"] and not r["passed"]
    assert selection.performance_gate(metrics, {"overall_score": 60}).first()["passed"]
    bias = spark.createDataFrame([("m", 65.0, "HIGH")], "model_name string, bias_score double, severity string")
    assert selection.bias_gate(bias).first()["errors"] == [
        "Bias score 65.00 exceeds threshold 30.0", "Bias severity 'HIGH' exceeds threshold 'MEDIUM'",
    ]


def test_versions(spark):
    v = spark.createDataFrame(
        [(1, "selection", 1, 50.0), (2, "selection", 2, 55.0), (3, "metadata", 3, 60.0), (4, "metadata", 4, 58.0)],
        "version int, kind string, updated int, composite_score double",
    )
    assert selection.previous_version(v).first()["version"] == 3
    assert selection.previous_version(v.where("kind = 'selection'")).first()["version"] == 1
    assert selection.previous_version(v.where("version = 4")).count() == 0
    assert [r["reason"] for r in selection.promotion(v).orderBy("version").collect()] == [
        "No previous model to compare", "Model improved by 5.00 points", "Model improved by 5.00 points",
        "Model degraded by 2.00 points",
    ]


def test_sliced_history_equals_whole_history(spark):
    v = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("model"),
        F.col("id").alias("version"), (F.col("id") * 7919 % 97).alias("updated"), (F.col("id") * 31 % 50).cast("double").alias("composite_score"),
    )
    whole = rows(selection.with_previous(v, ["model"]), "version", "previous_score")
    assert whole == rows(selection.with_previous(v, ["model"], F.floor(F.col("updated") / 10)), "version", "previous_score")


def test_tuning_marks_first_best_or_none(spark):
    good, half = '{"sql_query": "S", "visualization": {}}', "{}"
    trials = spark.createDataFrame(
        [(0.2, 0.8, 40, half), (0.4, 0.8, 60, good), (0.6, 0.9, 40, good)],
        "temperature double, top_p double, top_k int, raw_response string",
    )
    result = selection.tune(trials)
    assert result.count() == 12
    assert rows(result.where("is_best"), "temperature", "top_k", "score") == [(0.4, 60, 100.0)]
    assert selection.tune(trials.withColumn("raw_response", F.lit("bad"))).where("is_best").count() == 0


@pytest.fixture(scope="module")
def dataset(spark):
    df = spark.createDataFrame(
        [("A", 10.0, 2020), ("A", 20.0, 2021), ("B", 5.0, 2022)], "region string, sales double, year int"
    )
    execution.bind_dataset(df)
    return df


def outcome(spark, question, sql, chart="bar_chart"):
    return execution.execute_and_validate(spark.table("dataset"), question, sql, chart)


BY_REGION = "SELECT region, SUM(sales) AS total_sales FROM dataset GROUP BY region ORDER BY total_sales DESC"


ANSWERS = [
    ("total sales", "SELECT SUM(sales) AS sales FROM dataset", "The total is $35.00"),
    ("how many rows", "SELECT COUNT(*) AS row_count FROM dataset", "The count is 3"),
    ("total by region", BY_REGION, "Results by region: A ($30.00), B ($5.00). Total 2 categories found."),
    ("best regions", BY_REGION, "Top results: A ($30.00), B ($5.00). Total of 2 results found."),
    ("compare regions", BY_REGION, "Comparison shows A has the highest (30.00) while B has the lowest (5.00)"),
    ("sales trend", "SELECT sales, year FROM dataset ORDER BY year",
     "The trend shows values decreased from 10.00 to 5.00 (50.0% change) over 3 time periods."),
    ("list them", BY_REGION, "Found 2 records. Showing details in table view."),
    ("regions?", BY_REGION, "Query returned 2 rows with 2 columns."),
    ("regions?", "SELECT * FROM dataset WHERE sales > 99", "No results found for your query."),
]
_answered = {}


def answered(spark, dataset):
    """All cases as one log."""
    if not _answered:
        log = spark.createDataFrame([(q, s, ("bar_chart",)) for q, s, _ in ANSWERS], "user_query string, sql_query string, visualization struct<type: string>")
        _answered.update({(r["user_query"], r["sql_query"]): r["answer"] for r in execution.execute_batch(log, dataset).collect()})
    return _answered


@pytest.mark.parametrize("question, sql, text", ANSWERS)
def test_answers(spark, dataset, question, sql, text):
    assert answered(spark, dataset)[question, sql] == text


def test_result_checks(spark, dataset):
    assert not outcome(spark, "top 3 regions", BY_REGION)["reasonable_count"]
    assert not outcome(spark, "regions", "SELECT COUNT(*) AS n FROM dataset")["visualization_compatible"]
    assert not outcome(spark, "x", "SELECT region, 0 AS z FROM dataset")["values_reasonable"]
    assert not outcome(spark, "x", "SELECT region, 2e10 AS z FROM dataset")["values_reasonable"]
    assert not outcome(spark, "sales in 2023", BY_REGION)["intent_aligned"]
    assert not outcome(spark, "show details", BY_REGION, "table")["intent_aligned"]
    assert outcome(spark, "total sales by region", BY_REGION)["results_valid"]


def test_only_queries_run(spark, dataset):
    for text in ("DROP VIEW dataset", "CREATE TABLE x (a int)", "SELECT nothing FROM dataset", "SELECT 1) ; DROP VIEW dataset"):
        assert outcome(spark, "q", text)["execution_status"] == "failed"
    assert spark.table("dataset").count() == 3


def test_messages(spark, dataset):
    said = outcome(spark, "top 3 regions", BY_REGION)["messages"]
    assert said["not_empty"] == "Query returned 2 rows" and said["reasonable_count"] == "Expected 3 results but got 2"
    assert said["visualization_compatible"] == "Results compatible with bar_chart"
    said = outcome(spark, "show details of 2023", "SELECT 'a' AS x", "pie_chart")["messages"]
    assert said["visualization_compatible"] == "Pie chart needs exactly 2 columns, got 1"
    assert said["intent_aligned"] == "User asked about specific year but results have no date columns"
    said = outcome(spark, "x", "SELECT 0 AS z, double('inf') AS y, 1 AS w")["messages"]
    assert said["values_reasonable"] == "Column 'z' is all zeros; Column 'y' contains infinite values; Column 'y' has extreme values (>1e10)"
    nothing = outcome(spark, "x", "SELECT * FROM dataset WHERE sales > 99")
    assert nothing["messages"]["not_empty"].startswith("Query returned 0 rows") and nothing["messages"]["values_reasonable"] is None


def test_first_rows_and_repeated_names(spark, dataset):
    made = outcome(spark, "list", "SELECT region, sales, sales AS region, CAST(NULL AS INT) AS gone FROM dataset ORDER BY sales")
    assert made["result_count"] == 3 and json.loads(made["first_rows"])[0] == {"region": 5.0, "sales": 5.0, "gone": None}
    many = outcome(spark, "list", "SELECT id FROM range(0, 5000, 1, 300) ORDER BY id DESC")
    assert [r["id"] for r in json.loads(many["first_rows"])] == list(range(4999, 4899, -1))


def _executions(spark):
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_queries_of_a_batch_share_jobs(spark, dataset):
    """Work on the driver follows the batches, not the texts, and a text that fails at run time takes no other along."""
    texts = [f"SELECT region, SUM(sales) + {i} AS s FROM dataset GROUP BY region" for i in range(24)]
    log = lambda texts: spark.createDataFrame([(q, t, ("table",)) for t in texts for q in ("a", "b")], "user_query string, sql_query string, visualization struct<type: string>")
    before = _executions(spark)
    few = execution.execute_batch(log(texts[:3]), dataset, batch=24)
    between = _executions(spark)
    made = execution.execute_batch(log(texts), dataset, batch=24)
    assert few.count() == 6 and made.where("execution_status = 'success' and results_valid").count() == 48
    assert made.where("run_texts = 24 and elapsed_seconds > 0").count() == 48
    assert _executions(spark) - between <= between - before + 4
    bad = [*texts[:5], "SELECT 1 / (year - 2020) AS x FROM dataset", "SELECT nothing FROM dataset", "SELECT raise_error('no') AS x"]
    got = {r["sql_query"]: r for r in execution.execute_batch(log(bad), dataset).collect()}
    assert {t: r["execution_status"] for t, r in got.items()} == {t: "success" if t in texts else "failed" for t in bad}
    assert "DIVIDE_BY_ZERO" in got[bad[5]]["error"] and "nothing" in got[bad[6]]["error"]
    checked = {r["sql_query"]: (r["syntax_valid"], r["executable"]) for r in execution.check_sql(log(bad), dataset).collect()}
    assert checked == {t: (t != bad[6], t in texts) for t in bad}


def test_runs_do_not_see_each_other(spark, dataset):
    other = spark.createDataFrame([("Z", 1.0, 1999)], dataset.schema)
    assert execution.execute_and_validate(other, "x", "SELECT * FROM dataset", "table")["result_count"] == 1
    assert outcome(spark, "x", "SELECT * FROM dataset", "table")["result_count"] == 3
    assert spark.table("dataset").count() == 3


def test_check_sql_deduplicates_texts(spark, dataset):
    df = log(spark, *[answer(i, "q", BY_REGION) for i in range(3)], answer(9, "q", "SELEC"))
    got = {r["sql_query"]: (r["syntax_valid"], r["executable"]) for r in execution.check_sql(df, dataset).collect()}
    assert got == {BY_REGION: (True, True), "SELEC": (False, False)}


def test_accuracy_and_merge(spark, dataset):
    df = log(spark, answer(1, "total sales by region", BY_REGION), answer(2, "q", "SELEC"), answer(3, "q", BY_REGION, status="failed"))
    merged = execution.merge_outcomes(df, execution.execute_batch(df.where(responses.succeeded()), dataset))
    assert rows(merged, "query_number", "execution_status") == [(1, "success"), (2, "failed"), (3, None)]
    r = execution.accuracy(merged.where("execution_status IS NOT NULL")).first()
    assert (r["execution_success_rate"], r["result_validity_rate"], r["overall_accuracy"]) == (50.0, 100.0, 50.0)


@pytest.mark.parametrize(
    "texts, named",
    [
        (["SELECT region, SUM(Sales) FROM dataset GROUP BY region", "SELECT missing FROM dataset"], ["region", "sales"]),
        (["SELECT COUNT(*) FROM dataset"], ["order_id"]),
        (["SELECT total_sales FROM dataset"], ["order_id"]),
        (["SELECT COUNT( * ) FROM (SELECT DISTINCT * FROM dataset)"], None),
        (["SELECT profit FROM dataset", "SELECT 1 FROM (TABLE dataset)"], None),
        (["SELECT 1 FROM (FROM dataset)"], None),
    ],
)
def test_columns_that_texts_can_read(spark, texts, named):
    from orderlore.plans.star import SALES_COLUMNS

    found = execution.columns_read(log(spark, *[answer(i, "q", t) for i, t in enumerate(texts)]), SALES_COLUMNS)
    assert sorted(found) == sorted(named or SALES_COLUMNS)


def test_texts_run_on_the_columns_they_read(spark, dataset):
    texts = ["SELECT region, sales FROM dataset", "SELECT missing FROM dataset", "SELECT profit FROM dataset", "SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dataset)"]
    asked = log(spark, *[answer(i, "Total sales", t) for i, t in enumerate(texts)])
    figures = ["sql_query", "execution_status", "result_count", "first_rows", "error"]
    whole = rows(execution.execute_batch(asked, dataset), *figures)
    narrow = dataset.select(*execution.columns_read(asked, dataset.columns))
    assert rows(execution.execute_batch(asked, dataset, narrow=narrow), *figures) == whole
    # a text whose columns are not among the stored ones goes to the whole table
    assert rows(execution.execute_batch(asked, dataset, narrow=dataset.select("region")), *figures[:4]) != []


def test_a_text_joins_only_what_it_reads(spark, sf):
    from checks.answers import QUERIES

    plan = QUERIES["X03"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "profit" not in plan


def test_best_model_is_computed_once(spark):
    metrics = spark.createDataFrame([("a", 80.0, 1.0, 90.0), ("b", 90.0, 1.0, 90.0)], "model_name string, overall_score double, avg_response_time double, success_rate double")
    best = selection.select_best(metrics, metrics.select("model_name", F.lit(0.0).alias("bias_score")))
    assert "Join" not in best._jdf.queryExecution().executedPlan().toString()
    assert [r["model_name"] for r in best.collect()] == ["b"]


def test_texts_are_folded_once_a_row(spark):
    matched = responses.match_intents(log(spark, answer(1, "Top sales", TOP)))
    plan = matched._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("upper(") == 1 and "lambda" not in plan
