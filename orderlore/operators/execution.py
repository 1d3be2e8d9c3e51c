"""Running generated SQL: validity, executability, results, checks and answers (R13, R14, X).

Each distinct text is boiled down to one row of figures by `sql_runs`, many texts to a job. All that depends on the question or
the chart (checks, messages, sentences) are expressions over those figures, joined to the log, so the driver handles each text
once, however often it was asked.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlore.functions.numeric import is_datetime, is_number
from orderlore.functions.numeric import percent
from orderlore.functions.text import first_label, has_any
from orderlore.operators.sql_runs import BATCH, VIEW, as_query, columns_named, run_texts
from orderlore.session import materialise

CHECK_LIMIT = 100
SAFETY_LIMIT = 10_000
KEPT_ROWS = 100
TOO_MANY_ROWS = 100_000
EXTREME_VALUE = 1e10
# partitions whose first rows meet in one task before all do
HEADS = 64

# fixed values: words that decide how a result is put into a sentence, in order
ANSWER_KINDS = {
    "aggregation": ["total", "sum", "how much", "how many"],
    "ranking": ["top", "best", "highest", "worst", "bottom"],
    "comparison": ["compare", "versus", "between"],
    "trend": ["trend", "over time", "growth"],
    "listing": ["list", "show all", "display"],
}
DETAIL_PHRASES = ["list all", "show all", "details", "show me all"]
TOTAL_PHRASES = ["total", "sum", "how much", "how many"]
CHECKED_YEARS = ["2023", "2024", "2025"]
MONEY_WORDS = ["sales", "revenue", "amount", "price", "cost"]
LIST_MONEY_WORDS = ["sales", "revenue", "amount"]


def bind_dataset(df: DataFrame) -> None:
    """The table the generated SQL calls `dataset`."""
    df.createOrReplaceTempView(VIEW)


def _limited(result: DataFrame, limit: int) -> DataFrame:
    """The result, limited when its plan has no limit of its own; the word alone, as in a name, is none."""
    plan = result._jdf.queryExecution().analyzed().toString()
    return result if re.search(r"^\W*(Global|Local)Limit\b", plan, re.MULTILINE) else result.limit(limit)


def run_query(spark: SparkSession, text: str, limit: int = SAFETY_LIMIT) -> DataFrame:
    """The rows of one text, at most `limit` if it names no limit."""
    return _limited(as_query(spark, text), limit)


def _plain(result: DataFrame) -> DataFrame:
    """Columns by place, as a generated query may name several alike."""
    return result.toDF(*[f"c{i}" for i in range(len(result.columns))])


def _record(names: list[str]) -> Column:
    """A row of `_plain` as JSON under its own names."""
    return F.to_json(F.struct(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)]), {"ignoreNullFields": "false"})


def _ran(result: DataFrame) -> DataFrame:
    """One row that can't be told without computing every value of the first rows."""
    limited = _limited(result, CHECK_LIMIT)
    return _plain(limited).agg(F.coalesce(F.sum(F.length(_record(limited.columns))), F.lit(0)).alias("size"))


def columns_read(log: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that a table must have for the texts of the log to run on it."""
    return columns_named(log.where(F.col("sql_query").isNotNull()).select("sql_query"), columns)


def check_sql(log: DataFrame, dataset: DataFrame, execute: bool = True, batch: int = BATCH, narrow: DataFrame | None = None) -> DataFrame:
    """(sql_query, syntax_valid, executable, error) per distinct text of the log.

    A text is valid when it analyses against the real table, executable when its first rows can be
    computed, from `narrow` (the columns of `columns_read`) if that is given.
    """
    texts = log.where(F.col("sql_query").isNotNull()).select("sql_query").distinct()
    found = run_texts(texts, dataset, "size bigint", _ran, execute, batch, narrow)
    kind = F.when(F.col("valid"), "Execution error: ").otherwise("Syntax error: ")
    return found.select("sql_query", F.col("valid").alias("syntax_valid"), F.col("done").alias("executable"), F.concat(kind, "error").alias("error"))


# --- figures of one result -------------------------------------------------------------------------

#: What the checks and sentences need to know of a result: its shape, its first numeric column beside its first label, its
#: first rows.
FIGURES = (
    "n bigint, width int, numbers int, dated boolean, number_name string, label_name string, issues array<string>, first double, "
    "last double, total double, filled bigint, maximum double, high string, minimum double, low string, "
    "items array<struct<label: string, value: double>>, first_rows string"
)


def figures(result: DataFrame) -> DataFrame:
    """One row of FIGURES from one pass over the rows.

    Rows are folded twice, by groups of partitions and then over all, so that the first rows of very many partitions don't
    meet in one task.
    """
    fields = result.schema.fields
    numeric = [i for i, f in enumerate(fields) if is_number(f.dataType)]
    label = next((i for i, f in enumerate(fields) if isinstance(f.dataType, T.StringType)), None)
    dated = any(is_datetime(f.dataType) or "date" in f.name.lower() or "year" in f.name.lower() for f in fields)
    null = F.lit(None).cast("double")
    place = F.col("_row")
    value = F.col(f"c{numeric[0]}").cast("double") if numeric else null
    name = F.col(f"c{label}") if label is not None else F.lit(None).cast("string")
    early = place.bitwiseAND((1 << 33) - 1) < KEPT_ROWS
    head = F.struct(place.alias("row"), name.alias("label"), value.alias("value"), _record([f.name for f in fields]).alias("json"))
    first = lambda rows: F.slice(F.array_sort(rows), 1, KEPT_ROWS)
    # how each figure comes from rows, and from two of its kind
    folds = {
        "n": (F.count("*"), F.sum),
        "head": (first(F.collect_list(F.when(early, head))), lambda c: first(F.flatten(F.collect_list(c)))),
        "first": (F.min(F.struct(place.alias("row"), value.alias("value"))), F.min),
        "last": (F.max(F.struct(place.alias("row"), value.alias("value"))), F.max),
        "total": (F.sum(value), F.sum),
        "filled": (F.count(value), F.sum),
        "maximum": (F.max(value), F.max),
        "minimum": (F.min(value), F.min),
        "high": (F.min(F.when(value.isNotNull(), F.struct((-value).alias("rank"), place.alias("row"), name.alias("label")))), F.min),
        "low": (F.min(F.when(value.isNotNull(), F.struct(value.alias("rank"), place.alias("row"), name.alias("label")))), F.min),
    }
    for i in numeric:
        v = F.abs(F.col(f"c{i}").cast("double"))
        folds[f"largest{i}"] = (F.max(F.nanvl(v, F.lit(None))), F.max)
        folds[f"zeros{i}"] = (F.bool_and(F.coalesce(v == 0, F.lit(False))), F.bool_and)
    rows = _plain(result).withColumn("_row", F.monotonically_increasing_id())
    some = rows.groupBy(F.shiftright("_row", 33 + HEADS.bit_length() - 1).alias("_part")).agg(*[rows_fold.alias(k) for k, (rows_fold, _) in folds.items()])
    one = some.agg(*[fold(F.col(k)).alias(k) for k, (_, fold) in folds.items()])
    issues = []
    for i in numeric:
        largest, said = F.col(f"largest{i}"), {k: F.lit(t.format(fields[i].name)) for k, t in VALUE_ISSUES.items()}
        issues += [F.when(largest == float("inf"), said["infinite"]), F.when(largest > EXTREME_VALUE, said["extreme"]), F.when(F.col(f"zeros{i}"), said["zeros"])]
    items = F.transform(F.slice("head", 1, 3), lambda r: F.struct(r["label"].alias("label"), r["value"].alias("value")))
    text = lambda v: F.lit(v).cast("string")
    return one.select(
        F.coalesce("n", F.lit(0)).alias("n"), F.lit(len(fields)).alias("width"), F.lit(len(numeric)).alias("numbers"), F.lit(dated).alias("dated"),
        text(fields[numeric[0]].name if numeric else None).alias("number_name"), text(fields[label].name if label is not None else None).alias("label_name"),
        F.array_compact(F.array(*issues).cast("array<string>")).alias("issues"), F.col("first.value").alias("first"), F.col("last.value").alias("last"),
        "total", F.coalesce("filled", F.lit(0)).alias("filled"), "maximum", F.col("high.label").alias("high"), "minimum", F.col("low.label").alias("low"),
        items.alias("items"), F.concat(F.lit("["), F.array_join(F.transform("head", lambda r: r["json"]), ","), F.lit("]")).alias("first_rows"),
    )


# --- checks of one result, as expressions over its figures ------------------------------------------

# fixed values: what each check reports
VALUE_ISSUES = {
    "infinite": "Column '{}' contains infinite values",
    "extreme": "Column '{}' has extreme values (>1e10)",
    "zeros": "Column '{}' is all zeros",
}
EMPTY_MESSAGE = "Query returned 0 rows - no data matches criteria"
ROWS_MESSAGE = "Query returned %d rows"
TOO_FEW_MESSAGE = "Expected %s results but got %d"
TOO_MANY_MESSAGE = "Too many results (%d) - query might be too broad"
COUNT_MESSAGE = "Result count (%d) is reasonable"
CHART_WIDTH_MESSAGE = "%s needs at least 2 columns, got %d"
PIE_MESSAGE = "Pie chart needs exactly 2 columns, got %d"
CHART_NUMBER_MESSAGE = "%s needs at least one numeric column"
CHART_MESSAGE = "Results compatible with %s"
VALUES_MESSAGE = "All values are within reasonable ranges"
YEAR_MESSAGE = "User asked about specific year but results have no date columns"
DETAIL_MESSAGE = "User asked for details but results appear aggregated"
TOTAL_MESSAGE = "User asked for totals but results have no numeric columns"
INTENT_MESSAGE = "Results align with user intent"
CHARTS = ["bar_chart", "line_chart", "scatter_plot"]


def _ladder(failures: list[tuple[Column, Column | str]], fine: Column | str) -> tuple[Column, Column]:
    """Whether no failure holds, and the message of the first that does."""
    lit = lambda m: F.lit(m) if isinstance(m, str) else m
    passed, message = F.lit(True), lit(fine)
    for condition, said in reversed(failures):
        failed = F.coalesce(condition, F.lit(False))
        passed, message = passed & ~failed, F.when(failed, lit(said)).otherwise(message)
    return passed, message


def result_checks(question: Column, chart: Column) -> dict[str, tuple[Column, Column]]:
    """Verdict and message of each check over FIGURES."""
    n, width, numbers, q = F.col("n"), F.col("width"), F.col("numbers"), F.lower(question)
    shown = F.coalesce(chart, F.lit("unknown"))
    wanted = F.regexp_extract(q, r"top\s+(\d+)", 1)
    filled = n > 0
    checks = {
        "not_empty": _ladder([(~filled, EMPTY_MESSAGE)], F.format_string(ROWS_MESSAGE, n)),
        "reasonable_count": _ladder(
            [(n < wanted.try_cast("bigint"), F.format_string(TOO_FEW_MESSAGE, wanted, n)), (n > TOO_MANY_ROWS, F.format_string(TOO_MANY_MESSAGE, n))],
            F.format_string(COUNT_MESSAGE, n),
        ),
        "visualization_compatible": _ladder(
            [
                (shown.isin(CHARTS) & (width < 2), F.format_string(CHART_WIDTH_MESSAGE, shown, width)),
                ((shown == "pie_chart") & (width != 2), F.format_string(PIE_MESSAGE, width)),
                (shown.isin([*CHARTS, "pie_chart"]) & (numbers == 0), F.format_string(CHART_NUMBER_MESSAGE, shown)),
            ],
            F.format_string(CHART_MESSAGE, shown),
        ),
        "values_reasonable": _ladder([(F.size("issues") > 0, F.array_join("issues", "; "))], VALUES_MESSAGE),
        "intent_aligned": _ladder(
            [
                (has_any(question, CHECKED_YEARS) & ~F.col("dated"), YEAR_MESSAGE),
                (has_any(q, DETAIL_PHRASES) & (width < 3), DETAIL_MESSAGE),
                (has_any(q, TOTAL_PHRASES) & (numbers == 0), TOTAL_MESSAGE),
            ],
            INTENT_MESSAGE,
        ),
    }
    for name in ("visualization_compatible", "values_reasonable"):  # not asked of an empty result
        passed, message = checks[name]
        checks[name] = (~filled | passed, F.when(filled, message))
    return checks


def answer_kind(question: Column) -> Column:
    """X10."""
    q = F.lower(question)
    return first_label({k: has_any(q, words) for k, words in ANSWER_KINDS.items()}, "general")


# --- sentences -------------------------------------------------------------------------------------


def _named(name: Column, words: list[str]) -> Column:
    return has_any(F.lower(name), words)


def _money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 2))


def _listed(ranking: bool) -> Column:
    """The first three rows as label and value; how the value is written depends on its column's name."""
    name = F.col("number_name")

    def item(r: Column) -> Column:
        value = r["value"]
        if ranking:
            shown = F.when(_named(name, ["sales"]), _money(value)).otherwise(F.format_number(value, 0))
        else:
            shown = F.when(_named(name, ["discount"]), F.format_string("%.1f%%", value * 100)).when(_named(name, LIST_MONEY_WORDS), _money(value))
            shown = shown.otherwise(F.format_number(value, 1))
        return F.concat(r["label"], F.lit(" ("), shown, F.lit(")"))

    return F.array_join(F.transform("items", item), ", ")


def _single_value(name: Column, value: Column) -> Column:
    money = F.when(_named(name, MONEY_WORDS), F.concat(F.lit("The total is $"), F.format_number(value, 2)))
    counted = money.when(_named(name, ["count"]), F.concat(F.lit("The count is "), F.format_number(value.cast("bigint"), 0)))
    discount = counted.when(_named(name, ["discount"]), F.format_string("The average discount is %.2f%%", value * 100))
    return discount.otherwise(F.concat(F.lit("The "), F.translate(name, "_", " "), F.lit(" is "), F.format_number(value, 2)))


def sentences() -> dict[str, Column]:
    """The sentence of each kind over FIGURES."""
    n, name, label = F.col("n"), F.col("number_name"), F.col("label_name")
    first, last = F.col("first"), F.col("last")
    count, number, both = n.cast("string"), name.isNotNull(), name.isNotNull() & label.isNotNull()
    change = F.coalesce(F.try_divide(last - first, first) * 100, F.lit(0.0))
    trend = F.concat(
        F.lit("The trend shows values "), F.when(last > first, "increased").otherwise("decreased"), F.lit(" from "), F.format_number(first, 2),
        F.lit(" to "), F.format_number(last, 2), F.format_string(" (%.1f%% change) over ", F.abs(change)), count, F.lit(" time periods."),
    )
    several = F.concat(
        F.lit("Found "), count, F.lit(" results with total of "), F.format_number("total", 2), F.lit(" and average of "),
        F.format_number(F.try_divide("total", "filled"), 2),
    )
    by_label = F.concat(F.lit("Results by "), label, F.lit(": "), _listed(False), F.lit(". Total "), count, F.lit(" categories found."))
    comparison = F.concat(
        F.lit("Comparison shows "), F.col("high"), F.lit(" has the highest ("), F.format_number("maximum", 2), F.lit(") while "), F.col("low"),
        F.lit(" has the lowest ("), F.format_number("minimum", 2), F.lit(")"),
    )
    ranking = F.concat(F.lit("Top results: "), _listed(True), F.lit(". Total of "), count, F.lit(" results found."))
    total = F.when(n == 1, _single_value(name, first)).when(both, by_label).otherwise(several)
    return {
        "listing": F.concat(F.lit("Found "), count, F.lit(" records. Showing details in table view.")),
        "general": F.concat(F.lit("Query returned "), count, F.lit(" rows with "), F.col("width").cast("string"), F.lit(" columns.")),
        "ranking": F.when(both, ranking).otherwise(F.concat(F.lit("Found "), count, F.lit(" ranked results."))),
        "comparison": F.when(both, comparison).otherwise(F.concat(F.lit("Comparison shows "), count, F.lit(" different groups."))),
        "trend": F.when(n < 2, "Not enough data points to show a trend.")
        .when(number, trend)
        .otherwise(F.concat(F.lit("Trend data shows "), count, F.lit(" time periods."))),
        "aggregation": F.when(number, total).otherwise(F.concat(F.lit("The query returned "), count, F.lit(" results."))),
    }


OUTCOME = (
    "user_query string, sql_query string, chart string, execution_status string, result_count bigint, not_empty boolean, "
    "reasonable_count boolean, visualization_compatible boolean, values_reasonable boolean, intent_aligned boolean, "
    "results_valid boolean, answer_kind string, answer string, error string, elapsed_seconds double, first_rows string, "
    "messages struct<not_empty: string, reasonable_count: string, visualization_compatible: string, values_reasonable: string, "
    "intent_aligned: string>, run_texts int"
)


def assess(asked: DataFrame) -> DataFrame:
    """OUTCOME of each row of `asked`, which has user_query, chart and the figures of its text."""
    question, done, n = F.col("user_query"), F.col("done"), F.col("n")
    checks, kind = result_checks(question, F.col("chart")), answer_kind(question)
    sentence = F.when(n == 0, "No results found for your query.")
    for name, text in sentences().items():
        sentence = sentence.when(kind == name, text)
    valid = done
    for passed, _ in checks.values():
        valid = valid & passed
    return asked.select(
        "user_query", "sql_query", "chart", F.when(done, "success").otherwise("failed").alias("execution_status"),
        F.coalesce(n, F.lit(0)).alias("result_count"), *[F.when(done, passed).alias(k) for k, (passed, _) in checks.items()],
        F.coalesce(valid, F.lit(False)).alias("results_valid"), F.when(done, kind).alias("answer_kind"), F.when(done, sentence).otherwise("").alias("answer"),
        "error", F.coalesce("elapsed_seconds", F.lit(0.0)).alias("elapsed_seconds"), "first_rows",
        F.when(done, F.struct(*[said.alias(k) for k, (_, said) in checks.items()])).alias("messages"), "run_texts",
    )


def execute_batch(log: DataFrame, dataset: DataFrame, batch: int = BATCH, narrow: DataFrame | None = None) -> DataFrame:
    """Outcomes of all distinct (question, SQL, chart) of the log; each distinct text runs once.

    `elapsed_seconds` is the time of the job that ran the text, together with `run_texts` texts in all. The result itself is never
    written: its figures and first rows, as JSON, are all that is kept. `narrow` as in `check_sql`.
    """
    work = log.select("user_query", "sql_query", F.col("visualization.type").alias("chart")).distinct()
    texts = work.where("sql_query is not null").select("sql_query").distinct()
    ran = run_texts(texts, dataset, FIGURES, figures, size=batch, narrow=narrow)
    asked = work.join(ran, "sql_query", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    missing = F.when(F.col("sql_query").isNull(), "No SQL").otherwise(F.col("error")).alias("error")
    return materialise(assess(asked.withColumn("error", missing)), "outcomes")


def execute_and_validate(dataset: DataFrame, question: str, text: str, chart: str) -> dict:
    """The outcome of one text."""
    asked = dataset.sparkSession.createDataFrame([(question, text, (chart,))], "user_query string, sql_query string, visualization struct<type: string>")
    return execute_batch(asked, dataset).first().asDict()


def merge_outcomes(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each answer with the outcome of its text; answers never run keep NULLs."""
    kept = outcomes.select(
        F.col("user_query").alias("_q"), F.col("sql_query").alias("_s"), F.col("chart").alias("_c"),
        "execution_status", "results_valid", "result_count", "answer",
    )
    same = (
        F.col("user_query").eqNullSafe(F.col("_q"))
        & F.col("sql_query").eqNullSafe(F.col("_s"))
        & F.col("visualization.type").eqNullSafe(F.col("_c"))
    )
    return log.join(kept, same, "left").drop("_q", "_s", "_c")


def accuracy(merged: DataFrame) -> DataFrame:
    """Execution, validity and overall rates."""
    executed = F.count_if(F.col("execution_status") == "success")
    valid = F.count_if(F.coalesce("results_valid", F.lit(False)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return merged.agg(
        F.count("*").alias("total_queries"),
        executed.alias("successfully_executed"),
        valid.alias("valid_results"),
        zero(percent(executed, F.count("*"))).alias("execution_success_rate"),
        zero(percent(valid, executed)).alias("result_validity_rate"),
        zero(percent(valid, F.count("*"))).alias("overall_accuracy"),
    )
