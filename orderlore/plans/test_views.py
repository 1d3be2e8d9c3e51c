"""Views derived from the order tables that the data-quality and response operators are checked on.

Each view is one SQL text that Spark and the reference engine both run, so both sides start from the
same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlore.plans.star import read_table

# Orders with the faults a raw file has: missing cells, padded text, extreme values, dates as text,
# a constant column and repeated rows.
DIRTY_SQL = """
SELECT * FROM (
SELECT o_orderkey AS order_id,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS customer_id,
 CASE WHEN o_orderkey % 7 = 1 THEN NULL WHEN o_orderkey % 5 = 0 THEN '  ' || c_mktsegment || ' ' ELSE c_mktsegment END AS segment,
 o_orderpriority AS priority,
 r_name AS region,
 CAST(CAST(o_orderdate AS DATE) AS STRING) AS order_date,
 CAST(floor(o_totalprice / 100) AS DOUBLE) * CASE WHEN o_orderkey % 97 = 0 THEN 1000 ELSE 1 END AS total,
 CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE c_acctbal END AS balance,
 CAST(o_orderkey % 17 AS INT) AS item_count,
 o_orderkey % 1000 AS points,
 'note ' || CAST(o_orderkey AS STRING) AS remark,
 'web' AS channel,
 o_orderkey % 2 = 0 AS gift
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey
) base
"""
DIRTY_SQL = DIRTY_SQL.strip() + "\nUNION ALL\n" + DIRTY_SQL.strip() + " WHERE order_id % 29 = 0"

# A log of generated answers: ten question templates, three models, with failures, invalid SQL,
# and raw texts in the shapes the parser has to cope with.
RESPONSE_LOG_SQL = """
SELECT model_name, query_number, user_query, sql_query, viz_type, viz_title, viz_x, viz_y, explanation, response_time,
 status, error,
 CASE WHEN status = 'failed' THEN NULL
  WHEN query_number % 6 = 0 THEN '```json' || chr(10) || body || chr(10) || '```'
  WHEN query_number % 6 = 1 THEN 'Here is the answer: ' || body || ' Hope it helps.'
  WHEN query_number % 6 = 2 THEN 'The query is ' || sql_query || '; and no more'
  WHEN query_number % 6 = 3 THEN 'I cannot answer this.'
  WHEN query_number % 6 = 4 THEN '{"sql_query": "' || sql_query || '", "visualization": {"title": "' || viz_title || '"}}'
  ELSE body END AS raw_response
FROM (
SELECT *, '{"sql_query": "' || sql_query || '", "visualization": {"type": "' || viz_type || '", "title": "' || viz_title
 || '", "x_axis": "' || viz_x || '", "y_axis": "' || viz_y || '"}, "explanation": "' || explanation || '"}' AS body
FROM (
SELECT CASE user_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS model_name,
 event_id AS query_number,
 CASE event_id % 10
  WHEN 0 THEN 'What is the total sales by region?' WHEN 1 THEN 'Show me the trend of profit over time'
  WHEN 2 THEN 'Top 5 products by revenue' WHEN 3 THEN 'List all orders with details'
  WHEN 4 THEN 'How many orders in 1999?' WHEN 5 THEN 'Compare sales between segments'
  WHEN 6 THEN 'Average discount of each category' WHEN 7 THEN 'Display only expensive lines'
  WHEN 8 THEN 'Highest profit months' ELSE 'Is discount related to quantity' END AS user_query,
 CASE WHEN event_id % 23 = 5 THEN 'SELECT missing_column FROM dataset' WHEN event_id % 29 = 7 THEN 'SELEC region FORM dataset'
  ELSE CASE event_id % 10
  WHEN 0 THEN 'SELECT region, SUM(sales) AS total_sales FROM dataset GROUP BY region ORDER BY total_sales DESC, region'
  WHEN 1 THEN 'SELECT year(order_date) AS year, SUM(profit) AS profit FROM dataset GROUP BY year(order_date) ORDER BY year'
  WHEN 2 THEN 'SELECT product_name, SUM(sales) AS sales FROM dataset GROUP BY product_name ORDER BY sales DESC LIMIT 5'
  WHEN 3 THEN 'SELECT order_id, sales, profit FROM dataset ORDER BY order_id LIMIT 100'
  WHEN 4 THEN 'SELECT COUNT(*) AS order_count FROM dataset WHERE year(order_date) = 1999'
  WHEN 5 THEN 'SELECT segment, SUM(sales) AS sales FROM dataset GROUP BY segment'
  WHEN 6 THEN 'SELECT category, AVG(discount) AS avg_discount FROM dataset GROUP BY category'
  WHEN 7 THEN 'SELECT order_id, sales FROM dataset WHERE sales > 90000'
  WHEN 8 THEN 'SELECT month(order_date) AS month, MAX(profit) AS profit FROM dataset GROUP BY month(order_date) ORDER BY profit DESC'
  ELSE 'SELECT quantity, AVG(discount) AS discount FROM dataset GROUP BY quantity' END END AS sql_query,
 CASE WHEN event_id % 31 = 3 THEN 'heatmap' WHEN event_id % 10 = 1 THEN 'line_chart' WHEN event_id % 10 = 6 THEN 'pie_chart'
  WHEN event_id % 10 = 9 THEN 'scatter_plot' WHEN event_id % 10 IN (3, 7) THEN 'table' ELSE 'bar_chart' END AS viz_type,
 'Chart ' || CAST(event_id % 10 AS STRING) AS viz_title,
 CASE WHEN event_id % 13 = 0 THEN '' ELSE 'label' END AS viz_x,
 'amount' AS viz_y,
 CASE WHEN event_id % 37 = 2 THEN 'short' ELSE CASE event_id % 4
  WHEN 0 THEN 'Shows the best and top results of good products' WHEN 1 THEN 'Displays and presents the totals'
  WHEN 2 THEN 'The worst and bad results, poor at best' ELSE 'Analyzes the figures per group' END END AS explanation,
 value / 100 AS response_time,
 CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
 CASE WHEN event_type = 'error' THEN 'no answer in time' END AS error
FROM events) templated) written
""".strip()

# Extracted documents beside their truth: order documents with nested parts, some fields changed, one
# missing, an empty object, numbers written differently, and text around the JSON.
# a leaf far down in some of the documents
DEEP_PATH = "deep" + ".n" * 19
_DEEP = ', "deep": ' + '{"n": ' * 19 + "1" + "}" * 19

DOCUMENTS_SQL = """
SELECT 'out_' || key || '.json' AS prediction_file, CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE 'in/doc_' || key || '.pdf' END AS origin_file,
 'truth/doc_' || key || '.json' AS truth_path, o_orderkey % 23 <> 0 AS has_truth,
 '{"fname": "doc", "0_expected": {"order": ' || key || ', "customer": {"name": "' || c_name || '", "address": {"nation": "' || n_name
 || '"}}, "total": {"amount": ' || CAST(o_totalprice AS STRING) || ', "currency": "USD"}, "status": "' || o_orderstatus
 || '", "items": [' || cust || ', -1], "tags": ["x1.0, y", {"k": [1]}], "note": null, "extra": {}' || CASE WHEN o_orderkey % 29 = 0 THEN 'DEEP' ELSE '' END || '}}' AS truth_text,
 CASE WHEN o_orderkey % 2 = 1 THEN 'Result: ' ELSE '' END || '{' || CASE WHEN o_orderkey % 31 = 0 THEN '"order": -1, ' ELSE '' END || '"order": ' || key || ', "customer": {"name": "'
 || CASE WHEN o_orderkey % 7 = 3 THEN 'unknown' ELSE
  substring(CASE WHEN o_orderkey % 3 = 0 THEN upper(c_name) ELSE c_name END, 1, length(c_name) - CASE WHEN o_orderkey % 7 = 2 THEN 3 ELSE 0 END) END
 || '", "address": {"nation": "' || n_name || '"}}, "total": {"amount": '
 || CAST(o_totalprice * CASE o_orderkey % 5 WHEN 0 THEN CAST(1.005 AS DOUBLE) WHEN 1 THEN CAST(1.02 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS STRING)
 || ', "currency": "USD"}' || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE ', "status": "' || o_orderstatus || '"' END || ', "items": '
 || CASE o_orderkey % 13 WHEN 0 THEN '[-1, ' || cust || ']' WHEN 1 THEN '[' || cust || '.0, -1]' ELSE '[' || cust || ', -1]' END
 || CASE WHEN o_orderkey % 37 = 0 THEN ', "tags": ["x1, y", {"k": [1]}]' ELSE ', "tags": ["x1.0, y", {"k": [1.0]}]' END
 || CASE WHEN o_orderkey % 29 = 0 THEN 'DEEP' ELSE '' END
 || ', "note": ' || CASE WHEN o_orderkey % 17 = 0 THEN '"x"' ELSE 'null' END
 || ', "document_type": "order", "origin_file": "doc"}' || CASE WHEN o_orderkey % 2 = 1 THEN ' (end)' ELSE '' END AS predicted_text
FROM (SELECT *, CAST(o_orderkey AS STRING) AS key, CAST(o_custkey AS STRING) AS cust FROM orders
 JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) joined
""".strip().replace("DEEP", _DEEP)


def _over(spark: SparkSession, sf_dir: str, sql: str, *tables: str, **frames: DataFrame) -> DataFrame:
    """Run a view's SQL over frames of the named tables, leaving the session's own views alone."""
    frames |= {t: read_table(spark, sf_dir, t) for t in tables}
    text = sql.replace("{", "{{").replace("}", "}}")
    for table in frames:
        text = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", text)
    return spark.sql(text, **frames)


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, DIRTY_SQL, "orders", "customer", "nation", "region")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders are dealt out before they meet their texts, which are many times as long."""
    orders = read_table(spark, sf_dir, "orders").repartition("o_orderkey")
    return _over(spark, sf_dir, DOCUMENTS_SQL, "customer", "nation", orders=orders)


def response_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _over(spark, sf_dir, RESPONSE_LOG_SQL, "events")
    chart = F.struct(
        F.col("viz_type").alias("type"),
        F.col("viz_title").alias("title"),
        F.col("viz_x").alias("x_axis"),
        F.col("viz_y").alias("y_axis"),
        F.lit(None).cast("string").alias("x_label"),
        F.lit(None).cast("string").alias("y_label"),
        F.lit(None).cast("string").alias("labels"),
        F.lit(None).cast("string").alias("values"),
    )
    return flat.select(
        "model_name", "query_number", "user_query", "raw_response", "sql_query", chart.alias("visualization"),
        "explanation", "response_time", "status", "error",
    )
