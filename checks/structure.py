"""Registered queries for document comparison and table descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import quality
from checks.shared import document_rows
from orderlore.operators import clean, describe, documents, profile
from orderlore.plans.star import read_table
from orderlore.plans.test_views import DEEP_PATH, DIRTY_SQL, DOCUMENTS_SQL, dirty_orders


def _predictions(s, d) -> DataFrame:
    rows = document_rows(s, d)
    return rows.select("prediction_file", "origin_file", documents.lenient_document(F.col("predicted_text")).alias("document"))


def _pairs(s, d) -> DataFrame:
    truths = document_rows(s, d).where("has_truth")
    truths = truths.select(F.col("truth_path").alias("path"), documents.document(F.col("truth_text")).alias("document"))
    return documents.pair_documents(_predictions(s, d), truths)


def _fields(s, d) -> DataFrame:
    return documents.compare_fields(_pairs(s, d))


def _report(*columns: str):
    return lambda s, d: documents.report(_fields(s, d)).select("prediction_file", *columns)


def _text(df: DataFrame, path: str, name: str) -> DataFrame:
    return df.withColumn(name, F.try_variant_get("document", path, "string"))


def _profiles(s, d) -> DataFrame:
    name, kind = F.col("c_name"), F.col("c_custkey") % 3
    listed = F.format_string('{"columns": [{"name": "%s", "description": "%s"}, {"name": "b"}]}', name, "c_mktsegment")
    names = F.format_string('{"columns": ["%s", "b"]}', name)
    keyed = F.format_string('{"columns": {"%s": {"description": "%s"}, "b": {}}}', name, "c_mktsegment")
    return read_table(s, d, "customer").select(F.when(kind == 0, listed).when(kind == 1, names).otherwise(keyed).alias("profile"))


def _stored_descriptions(s, d) -> DataFrame:
    """Descriptions that stored profiles give to two columns, made of what the regions say of themselves."""
    said = F.format_string('{"columns": [{"name": "%s", "description": "%s"}]}', F.when(F.col("r_regionkey") % 2 == 0, "remark").otherwise("gone"), "r_name")
    return describe.parse_profile(read_table(s, d, "region").select(said.alias("profile")))


def _unique(s, d) -> DataFrame:
    return clean.remove_duplicates(dirty_orders(s, d))


def _facts(*columns: str):
    return lambda s, d: describe.column_facts(_unique(s, d)).select("column", *columns)


def _lists(s, d) -> DataFrame:
    lists = describe.column_lists(describe.column_facts(_unique(s, d)))
    return lists.select(*[F.array_join(c, ",").alias(c) for c in lists.columns])


def _metadata(s, d) -> DataFrame:
    m = describe.metadata(_unique(s, d), "orders")
    return m.select(
        "table_name", "row_count", "column_count",
        F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["column"], c["unique_count"], c["cardinality"])), ",").alias("columns"),
        F.size("sample_values").cast("bigint").alias("samples"),
        F.size("statistics").cast("bigint").alias("statistics"),
        F.size("relationships").cast("bigint").alias("relationships"),
        F.array_join("lists.numeric_columns", ",").alias("numeric_columns"),
    )


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


QUERIES = {
    "D01": lambda s, d: _text(_text(_predictions(s, d), "$.order", "order_key"), "$.total.currency", "currency").select(
        "prediction_file", "order_key", "currency"
    ),
    "D02": lambda s, d: documents.tag_predictions(_predictions(s, d), "invoice").select(
        "prediction_file", "document_type", "origin_file"
    ),
    "D03": lambda s, d: _pairs(s, d).select("prediction_file", "origin_file", "stem"),
    "D04": lambda s, d: documents.flatten(
        _pairs(s, d).withColumn("_t", documents.truth_body(F.col("truth"))), "prediction_file", "_t"
    ).select("prediction_file", "path", "json"),
    "D05": lambda s, d: _fields(s, d).where("outcome IN ('exact', 'partial', 'wrong')"),
    "D06": _report("tp", "fp", "fn", "wrong_fields", "partial_matches", "extra_fields"),
    "D07": _report("precision", "recall", "f1"),
    "D08": lambda s, d: documents.report(_fields(s, d)),
    "F01": lambda s, d: describe.parse_profile(_profiles(s, d)),
    "F02": lambda s, d: _rounded(
        describe.column_facts(_unique(s, d)).select("column", "unique_count", "null_count", "null_pct", "data_class"), 8, "null_pct"
    ),
    "F02.range": lambda s, d: profile.named(
        profile.numeric_summary(_unique(s, d)).select("ordinal", "min", "max"), _unique(s, d)
    ).select("column", "min", "max"),
    "F03": _facts("description"),
    "F03.stored": lambda s, d: describe.column_facts(
        dirty_orders(s, d).select("order_id", "remark"), descriptions=_stored_descriptions(s, d)
    ).select("column", "description"),
    "F04": _facts("is_low_cardinality"),
    "F05": lambda s, d: describe.sample_values(_unique(s, d), describe.column_facts(_unique(s, d))).drop("ordinal"),
    "F06": lambda s, d: _rounded(describe.statistics(_unique(s, d)).drop("ordinal"), 4, "mean", "median", "std", "q25", "q75"),
    "F07": _facts("is_primary_key"),
    "F08": _facts("is_foreign_key"),
    "F09": _facts("cardinality"),
    "F10": _lists,
    "F11": lambda s, d: describe.relationships(describe.column_facts(_unique(s, d))).select("place", "dimension", "measure"),
    "F12": _metadata,
    "F13": lambda s, d: describe.context(describe.metadata(_unique(s, d), "orders")),
    "F14": lambda s, d: describe.feature_summary(describe.column_facts(_unique(s, d)), "orders"),
}


def queries() -> dict:
    return dict(QUERIES)


# --- reference SQL ---------------------------------------------------------------------------------

_DOCS = f"""WITH docs AS (SELECT *, CAST(regexp_extract(prediction_file, '(\\d+)', 1) AS BIGINT) AS o FROM ({DOCUMENTS_SQL})),
paired AS (SELECT * FROM docs WHERE has_truth AND origin_file <> ''),
outcomes AS (SELECT * FROM (SELECT prediction_file, unnest([
 {{'path': 'order', 'outcome': 'exact'}},
 {{'path': 'customer.name', 'outcome': CASE WHEN o % 7 = 3 THEN 'wrong' WHEN o % 7 = 2 THEN 'partial' ELSE 'exact' END}},
 {{'path': 'customer.address.nation', 'outcome': 'exact'}},
 {{'path': 'total.amount', 'outcome': CASE WHEN o % 5 = 1 THEN 'wrong' ELSE 'exact' END}},
 {{'path': 'total.currency', 'outcome': 'exact'}},
 {{'path': 'status', 'outcome': CASE WHEN o % 11 = 0 THEN 'missing' ELSE 'exact' END}},
 {{'path': 'items', 'outcome': CASE WHEN o % 13 = 0 THEN 'wrong' ELSE 'exact' END}},
 {{'path': 'note', 'outcome': CASE WHEN o % 17 = 0 THEN 'wrong' ELSE 'exact' END}},
 {{'path': 'tags', 'outcome': CASE WHEN o % 37 = 0 THEN 'wrong' ELSE 'exact' END}},
 {{'path': '{DEEP_PATH}', 'outcome': CASE WHEN o % 29 = 0 THEN 'exact' END}},
 {{'path': 'document_type', 'outcome': 'extra'}},
 {{'path': 'origin_file', 'outcome': 'extra'}}], recursive := true) FROM paired) WHERE outcome IS NOT NULL),
counts AS (SELECT prediction_file, count(*) FILTER (outcome = 'exact') AS tp, count(*) FILTER (outcome IN ('partial', 'wrong')) AS fp,
 count(*) FILTER (outcome = 'missing') AS fn, count(*) FILTER (outcome = 'wrong') AS wrong_fields,
 count(*) FILTER (outcome = 'partial') AS partial_matches, count(*) FILTER (outcome = 'extra') AS extra_fields FROM outcomes GROUP BY 1),
scored AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM counts)
"""
_SCORES = "round_even(p, 3) AS precision, round_even(r, 3) AS recall, round_even(2 * p * r / (p + r), 3) AS f1"
_LEAVES = """SELECT * FROM (SELECT prediction_file, unnest([
 {'path': 'order', 'json': CAST(o AS VARCHAR)},
 {'path': 'customer.name', 'json': CAST(json_extract(truth_text, '$."0_expected".customer.name') AS VARCHAR)},
 {'path': 'customer.address.nation', 'json': CAST(json_extract(truth_text, '$."0_expected".customer.address.nation') AS VARCHAR)},
 {'path': 'total.amount', 'json': regexp_replace(CAST(CAST(json_extract_string(truth_text, '$."0_expected".total.amount') AS DOUBLE) AS VARCHAR), '\\.0$', '')},
 {'path': 'total.currency', 'json': '"USD"'},
 {'path': 'status', 'json': CAST(json_extract(truth_text, '$."0_expected".status') AS VARCHAR)},
 {'path': 'items', 'json': replace(CAST(json_extract(truth_text, '$."0_expected".items') AS VARCHAR), ' ', '')},
 {'path': 'tags', 'json': '["x1.0, y",{"k":[1]}]'},
 {'path': 'DEEP', 'json': CASE WHEN o % 29 = 0 THEN '1' END},
 {'path': 'note', 'json': 'null'}], recursive := true) FROM paired) WHERE json IS NOT NULL""".replace("DEEP", DEEP_PATH)

_BASE = quality._DIRTY.replace(f"dirty AS ({DIRTY_SQL})", f"dirty AS (SELECT DISTINCT * FROM ({DIRTY_SQL}))")
_NAMES = {
    "order_id": "Order Identifier", "customer_id": "Customer Identifier", "segment": "Segment", "priority": "Priority",
    "region": "Region Location", "order_date": "Order Date Timestamp", "total": "Total", "balance": "Balance",
    "item_count": "Item Count Count", "points": "Points", "remark": "Remark", "channel": "Channel", "gift": "Gift",
}
_ORDINALS = "[" + ", ".join(f"'{c}'" for c in quality.COLUMNS) + "]"
_DESCRIPTION = "CASE \"column\" " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in _NAMES.items()) + " END"
_ALL_TOP = " UNION ALL ".join(quality._top(c).replace("place <= 5", "place <= 10") for c in quality.COLUMNS)


def _quartiles(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean, "
        f"round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}, 0.25), 4) AS q25, "
        f"round(quantile_cont({c}, 0.75), 4) AS q75 FROM dirty"
    )


_DESCRIBED = _BASE + f""", facts AS (SELECT *, list_position({_ORDINALS}, "column") AS i, {_DESCRIPTION} AS description,
 CASE WHEN kind IN ('integral', 'fractional') THEN 'numeric' ELSE 'categorical' END AS data_class,
 kind = 'string' OR unique_count < 50 AS is_low_cardinality,
 ends_with("column", '_id') AND unique_count = row_count AND null_count = 0 AS is_primary_key,
 ends_with("column", '_id') AND NOT (unique_count = row_count AND null_count = 0) AND unique_count / row_count < 0.9 AS is_foreign_key,
 CASE WHEN unique_count / row_count > 0.95 THEN 'high' WHEN unique_count / row_count > 0.5 THEN 'medium-high'
 WHEN unique_count / row_count > 0.1 THEN 'medium' WHEN unique_count / row_count > 0.01 THEN 'low' ELSE 'very-low' END AS cardinality FROM counts),
pairs AS (SELECT row_number() OVER (ORDER BY a.i, b.i) AS place, a."column" AS dimension, b."column" AS measure
 FROM facts a JOIN facts b ON a.is_low_cardinality AND a.unique_count <= 100 AND b.data_class = 'numeric'
 AND NOT ends_with(a."column", '_id') AND NOT ends_with(b."column", '_id') QUALIFY place <= 20),
tops AS (SELECT t.* FROM ({_ALL_TOP}) t JOIN facts USING ("column") WHERE is_low_cardinality)
"""
_N = "(SELECT max(row_count) FROM facts)"
_CONTEXT = f"""SELECT 'orders' AS dataset_name, 'Dataset: orders' || chr(10) || 'Description: Business data table with ' || format('{{:,}}', {_N}) || ' records'
 || chr(10) || 'Total Records: ' || format('{{:,}}', {_N}) || chr(10) || 'Total Columns: 13' || chr(10) || chr(10) || 'Column Definitions:' || chr(10)
 || (SELECT string_agg(chr(10) || '- ' || "column" || ': ' || description || ' (' || data_class || ', ' || unique_count || ' unique values)', chr(10) ORDER BY i) FROM facts)
 || chr(10) || chr(10) || chr(10) || 'Key Categories and Sample Values:' || chr(10)
 || (SELECT string_agg(chr(10) || '- ' || "column" || ': ' || shown, chr(10) ORDER BY i) FROM (SELECT "column", any_value(i) AS i,
  string_agg(value || ' (' || count || ')', ', ' ORDER BY place) AS shown FROM tops JOIN facts USING ("column") WHERE place <= 3 GROUP BY 1 ORDER BY 2 LIMIT 5))
 || chr(10) || chr(10) || chr(10) || 'Common Analysis Patterns:' || chr(10)
 || (SELECT string_agg(chr(10) || '- Analyze ' || measure || ' by ' || dimension, chr(10) ORDER BY place) FROM pairs WHERE place <= 5) AS llm_context"""


def _fact(columns: str) -> str:
    return f'SELECT "column", {columns} FROM facts'


_SQL = {
    "D01": _DOCS + "SELECT prediction_file, CAST(o AS VARCHAR) AS order_key, 'USD' AS currency FROM docs",
    "D02": _DOCS + "SELECT prediction_file, 'invoice' AS document_type, origin_file FROM docs",
    "D03": _DOCS + "SELECT prediction_file, origin_file, 'doc_' || o AS stem FROM paired",
    "D04": _DOCS + _LEAVES,
    "D05": _DOCS + "SELECT * FROM outcomes WHERE outcome IN ('exact', 'partial', 'wrong')",
    "D06": _DOCS + "SELECT * FROM counts",
    "D07": _DOCS + f"SELECT prediction_file, {_SCORES} FROM scored",
    "D08": _DOCS + f"SELECT prediction_file, tp, fp, fn, wrong_fields, partial_matches, extra_fields, {_SCORES} FROM scored",
    "F01": "SELECT c_name AS name, CASE WHEN c_custkey % 3 <> 1 THEN c_mktsegment END AS description FROM customer "
    "UNION ALL SELECT 'b', NULL FROM customer",
    "F02": _DESCRIBED + _fact("unique_count, null_count, round(null_count / row_count * 100, 8) AS null_pct, data_class"),
    "F02.range": _DESCRIBED
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM dirty" for c in quality.NUMBERS
    ),
    "F03": _DESCRIBED + _fact("description"),
    "F03.stored": "SELECT 'order_id' AS \"column\", 'Order Identifier' AS description UNION ALL "
    "SELECT 'remark', min(r_name) FROM region WHERE r_regionkey % 2 = 0",
    "F04": _DESCRIBED + _fact("is_low_cardinality"),
    "F05": _DESCRIBED + "SELECT * FROM tops",
    "F06": _DESCRIBED + " UNION ALL ".join(map(_quartiles, quality.NUMBERS)),
    "F07": _DESCRIBED + _fact("is_primary_key"),
    "F08": _DESCRIBED + _fact("is_foreign_key"),
    "F09": _DESCRIBED + _fact("cardinality"),
    "F10": _DESCRIBED + "SELECT '' AS date_columns, (SELECT string_agg(\"column\", ',' ORDER BY i) FROM facts WHERE data_class = 'numeric') AS numeric_columns, "
    "(SELECT string_agg(\"column\", ',' ORDER BY i) FROM facts WHERE is_low_cardinality) AS categorical_columns",
    "F11": _DESCRIBED + "SELECT * FROM pairs",
    "F12": _DESCRIBED + f"SELECT 'orders' AS table_name, {_N} AS row_count, (SELECT count(*) FROM facts) AS column_count, "
    "(SELECT string_agg(\"column\" || ':' || unique_count || ':' || cardinality, ',' ORDER BY i) FROM facts) AS columns, "
    "(SELECT count(*) FROM tops) AS samples, CAST(6 AS BIGINT) AS statistics, (SELECT count(*) FROM pairs) AS relationships, "
    "(SELECT string_agg(\"column\", ',' ORDER BY i) FROM facts WHERE data_class = 'numeric') AS numeric_columns",
    "F13": _DESCRIBED + _CONTEXT,
    "F14": _DESCRIBED + "SELECT 'orders' AS dataset, max(row_count) AS total_rows, count(*) AS total_columns, count(*) FILTER (data_class = 'numeric') AS numeric_columns, "
    "count(*) FILTER (is_low_cardinality) AS categorical_columns, CAST(0 AS BIGINT) AS date_columns, count(*) FILTER (is_primary_key) AS primary_keys, "
    "count(*) FILTER (is_foreign_key) AS foreign_keys, (SELECT count(*) FROM pairs) AS relationships_found FROM facts",
}
SQL = dict(_SQL)
