"""Registered queries for files, stages, tables and stored metadata.

Each writes what it needs from the given tables into a new folder under the session's shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlore.operators import profile, validate
from orderlore.plans.star import read_table
from orderlore.plans.test_views import dirty_orders
from orderlore.session import fresh_path
from orderlore.sources import files, metadata, responses, stages


def _orders(s, d) -> DataFrame:
    return read_table(s, d, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


def _formats(s, d) -> DataFrame:
    name = F.concat(F.lit("in/"), "p_name", F.element_at(F.array(*map(F.lit, [".csv", ".XLSX", ".json", ".parquet", ".txt", ".pdf"])), (F.col("p_partkey") % 6 + 1).cast("int")))
    return read_table(s, d, "part").select("p_partkey", files.file_format_column(name).alias("format"))


def _csv(s, d) -> DataFrame:
    path = fresh_path(s, "csv")
    _orders(s, d).write.option("header", True).csv(path)
    return files.read_csv(s, path).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


def _encodings(s, d) -> DataFrame:
    """Every customer's segment file as UTF-8 or Latin-1 bytes, one file per nation."""
    path = fresh_path(s, "encodings")
    rows = read_table(s, d, "customer").select(
        F.format_string("nation_%02d", "c_nationkey").alias("part"),
        F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("é "), "c_name")).otherwise(F.col("c_name")).alias("value"),
    )
    odd = F.substring("part", 8, 2).cast("int") % 4 == 0
    rows.where(~odd).repartition("part").write.partitionBy("part").text(path + "/utf8")
    rows.where(odd).repartition("part").write.option("encoding", "ISO-8859-1").partitionBy("part").csv(path + "/latin1")
    found = files.encodings(s, f"{path}/utf8/*", f"{path}/latin1/*")
    return (
        found.select(F.regexp_extract("path", r"nation_(\d+)", 1).cast("bigint").alias("nation"), "encoding").distinct()
    )


def _json(s, d) -> DataFrame:
    path = fresh_path(s, "json")
    read_table(s, d, "customer").write.json(path)
    return files.read_json(s, path, array=False)


def _json_arrays(s, d) -> DataFrame:
    """Files that each hold an array of a few hundred records, as an export writes them."""
    path = fresh_path(s, "json-arrays")
    record = F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"})
    arrays = read_table(s, d, "customer").groupBy(F.floor(F.col("c_custkey") / 500)).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(record), ",\n"), F.lit("\n]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_json(s, path)


def _first_files(s, d) -> DataFrame:
    """The first file of the nations' folders from each of five on: JSON where a nation has a customer deep in debt, else CSV."""
    root = fresh_path(s, "folders")
    rows = read_table(s, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal").repartition("nation")
    rows.write.partitionBy("nation").csv(root)
    rows.where("c_acctbal < -950").write.mode("append").partitionBy("nation").json(root)
    folders = [f"{root}/nation={r[0]}" for r in rows.select("nation").distinct().orderBy("nation").collect()]  # 25 at most
    found = [files.find_data_files(s, folders[k:], ("json", "csv")).withColumn("start", F.lit(k).cast("bigint")) for k in range(5)]
    named = reduce(DataFrame.unionByName, found)
    return named.select("start", F.regexp_extract("path", r"nation=(\d+)", 1).cast("bigint").alias("nation"), F.regexp_extract("path", r"\.(\w+)$", 1).alias("kind"))


def _file_sizes(s, d) -> DataFrame:
    """Size and ending of one file a nation, whose lines are written from the customers."""
    root = fresh_path(s, "sizes")
    line = F.concat_ws("|", "c_custkey", "c_name")
    read_table(s, d, "customer").select(F.col("c_nationkey").alias("nation"), line.alias("value")).repartition("nation").write.partitionBy("nation").text(root)
    found = files.file_info(s, root).where("name like 'part-%'")
    return found.select(F.regexp_extract("path", r"nation=(\d+)", 1).cast("bigint").alias("nation"), "size", "extension")


def _newest_report(s, d) -> DataFrame:
    """The content of the newest JSON report among one a region, written one after the other, beside a newer CSV file."""
    root = fresh_path(s, "reports")
    nations = read_table(s, d, "region").join(read_table(s, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    reports = nations.groupBy("r_regionkey", "r_name").agg(F.count("*").alias("nations"))
    for key in [r[0] for r in read_table(s, d, "region").orderBy("r_regionkey").select("r_regionkey").collect()]:  # 5
        reports.where(F.col("r_regionkey") == key).coalesce(1).write.json(f"{root}/region={key}")
    reports.coalesce(1).write.csv(f"{root}/all")
    newest = stages.latest_report(s, root, ".json", ".csv").first()["path"]
    return s.read.json(newest).select(F.col("r_name").alias("region"), "nations")


def _stage_roundtrip(s, d) -> DataFrame:
    root = fresh_path(s, "stages")
    stages.write_stage(_orders(s, d), root, "orders", "validated")
    return stages.load_stage(s, root, "orders", "validated").groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


def _acquire(s, d) -> DataFrame:
    return stages.acquire(s, f"{d}/orders.parquet", fresh_path(s, "acquired"), "orders")


def _report_roundtrip(s, d) -> DataFrame:
    root = fresh_path(s, "reports")
    report = validate.null_shares(dirty_orders(s, d))
    stages.write_report(report, root, "orders", "validation")
    back = stages.read_report(s, root, "orders", "validation", "column string, null_count bigint, null_share double, exceeds boolean")
    return back.select("column", "null_count", "exceeds")


def _missing_report(s, d) -> DataFrame:
    root = fresh_path(s, "reports")
    nulls = profile.null_counts(read_table(s, d, "orders"))
    stages.write_report(nulls, root, "orders", "schema")
    schema = "ordinal int, row_count bigint, null_count bigint"
    found = stages.read_report(s, root, "orders", "schema", schema).agg(F.count("*").alias("rows"))
    absent = stages.read_report(s, root, "orders", "bias", schema).agg(F.count("*").alias("rows"))
    return found.select(F.lit("schema").alias("report"), "rows").unionByName(absent.select(F.lit("bias").alias("report"), "rows"))


def _published_root(s, d) -> str:
    root = fresh_path(s, "published")
    for name in ("customer", "supplier", "part"):
        df = read_table(s, d, name)
        stages.write_stage(df, root, name, "validated")
        if name != "part":
            stages.write_report(profile.null_counts(df), root, name, "schema")
        if name == "customer":
            stages.write_stage(df, root, name, "processed", "csv")
    return root


def _tables(s, d) -> DataFrame:
    return stages.query_table(s, stages.save_table(read_table(s, d, "nation"), "nations", path=fresh_path(s, "nations")))


def _limited_table(s, d) -> DataFrame:
    table = stages.save_table(read_table(s, d, "orders"), "ordered", path=fresh_path(s, "ordered"))
    return stages.query_table(s, table, 10).agg(F.count("*").alias("rows"))


def _table_info(s, d) -> DataFrame:
    table = stages.save_table(read_table(s, d, "orders"), "informed", path=fresh_path(s, "informed"))
    info = stages.table_info(s, table).unionByName(stages.table_info(s, "no_such_table"))
    return info.select("exists", "num_rows", "num_columns", (F.col("num_bytes") > 0).alias("has_bytes"))


def _dataset_metadata(s, d) -> DataFrame:
    tables = {"raw": read_table(s, d, "lineitem"), "processed": read_table(s, d, "orders"), "validated": read_table(s, d, "customer")}
    return stages.dataset_metadata(tables, "orders").withColumn("column_names", F.array_join("column_names", ","))


def _publish(s, d) -> DataFrame:
    df = read_table(s, d, "orders")
    reports = {"schema": profile.null_counts(df), "validation": validate.verdict(df)}
    manifest = stages.publish({"raw": df, "processed": df, "validated": df}, reports, fresh_path(s, "target"), "orders")
    return manifest.select("artifact", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"))


def _publish_totals(s, d) -> DataFrame:
    df = read_table(s, d, "orders")
    manifest = stages.publish({"validated": df}, {"schema": profile.null_counts(df)}, fresh_path(s, "target"), "orders")
    return stages.manifest_totals(manifest).select("artifacts_published", (F.col("total_bytes") > 0).alias("has_bytes"))


def _records(s, d, stamp: str, condition: str) -> DataFrame:
    when = F.lit(stamp).cast("timestamp")
    return (
        read_table(s, d, "customer")
        .where(condition)
        .select(
            F.col("c_name").alias("dataset_name"),
            F.format_string('{"segment": "%s"}', "c_mktsegment").alias("metadata"),
            F.lit(stamp).alias("llm_context"),
            F.col("c_custkey").alias("row_count"),
            F.col("c_nationkey").cast("bigint").alias("column_count"),
            when.alias("created_at"),
            when.alias("updated_at"),
        )
    )


def _upserted(s, d) -> DataFrame:
    """The stored table after an upsert, read back from its newest version."""
    root = fresh_path(s, "metadata")
    metadata.write_version(_records(s, d, "2024-01-01 00:00:00", "c_custkey % 3 <> 0"), root, 1)
    merged = metadata.upsert(metadata.read_latest(s, root), _records(s, d, "2024-02-01 00:00:00", "c_custkey % 2 = 0"))
    metadata.write_version(merged, root, 2)
    return metadata.read_latest(s, root)


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("created_at", "updated_at")})


def _questions(s, d) -> DataFrame:
    """One question file per nation with comments and blank lines, read back."""
    path = fresh_path(s, "questions")
    line = F.concat(F.lit("# nation\n\n  How much does "), "n_name", F.lit(" sell?  \n   \nWho buys in "), "n_name", F.lit("?\n"))
    read_table(s, d, "nation").select(line.alias("value")).repartition(5).write.text(path)
    return responses.read_questions(s, path).groupBy(F.regexp_extract("user_query", r"(NATION_\d+)", 1).alias("nation")).agg(
        F.count("*").alias("questions")
    )


def _examples(s, d) -> DataFrame:
    orders = read_table(s, d, "orders")
    key = F.col("o_orderkey").cast("string")
    pdfs = orders.where("o_orderkey % 2 = 0").select(F.concat(F.lit("in/doc_"), key, F.lit(".pdf")).alias("path"))
    answers = orders.where("o_orderkey % 3 = 0").select(F.concat(F.lit("in/doc_"), key, F.lit(".json")).alias("path"), F.col("o_orderstatus").alias("text"))
    return files.pair_examples(pdfs, answers, None)


def _first_examples(s, d) -> DataFrame:
    return _examples(s, d).orderBy("id").limit(3)


QUERIES = {
    "S01": _formats,
    "S02": _csv,
    "S03": _encodings,
    "S04": _json_arrays,
    "S04.lines": _json,
    "S05": lambda s, d: files.read_parquet(s, f"{d}/lineitem.parquet").where("l_quantity > 45").select("l_orderkey", "l_quantity"),
    "S07": _first_files,
    "S08": _acquire,
    "S09": _stage_roundtrip,
    "S10": _report_roundtrip,
    "S12": _stage_roundtrip,
    "S13": lambda s, d: stages.list_datasets(s, _published_root(s, d)),
    "S14": lambda s, d: stages.latest_dataset(s, _published_root(s, d), "processed").select("dataset"),
    "S15": _tables,
    "S16": _limited_table,
    "S17": _table_info,
    "S19": _missing_report,
    "S20": _file_sizes,
    "S22": lambda s, d: stages.artifact_summary(s, _published_root(s, d)),
    "S23": _dataset_metadata,
    "S24": _publish,
    "S24.totals": _publish_totals,
    "S26": lambda s, d: _dated(_upserted(s, d)),
    "S27": lambda s, d: metadata.lookup(_upserted(s, d), "Customer#000000004").select(
        "dataset_name", F.try_variant_get("metadata", "$.segment", "string").alias("segment"), "row_count"
    ),
    "S28": lambda s, d: _dated(metadata.list_all(_upserted(s, d))),
    "S29": lambda s, d: metadata.delete(_upserted(s, d), "Customer#000000004").select("dataset_name", "row_count"),
    "S31": _questions,
    "S35": _examples,
    "S35.first": _first_examples,
    "S36": lambda s, d: read_table(s, d, "documents").select("doc_id", files.data_url(F.encode("text", "UTF-8")).alias("url")),
    "M10": _newest_report,
}


def queries() -> dict:
    return dict(QUERIES)


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"
_UPSERTED = """WITH stored AS (SELECT c_name AS dataset_name, '{"segment": "' || c_mktsegment || '"}' AS metadata, c_mktsegment AS segment,
 CASE WHEN c_custkey % 2 = 0 THEN '2024-02-01 00:00:00' ELSE '2024-01-01 00:00:00' END AS llm_context, c_custkey AS row_count,
 CAST(c_nationkey AS BIGINT) AS column_count, CASE WHEN c_custkey % 3 <> 0 THEN '2024-01-01' ELSE '2024-02-01' END AS created_at,
 CASE WHEN c_custkey % 2 = 0 THEN '2024-02-01' ELSE '2024-01-01' END AS updated_at FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0) """
_STATUS = "SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY 1"
_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, (count(*) - count({c})) / count(*) > 0.15 AS exceeds FROM dirty"
    for c in ("order_id", "customer_id", "segment", "priority", "region", "order_date", "total", "balance", "item_count", "points", "remark", "channel", "gift")
)
_EXAMPLES = (
    "SELECT 'doc_' || o_orderkey AS id, 'in/doc_' || o_orderkey || '.pdf' AS document_path, 'in/doc_' || o_orderkey || '.json' AS answer_path, "
    "o_orderstatus AS answer_text FROM orders WHERE o_orderkey % 6 = 0"
)


def _sql() -> dict[str, str]:
    from orderlore.plans.test_views import DIRTY_SQL

    metas = [("raw", "lineitem"), ("processed", "orders"), ("validated", "customer")]
    return {
        "S01": "SELECT p_partkey, ['csv', 'excel', 'json', 'parquet', 'text', 'unknown'][CAST(p_partkey % 6 AS INT) + 1] AS format FROM part",
        "S02": _ORDERS,
        "S03": "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS nation, CASE WHEN c_nationkey % 4 = 0 THEN 'iso-8859-1' ELSE 'utf-8' END AS encoding FROM customer",
        "S04": "SELECT * FROM customer",
        "S04.lines": "SELECT * FROM customer",
        "S05": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45",
        "S07": "SELECT row_number() OVER (ORDER BY c_nationkey) - 1 AS start, CAST(c_nationkey AS BIGINT) AS nation, "
        "CASE WHEN min(c_acctbal) < -950 THEN 'json' ELSE 'csv' END AS kind FROM customer GROUP BY c_nationkey ORDER BY 1 LIMIT 5",
        "S20": "SELECT c_nationkey AS nation, CAST(sum(strlen(c_custkey || '|' || c_name) + 1) AS BIGINT) AS size, '.txt' AS extension FROM customer GROUP BY 1",
        "M10": "SELECT r_name AS region, count(*) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey "
        "WHERE r_regionkey = (SELECT max(r_regionkey) FROM region) GROUP BY 1",
        "S08": "SELECT 'orders' AS dataset_name, count(*) AS rows, CAST(6 AS BIGINT) AS columns FROM orders",
        "S09": _STATUS,
        "S10": f"WITH dirty AS ({DIRTY_SQL}) {_NULLS}",
        "S12": _STATUS,
        "S13": "SELECT unnest(['customer', 'part', 'supplier']) AS dataset",
        "S14": "SELECT 'customer' AS dataset",
        "S15": "SELECT * FROM nation",
        "S16": "SELECT CAST(10 AS BIGINT) AS rows",
        "S17": "SELECT true AS exists, count(*) AS num_rows, CAST(6 AS BIGINT) AS num_columns, true AS has_bytes FROM orders UNION ALL SELECT false, NULL, NULL, NULL",
        "S19": "SELECT 'schema' AS report, CAST(6 AS BIGINT) AS rows UNION ALL SELECT 'bias', 0",
        "S22": "SELECT dataset, false AS raw, dataset = 'customer' AS processed, true AS validated, dataset <> 'part' AS schema, false AS validation, "
        "false AS bias, false AS cleaning FROM (SELECT unnest(['customer', 'part', 'supplier']) AS dataset)",
        "S23": " UNION ALL ".join(
            f"SELECT 'orders' AS dataset_name, '{s}' AS stage, (SELECT count(*) FROM {t}) AS rows, count(*) AS columns, "
            f"string_agg(column_name, ',' ORDER BY i) AS column_names FROM (SELECT column_name, row_number() OVER () AS i FROM (DESCRIBE {t}))"
            for s, t in metas
        ),
        "S24": "SELECT unnest(['data/processed', 'data/validated', 'reports/schema', 'reports/validation']) AS artifact, true AS has_files, true AS has_bytes",
        "S24.totals": "SELECT CAST(2 AS BIGINT) AS artifacts_published, true AS has_bytes",
        "S26": _UPSERTED + "SELECT * EXCLUDE (segment) FROM stored",
        "S27": _UPSERTED + "SELECT dataset_name, segment, row_count FROM stored WHERE dataset_name = 'Customer#000000004'",
        "S28": _UPSERTED + "SELECT dataset_name, row_count, column_count, created_at, updated_at FROM stored ORDER BY updated_at DESC, dataset_name",
        "S29": _UPSERTED + "SELECT dataset_name, row_count FROM stored WHERE dataset_name <> 'Customer#000000004'",
        "S31": "SELECT n_name AS nation, CAST(2 AS BIGINT) AS questions FROM nation",
        "S35": _EXAMPLES,
        "S35.first": _EXAMPLES + " ORDER BY id LIMIT 3",
        "S36": "SELECT doc_id, 'data:application/pdf;base64,' || base64(encode(text)) AS url FROM documents",
    }


SQL = _sql()
