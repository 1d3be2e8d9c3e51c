"""Stage files, reports, warehouse tables and their listings.

A data set lives under one root, which may be any URI that Spark's file layer reads:
data/<stage>/<name>_<stage> and reports/<kind>/<name>_<kind>_report.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from orderlore.functions.numeric import percent
from orderlore.sources.files import listing, read_data_file

STAGES = ("raw", "processed", "validated")
REPORTS = ("schema", "validation", "bias", "cleaning")
_READERS = {"csv": {"header": True, "inferSchema": True}, "parquet": {}, "json": {}}


def stage_path(root: str, name: str, stage: str) -> str:
    if stage not in STAGES:
        raise ValueError(f"invalid stage: {stage}")
    return f"{root.rstrip('/')}/data/{stage}/{name}_{stage}"


def report_path(root: str, name: str, kind: str) -> str:
    return f"{root.rstrip('/')}/reports/{kind}/{name}_{kind}_report"


def write_stage(df: DataFrame, root: str, name: str, stage: str, fmt: str = "parquet") -> str:
    """S09."""
    path = stage_path(root, name, stage)
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
    return path


def write_report(report: DataFrame, root: str, name: str, kind: str) -> str:
    """Reports are small, so they become one JSON file."""
    path = report_path(root, name, kind)
    report.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_report(spark: SparkSession, root: str, name: str, kind: str, schema: str) -> DataFrame:
    """A stored report, or an empty frame of its schema when there is none."""
    try:
        return spark.read.schema(schema).json(report_path(root, name, kind))
    except AnalysisException:
        return spark.createDataFrame([], schema)


def acquire(spark: SparkSession, path: str, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Read a file of any supported format, store it as the raw stage, return rows and columns."""
    df = read_data_file(spark, path)
    write_stage(df, root, name, "raw", fmt)
    stored = spark.read.options(**_READERS[fmt]).format(fmt).load(stage_path(root, name, "raw"))
    return stored.agg(F.count("*").alias("rows")).select(
        F.lit(name).alias("dataset_name"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns")
    )


def load_stage(spark: SparkSession, root: str, name: str, stage: str = "validated", fmt: str = "parquet") -> DataFrame:
    """A stored stage; a missing one is reported with the names that exist."""
    try:
        return spark.read.options(**_READERS[fmt]).format(fmt).load(stage_path(root, name, stage))
    except AnalysisException as error:
        try:
            known = ", ".join(r["dataset"] for r in list_datasets(spark, root, stage).collect())
        except AnalysisException:
            known = "none"
        raise FileNotFoundError(f"no data set {name} at stage {stage}; available: {known}") from error


def stage_files(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """(dataset, path, modificationTime, length) of the files of a stage."""
    files = listing(spark, f"{root.rstrip('/')}/data/{stage}")
    name = F.regexp_extract("path", rf"/data/{stage}/([^/]+?)_{stage}(?:\.[a-z]+)?(?:/|$)", 1)
    return files.select(name.alias("dataset"), "path", "modificationTime", "length").where(F.col("dataset") != "")


def list_datasets(spark: SparkSession, root: str, stage: str = "validated") -> DataFrame:
    """S13."""
    return stage_files(spark, root, stage).select("dataset").distinct().orderBy("dataset")


def latest_dataset(spark: SparkSession, root: str, stage: str = "validated") -> DataFrame:
    """The data set written last, ties by name."""
    return stage_files(spark, root, stage).agg(
        F.max_by("dataset", F.struct("modificationTime", "dataset")).alias("dataset"),
        F.max("modificationTime").alias("updated"),
    )


def latest_report(spark: SparkSession, folder: str, preferred: str, otherwise: str) -> DataFrame:
    """The newest file whose name contains `preferred`, else the newest containing `otherwise`."""
    files = listing(spark, folder).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    rank = F.when(F.contains("name", F.lit(preferred)), 2).when(F.contains("name", F.lit(otherwise)), 1)
    return files.withColumn("_rank", rank).where(F.col("_rank").isNotNull()).agg(
        F.max_by("path", F.struct("_rank", "modificationTime", "path")).alias("path")
    )


def save_table(df: DataFrame, name: str, suffix: str = "_processed", path: str | None = None) -> str:
    """Replace a warehouse table."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name + suffix)
    return name + suffix


def query_table(spark: SparkSession, table: str, limit: int | None = None) -> DataFrame:
    """S16."""
    df = spark.table(table)
    return df if limit is None else df.limit(limit)


def table_info(spark: SparkSession, table: str) -> DataFrame:
    """Rows, columns, bytes and schema; a missing table gives one row with exists = false."""
    if not spark.catalog.tableExists(table):
        return spark.createDataFrame(
            [(table, False, None, None, None, None)],
            "table string, exists boolean, num_rows bigint, num_columns bigint, num_bytes bigint, schema string",
        )
    df = spark.table(table)
    where = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Location'").first()["data_type"]
    size = listing(spark, where).select(F.coalesce(F.sum("length"), F.lit(0))).scalar()
    return df.agg(F.count("*").alias("num_rows")).select(
        F.lit(table).alias("table"),
        F.lit(True).alias("exists"),
        "num_rows",
        F.lit(len(df.columns)).cast("bigint").alias("num_columns"),
        size.alias("num_bytes"),
        F.lit(df.schema.simpleString()).alias("schema"),
    )


def artifact_summary(spark: SparkSession, root: str, table_suffix: str = "_processed") -> DataFrame:
    """Per data set, which stage files and reports exist."""
    files = listing(spark, root)
    kind = F.regexp_extract("path", r"/(?:data|reports)/([^/]+)/", 1)
    name = F.regexp_extract("path", r"/(?:data|reports)/[^/]+/([^/]+?)_(?:" + "|".join(STAGES + REPORTS) + r")(?:_report)?(?:\.[a-z]+)?/", 1)
    found = files.select(name.alias("dataset"), kind.alias("kind")).where("dataset <> ''").distinct()
    return (
        found.groupBy("dataset")
        .pivot("kind", list(STAGES + REPORTS))
        .agg(F.lit(True))
        .na.fill(False)
    )


def dataset_metadata(stages: Mapping[str, DataFrame], name: str) -> DataFrame:
    """Rows, columns and column names per stage."""
    rows = None
    for stage, df in stages.items():
        one = df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("dataset_name"),
            F.lit(stage).alias("stage"),
            "rows",
            F.lit(len(df.columns)).cast("bigint").alias("columns"),
            F.array(*map(F.lit, df.columns)).alias("column_names"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


def publish(
    stages: Mapping[str, DataFrame], reports: Mapping[str, DataFrame], root: str, name: str, include_raw: bool = False
) -> DataFrame:
    """Write stages and reports under the target and return the manifest, one row per artifact."""
    wanted = [s for s in STAGES if s in stages and (include_raw or s != "raw")]
    paths = {f"data/{s}": write_stage(stages[s], root, name, s) for s in wanted}
    paths |= {f"reports/{k}": write_report(r, root, name, k) for k, r in reports.items()}
    spark = next(iter({**stages, **reports}.values())).sparkSession
    artifact = F.regexp_extract("path", r"/((?:data|reports)/[^/]+)/[^/]+/[^/]+$", 1)
    files = listing(spark, *paths.values()).select(artifact.alias("artifact"), "length")
    return files.groupBy("artifact").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """How much was published."""
    return manifest.agg(
        F.count("*").alias("artifacts_published"),
        F.sum("files").alias("files_published"),
        F.sum("bytes").alias("total_bytes"),
        percent(F.max("bytes"), F.sum("bytes")).alias("largest_pct"),
    )
