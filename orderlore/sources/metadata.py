"""The table of data set descriptions: upsert, lookup, listing, deletion.

Plain parquet has no MERGE, so every change writes a complete new version; a reader never sees a
folder that is being rewritten.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "dataset_name string, metadata string, llm_context string, row_count bigint, column_count bigint, "
    "created_at timestamp, updated_at timestamp"
)


def upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The newest record per data set, with the time the first one was created.

    An aggregate, not a window, so that many changes of one data set are folded before the shuffle.
    """
    both = current.unionByName(changes)
    kept = [c for c in both.columns if c not in ("dataset_name", "created_at")]
    newest = both.groupBy("dataset_name").agg(
        F.max_by(F.struct(*kept), F.struct("updated_at", "metadata", "llm_context")).alias("_r"),
        F.min("created_at").alias("created_at"),
    )
    return newest.select("dataset_name", "_r.*", "created_at").select(*both.columns)


def lookup(table: DataFrame, dataset_name: str) -> DataFrame:
    """The record of one data set with its metadata parsed."""
    return table.where(F.col("dataset_name") == dataset_name).withColumn("metadata", F.try_parse_json("metadata"))


def exists(table: DataFrame, dataset_name: str) -> bool:
    return not table.where(F.col("dataset_name") == dataset_name).isEmpty()


def list_all(table: DataFrame) -> DataFrame:
    """Newest first."""
    return table.select("dataset_name", "row_count", "column_count", "created_at", "updated_at").orderBy(
        F.col("updated_at").desc(), "dataset_name"
    )


def delete(table: DataFrame, dataset_name: str) -> DataFrame:
    """The table without one data set; rows without a name stay."""
    return table.where(~F.col("dataset_name").eqNullSafe(dataset_name))


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed versions: those whose folder has the mark that a finished write leaves."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    marks = hadoop.Path(f"{root.rstrip('/')}/version=*/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks) or []
    return sorted(int(m[1]) for f in found if (m := re.search(r"/version=(\d+)/", f.getPath().toString())))


def write_version(table: DataFrame, root: str, version: int, keep: int = 3) -> str:
    """Write a new version and prune all but the `keep` newest committed ones."""
    path = f"{root.rstrip('/')}/version={version}"
    table.write.mode("errorifexists").parquet(path)
    spark = table.sparkSession
    for old in _versions(spark, root)[:-keep]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/version={old}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return path


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The highest committed version; one without its success mark, as a broken write leaves it, is ignored."""
    committed = _versions(spark, root)
    if not committed:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{root.rstrip('/')}/version={committed[-1]}")
