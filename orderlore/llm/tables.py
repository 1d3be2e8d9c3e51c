"""Shared helpers of the text operators: table access, shared files and Arrow mapping."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlore.session import fresh_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, whatever folder they are started in."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> Column:
    """16 bytes that identify a text. With the document's id it names a row, so that repeated ids stay apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, and still there when executors are lost.

    Zstandard instead of Snappy, whose buffers outside of the heap stay until the next collection.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(rows, schema)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder's URI (file, hdfs, s3, gs), for code inside tasks."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)
