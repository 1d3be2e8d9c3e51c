"""A stored copy of the documents with row numbers, whose files tasks can open by themselves.

The row number's upper bits name the file, so whatever is known of rows can be brought to their texts by dealing it out by
file: the texts are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlore.llm.tables import filesystem
from orderlore.session import fresh_path

FILE_BITS = 33
_FILE = re.compile(r"part-(\d+)(-[^/]*\.parquet)")


@dataclass(frozen=True)
class Store:
    path: str
    name: str  # of the files, with a place for their number

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def batches(self, number: int, columns: list[str], size: int = 2000) -> Iterator[pa.RecordBatch]:
        """Rows of one file in order of their numbers."""
        files, place = filesystem(self.path)
        with files.open_input_file(f"{place}/{self.name.format(number)}") as file:
            yield from pq.ParquetFile(file).iter_batches(size, columns=columns)


def file_of(rid: Column) -> Column:
    return F.shiftright(rid, FILE_BITS)


def numbers(texts: Store) -> list[int]:
    """Numbers of the files."""
    files, place = filesystem(texts.path)
    names = (f.base_name for f in files.get_file_info(pafs.FileSelector(place)))
    return [int(m[1]) for m in map(_FILE.fullmatch, names) if m]


def store(docs: DataFrame) -> Store:
    """Write doc_id and text (null as empty) with a row number `rid`."""
    path = fresh_path(docs.sparkSession, "documents")
    text = F.coalesce("text", F.lit("")).alias("text")
    docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), text).write.option("maxRecordsPerFile", 0).parquet(path)
    files, place = filesystem(path)
    found = next(m for f in files.get_file_info(pafs.FileSelector(place)) if (m := _FILE.fullmatch(f.base_name)))
    return Store(path, f"part-{{:05d}}{found[2]}")
