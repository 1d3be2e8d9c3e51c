"""Reading files of several formats and listing what is there."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlore.sources.json_array import read_array

# fixed values: file endings and the format each stands for
FORMATS = {
    ".csv": "csv",
    ".xlsx": "excel",
    ".xls": "excel",
    ".json": "json",
    ".parquet": "parquet",
    ".txt": "text",
}
READABLE = ("csv", "json", "parquet")
SEARCH_ORDER = ("csv", "xlsx", "json", "parquet", "txt")


def file_format(path: str) -> str:
    """S01."""
    return FORMATS.get(PurePosixPath(path.rstrip("/")).suffix.lower(), "unknown")


def file_format_column(path: Column) -> Column:
    """S01 for a listing of paths."""
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]+)/?$", 1))
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.coalesce(known[ending], F.lit("unknown"))


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8", schema: str | None = None) -> DataFrame:
    """Header and inferred types; a stored schema avoids the second pass that inference needs."""
    reader = spark.read.option("header", True).option("encoding", encoding)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, array: bool = True, schema: str | None = None) -> DataFrame:
    """An array of records, or with array=False one record per line. Both are read in byte ranges."""
    if array:
        return read_array(spark, path, schema=schema)
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S05."""
    return spark.read.parquet(path)


def read_data_file(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Read by ending; formats without a distributed reader are refused before any job starts."""
    kind = file_format(path)
    if kind == "csv":
        return read_csv(spark, path, encoding or probe_encoding(spark, path))
    if kind == "json":
        return read_json(spark, path)
    if kind == "parquet":
        return read_parquet(spark, path)
    raise ValueError(f"unsupported file format: {kind}")


def listing(spark: SparkSession, *folders: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Files under the folders: path, modificationTime, length. The contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", recursive)
        .load(list(folders))
        .select("path", "modificationTime", "length")
    )


def encodings(spark: SparkSession, *paths: str, pattern: str = "*") -> DataFrame:
    """(path, encoding) per file: a UTF-16 mark, valid UTF-8, else Latin-1 (iso-8859-1), which reads any bytes.

    The files are read in byte ranges, line by line: no byte of a UTF-8 character is a line feed, so a file is valid if all its
    lines are. No task holds more than a line, whatever the size of the file. Empty files, which the engine passes over, have
    no row.
    """
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).text(list(paths))
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    lines = lines.select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value")
    head = F.hex(F.substring(F.col("value").cast("binary"), 1, 2))
    found = lines.groupBy("file").agg(F.min_by(head, "place").alias("mark"), F.bool_and(F.is_valid_utf8("value")).alias("valid"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(list(paths)).select("path", F.col("_metadata.file_path").alias("file"))
    kind = F.when(F.col("mark").isin("FFFE", "FEFF"), "utf-16").when(F.col("valid"), "utf-8").otherwise("iso-8859-1")
    return files.join(found, "file").select("path", kind.alias("encoding"))


def probe_encoding(spark: SparkSession, path: str) -> str:
    """One encoding for a data set: the least permissive that fits all of its files."""
    order = F.array(*map(F.lit, ["utf-8", "utf-16", "iso-8859-1"]))
    found = encodings(spark, path).agg(F.max_by("encoding", F.array_position(order, F.col("encoding")))).first()
    return found[0] or "utf-8"


def find_data_files(spark: SparkSession, folders: Sequence[str], formats: Sequence[str] = SEARCH_ORDER) -> DataFrame:
    """The first file by folder, then format, then path."""
    files = listing(spark, *folders, recursive=False)
    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]+$", 1), r"^file:/*", "/")
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    places = F.array(*[F.lit("/" + f.split("://")[-1].strip("/")) for f in folders])
    kinds = F.array(*map(F.lit, formats))
    return (
        files.select(
            "path",
            F.array_position(places, folder).alias("folder_rank"),
            F.array_position(kinds, ending).alias("format_rank"),
        )
        .where(F.col("format_rank") > 0)
        .orderBy("folder_rank", "format_rank", "path")
        .limit(1)
    )


def file_info(spark: SparkSession, *paths: str) -> DataFrame:
    """Path, name, size, time and ending of the files behind the paths."""
    return listing(spark, *paths).select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.col("length").alias("size"),
        F.round(F.col("length") / 1048576, 2).alias("size_mb"),
        F.col("modificationTime").alias("modified"),
        F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("extension"),
    )


def pair_examples(documents: DataFrame, answers: DataFrame, n: int | None = 3) -> DataFrame:
    """Documents with the answer of the same stem, in stem order; the rest is skipped.

    Both sides are listings with `path`; the answer's text may travel along.
    """
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    left = documents.select(stem.alias("id"), F.col("path").alias("document_path"))
    right = answers.select(stem.alias("id"), *[F.col(c).alias(f"answer_{c}") for c in answers.columns])
    pairs = left.join(right, "id")
    return pairs if n is None else pairs.orderBy("id").limit(n)


def data_url(content: Column, mime: str = "application/pdf") -> Column:
    """Bytes as a data URL; the line breaks that base64 puts in are not allowed there."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.translate(F.base64(content), "\r\n", ""))
