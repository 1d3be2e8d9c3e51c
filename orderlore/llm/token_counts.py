"""Token counts with a digest cache (operator 9).

A text's count depends on its content and on the tokenizer's version only. Counts are stored under the pair of digests;
a run joins the corpus to the stored counts, encodes each distinct missing text once and appends it to the store.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlore.llm.byte_tokens import byte_encoder
from orderlore.llm.tables import map_arrow
from orderlore.session import fresh_path

CACHE = "digest binary, version string, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _counts(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path)
        for batch in batches:
            counts = [len(encoder.encode(t.as_py())) // encoder.dtype.itemsize for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return rows


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """Token count of each document: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    `path` is the vocabulary file, present on every node. `cache` is the folder of the stored counts; without one a new
    folder under the shared folder is used. It is only appended to, and a count that two runs both add is the same, so
    repeated digests are folded when read. Normalised content is the text itself, a null text being the empty one: any
    stronger normal form would change the count. Null texts count as empty (no tokens); null ids and repeated ids keep
    one result row per input row; an empty table gives an empty result; other columns are ignored. A text is shuffled
    once, after equal texts of a task were folded; a group of copies of any size is encoded once.
    """
    spark = docs.sparkSession
    version, cache = tokenizer_version(path), cache or fresh_path(spark, "token-counts")
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    rows = docs.select("doc_id", digest.alias("digest"), text.alias("text"))

    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)

    def known() -> DataFrame:
        found = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
        return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    distinct = rows.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(known(), "digest", "left_anti")
    counted = map_arrow(misses, _counts(path), "digest binary, n_tokens bigint")
    counted.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)

    sizes = docs.select("doc_id", digest.alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    return sizes.join(known(), "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
