"""Token ids as flat binary files (operator 5).

A shard is `<name>.bin`, the ids of its documents as little-endian unsigned integers one after the other, and
`<name>.idx`, little-endian 64-bit offsets: where each document starts, in ids from the start of the whole corpus, and one
more for the end of the last. A reader maps both files into memory. Shards hold ascending ranges of doc_id; the base
of a shard is the sum of the ids of all shards before it. The table of shards is the only list of valid files: a file
left behind by a lost or repeated task is in no row of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlore.llm.byte_tokens import END_ID, byte_encoder
from orderlore.llm.tables import filesystem, map_arrow, stored
from orderlore.session import fresh_path


def _write(path: str, folder: str, end_id: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (files, place) = byte_encoder(path), filesystem(folder)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
        end = np.array([end_id], encoder.dtype).tobytes()
        sizes, ids = [], []
        with files.open_output_stream(f"{place}/{name}.bin") as out:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    data = encoder.encode(text.as_py() or "")
                    out.write(data + end)
                    sizes.append(len(data) // encoder.dtype.itemsize + 1)
                    ids.append(doc_id)
        if not ids:
            files.delete_file(f"{place}/{name}.bin")
            return
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
        with files.open_output_stream(f"{place}/{name}.loc") as out:
            out.write(starts.tobytes())
        keys = pa.array(ids, pa.int64())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64())])) as writer:
            writer.write_batch(pa.RecordBatch.from_arrays([keys], ["doc_id"]))
        with files.open_output_stream(f"{place}/{name}.ids") as out:
            out.write(sink.getvalue())
        row = {"shard": [shard], "name": [name], "ids_width": [encoder.dtype.itemsize], "n_docs": [len(ids)], "n_ids": [int(starts[-1])]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("name", pa.string()), ("ids_width", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return rows


def _index(folder: str):
    """Adds the base to the offsets of each shard and writes its .idx file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(f"{place}/{row['name']}.loc") as file:
                    starts = np.frombuffer(file.read(), "<i8") + row["base"]
                with files.open_output_stream(f"{place}/{row['name']}.idx") as out:
                    out.write(starts.astype("<i8").tobytes())
            yield batch

    return rows


def write_tokens(docs: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, str]:
    """Encode all documents into shards in ascending doc_id order; the table of shards and the folder.

    Each document gets `end_id` after its ids. Null texts are empty (the end id only); null ids come first; equal ids
    are ordered by text. An empty table gives no shards. Other columns are ignored. The rows are dealt by ranges of
    doc_id and sorted inside a range, so no task holds more than its range; ids go to the file as they are made.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    files, place = filesystem(folder)
    files.create_dir(place, recursive=True)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    written = map_arrow(dealt, _write(path, folder, end_id), "shard int, name string, ids_width int, n_docs bigint, n_ids bigint")
    shards = stored(written, "token-shards")
    # one row a shard: the running sum over all shards is a small table
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    indexed = based.repartition(parts, "shard")
    return stored(map_arrow(indexed, _index(folder), ", ".join(f"{n} {t}" for n, t in based.dtypes)), "token-index"), folder


def _read(folder: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = filesystem(folder)

        def mapped(name: str, dtype: str) -> np.ndarray:
            full = f"{place}/{name}"
            if files.type_name == "local":
                return np.memmap(full, dtype, "r")
            with files.open_input_file(full) as file:
                return np.frombuffer(file.read_buffer(), dtype)

        for batch in batches:
            for shard in batch.to_pylist():
                name = shard["name"]
                ids, starts = mapped(f"{name}.bin", f"<u{shard['ids_width']}"), mapped(f"{name}.idx", "<i8")
                with files.open_input_file(f"{place}/{name}.ids") as file:
                    keys = pa.ipc.open_stream(file).read_all().column("doc_id")
                base = shard["base"]
                for at in range(0, len(starts) - 1, 1024):
                    own = starts[at : at + 1025]
                    texts = [ids[a - base : b - base].astype("<u4").tobytes() for a, b in zip(own[:-1], own[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(at, len(texts)).combine_chunks(), pa.array(own[:-1]), pa.array(np.diff(own)), pa.array(texts, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return rows


def read_tokens(shards: DataFrame, folder: str) -> DataFrame:
    """The documents of a token folder: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    return map_arrow(shards, _read(folder), "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def digests(tokens: DataFrame) -> DataFrame:
    """Start, length and checksum of each document read back."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

