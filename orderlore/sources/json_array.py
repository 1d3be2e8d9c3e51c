"""Reading a JSON array of records in byte ranges.

The engine's own reader takes such a file as one value, in one task. Here the file is read as text cut at every closing brace,
which splits into byte ranges like any text. Whether a brace closes a record depends on all that came before it, though: on
the open braces, and on whether a string is open. So each range is first summed up for both cases (it begins inside a string, or
not), one small row a range; these rows in order tell how each range really begins, and a second pass cuts out its records.
A record that crosses ranges comes in parts, which are put together at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlore.session import fresh_path

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_TO_CLOSE = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
_SUMMARY = pa.schema([("file", pa.string()), ("start", pa.int64()), ("text_ends_inside", pa.bool_()), ("text_braces", pa.int64()), ("string_ends_inside", pa.bool_()), ("string_braces", pa.int64())])
_PARTS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("record", pa.int64()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("value", pa.string())])


def _effect(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a string is open after a piece and the brace that ends it, and by how much the open braces have grown."""
    if inside:
        found = _TO_CLOSE.match(piece)
        if not found:
            return True, 0
        piece = piece[found.end() :]
    bare = _STRING.sub("", piece)
    quote = bare.find('"')
    if quote >= 0:
        return True, bare[:quote].count("{") - bare[:quote].count("}")
    return False, bare.count("{") - bare.count("}") - 1


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value")))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, state = None, None
    for file, start, piece in _pieces(batches):
        if (file, start) != place:
            if place:
                yield pa.RecordBatch.from_pylist([_row(place, state)], _SUMMARY)
            place, state = (file, start), [(False, 0), (True, 0)]
        state = [(after, braces + more) for inside, braces in state for after, more in [_effect(piece, inside)]]
    if place:
        yield pa.RecordBatch.from_pylist([_row(place, state)], _SUMMARY)


def _row(place: tuple[str, int], state: list[tuple[bool, int]]) -> dict:
    return dict(zip(_SUMMARY.names, (*place, *state[0], *state[1])))


def _begins(summaries: DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """How each range begins: whether inside a string, and with how many open braces. The driver's own list of ranges to
    read has as many entries."""
    found, at, inside, braces = {}, None, False, 0
    for r in summaries.orderBy("file", "start").toLocalIterator():
        if r["file"] != at:
            at, inside, braces = r["file"], False, 0
        found[r["file"], r["start"]] = (inside, braces)
        kind = "string" if inside else "text"
        inside, braces = r[f"{kind}_ends_inside"], braces + r[f"{kind}_braces"]
    return found


def _cut(begins: dict[tuple[str, int], tuple[bool, int]]):
    """Records of each range. The first part of a range may end a record of an earlier one, the last may lack its end."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, inside, braces, held, number, opened, out = None, False, 0, [], 0, False, []

        def part(closes: bool) -> None:
            nonlocal held, number, opened
            out.append((*place, number, opened, closes, "".join(held).replace("\n", " ").replace("\r", " ")))
            held, number, opened = [], number + 1, False

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), _PARTS)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_PARTS)

        for file, start, piece in _pieces(batches):
            if (file, start) != place:
                if held:
                    part(False)
                place, (inside, braces), held, number, opened = (file, start), begins[file, start], [], 0, False
            if braces <= 0 and not inside:
                first = piece.find("{")
                if first < 0:  # what stands after the last record
                    continue
                piece, opened = piece[first:], True
            inside, more = _effect(piece, inside)
            braces += more
            held.append(piece + "}")
            if braces == 0 and not inside:
                part(True)
                if len(out) >= 2000:
                    yield batch()
        if held:
            part(False)
        if out:
            yield batch()

    return rows


def records(spark: SparkSession, *paths: str) -> DataFrame:
    """The records (objects) of files that each hold an array of them, as one line of JSON text each, in column `value`.

    Files without a record give none. Only files of objects are meant: other elements of the array are passed over.
    """
    pieces = spark.read.option("lineSep", "}").text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    summary = "file string, start bigint, text_ends_inside boolean, text_braces bigint, string_ends_inside boolean, string_braces bigint"
    begins = _begins(pieces.mapInArrow(_summaries, summary))
    parts = pieces.mapInArrow(_cut(begins), "file string, start bigint, record bigint, opens boolean, closes boolean, value string")
    whole = parts.where("opens and closes").select("value")
    # at most two parts a range are incomplete: a record begins at its last one and goes on through whole ranges to a first one
    broken = parts.where("not (opens and closes)").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "record", "opens", "value"))).alias("parts"))
    return whole.unionByName(broken.mapInArrow(_stitch, "value string"))


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.column("parts"):
            out: list[list[str]] = []
            for p in row.as_py():
                if p["opens"]:
                    out.append([])
                out[-1].append(p["value"])
            yield pa.RecordBatch.from_pydict({"value": ["".join(x) for x in out]}, pa.schema([("value", pa.string())]))


def read_array(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """The records as rows. They are written once as lines of JSON, from which the engine infers the schema or reads."""
    lines = fresh_path(spark, "json-lines")
    records(spark, *paths).write.text(lines)
    return (spark.read.schema(schema) if schema else spark.read).json(lines)
