"""Texts as blocks of word numbers, and sums over the equal keys of all blocks (operator 7).

A block is a file with some two million words of whole texts: the 64-bit hashes of its distinct words and, for each word, its
number among them. Blocks are told apart by name, so they stay what they are when a task is run again.

`exchange` adds up what blocks know of the same key without a row for each key: a block sends one sorted, delta-coded array
of its distinct keys and their columns to each range of keys; a range merges the arrays and sends back, in the order asked and
without the keys, what all blocks know. Ranges are worked through in rounds, each with a shuffle of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlore.llm.tables import filesystem, stored
from orderlore.session import fresh_path

START = np.uint64(0x9E3779B97F4A7C15)
BLOCK, SLICE, ROUNDS = 2_000_000, 500, 2
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a key that are as good as random, so that nobody tries to compress them.
_RANDOM = 5
#: Added to the level of rows with tallies, and of rows with all columns of an answer but the last three.
TALLIES, EARLIER = 10, 20
_MESSAGE = "block string, level int, shard int, payload binary"


@contextmanager
def brief_shuffles(spark: SparkSession):
    """Inside, the shuffle files of a write go as soon as it has ended, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def pack(*columns: np.ndarray, keyed: bool = False) -> bytes:
    """Columns of equal length as planes of bytes, without planes of zeros; the first holds ascending keys if `keyed`."""
    head, body = [len(columns[0]), len(columns)], []
    for k, column in enumerate(columns):
        values = np.ascontiguousarray(column).astype("<u8")
        if keyed and k == 0:
            values[1:] -= values[:-1].copy()
        width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
        head.append(width)
        for byte in range(width):
            plane = values.view(np.uint8).reshape(-1, 8)[:, byte].tobytes()
            if not (keyed and k == 0 and byte < _RANDOM):
                plane = min(plane, pa.compress(plane, codec="zstd", asbytes=True), key=len)
            head.append(len(plane))
            body.append(plane)
    return np.array([len(head), *head], "<u4").tobytes() + b"".join(body)


def unpack(data: bytes, keyed: bool = False) -> list[np.ndarray]:
    size = int(np.frombuffer(data, "<u4", 1)[0])
    n, count, *head = np.frombuffer(data, "<u4", size, 4).tolist()
    at, columns, lengths = 4 * (size + 1), [], iter(head)
    for k in range(count):
        width = next(lengths)
        values = np.zeros(n, "<u8" if width > 4 or (keyed and k == 0) else "<u4")
        for byte in range(width):
            plane = data[at : at + (length := next(lengths))]
            at += length
            plane = plane if length == n else pa.decompress(plane, n, codec="zstd", asbytes=True)
            values.view(np.uint8).reshape(-1, values.itemsize)[:, byte] = np.frombuffer(plane, np.uint8)
        columns.append(np.cumsum(values, dtype="<u8") if keyed and k == 0 else values)
    return columns


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the place of every key among them, and where each is met first."""
    if not len(keys):
        return keys, np.zeros(0, np.int32), np.zeros(0, np.int32)
    bits = np.uint64(len(keys).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = keys & ~low
    order |= np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order = (order & low).astype(np.int32 if len(keys) < 1 << 31 else np.int64)
    ranked = keys[order]
    wrong = np.flatnonzero(ranked[1:] < ranked[:-1])  # different keys with equal upper bits
    if len(wrong) > 100:
        order = np.argsort(keys, kind="stable").astype(order.dtype)
    elif len(wrong):
        upper = ranked >> bits
        for x in set(upper[wrong].tolist()):
            a, b = np.searchsorted(upper, np.array([x, x + 1], np.uint64))
            order[a:b] = order[a:b][np.argsort(ranked[a:b], kind="stable")]
    if len(wrong):
        ranked = keys[order]
    new = np.empty(len(keys), bool)
    new[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    places = np.empty(len(keys), order.dtype)
    places[order] = np.cumsum(new, dtype=order.dtype) - 1
    return ranked[new], places, order[new]


class _Numbers(dict):
    """Numbers of the words of a language within a block; a new word's hash is appended to `hashes`."""

    def __init__(self, lang: str):
        self.seed, self.hashes = xxhash.xxh32_intdigest(lang.encode()), []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return number


def write_blocks(docs: DataFrame, identity: Column, words: int = BLOCK) -> tuple[DataFrame, str]:
    """Messages with the name, language and words of each block, and their folder, which has one of its own for each language.

    A block has texts of one language. Texts without words are in none.
    """
    folder = fresh_path(docs.sparkSession, "word-blocks")
    files, place = filesystem(folder)
    files.create_dir(place, recursive=True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = filesystem(folder)
        numbers, held, sizes = {}, {}, {}

        def flush(lang: str) -> pa.RecordBatch:
            known, texts, size = np.array(numbers.pop(lang).hashes, np.uint64), held.pop(lang), sizes.pop(lang)
            ids = np.concatenate([x[1] for x in texts])
            # frequent words get small numbers; words as frequent are in order of their hashes
            order = np.lexsort((known, -np.bincount(ids, minlength=len(known))))
            rank = np.empty(len(known), np.int32)
            rank[order] = np.arange(len(known))
            code = xxhash.xxh64_intdigest(lang.encode())
            of_texts = [np.array([x[0] for x in texts], np.int64).view(np.uint64), np.array([len(x[1]) for x in texts])]
            parts = [pack(known[order], keyed=True), pack(rank[ids]), pack(*of_texts)]
            name = f"{code:016x}/{uuid.uuid4().hex}"
            files.create_dir(f"{place}/{code:016x}", recursive=True)
            with files.open_output_stream(f"{place}/{name}") as out:
                out.write(np.array([len(x) for x in parts], "<u8").tobytes() + b"".join(parts))
            return _batch([name], -1, [0], [pack(np.array([code, size], np.uint64))])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for h, lang, text in zip(*(batch.column(x).slice(at, SLICE).to_pylist() for x in ("h", "lang", "text"))):
                    if not (found := text.encode().split()):
                        continue
                    if lang not in numbers:
                        numbers[lang], held[lang], sizes[lang] = _Numbers(lang), [], 0
                    held[lang].append((h, np.fromiter(map(numbers[lang].__getitem__, found), np.int32, len(found))))
                    sizes[lang] += len(found)
                    if sizes[lang] >= words:
                        yield flush(lang)
                    elif sum(sizes.values()) >= 2 * words:
                        yield flush(max(sizes, key=sizes.get))
        for lang in list(held):
            yield flush(lang)

    text = docs.select(identity.alias("h"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(text.mapInArrow(rows, _MESSAGE), "word-blocks"), folder


def language_groups(blocks: DataFrame) -> list[np.ndarray]:
    """Languages to work on at the same time, at most as many words as the largest language has; that comes last."""
    sizes: dict[int, int] = {}
    for row in blocks.select("payload").collect():  # one small row a block
        code, size = unpack(bytes(row["payload"]))[0].tolist()
        sizes[code] = sizes.get(code, 0) + size
    groups, room = [], 0
    for code in sorted(sizes, key=lambda x: (sizes[x], x)):
        if sizes[code] > room:
            groups.append([])
            room = max(sizes.values())
        groups[-1].append(code)
        room -= sizes[code]
    return [np.array(sorted(x), np.uint64) for x in groups]


def of_languages(blocks: DataFrame, codes: np.ndarray) -> DataFrame:
    return blocks.where(F.substring("block", 1, 16).isin([f"{x:016x}" for x in codes.tolist()]))


def drop_folder(folder: str) -> None:
    files, place = filesystem(folder)
    files.delete_dir(place)


def _batch(blocks: list[str], level: int, shards: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(blocks, pa.string()), pa.array([level] * len(blocks), pa.int32()), pa.array(shards, pa.int32()), pa.array(payloads, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "level", "shard", "payload"])


def read_block(folder: str, name: str) -> tuple[int, list[np.ndarray]]:
    """The language's code; hashes of the distinct words, number of each word, identity and length of the texts."""
    files, place = filesystem(folder)
    with files.open_input_file(f"{place}/{name}") as file:
        data = file.read()
    ends = np.cumsum(np.concatenate([[24], np.frombuffer(data, "<u8", 3)])).astype(int)
    parts = [data[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return int(name[:16], 16), [*unpack(parts[0], keyed=True), *(x for part in parts[1:] for x in unpack(part))]


def _by_group(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[object, list[dict]]]:
    """Rows that follow each other with the same value of a column."""
    held: list[dict] = []
    for batch in batches:
        for at in range(batch.num_rows):
            row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
            if held and held[0][name] != row[name]:
                yield held[0][name], held
                held = []
            held.append(row)
    if held:
        yield held[0][name], held


def with_blocks(messages: list[DataFrame], rows: Callable[[str, dict[int, list[np.ndarray]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `rows` makes of the name of each block and the answers to it: for each level its columns in order of the keys."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own in _by_group(batches, "block"):
            levels = sorted({x["level"] for x in own} - {-1})
            found = {level: [np.concatenate(c) for c in zip(*(unpack(x["payload"]) for x in own if x["level"] == level))] for level in levels}
            yield from rows(block, {level: [*found.get(level + EARLIER, []), *found[level]] for level in levels if level < EARLIER})

    every = messages[0]
    for more in messages[1:]:
        every = every.unionByName(more)
    parts = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return every.repartition(parts, "block").sortWithinPartitions("block", "level", "shard").mapInArrow(mapped, schema)


def _answers(level: int, kinds: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, asked in _by_group(batches, "shard"):
            own = [unpack(x["payload"], keyed=True) for x in asked]
            ends = np.cumsum([0, *(len(x[0]) for x in own)])
            distinct, places, at = grouped(np.concatenate([x[0] for x in own]))
            sums = []
            for column in range(1, len(own[0]) - 1):
                values = np.concatenate([x[column] for x in own])
                sums.append(np.bincount(places, weights=values, minlength=len(distinct)).astype(np.int64))
            # the last two columns are the counts of the n-grams themselves
            kind = np.concatenate([x[-1] for x in own])[at].astype(np.int64)
            tallies = [_tally(n, kind, kinds) for n in sums[-2:]]
            first = np.zeros(len(places), np.uint8)
            first[at] = 1
            places = [places[a:b] for a, b in zip(ends[:-1], ends[1:])]
            for own_level, columns in ((level, sums[-2:]), (level + EARLIER, sums[:-2])):
                if columns:
                    flags = [[first[a:b]] if own_level == level else [] for a, b in zip(ends[:-1], ends[1:])]
                    yield _batch([x["block"] for x in asked], own_level, [shard] * len(asked), [pack(*(c[x] for c in columns), *f) for x, f in zip(places, flags)])
            yield _batch([""], level + TALLIES, [shard], [pack(*(c for t in tallies for c in t))])

    return rows


def _tally(n: np.ndarray, kind: np.ndarray, kinds: int) -> list[np.ndarray]:
    """For each kind: how many keys, how many with a count of 1, 2, 3, 4 and of more than 0, and the sum of the counts."""
    counted = [np.bincount(kind[x], minlength=kinds)[:kinds] for x in (n >= 0, n == 1, n == 2, n == 3, n == 4, n > 0)]
    return [*counted, np.bincount(kind, n, kinds)[:kinds].astype(np.int64)]


def exchange(messages: list[DataFrame], asks: Callable, level: int, kinds: int, folder: str, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers to what `asks` gives for each block: its ascending distinct keys, their columns of whole numbers, and last their
    kind (`kinds` for those of none).

    An answer holds for each key the sums of the columns but the kind over all blocks, and last whether this block is the
    first that has it. Given are the answers' last three columns, the others, which not every step needs, and the tallies
    of the last two sums by kind, one row a range. They are stored in `folder`.
    """
    spark = messages[0].sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = parts * rounds
    answers = []
    for turn in range(rounds):
        own = range(turn * parts, (turn + 1) * parts)
        bounds = np.array([min(-(-(x << 64) // ranges), (1 << 64) - 1) for x in (*own, own[-1] + 1)], np.uint64)

        def rows(block: str, replies: dict[int, list[np.ndarray]], own=own, bounds=bounds) -> Iterator[pa.RecordBatch]:
            keys, columns = asks(block, replies)
            ends = np.searchsorted(keys, bounds)
            if own[-1] == ranges - 1:
                ends[-1] = len(keys)
            sent = [(shard, pack(keys[a:b], *(c[a:b] for c in columns), keyed=True)) for shard, a, b in zip(own, ends[:-1], ends[1:]) if a < b]
            yield _batch([block] * len(sent), level, [x[0] for x in sent], [x[1] for x in sent])

        asked = with_blocks(messages, rows, _MESSAGE).repartition(parts, "shard").sortWithinPartitions("shard", "block")
        path = f"{folder}/answers-{level}-{turn}"
        asked.mapInArrow(_answers(level, kinds), _MESSAGE).write.option("compression", "zstd").parquet(path)
        answers.append(spark.read.schema(_MESSAGE).parquet(path))
    every = answers[0]
    for more in answers[1:]:
        every = every.unionByName(more)
    own = F.col("level")
    return every.where(own < TALLIES), every.where(own >= EARLIER), every.where((own >= TALLIES) & (own < EARLIER))
