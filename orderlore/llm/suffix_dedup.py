"""Removal of repeated strings by sorted suffixes (operator 8).

Every byte covered by a string of `length` bytes that also starts elsewhere in the corpus is removed. Sorting all suffixes
of a corpus would move each byte `length` times, so only those that can matter are sorted:
 1. of every string of `length` bytes, the k-gram with the smallest hash is an anchor. Equal strings have equal anchors at
    equal places, so only strings around anchors that occur twice can repeat. Anchors come from each text by itself;
 2. an anchor's context is the text that the strings around it can reach. Equal contexts are counted, not compared: all
    their strings repeat, and one of them stands for all in what follows;
 3. the different contexts of an anchor form a group, whose strings are dealt out to four parts by how far before the
    anchor they start. A part goes on under what all its strings have in common (at least 158 bytes), and again contexts
    that are equal are counted and those that are alone under their common part are dropped;
 4. the suffixes at the starts of the strings that are left are ordered by deep-shallow sorting (`suffixes`), group by
    group; neighbours that agree on `length` bytes are repeats. A group of more than `crowd` contexts, as at the edge of a
    passage that many documents have, is not sorted but halved like in step 3, which ends after four rounds at single
    strings: no group is ever too large for a task.
Texts are stored once; contexts and results are dealt out by file (`document_store`), so no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlore.llm.document_store import FILE_BITS, Store, file_of, numbers, store
from orderlore.llm.suffixes import sort_suffixes
from orderlore.llm.tables import stored

LENGTH, GRAM, CROWD, SHALLOW, WAYS = 200, 32, 512, 64, 4
SEGMENT = 1 << 20
_RANDOM = np.random.default_rng(20)
_BYTES = _RANDOM.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_INVERSE = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASE)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.cumprod(out)


class Hasher:
    """Hashes of any part of a byte string, by prefix sums of a polynomial modulo 2^64."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int):
        n = len(data) + 1
        up, down = self._tables.get(which, (np.empty(0), np.empty(0)))
        if len(up) < n:
            size = max(n, 1 << 16)
            up, down = self._tables[which] = _powers(_BASE[which], size), _powers(_INVERSE[which], size)
        self.down = down
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTES[which][data] * up[: n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding(values: np.ndarray, width: int, of: np.ufunc, fill: int) -> np.ndarray:
    """Minimum or maximum of every `width` neighbours, from running values to both sides inside blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, fill, values.dtype)
    padded[:n] = values
    table = padded.reshape(blocks, width)
    ahead = of.accumulate(table, axis=1).ravel()
    back = of.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are the smallest of some string of `length` bytes."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes, width = Hasher(data, 0).grams(gram), length - gram + 1
    least = _sliding(hashes, width, np.minimum, (1 << 64) - 1)
    around = np.zeros(len(hashes) + width - 1, np.uint64)
    around[width - 1 : width - 1 + len(least)] = least
    places = np.flatnonzero(_sliding(around, width, np.maximum, 0) == hashes)
    return places, hashes[places]


def _anchor_rows(rid: int, data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and context hashes of a text, worked on in segments that overlap by two contexts."""
    found: list = []
    for at in range(0, max(1, len(data)), SEGMENT):
        first, last = max(0, at - 2 * length), min(len(data), at + SEGMENT + 3 * length)
        part = data[first:last]
        places, hashes = anchors(part, length, gram)
        inside = (places + first >= at) & (places + first < at + SEGMENT)
        places, hashes = places[inside], hashes[inside]
        left = np.minimum(places + first, length - gram)
        right = np.minimum(len(data) - first - places, length)
        context = Hasher(part, 1).of(places - left, places + right)
        found.append((places + first, hashes, mixed(context ^ (left * 1024 + right).astype(np.uint64))))
    return tuple(np.concatenate(x) for x in zip(*found))


def find_anchors(texts: Store, spark, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """g (hash of the anchor), c (hash of its context), rid, pos and size (of the text) of every anchor of every text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for rid, text in zip(part.column("rid").to_pylist(), part.column("text")):
                    data = np.frombuffer(text.as_buffer(), np.uint8)
                    if len(data) >= length:
                        places, hashes, contexts = _anchor_rows(rid, data, length, gram)
                        out.append((hashes.view(np.int64), contexts.view(np.int64), np.full(len(places), rid), places.astype(np.int32), np.full(len(places), len(data), np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["g", "c", "rid", "pos", "size"])

    return texts.rows(spark).select("rid", "text").mapInArrow(rows, "g bigint, c bigint, rid bigint, pos int, size int")


def _settle(rows: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (g, c, rid, pos, ...) whose context occurs again, and those that go on: one of each context of a group with
    several, in groups of at most `crowd` contexts and in larger ones."""
    twice = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    shared = stored(rows.join(twice, "g"), "context-rows")
    counts = stored(shared.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos")).alias("first")), "contexts")
    groups = counts.groupBy("g").agg(F.count("*").alias("kinds"))
    joined = stored(shared.join(counts, ["g", "c"]).join(groups, "g"), "context-rows")
    again = joined.where("n > 1")
    going = joined.where("kinds > 1 and struct(rid, pos) = first").drop("n", "first")
    return again, going.where(F.col("kinds") <= crowd).drop("kinds"), going.where(F.col("kinds") > crowd).drop("kinds")


def _parts(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _cursor(texts: Store, number: int, columns: list[str]):
    """Text by row number from one file, for ascending row numbers; holds one batch at a time."""
    batches, held, last = texts.batches(number, columns, 200), {}, (-1, b"")

    def text(rid: int) -> bytes:
        nonlocal held, last
        if last[0] != rid:
            while rid not in held:
                batch = next(batches)
                held = dict(zip(batch.column("rid").to_pylist(), batch.column("text")))
            last = (rid, held[rid].as_buffer().to_pybytes())
        return last[1]

    return text


# g: group, c: context; the strings that start `lo` to `hi` bytes before the anchor at `pos` of text `rid`, in a group about
# the strings that start `from` to `to` bytes before it
_RANGE = "g bigint, c bigint, rid bigint, pos int, lo int, hi int, from int, to int"


def _at_texts(rows: DataFrame, texts: Store, schema: str, each) -> DataFrame:
    """Rows of a range with their texts at hand: dealt out by file, in the order of the file. `each` takes the text and
    a row's values and gives tuples of `schema`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(n).to_pylist() for n in wanted)):
                number = row[2] >> FILE_BITS
                if held is None or held[0] != number:
                    held = (number, _cursor(texts, number, ["rid", "text"]))
                out.extend(each(held[1](row[2]), *row))
            for at in range(0, len(out), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[at : at + 5000]), kinds)], names)

    wanted = [x.split()[0] for x in _RANGE.split(", ")]
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    dealt = rows.select(*wanted).repartition(_parts(rows), file_of(F.col("rid"))).sortWithinPartitions("rid", "pos")
    return dealt.mapInArrow(read, schema)


def _split(rows: DataFrame, texts: Store, length: int, ways: int) -> DataFrame:
    """Each range as up to `ways` parts, as far as they hold strings.

    The parts are fixed places before the anchor, so that equal strings stay together. A part's group is what all its
    strings share, its context what they reach in this text.
    """

    def each(text, g, c, rid, pos, lo, hi, first, last):
        width = -(-(last - first + 1) // ways)
        for a in range(first, last + 1, width):
            b = min(last, a + width - 1)
            low, high = max(lo, a), min(hi, b)
            if low <= high:
                core, wide = text[pos - a : pos - b + length], text[pos - high : pos - low + length]
                yield _digest(core, g, a, b), _digest(wide, low, high), rid, pos, low, high, a, b

    return _at_texts(rows, texts, _RANGE, each)


def _digest(data: bytes, *more: int) -> int:
    return xxhash.xxh3_64_intdigest(repr(more).encode() + data) - (1 << 63)


_CONTEXT = "g bigint, rid bigint, pos int, lo int, hi int, ctx binary"


def _with_contexts(rows: DataFrame, texts: Store, length: int) -> DataFrame:
    """The ranges with the bytes that their strings reach, from the start of the farthest."""

    def each(text, g, c, rid, pos, lo, hi, first, last):
        yield g, rid, pos, lo, hi, text[pos - hi : pos - lo + length]

    return _at_texts(rows, texts, _CONTEXT, each)


def _sorted_repeats(rows: DataFrame, length: int, shallow: int) -> DataFrame:
    """rid, pos, lo, hi: places before the anchors from which strings start that equal another of their group."""

    def solve(held: list[dict]) -> Iterator[pa.RecordBatch]:
        data = bytearray()
        starts, labels, owner, place, found = [], [], [], [], []
        names = {g: i for i, g in enumerate(dict.fromkeys(r["g"] for r in held))}
        for i, r in enumerate(held):
            places = np.arange(r["lo"], r["hi"] + 1)
            starts.append(len(data) + r["hi"] - places)
            labels.append(np.full(len(places), names[r["g"]]))
            owner.append(np.full(len(places), i))
            place.append(places)
            data += r["ctx"]
        data += bytes(length + 8)
        owners, places = np.concatenate(owner), np.concatenate(place)
        order, same = sort_suffixes(bytes(data), np.concatenate(starts), np.concatenate(labels), length, shallow)
        rid = np.array([r["rid"] for r in held])[owners]
        at = np.array([r["pos"] for r in held], np.int64)[owners] - places
        # in a class of equal strings, those are repeats that start at more than one place
        kinds = np.cumsum(~same)
        by = np.lexsort((at[order], rid[order], kinds))
        k, r, a, o = kinds[by], rid[order][by], at[order][by], order[by]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1]) | (a[1:] != a[:-1])
        distinct = np.bincount(k, new)
        hit = np.zeros(len(k), bool)
        hit[o] = distinct[k] > 1
        edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        # runs of hits, cut where the context changes
        breaks = np.flatnonzero(owners[1:] != owners[:-1]) + 1
        starts_, ends_ = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        for s, e in zip(starts_.tolist(), ends_.tolist()):
            cuts = [s, *breaks[(breaks > s) & (breaks < e)].tolist(), e]
            found.extend((int(rid[x]), held[owners[x]]["pos"], int(places[x]), int(places[y - 1])) for x, y in zip(cuts, cuts[1:]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds_)], ["rid", "pos", "lo", "hi"])

    kinds_ = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if len(held) >= 1000 and row["g"] != held[-1]["g"]:
                    yield from solve(held)
                    held = []
                held.append(row)
        if held:
            yield from solve(held)

    dealt = rows.repartition(_parts(rows), "g").sortWithinPartitions("g", "rid", "pos")
    return dealt.mapInArrow(rows_of, "rid bigint, pos int, lo int, hi int")


def repeated_places(texts: Store, spark, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, shallow: int = SHALLOW) -> DataFrame:
    """rid, pos, lo, hi: strings that start lo to hi bytes before pos, as far as they fit, occur elsewhere, too."""
    wide = length - gram
    # places of the first byte, before the anchor, from which a whole string fits
    size = F.col("size")
    fits = {"lo": F.greatest(F.lit(0), F.col("pos") + length - size), "hi": F.least(F.col("pos"), F.lit(wide)), "from": F.lit(0), "to": F.lit(wide)}
    going = stored(find_anchors(texts, spark, length, gram), "anchors").withColumns(fits).drop("size")
    # two rounds narrow every range before any suffix is sorted
    again, _, large = _settle(going, 0)
    found = [again]
    again, _, large = _settle(_split(large, texts, length, WAYS), 0)
    found.append(again)
    ways = WAYS
    while not large.isEmpty():
        again, small, large = _settle(_split(large, texts, length, ways), crowd)
        found += [again, stored(_sorted_repeats(_with_contexts(small, texts, length), length, shallow), "repeats")]
        ways = 2
    out = found[0].select("rid", "pos", "lo", "hi")
    for more in found[1:]:
        out = out.union(more.select("rid", "pos", "lo", "hi"))
    return out


def _kept(texts: Store, length: int, columns: list[str]):
    """Documents of the files dealt to a task, without the bytes that repeated strings cover."""

    def finish(number: int, intervals: dict[str, list]) -> Iterator[pa.RecordBatch]:
        rid, a, b = (np.array(intervals[k], np.int64) for k in ("rid", "a", "b"))
        for batch in texts.batches(number, ["rid", "doc_id", "text"], 500):
            rids = batch.column("rid").to_numpy()
            first, last = np.searchsorted(rid, rids), np.searchsorted(rid, rids, "right")
            spans, kept = [], []
            for text, i, j in zip(batch.column("text"), first.tolist(), last.tolist()):
                data = text.as_buffer().to_pybytes()
                n, own = len(data), []
                lo, hi = np.maximum(a[i:j], 0), np.minimum(b[i:j], n - length)
                good = lo <= hi
                for s, e in sorted(set(zip(lo[good].tolist(), (hi[good] + length).tolist()))):
                    if own and s <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], e)
                    else:
                        own.append([s, e])
                spans.append([{"start": s, "end": e} for s, e in own])
                ends = [0, *(x for s in own for x in s), n]
                kept.append(b"".join(data[x:y] for x, y in zip(ends[::2], ends[1::2])))
            sizes = [len(t.as_buffer()) for t in batch.column("text")]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], columns)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, {"rid": [], "a": [], "b": []}
        for batch in batches:
            files = batch.column("file").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if number is not None and number != files[x]:
                    yield from finish(number, held)
                    held = {"rid": [], "a": [], "b": []}
                number = int(files[x])
                for key in held:
                    held[key].extend(v for v in batch.column(key).slice(x, y - x).to_pylist() if v is not None)
        if number is not None:
            yield from finish(number, held)

    return rows


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, shallow: int = SHALLOW) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs, start and end exclusive, in bytes) and kept (the other bytes) of every row.

    Strings are judged on the input; those of one text count as well, overlapping or not. Texts shorter than `length` bytes
    stay whole. Null texts count as empty; null and repeated ids keep one row per input row (rows equal in all columns are
    copies like any other, so their texts repeat); an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = store(docs)
    found = repeated_places(texts, spark, length, gram, crowd, shallow)
    starts = found.select("rid", (F.col("pos") - F.col("hi")).alias("a"), (F.col("pos") - F.col("lo")).alias("b"))
    files = spark.createDataFrame([(n,) for n in numbers(texts)], "file bigint").select("file", *(F.lit(None).cast("bigint").alias(c) for c in ("rid", "a", "b")))
    dealt = starts.select(file_of(F.col("rid")).alias("file"), "rid", F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).union(files)
    dealt = dealt.repartition(_parts(docs), "file").sortWithinPartitions("file", "rid")
    columns = ["doc_id", "n_bytes", "spans", "kept"]
    return dealt.mapInArrow(_kept(texts, length, columns), "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def digests(kept: DataFrame) -> DataFrame:
    """Sizes, and digest of the bytes that stay."""
    removed = F.col("n_bytes") - F.octet_length("kept")
    return kept.select("doc_id", "n_bytes", removed.cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
