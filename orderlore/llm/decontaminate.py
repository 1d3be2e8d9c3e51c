"""Benchmark decontamination by a prefix-filtered join (operator 1).

Every item is cut into windows of `window` consecutive words. A document holds a window only if it holds all its shingles,
so one shingle suffices as the necessary prefix of exact containment, and the best is the one the corpus has least often:
 1. the corpus is scanned once to count the items' shingles, and each window is filed under its rarest one (windows with
    a shingle that never occurs are dropped: they can't occur);
 2. a second scan emits the places of these prefix shingles with the words around them, and a join on the shingle meets
    places with windows. The window must fit into the document around the place (length and positional bounds) before
    its words are compared one by one.
Both scans use a bitmap of fixed size to pass over shingles that no window has. It may let others through, which the
join removes; how many items there are changes its hit rate, never the result or the size of what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlore.llm.tables import LOWER, UPPER, lower_ascii, stored, text_key

WINDOW, SHINGLE, FILTER_BITS = 10, 3, 22
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A-Z to a-z, all other bytes that are in no word to a blank
_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SPLIT).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each place on."""
    n = max(0, len(hashes) - size + 1)
    total = np.full(n, np.uint64(size))
    for i in range(size):
        total = (total ^ hashes[i : i + n]) * _MULTIPLIER
        total ^= total >> np.uint64(29)
    return (total * _MIX) ^ (total >> np.uint64(32))


def _shingle_hash(words: DataFrame) -> DataFrame:
    """Adds `sh`, the hash of the array of words in `shingle`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [int(_shingles(_hashes([w.encode() for w in s]), len(s))[0]) for s in batch.column("shingle").to_pylist()]
            yield batch.append_column("sh", pa.array(np.array(own, np.uint64).view(np.int64)))

    return words.mapInArrow(rows, ", ".join(f"{n} {t}" for n, t in words.dtypes) + ", sh bigint")


def windows_of(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Distinct windows with their shingles (win, m, at, s, sh), and which item has which window (win, item_id)."""
    words = items.select("item_id", F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    m = F.least(F.size("w"), F.lit(window))
    cut = words.select("item_id", "w", m.alias("m"), F.explode(F.sequence(F.lit(1), F.size("w") - m + 1)).alias("at"))
    owned = stored(cut.select("item_id", F.slice("w", F.col("at"), F.col("m")).alias("words")).select("item_id", F.array_join("words", " ").alias("win"), F.size("words").alias("m")).distinct(), "item-windows")
    s = F.least("m", F.lit(shingle))
    distinct = owned.select("win", "m").distinct().withColumn("s", s)
    placed = distinct.select("win", "m", "s", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("s"))).alias("at"))
    shingled = placed.withColumn("shingle", F.slice(F.split("win", " "), F.col("at") + 1, F.col("s")))
    return stored(_shingle_hash(shingled).drop("shingle"), "window-shingles"), owned


def _bitmap(shingles: DataFrame, bits: int) -> tuple[np.ndarray, list[int]]:
    """Bitmap of the top bits of the hashes, at most 2^bits slots, and the lengths of the shingles."""
    slots = shingles.select(F.shiftrightunsigned("sh", 64 - bits).cast("int").alias("slot"), "s").distinct().toArrow()
    bitmap = np.zeros(1 << bits, bool)
    bitmap[slots.column("slot").to_numpy()] = True
    return np.packbits(bitmap, bitorder="little"), sorted(set(slots.column("s").to_pylist()))


def _passing(hashes: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Places whose shingle the bitmap lets through."""
    slot = hashes >> np.uint64(64 - bits)
    return np.flatnonzero(bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)


def _counted(docs: DataFrame, bitmap: np.ndarray, sizes: list[int], bits: int) -> DataFrame:
    """How often the corpus has each shingle that the bitmap lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text"):
                hashes = _hashes(words_of(text.as_py()))
                for size in sizes:
                    own = _shingles(hashes, size)
                    found.append(own[_passing(own, shared.value, bits)])
            sh, n = np.unique(np.concatenate(found or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sh.view(np.int64)), pa.array(n.astype(np.int64))], ["sh", "n"])

    return docs.select("text").mapInArrow(rows, "sh bigint, n bigint").groupBy("sh").agg(F.sum("n").alias("n"))


_PLACES = "n_words bigint, places array<struct<sh:bigint,at:int,before:int,around:string>>"


def _placed(docs: DataFrame, bitmap: np.ndarray, sizes: list[int], bits: int, window: int) -> DataFrame:
    """Each document with its number of words and the places of prefix shingles, with up to window - 1 words around."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = pa.list_(pa.struct([("sh", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("around", pa.string())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, places = [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                hashes, own = _hashes(words), []
                for size in sizes:
                    sh = _shingles(hashes, size)
                    for at in _passing(sh, shared.value, bits).tolist():
                        first = max(0, at + size - window)
                        around = b" ".join(words[first : at + window]).decode()
                        own.append({"sh": int(sh[at].view(np.int64)), "at": at, "before": at - first, "around": around})
                counts.append(len(words))
                places.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(counts, pa.int64()), pa.array(places, kind)], ["doc_id", "key", "n_words", "places"])

    return docs.select("doc_id", text_key(F.col("text")).alias("key"), "text").mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, key binary, {_PLACES}")


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences of item windows in documents.

    Three tables: the documents (doc_id, key, n_words), the occurrences (doc_id, key, start, m, win: the m words from
    `start` on are window `win`) and the items of each window (win, item_id). `key` tells rows with equal doc_id apart.
    """
    shingles, owned = windows_of(items, window, shingle)
    bitmap, sizes = _bitmap(shingles, filter_bits)
    seen = _counted(docs, bitmap, sizes, filter_bits)
    rarity = shingles.join(seen, "sh", "left").groupBy("win", "m").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sh", "at", "s")).alias("p"))
    prefixes = stored(rarity.where("p.n > 0").select("win", "m", "p.sh", F.col("p.at").alias("offset"), "p.s"), "window-prefixes")
    bitmap, sizes = _bitmap(prefixes, filter_bits)
    placed = stored(_placed(docs, bitmap, sizes, filter_bits, window), "prefix-places")
    candidates = placed.where(F.size("places") > 0).select("doc_id", "key", F.explode("places").alias("p")).select("doc_id", "key", "p.*")
    met = candidates.join(prefixes.drop("s"), "sh").where((F.col("before") >= F.col("offset")))
    taken = F.slice(F.split("around", " "), F.col("before") - F.col("offset") + 1, F.col("m"))
    hits = met.where(F.array_join(taken, " ") == F.col("win")).select("doc_id", "key", (F.col("at") - F.col("offset")).alias("start"), "m", "win")
    return placed.select("doc_id", "key", "n_words"), stored(hits, "window-hits"), owned


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Each document row with n_words, n_hit, n_items, items (sorted ids as strings), contaminated, and its key.

    Words are maximal runs of 0-9, a-z (after lowering A-Z) and characters from U+0080 on. An item of fewer than `window`
    words, but not none, is one window. n_hit counts the words that lie inside any occurrence of any window. Null and
    empty texts have no words; null item ids are left out of `items`; rows with equal ids keep one result each; an empty
    table of documents gives an empty result and one of items leaves all documents clean. Other columns are ignored.
    """
    counted, hits, owned = find_items(docs, items, window, shingle, filter_bits)
    spans = hits.groupBy("doc_id", "key", "start").agg(F.max("m").alias("m"))
    before = Window.partitionBy("doc_id", "key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = spans.withColumn("done", F.coalesce(F.max(F.col("start") + F.col("m")).over(before), F.lit(0)))
    gain = F.greatest(F.lit(0), F.col("start") + F.col("m") - F.greatest("start", "done"))
    n_hit = covered.groupBy("doc_id", "key").agg(F.sum(gain).cast("bigint").alias("n_hit"))
    found = hits.select("doc_id", "key", "win").distinct().join(owned.select("win", F.col("item_id").cast("string").alias("item_id")), "win")
    named = found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    per_doc = n_hit.alias("a").join(named.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left").select("a.*", "b.items")
    per_doc = stored(per_doc.distinct(), "hit-documents")
    joined = counted.alias("c").join(per_doc.alias("h"), F.col("c.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("c.key") == F.col("h.key")), "left")
    items_found = F.coalesce("h.items", F.array().cast("array<string>"))
    return joined.select(
        "c.doc_id",
        "c.key",
        "c.n_words",
        F.coalesce("h.n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(items_found).cast("bigint").alias("n_items"),
        items_found.alias("items"),
        (F.coalesce("h.n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """The documents that hold no item window, with all their columns."""
    dirty = contamination(docs, items, **options).where("contaminated").select("doc_id", "key").distinct()
    same = docs["doc_id"].eqNullSafe(dirty["doc_id"]) & (text_key(docs["text"]) == dirty["key"])
    return docs.join(dirty, same, "left_anti")
