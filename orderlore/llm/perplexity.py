"""Character n-gram perplexity under a modified Kneser-Ney model (operator 7).

Spark counts the character 4-grams of all documents, one model a language. A character is a symbol of 16 bits (those beyond
U+FFFF share the 2,048 codes that no character has), so four symbols make a 64-bit hash without collisions; the context
and the suffix of an n-gram are shifts and masks of it. Counts of lower orders are continuation counts. The model is
stored as arrays sorted by hash in the shared folder and read by the tasks; it holds one entry for each distinct n-gram,
which the alphabets in use bound, not the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlore.llm.tables import filesystem, stored
from orderlore.session import fresh_path

ORDER, START, BITS = 4, 2, 16
CHUNK, FLUSH = 1 << 20, 1 << 22


def symbols(text: str) -> np.ndarray:
    """16-bit symbols of a text, as unsigned 64-bit integers."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    return np.where(codes < 1 << 16, codes, 0xD800 + (codes & np.uint64(0x7FF)))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 4-grams that end in each character of the texts, and the number of characters of each text."""
    joined = symbols("".join("\x02\x02\x02" + t for t in texts))
    lengths = np.array([len(t) for t in texts], np.int64)
    hashes = joined[3:].copy()
    for back in (1, 2, 3):
        hashes |= joined[3 - back : len(joined) - back] << np.uint64(BITS * back)
    ends = np.cumsum(lengths + 3)
    keep = np.ones(len(hashes), bool)
    if len(texts) > 1:
        keep[(ends[:-1, None] - 3 + np.arange(3)).ravel()] = False
    return hashes[keep], lengths


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters each; one long text is a range of its own."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK:
            yield start, at + 1
            start, size = at + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _fold(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, hash, n: the 4-grams of all documents. Each task folds its own counts before the shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, n = _fold(parts)
                for at in range(0, len(keys), 100_000):
                    own = keys[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(own.view(np.int64)), pa.array(n[at : at + 100_000])], ["lang", "hash", "n"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for a, b in chunks(own):
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(grams(own[a:b])[0], return_counts=True))
                    if len(parts) > 8:
                        held[lang] = [_fold(parts)]
            if sum(len(k) for parts in held.values() for k, _ in parts) > FLUSH:
                yield from flush()
        yield from flush()

    text = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInArrow(rows, "lang string, hash bigint, n bigint").groupBy("lang", "hash").agg(F.sum("n").alias("n"))


def _discount(n: Column) -> Column:
    return F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def _discounts(counts: DataFrame) -> DataFrame:
    """Discounts of counts 1, 2 and more for each language; 1/2, 1 and 3/2 where too few counts are small."""
    t = [F.sum((F.col("n") == k).cast("double")).alias(f"t{k}") for k in (1, 2, 3, 4)]
    y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
    few = F.least("t1", "t2", "t3", "t4") == 0
    d = [F.when(few, F.lit(k / 2)).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * F.col(f"t{k + 1}") / F.col(f"t{k}")))).alias(f"d{k}") for k in (1, 2, 3)]
    return counts.groupBy("lang").agg(*t).select("lang", *d)


def train(docs: DataFrame) -> str:
    """Folder of the model: lang, size (n-gram length), hash, logp, and logb, the back-off weight as a context."""
    counts = {ORDER: stored(count_grams(docs), "grams")}
    for size in range(ORDER - 1, 0, -1):
        suffix = F.col("hash").bitwiseAND((1 << BITS * size) - 1)
        counts[size] = stored(counts[size + 1].groupBy("lang", suffix.alias("hash")).agg(F.count("*").alias("n")), "grams")
    lower, contexts = None, {}
    tables = {}
    for size in range(1, ORDER + 1):
        own = counts[size].join(_discounts(counts[size]), "lang")
        context = F.shiftrightunsigned("hash", BITS) if size > 1 else F.lit(0).cast("bigint")
        own = own.withColumn("context", context).withColumn("cut", _discount(F.col("n")))
        totals = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("saved"), F.count("*").alias("kinds"))
        totals = stored(totals, "contexts")
        contexts[size] = totals.select("lang", F.col("context").alias("hash"), F.log(F.col("saved") / F.col("total")).alias("logb"))
        own = own.join(totals, ["lang", "context"])
        if size == 1:
            below = 1.0 / (F.col("kinds") + 1)
        else:
            own = own.withColumn("suffix", F.col("hash").bitwiseAND((1 << BITS * (size - 1)) - 1))
            own = own.join(lower.select("lang", F.col("hash").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
            below = F.col("below")
        p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("saved") / F.col("total") * below
        lower = tables[size] = stored(own.select("lang", "hash", p.alias("p")), "grams")
    parts = []
    for size, table in tables.items():
        if size < ORDER:
            table = table.join(contexts[size + 1], ["lang", "hash"], "left")
        else:
            table = table.withColumn("logb", F.lit(0.0))
        parts.append(table.select("lang", F.lit(size).alias("size"), "hash", F.log("p").cast("float").alias("logp"), F.coalesce("logb", F.lit(0.0)).cast("float").alias("logb")))
    unknown = contexts[1].join(counts[1].groupBy("lang").agg(F.count("*").alias("kinds")), "lang").select("lang", F.lit(0).alias("size"), "hash", (F.col("logb") - F.log(F.col("kinds") + 1)).cast("float").alias("logp"), F.lit(0.0).cast("float").alias("logb"))
    path = fresh_path(docs.sparkSession, "language-model")
    model = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(unknown)
    model.repartitionByRange("size", "lang", "hash").sortWithinPartitions("size", "lang", "hash").write.parquet(path)
    return path


class Model:
    """The stored arrays of every language and size, sorted by hash."""

    def __init__(self, path: str):
        files, place = filesystem(path)
        table = pads.dataset(place, filesystem=files, format="parquet").to_table()
        langs = table.column("lang").to_numpy()
        size, hashes = table.column("size").to_numpy(), table.column("hash").to_numpy().view(np.uint64)
        logp, logb = table.column("logp").to_numpy(), table.column("logb").to_numpy()
        self.arrays = {}
        for lang in set(langs):
            for k in range(ORDER + 1):
                at = np.flatnonzero((langs == lang) & (size == k))
                at = at[np.argsort(hashes[at], kind="stable")]
                self.arrays[lang, k] = hashes[at], logp[at], logb[at]

    def _find(self, lang: str, size: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = self.arrays[lang, size][0]
        at = np.searchsorted(hashes, keys)
        at[at == len(hashes)] = 0
        return at, hashes[at] == keys if len(hashes) else np.zeros(len(keys), bool)

    def logp(self, lang: str, keys: np.ndarray, size: int = ORDER) -> np.ndarray:
        """Log probability of the last symbol of each n-gram; unseen ones back off to their suffix."""
        if (lang, size) not in self.arrays:
            return np.full(len(keys), -np.log(1 << BITS))
        if size == 0:
            return np.full(len(keys), self.arrays[lang, 0][1][0])
        at, found = self._find(lang, size, keys)
        out = self.arrays[lang, size][1][at].astype(np.float64) if len(self.arrays[lang, size][1]) else np.zeros(len(keys))
        if not found.all():
            rest = keys[~found]
            weight = np.zeros(len(rest))
            if size > 1:
                where, known = self._find(lang, size - 1, rest >> np.uint64(BITS))
                weight = np.where(known, self.arrays[lang, size - 1][2][where], 0.0)
            out[~found] = weight + self.logp(lang, rest & np.uint64((1 << BITS * (size - 1)) - 1), size - 1)
        return out

    def log_perplexity(self, lang: str, texts: list[str]) -> np.ndarray:
        """Mean negative log probability of a character of each text; 0 for an empty one."""
        out = np.zeros(len(texts))
        for a, b in chunks(texts):
            keys, lengths = grams(texts[a:b])
            sums = np.concatenate([[0.0], np.cumsum(self.logp(lang, keys))])
            ends = np.cumsum(lengths)
            out[a:b] = -(sums[ends] - sums[ends - lengths]) / np.maximum(lengths, 1)
        return out


@lru_cache(maxsize=1)
def load_model(path: str) -> Model:
    return Model(path)
