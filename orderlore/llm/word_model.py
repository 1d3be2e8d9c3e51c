"""Word n-gram perplexity under modified Kneser-Ney models that never saw the text they score (operator 7).

Texts are dealt into two halves by the smallest hash of their 3-grams of words, so copies and most near copies fall into the
same half. The 3-grams of each half are counted in Spark, one model a language and half, and each text is scored by the model
of the other half: a text's own words, and those of its copies, say nothing about it. Counts of lower orders are continuation counts.
Distinct n-grams grow with the corpus, so no task holds all: texts are kept as blocks of word numbers (`word_blocks`), and
each order is summed over the blocks as sorted arrays of hashes, range by range: 3-grams, then pairs as contexts of 3-grams
and as their suffixes, then words. Each block then knows the counts of its own n-grams and scores its texts.
Log probabilities are kept in whole millionths, so that sums don't depend on the order in which partitions arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlore.llm import word_blocks
from orderlore.llm.tables import stored
from orderlore.llm.word_blocks import START as _START
from orderlore.llm.word_blocks import brief_shuffles, drop_folder, exchange, grouped, language_groups, of_languages, read_block, with_blocks, write_blocks
from orderlore.session import fresh_path

ORDER, MICRO, HALVES = 3, 1_000_000, (0, 1)
_SLICE = 100_000
_NAMES = ["h", "w", "half", "l", "a", "b", "c"]


def identity() -> Column:
    """The hash of language and text that names a text."""
    return F.xxhash64(F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit("")))


def word_hashes(text: str, lang: str) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in text.encode().split()), np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hashes of 3-grams from the hashes of their words."""
    mixed = a * np.uint64(0x9E3779B97F4A7C15) ^ b
    mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) ^ c
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return mixed ^ mixed >> np.uint64(32)


def half_of(padded: np.ndarray) -> int:
    """0 or 1 from the smallest hash of the 3-grams of a text, given the hashes of its words after two start symbols."""
    if len(padded) < 3:
        return 0
    return int(_mixed(padded[:-2], padded[1:-1], padded[2:]).min() & np.uint64(1))


def grams(docs: DataFrame) -> DataFrame:
    """h (identity), w (words of the text), half, l (hash of the language) and the hashes a, b, c of three words, for each word c."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for at in range(batch.num_rows):
                lang, text, h = (batch.column(x)[at].as_py() for x in ("lang", "text", "h"))
                words = word_hashes(text, lang)
                n = len(words)
                padded = np.concatenate([np.array([_START, _START], np.uint64), words])
                half, padded = half_of(padded), padded.view(np.int64)
                code = np.uint64(xxhash.xxh64_intdigest(lang.encode())).view(np.int64)
                held.append((np.full(n, h, np.int64), np.full(n, n, np.int64), np.full(n, half, np.int64), np.full(n, code, np.int64), padded[:-2], padded[1:-1], padded[2:]))
                size += n
                if size >= _SLICE or at == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], _NAMES)
                    held, size = [], 0

    text = docs.select(identity().alias("h"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInArrow(rows, ", ".join(f"{c} bigint" for c in _NAMES))


def _moments(counts: list[np.ndarray], first: np.ndarray, context: np.ndarray, size: int) -> list[np.ndarray]:
    """For each half and context: n-grams met once, twice and more often, and by how much those exceed 3.

    Only n-grams that this block is the first to have are added, so that each adds once over all blocks.
    """
    columns = []
    for n in counts:
        own, at = n[first], context[first]
        columns += [np.bincount(at[own == 1], minlength=size), np.bincount(at[own == 2], minlength=size), np.bincount(at[own > 2], minlength=size)]
        columns.append(np.bincount(at[own > 3], own[own > 3] - 3, size).astype(np.int64))
    return columns


def _continuations(counts: list[np.ndarray], first: np.ndarray, suffix: np.ndarray, size: int) -> list[np.ndarray]:
    """For each half and suffix, the n-grams that end in it."""
    return [np.bincount(suffix[first & (n > 0)], minlength=size) for n in counts]


class _Block:
    """N-grams of a block: `keys` and `columns` are what to ask next, `replies` what all blocks know by level.

    Levels 1, 2 and 3 are the distinct 3-grams, pairs and words. Pairs are asked for with the answers of level 1, words with
    those of level 2; with all of them, every 3-gram has its probability.
    """

    def __init__(self, read: tuple[int, list[np.ndarray]], replies: dict[int, list[np.ndarray]], codes: np.ndarray):
        code, (hashes, ids, self.h, sizes) = read
        self.codes, self.spoken, self.sizes, self.replies = codes, int(np.searchsorted(codes, np.uint64(code))), sizes.astype(np.int64), replies
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.h = self.h.astype(np.uint64)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), self.sizes)
        # two start symbols, number 0, before each text
        word = np.arange(2, len(ids) + 2, dtype=np.int32) + 2 * doc
        padded = self.padded = np.zeros(len(ids) + 2 * len(sizes), np.int32)
        padded[word] = ids.astype(np.int32) + 1
        self.plain, self.context, self.suffix = np.concatenate([[_START], hashes]), {}, {}
        levels = set(replies)
        if levels != {2}:
            p = self.plain[padded]
            threes = _mixed(p[:-2], p[1:-1], p[2:])[word - 2]
            del p
            self.half = (np.minimum.reduceat(threes, self.starts) & np.uint64(1)).astype(np.int64)
            self.keys, self.gram, at = grouped(threes)
            del threes
            self.ends, ended = word[at], doc[at]
        del word, doc
        if not levels:
            half = np.repeat(self.half, self.sizes)
            self.columns = [*(np.bincount(self.gram[half != k], minlength=len(self.keys)) for k in HALVES), np.full(len(self.keys), self.spoken, np.uint32)]
            return
        # a text of n words has n + 1 pairs, the first of two start symbols; the pair at a place ends with the next one
        pair = np.delete(np.arange(len(padded), dtype=np.int32), np.cumsum(self.sizes + 2) - 1)
        own = np.concatenate([[_START ^ np.uint64(code)], hashes])
        q = own[padded]
        keys, twos, begin = grouped(_mixed(q[:-1], q[1:], np.uint64(0))[pair])
        del q
        begin = pair[begin]
        if 1 in levels:
            self.context[1], self.suffix[1] = twos[self.ends - 2 - ended], twos[self.ends - 1 - ended]
        del twos, pair
        if levels == {1}:
            self._ask(1, keys, padded[begin + 1] > 0)
            return
        keys, ones, at = grouped(own)
        self.context[2], self.suffix[2] = ones[padded[begin]], ones[padded[begin + 1]]
        if levels == {2}:
            self._ask(2, keys, at > 0)

    def _ask(self, level: int, keys: np.ndarray, are_words: np.ndarray) -> None:
        *counts, first = self.replies[level][-3:]
        counts, first = [n.astype(np.int64) for n in counts], first > 0
        moments = _moments(counts, first, self.context[level], len(keys))
        self.keys = keys
        self.columns = [*moments, *_continuations(counts, first, self.suffix[level], len(keys)), np.where(are_words, self.spoken, len(self.codes))]

    def words(self, places: np.ndarray) -> list[np.ndarray]:
        """Hashes of the three words of some of the distinct 3-grams."""
        return [self.plain[self.padded[self.ends[places] - back]] for back in (2, 1, 0)]

    def probabilities(self, known: dict) -> list[np.ndarray]:
        """For each half the probability of every distinct 3-gram's last word after the two before it."""
        found = []
        for half in HALVES:
            below = None
            for level in (3, 2, 1):
                n = self.replies[level][half - 3].astype(np.int64)
                d, *whole = known[self.spoken, ORDER + 1 - level, half]
                if level == ORDER:
                    total, saved, below = whole
                else:
                    once, twice, often, more = (x.astype(np.int64)[self.context[level]] for x in self.replies[level + 1][4 * half : 4 * half + 4])
                    total, saved = once + 2 * twice + 3 * often + more, d[0] * once + d[1] * twice + d[2] * often
                    below = below[self.suffix[level]]
                cut = np.where(n == 0, 0.0, np.where(n == 1, d[0], np.where(n == 2, d[1], d[2])))
                below = np.where(total == 0, below, (n - cut + saved * below) / np.maximum(total, 1))
            found.append(below)
        return found


_TALLY = ["l", "size", "half", "grams", "t1", "t2", "t3", "t4", "met", "total"]


def _discounts(tallies: DataFrame) -> dict:
    """By number of the language, order and half: the discounts of counts 1, 2 and more (1/2, 1 and 3/2 where too few counts are
    small), the sum of counts, what the discounts save of it, and the even probability of the language's words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level, payload in zip(batch.column("level").to_pylist(), batch.column("payload").to_pylist()):
                columns, size = word_blocks.unpack(payload), ORDER + 1 + word_blocks.TALLIES - level
                for half in HALVES:
                    own = [x.astype(np.int64) for x in columns[7 * half : 7 * half + 7]]
                    kinds = len(own[0])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(kinds), np.full(kinds, size), np.full(kinds, half), *own)], _TALLY)

    known = {}
    summed = tallies.mapInArrow(rows, ", ".join(f"{x} bigint" for x in _TALLY)).groupBy(*_TALLY[:3]).agg(*[F.sum(x).alias(x) for x in _TALLY[3:]])
    for r in summed.collect():
        t = [r["t1"], r["t2"], r["t3"], r["t4"]]
        d = [0.5, 1.0, 1.5]
        if min(t) > 0:
            y = t[0] / (t[0] + 2 * t[1])
            d = [max(0.05, min(k - 0.05, k - (k + 1) * y * t[k] / t[k - 1])) for k in (1, 2, 3)]
        saved = d[0] * t[0] + d[1] * t[1] + d[2] * (r["met"] - t[0] - t[1])
        known[r["l"], r["size"], r["half"]] = (d, r["total"], saved, 1.0 / (r["grams"] + 1))
    return known


def _over_blocks(docs: DataFrame, words: int | None, rows: Callable, schema: str, rounds: int = word_blocks.ROUNDS) -> DataFrame:
    """What `rows` makes of each block and the probabilities of its 3-grams, stored.

    Languages have nothing in common, so the largest is worked on after all others, and what a group of them needs goes with it.
    """
    spark, found = docs.sparkSession, []
    with brief_shuffles(spark):
        every, folder = write_blocks(docs, identity(), words or word_blocks.BLOCK)
        for codes in language_groups(every):

            def asks(name: str, replies: dict[int, list[np.ndarray]], codes=codes) -> tuple[np.ndarray, list[np.ndarray]]:
                block = _Block(read_block(folder, name), replies, codes)
                return block.keys, block.columns

            blocks, answers = of_languages(every, codes), fresh_path(spark, "word-sums")
            counts, sums, tallies = [], [], []
            for level in range(1, ORDER + 1):
                # only the many columns of pairs need rounds
                own = exchange([blocks, *counts[-1:]], asks, level, len(codes), answers, rounds if level == 2 else 1)
                for kept, x in zip((counts, sums, tallies), own):
                    kept.append(x)
            known = _discounts(tallies[0].unionByName(tallies[1]).unionByName(tallies[2]))

            def finished(name: str, replies: dict[int, list[np.ndarray]], codes=codes, known=known) -> Iterator[pa.RecordBatch]:
                block = _Block(read_block(folder, name), replies, codes)
                yield from rows(block, block.probabilities(known))

            for turn in range(rounds):
                some = [x.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == turn) for x in [blocks, *counts, *sums]]
                found.append(stored(with_blocks(some, finished, schema), "word-model"))
            for path in (answers, *(f"{folder}/{x:016x}" for x in codes.tolist())):
                drop_folder(path)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def train(docs: DataFrame, words: int | None = None) -> DataFrame:
    """l, a, b, c and for each half the probabilities p0, p1 of c after a and b under the counts of the other half.

    Every 3-gram of either half has a row, so that no document's n-gram is without one. `words` is the size of blocks.
    """
    names = ["l", "a", "b", "c", "p0", "p1"]

    def rows(block: _Block, p: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        first = block.replies[1][-1] > 0
        columns = [np.full(int(first.sum()), block.codes[block.spoken]).view(np.int64), *(x.view(np.int64) for x in block.words(first)), *(x[first] for x in p)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    return _over_blocks(docs, words, rows, "l bigint, a bigint, b bigint, c bigint, p0 double, p1 double")


def scores(docs: DataFrame, words: int | None = None) -> DataFrame:
    """h, w and log_perplexity, the mean negative log probability of a word, of every distinct text with words."""

    def rows(block: _Block, p: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        logs = [np.floor(-np.log(x) * MICRO + 0.5).astype(np.int64) for x in p]
        own = np.where(np.repeat(block.half, block.sizes) == 0, logs[0][block.gram], logs[1][block.gram])
        sums = np.add.reduceat(own, block.starts)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block.h.view(np.int64), block.sizes, sums)], ["h", "w", "m"])

    met = _over_blocks(docs, words, rows, "h bigint, w bigint, m bigint")
    # equal texts add up, words and logs alike
    return met.groupBy("h", "w").agg((F.sum("m") / F.sum("w") / MICRO).alias("log_perplexity"))
