"""Quality rules: fixed rules on words and repetition, and perplexity bands for each language (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlore.llm import word_model
from orderlore.llm.tables import stored

WINDOW, LEAST_WORDS, MOST_REPEATED, GRID = 8, 20, 30, 1000
#: Width of the bands in interquartile ranges below the first and above the third quartile.
BELOW, ABOVE = 3.0, 2.0
_BLANKS = str.maketrans("", "", " \t\n\v\f\r")
_SYMBOLS = [c.encode() for c in "#*$%&|<>"]


def _rolled(hashes: np.ndarray, window: int) -> np.ndarray:
    """Hashes of all windows of words, from those of windows of 1, 2, 4 and so on."""
    n, done, size = len(hashes) - window + 1, None, 0
    power, width = hashes, 1
    while True:
        if window & width:
            done = power[:n] if done is None else _joined(done, power[size : size + n])
            size += width
        if size == window:
            return done
        power = _joined(power[:-width], power[width:])
        width *= 2


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = a * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed += b
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that are found at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    rolled = _rolled(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), window)
    ranked = np.sort(rolled)
    if not (ranked[1:] == ranked[:-1]).any():
        return 0
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    first, hit = {}, np.zeros(len(words) + 1, np.int64)
    candidates = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    for at in candidates.tolist():
        key = tuple(words[at : at + window])
        earlier = first.setdefault(key, at)
        if earlier != at:
            for start in (earlier, at):
                hit[start] += 1
                hit[start + window] -= 1
    return int((np.cumsum(hit) > 0).sum())


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    blanks = len(raw) - sum(map(len, words))
    return len(words), len(text) - blanks, sum(map(raw.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


_MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, h (identity of the text) and measures of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                columns = list(zip(*map(measures, part.column("text").to_pylist())))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("h"), *(pa.array(c, pa.int64()) for c in columns)], names)

    names = ["doc_id", "lang", "h", *(c.split()[0] for c in _MEASURES.split(", "))]
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), word_model.identity().alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInArrow(rows, f"doc_id bigint, lang string, h bigint, {_MEASURES}")


def bands(measured: DataFrame) -> DataFrame:
    """lang, lower, upper: the band of log perplexity of each language.

    Quartiles over all documents with words that pass the base rules, from a histogram with steps of 1/1000: exact on that
    grid and the same whatever the partitions. The band reaches BELOW and ABOVE interquartile ranges beyond them, and one step
    of the grid further, since the quartiles are rounded to it.
    """
    sized = measured.where(~F.col("base_failed")).groupBy("lang", F.round(F.col("log_perplexity") * GRID).cast("bigint").alias("step")).agg(F.count("*").alias("n"))
    sized = stored(sized, "perplexity-steps")
    upto = sized.withColumn("upto", F.sum("n").over(Window.partitionBy("lang").orderBy("step")))
    totals = sized.groupBy("lang").agg(F.sum("n").alias("total"))
    ranked = upto.join(totals, "lang")

    def quartile(share: float):
        return F.min(F.when(F.col("upto") >= F.col("total") * share, F.col("step"))) / GRID

    q = ranked.groupBy("lang").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    width = F.col("q3") - F.col("q1")
    return q.select("lang", (F.col("q1") - BELOW * width - 1 / GRID).alias("lower"), (F.col("q3") + ABOVE * width + 1 / GRID).alias("upper"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, measures, base_failed, log_perplexity, and kept: neither failed by the rules nor outside its language's band.

    The language models and the bands come from all documents given. Null texts are empty and fail the rules; a null
    language is a language of its own; null and repeated ids keep one row per input row; an empty table gives an empty
    result; other columns are ignored. A language without any document that passes the rules keeps none.
    """
    scored = stored(word_model.scores(docs), "perplexities")
    measured = measure(docs).alias("m").join(scored.alias("s"), F.expr("m.h = s.h and m.n_words = s.w"), "left")
    measured = measured.select("m.*", F.coalesce("log_perplexity", F.lit(0.0)).alias("log_perplexity")).drop("h")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = stored(measured.withColumn("base_failed", failed), "quality-measures")
    banded = measured.join(bands(measured), "lang", "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return banded.withColumn("kept", ~F.col("base_failed") & inside)
