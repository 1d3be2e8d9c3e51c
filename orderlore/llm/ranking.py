"""Quality classifier by Bradley-Terry pairwise ranking (operator 10).

A document's quality is a linear score of its text's shape. From labelled documents preference pairs are formed (a good one
over a bad one) and the weights are learned by the logistic loss on the difference of the two feature vectors: the
model never sees a label alone, only which of two documents is to be preferred. The raw score is cut at the quantile of the
labelled documents' scores that their share of bad ones names, and moved so that the cut falls on `cut`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlore.functions.quantiles import exact_quantiles
from orderlore.llm.tables import stored

ROUNDS, FOLDS, CUT = 40, 5, 0.3
GROUP, LEAST = 64, 4
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARKS = [ord(c) for c in "!#$%&*|<>@"]


def features(text: str | None) -> list[float]:
    """Shape of a text: shares of kinds of characters, repetition of words, lines and word pairs, lengths."""
    raw = (text or "").encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, n = raw.split(), max(len(raw), 1)
    w = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = sum(counts[65:91]) / n
    repeats = sum(map(bytes.__eq__, words, words[1:])) / w
    distinct = len(set(words)) / w
    pairs = len(set(zip(words, words[1:]))) / w
    marked = [counts[m] / n for m in _MARKS]
    sentence = (counts[46] + counts[63]) / w
    return [
        *(np.sqrt(x) for x in marked),
        np.sqrt(counts[48:58].sum() / n),
        np.sqrt(upper),
        counts[_LETTERS].sum() / n,
        np.sqrt(repeats),
        distinct,
        pairs,
        np.log1p(len(words)) / 10,
        np.log1p(len(words)) * distinct / 10,
        min(n / w, 40) / 10,
        np.sqrt(min(sentence, 1)),
        np.sqrt(counts[44] / w),
        len(set(lines)) / max(len(lines), 1),
        np.log1p(len(lines)) / 10,
        max(map(len, words), default=0) ** 0.5 / 10,
        float(len(words) < 20),
    ]


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the checksum of its id; a null id counts as the empty text, whose checksum is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float
    cut: float = CUT

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; `cut` at the threshold."""
        z = (self.raw(x) - self.threshold) / self.spread + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _folded(rows: DataFrame, fold: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of `fold` over all batches of `rows`, added up within each task first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += fold(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["total"])

    return sum((np.array(r["total"]) for r in rows.mapInArrow(partial, "total array<double>").collect()), np.zeros(size))


def labelled_shapes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality and x, the features, of every labelled document outside the held-out fold.

    Features are computed before the join, so texts are never shuffled.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.list_(pa.float64()))], ["doc_id", "x"])

    wanted = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    known = labels.where(F.col("quality").isin(0, 1) & wanted).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    shapes = docs.where(wanted).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(rows, "doc_id bigint, x array<double>")
    # a fixed order, so that the same tables always give the same model
    return shapes.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).sortWithinPartitions("doc_id")


def _groups(shapes: DataFrame, good: int, bad: int) -> DataFrame:
    """Small groups of documents of both labels, one row each: all pairs of a good and a bad one within a group are learned from.

    A group has some GROUP documents. Of the rarer label each document enters several groups where it is needed, so that every
    group can expect LEAST of either.
    """
    groups = max(1, (good + bad) // GROUP)
    copies = lambda n: min(groups, -(-LEAST * groups // n))
    times = F.when(F.col("quality") == 1, copies(good)).otherwise(copies(bad))
    spread = shapes.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))
    member = F.struct("doc_id", "quality", "x")
    gathered = spread.groupBy(F.pmod(F.pmod(F.xxhash64("doc_id"), F.lit(groups)) + F.col("copy"), F.lit(groups)).alias("place")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    x = F.flatten(F.transform("members", lambda m: m["x"])).alias("x")
    return gathered.select("place", F.transform("members", lambda m: m["quality"]).alias("y"), x).sortWithinPartitions("place")


def _loss(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Number of pairs, then loss, gradient and Hessian summed over all pairs of a good and a bad document."""
    good, bad = x[y == 1], x[y == 0]
    margin = np.clip((good @ weights)[:, None] - (bad @ weights)[None, :], -50, 50)
    lost = 1 / (1 + np.exp(margin))
    slope = lost * (1 - lost)
    gradient = lost.sum(axis=0) @ bad - lost.sum(axis=1) @ good
    cross = good.T @ slope @ bad
    hessian = (good.T * slope.sum(axis=1)) @ good + (bad.T * slope.sum(axis=0)) @ bad - cross - cross.T
    return np.concatenate([[margin.size, np.log1p(np.exp(-margin)).sum()], gradient, hessian.ravel()])


def _learned(groups: DataFrame, mean: np.ndarray, scale: np.ndarray, rounds: int, penalty: float) -> np.ndarray:
    """Newton steps, halved where the loss would grow; each is one pass over the groups."""
    width = len(mean)

    def at(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def fold(batch: pa.RecordBatch) -> np.ndarray:
            total = np.zeros(2 + width + width * width)
            for y, x in zip(batch.column("y"), batch.column("x")):
                shapes = x.values.to_numpy(zero_copy_only=False).reshape(-1, width)
                total += _loss((shapes - mean) / scale, y.values.to_numpy(zero_copy_only=False), weights)
            return total

        found = _folded(groups, fold, 2 + width + width * width)
        pairs, loss, gradient, hessian = max(found[0], 1.0), found[1], found[2 : 2 + width], found[2 + width :].reshape(width, width)
        return loss / pairs + penalty / 2 * weights @ weights, gradient / pairs + penalty * weights, hessian / pairs + penalty * np.eye(width)

    weights, step = np.zeros(width), np.zeros(width)
    best, gradient, hessian = at(weights)
    for _ in range(rounds):
        if not step.any():
            step = -np.linalg.solve(hessian, gradient)
        loss, next_gradient, next_hessian = at(weights + step)
        if loss > best:
            step = step / 2
            continue
        weights, best, gradient, hessian, step = weights + step, loss, next_gradient, next_hessian, np.zeros(width)
        if np.abs(gradient).max() < 1e-6:
            break
    return weights


def fit(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, penalty: float = 1e-3) -> Ranker:
    """Learn from every labelled document outside the held-out fold. Sums over documents and pairs reach the driver, no rows.

    Mean, scale, spread and the exact quantile of the threshold are taken over all of them; the weights from pairs into which
    they all are spread. With one label only, or none, every document scores above the cut.
    """
    shapes = stored(labelled_shapes(docs, labels), "ranking-shapes")
    width = len(features(""))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, y = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width), batch.column("quality").to_numpy(zero_copy_only=False)
        return np.concatenate([[np.sum(y == 1), np.sum(y == 0)], x.sum(axis=0), (x.T @ x).ravel()])

    found = _folded(shapes.select("quality", "x"), moments, 2 + width + width * width)
    good, bad = int(found[0]), int(found[1])
    if not good or not bad:
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), -1.0, 1.0)
    mean, square = found[2 : 2 + width] / (good + bad), found[2 + width :].reshape(width, width) / (good + bad)
    covariance = square - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(covariance), 0)) + 1e-6
    weights = _learned(stored(_groups(shapes, good, bad), "ranking-groups"), mean, scale, rounds, penalty)
    spread = np.sqrt(max((weights / scale) @ covariance @ (weights / scale), 0)) / 4 + 1e-9
    ranker = Ranker(mean, scale, weights, 0.0, float(spread))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(ranker.raw(x), pa.float64())], ["value"])

    values = shapes.select("x").mapInArrow(raw, "value double").withColumn("all", F.lit(1))
    ranker.threshold = float(exact_quantiles(values, ["all"], [bad / (good + bad)], few_keys=True).first()["quantiles"][0])
    return ranker


def score(docs: DataFrame, ranker: Ranker, column: str = "score") -> DataFrame:
    """Adds (or replaces) `column`, the score of the whole text; all rows and other columns pass through."""
    kept = [c for c in docs.columns if c != column]
    where = kept.index("text")
    schema = docs.select(*kept).withColumn(column, F.lit(None).cast("double")).schema
    model = docs.sparkSession.sparkContext.broadcast(ranker)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(where)]).reshape(batch.num_rows, -1)
            values = model.value.score(x) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*kept, column])

    return docs.select(*kept).mapInArrow(rows, schema)


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Only the text enters a score. Null and empty texts are scored as the empty text; null and repeated ids keep one result
    per row; labels that are null, repeated (the larger wins) or of unknown documents do no harm; without labels of both
    kinds nothing is rejected. Empty tables give empty results; other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    scored = score(rows, fit(rows, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accuracy(y: np.ndarray, predicted: np.ndarray) -> tuple[float, float]:
    """Shares of good and of bad documents that are predicted right."""
    return float(np.mean(predicted[y == 1] == 1)), float(np.mean(predicted[y == 0] == 0))

