"""Exact quantiles by selection over range histograms, which never gather the values of a column in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlore.session import materialise

BINS = 1 << 16
_LARGEST = 1.7976931348623157e308


def _scaled(v: Column, level: int) -> Column:
    """A non-decreasing function of v with finite values: v itself in even levels, its logarithm in odd ones, so that
    neither evenly spread values nor such of very different sizes fill one bin again and again."""
    finite = F.greatest(F.least(v, F.lit(_LARGEST)), F.lit(-_LARGEST)) / 2  # halves, so that a range can't overflow
    return finite if level % 2 == 0 else F.signum(v) * F.log2(F.abs(finite) + 1)


def _bin(v: Column, low: Column, high: Column, level: int, bins: int) -> Column:
    """Number of the range that holds v: 0 to bins-1 from low to high, -1 and bins for what lies outside."""
    start, end = _scaled(low, level), _scaled(high, level)
    inside = F.least(F.floor(F.coalesce(F.try_divide(_scaled(v, level) - start, end - start), F.lit(0.0)) * bins), F.lit(bins - 1))
    # the ends stand apart from each other even if the scale can't tell them apart, so each level makes progress
    return F.when(v < low, -1).when(v > high, bins).when((v == high) & (low < high), bins - 1).otherwise(inside).cast("int")


def _first_targets(clean: DataFrame, keys: list[str], probabilities: Sequence[float], accuracy: int) -> DataFrame:
    """One row per key and wanted rank, with a range around the rank that percentile_approx expects it in."""
    margin = 2.0 / accuracy
    edges = [min(1.0, max(0.0, p + d)) for p in probabilities for d in (-margin, margin)]
    found = clean.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), F.lit(accuracy)).alias("_edges")
    )
    slots = [
        F.struct(
            F.lit(i).alias("slot"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("rank"),
            F.col("_edges")[2 * i].alias("low"), F.col("_edges")[2 * i + 1].alias("high"),
        )
        for i, p in enumerate(probabilities)
    ]
    return found.select(*keys, "_n", F.array(*slots).alias("_ts"))


def _counted(clean: DataFrame, targets: DataFrame, keys: list[str], level: int, bins: int, few_keys: bool) -> DataFrame:
    """keys, slot, rank and, for each bin with values, their number, smallest and largest. Counts combine on the map side."""
    v, t = F.col("_v"), F.col("_t")
    met = clean.join(F.broadcast(targets) if few_keys else targets, keys).select(*keys, "_n", "_v", F.explode("_ts").alias("_t"))
    if level:
        met = met.where((v >= t["low"]) & (v <= t["high"]))
    bin_ = _bin(v, t["low"], t["high"], level, bins)
    return met.groupBy(*keys, t["slot"].alias("_slot"), bin_.alias("_bin")).agg(
        F.count("*").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.first("_n").alias("_n"), F.first(t["rank"]).alias("_rank")
    )


def _placed(counted: DataFrame, keys: list[str]) -> DataFrame:
    """The bins that hold the two neighbours of each rank: solved (_q), or a range to look into again."""
    running = Window.partitionBy(*keys, "_slot").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cell = F.struct("_upto", "_c", "_min", "_max")
    found = counted.withColumn("_upto", F.sum("_c").over(running)).groupBy(*keys, "_slot").agg(
        F.first("_n").alias("_n"),
        F.first("_rank").alias("_rank"),
        F.min(F.when(F.col("_upto") > F.floor("_rank"), cell)).alias("_lo"),
        F.min(F.when(F.col("_upto") > F.ceil("_rank"), cell)).alias("_hi"),
    )
    # neighbours in two bins are the last value of one and the first of the other
    apart = F.col("_lo._upto") < F.col("_hi._upto")
    low = F.when(apart, F.col("_lo._max")).otherwise(F.col("_lo._min"))
    weight = F.col("_rank") - F.floor("_rank")
    value = low + F.when(weight > 0, (F.col("_hi._min") - low) * weight).otherwise(0.0)
    solved = apart | (F.col("_lo._min") == F.col("_lo._max"))
    rank = F.col("_rank") - (F.col("_lo._upto") - F.col("_lo._c"))
    again = F.struct(F.col("_slot").alias("slot"), rank.alias("rank"), F.col("_lo._min").alias("low"), F.col("_lo._max").alias("high"))
    return found.select(*keys, "_n", "_slot", F.when(solved, value).alias("_q"), F.when(~solved, again).alias("_again"))


def exact_quantiles(
    values: DataFrame,
    keys: Sequence[str],
    probabilities: Sequence[float],
    value: str = "value",
    accuracy: int = 50_000,
    few_keys: bool = False,
    bins: int = BINS,
) -> DataFrame:
    """Linearly interpolated quantiles of `value` per key, as `keys, n, quantiles array<double>`.

    The built-in exact percentile merges every distinct value of a group in one task. Here percentile_approx gives a range around
    each wanted rank, and one pass counts the values in `bins` equal parts of it, below it and above it. A rank whose
    neighbours fall into parts of one value, or into two parts, is found; for others the pass is repeated over the part
    that holds them, so the result is exact however far the approximation was off. Each pass combines on the map side, and no
    task ever sees more than `bins` + 2 rows for a rank. The targets, one row per key, are broadcast only when
    `few_keys` says that their number is bounded (columns of a table, counted groups); otherwise the join is left to the
    optimiser, which splits hot keys (skew join). The passes grow with the logarithm of the rows to the base `bins`.
    """
    keys = list(keys)
    clean = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    targets, level, done = _first_targets(clean, keys, probabilities, accuracy), 0, []
    while True:
        tried = materialise(_placed(_counted(clean, targets, keys, level, bins, few_keys), keys), "quantiles")
        done.append(tried.where("_again is null").drop("_again"))
        open_ = tried.where("_again is not null")
        if open_.isEmpty():
            break
        targets, level = open_.groupBy(*keys).agg(F.first("_n").alias("_n"), F.collect_list("_again").alias("_ts")), level + 1
    slots = F.array_sort(F.collect_list(F.struct("_slot", "_q")))
    return reduce(DataFrame.unionByName, done).groupBy(*keys).agg(F.first("_n").alias("n"), F.transform(slots, lambda s: s["_q"]).alias("quantiles"))
