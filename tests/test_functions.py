import math
import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderlore.functions.numeric import exact_mean, exact_sum, nan_to_null, ratio
from orderlore.functions.quantiles import exact_quantiles
from orderlore.functions.similarity import indel_ratio, indel_ratio_above
from orderlore.functions.statistics import f_tail
from orderlore.functions.text import has_any, hits, labels_where


def test_exact_sum_does_not_depend_on_order(spark):
    values = [0.1] * 1000 + [1e9, -1e9, 0.2]
    for seed in (1, 2):
        random.Random(seed).shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
        assert df.agg(exact_sum("v")).first()[0] == 100.2


def test_exact_mean_ignores_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,)], "v double")
    assert df.agg(exact_mean("v")).first()[0] == 2.5


def test_ratio_by_zero_is_null(spark):
    assert spark.range(1).select(ratio(F.lit(1), F.lit(0))).first()[0] is None


def test_nan_counts_as_missing(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, i int"))
    assert rows(df) == [(2.0, 2), (None, 1)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1000])
def test_quantiles_agree_with_numpy(spark, n):
    generator = np.random.default_rng(n)
    groups = {"a": generator.normal(size=n), "b": generator.integers(0, 3, size=n) * 1.0, "c": generator.pareto(0.5, size=n)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None)], "k string, value double")
    p = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    for accuracy in (10, 50_000):
        got = {r["k"]: r["quantiles"] for r in exact_quantiles(df, ["k"], p, accuracy=accuracy).collect()}
        for k, vs in groups.items():
            assert got[k] == pytest.approx(np.quantile(vs, p), rel=1e-12)


def test_quantiles_of_one_hot_value_and_without_broadcast(spark):
    df = spark.range(3000).select(F.lit("k").alias("k"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 1.0).alias("value"))
    values = [5.0 if i % 3 == 0 else float(i) for i in range(3000)]
    got = exact_quantiles(df, ["k"], (0.05, 0.5), few_keys=False, accuracy=100).first()["quantiles"]
    assert got == pytest.approx(np.quantile(values, (0.05, 0.5)))


def test_quantiles_with_a_missed_bracket(spark, monkeypatch):
    """Ranges that don't hold their ranks cost more passes, never a wrong value."""
    from orderlore.functions import quantiles

    first = quantiles._first_targets

    def wrong(clean, keys, probabilities, accuracy):
        aside = lambda t: F.struct(t["slot"].alias("slot"), t["rank"].alias("rank"), F.lit(990.5).alias("low"), F.lit(2000.0).alias("high"))
        return first(clean, keys, probabilities, accuracy).withColumn("_ts", F.transform("_ts", aside))

    monkeypatch.setattr(quantiles, "_first_targets", wrong)
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("value"))
    got = {r["k"]: r["quantiles"] for r in quantiles.exact_quantiles(df, ["k"], (0.5, 1.0), accuracy=100).collect()}
    assert got == {0: [499.0, 998.0], 1: [500.0, 999.0]}


def test_quantiles_look_at_few_bins(spark, monkeypatch):
    """However many values lie around a rank, no task gets more rows for it than there are bins."""
    from orderlore.functions import quantiles

    counted, most = quantiles._counted, []

    def watched(*args):
        out = counted(*args)
        most.append(out.groupBy("k", "_slot").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(quantiles, "_counted", watched)
    size = F.when(F.col("id") % 3 == 0, F.pow(F.lit(10.0), F.col("id") % 60 - 30)).otherwise(F.col("id") / 7)
    df = spark.range(6000).select(F.lit(1).alias("k"), F.when(F.col("id") % 100 == 0, -size).otherwise(size).alias("value"))
    df = df.union(spark.createDataFrame([(1, float("inf")), (1, float("-inf")), (1, 5e-324), (1, 1.7e308), (1, -1.7e308)], "k int, value double"))
    values = np.array([r["value"] for r in df.collect()])
    p = (0.0, 0.0101, 0.3333, 0.99, 1.0)
    got = quantiles.exact_quantiles(df, ["k"], p, accuracy=10, bins=128).first()["quantiles"]
    assert got[1:-1] == pytest.approx(np.quantile(values, p)[1:-1], rel=1e-12)
    assert (got[0], got[-1]) == (float("-inf"), float("inf"))
    assert len(most) > 2 and max(most) <= 130




def test_f_tail_known_values():
    assert f_tail(4.0, 1, 18) == pytest.approx(0.0608215, abs=1e-7)
    assert f_tail(0.0, 3, 10) == 1.0
    # for two numerator degrees of freedom the tail has a closed form
    for f, within in ((0.5, 4), (3.0, 11), (25.0, 60)):
        assert f_tail(f, 2, within) == pytest.approx((1 + 2 * f / within) ** (-within / 2), rel=1e-10)
    assert math.isnan(f_tail(float("nan"), 1, 2))


def slow_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé", max_size=80), st.text("abcé", max_size=80))
def test_indel_ratio_against_table(a, b):
    expected = 2 * slow_lcs(a, b) / (len(a) + len(b)) if a or b else 1.0
    assert indel_ratio(a, b) == expected


def test_indel_ratio_column(spark):
    df = spark.createDataFrame([("same", "same"), ("customer 12", "customer 13"), ("abc", "xyz"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(indel_ratio_above(F.col("a"), F.col("b"), 0.8)).collect()]
    assert got[:3] == [True, True, False] and not got[3]


def test_keyword_helpers(spark):
    df = spark.createDataFrame([("the total amount",)], "t string")
    t = F.col("t")
    r = df.select(has_any(t, ["sum", "total"]), hits(t, ["the", "total", "x"]), labels_where({"a": t == "x", "b": t != "x"})).first()
    assert tuple(r) == (True, 2, ["b"])
