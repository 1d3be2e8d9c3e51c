"""The registered queries: all operators are there, and they agree with their SQL."""

import re

import pytest
from conftest import SF

from checks import registry
from checks.compare import connect, differences
from orderlore.plans.star import sales_view
from orderlore.plans.workload import answer

# one query of every family; the compare tool runs all of them
SAMPLE = [
    "E01", "E05", "W-AGG05", "W-FIL11", "W-TOP20", "W-TIM06", "W-TIM20", "W-CMP10", "W-GRP16", "W-ANL03", "W-ANL05", "W-ANL09",
    "W-ANL10", "P06", "P12", "V04", "V05", "C07", "C17", "B03", "B08", "F13", "R02", "R15", "L07", "M03", "M12", "X09", "X11", "D08",
    "S02", "S26",
]


def expand(prefix, first, last, skip=()):
    return [f"{prefix}{i:02d}" for i in range(first, last + 1) if i not in skip]


def test_every_operator_is_registered():
    wanted = (
        expand("S", 1, 36, {6, 11, 18, 21, 25, 30}) + expand("P", 1, 14, {13}) + expand("V", 1, 6) + expand("C", 1, 18, {13})
        + expand("B", 1, 11) + expand("F", 1, 14) + expand("R", 1, 20) + expand("L", 1, 12) + expand("M", 1, 13, {6})
        + expand("X", 1, 20) + expand("D", 1, 8) + expand("E", 1, 6)
    )
    wanted += sum((expand(f"W-{f}", 1, 20) for f in ("AGG", "FIL", "TOP", "CMP", "GRP")), [])
    wanted += expand("W-TIM", 1, 25) + expand("W-ANL", 1, 15)
    assert set(wanted) <= set(registry.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("key", SAMPLE)
def test_agrees_with_sql(spark, key):
    problem = differences(registry.queries()[key](spark, SF), connect(SF), registry.oracle_sql()[key])
    assert problem in (None, "EMPTY"), problem


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unused_dimensions_are_not_joined(spark):
    text = plan(answer("W-AGG01", spark, SF))
    assert "Join" not in text and re.search(r"ReadSchema: struct<l_extendedprice:double,l_discount:double>", text)
    assert "customer" not in plan(sales_view(spark, SF, "order_date", "sales"))


def test_filters_reach_the_scan(spark):
    assert "GreaterThanOrEqual(o_orderdate" in plan(answer("W-TIM02", spark, SF))
    assert "EqualTo(l_returnflag,N)" in plan(answer("W-FIL06", spark, SF))


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "TakeOrderedAndProject" in plan(answer("W-TOP01", spark, SF))
    text = plan(answer("W-ANL09", spark, SF))
    assert text.index("Final") < text.rindex("Partial") and "WindowGroupLimit" in text


def test_no_cross_products(spark):
    for key in ("W-ANL03", "W-ANL08", "W-ANL10", "V04", "C11", "B07", "F11", "L03"):
        text = plan(registry.queries()[key](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, key
