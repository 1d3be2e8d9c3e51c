"""Profiling, validation, cleaning and group bias on the small fixtures."""

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from orderlore.functions import sketches
from orderlore.operators import clean, describe, fairness, profile, validate


def roles(df):
    return {r["column"]: r["role"] for r in profile.column_roles(df).collect()}


def frame(spark, schema, data):
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def dirty6(spark):
    return frame(
        spark,
        "ID bigint, Name string, Age double, Score double, Category string, Date string, Constant bigint",
        [
            (1, " Alice ", 25.0, 85.5, "A", "2023-01-01", 1),
            (2, "Bob", None, 90.0, "B", "2023-01-02", 1),
            (3, None, 35.0, 78.5, "A", "2023-01-03", 1),
            (4, "Dana", 28.0, 9999.0, None, None, 1),
            (5, "Eve", 32.0, 88.0, "B", "2023-01-05", 1),
            (5, "Eve", 32.0, 88.0, "B", "2023-01-05", 1),
        ],
    )


def test_roles_of_fixture_columns(spark):
    df = frame(
        spark,
        "price double, count bigint, id bigint, category string, text string, flag boolean, day string, none string",
        [(10.5 + i / 7, i % 3, i, "AB"[i % 2], f"text {i}", i % 2 == 0, f"2023-1-{i + 1}", None) for i in range(20)],
    )
    found = roles(df)
    assert found.pop("price") in ("identifier", "continuous_numeric")
    assert found == {
        "count": "categorical", "id": "identifier", "category": "categorical", "text": "text", "flag": "boolean",
        "day": "datetime", "none": "unknown",
    }


@pytest.mark.parametrize(
    "text", ["2023-01-05", "1/31/2023", "31/1/2023", "2023-1-5 10:00:00", "1/5/2023 10:00:00", "31-01-2023", "2023/1/5"]
)
def test_every_date_pattern_is_recognised(spark, text):
    df = frame(spark, "d string", [(text,)] * 9 + [("no date",)])
    assert roles(df)["d"] == "datetime"


def test_parse_rate_must_exceed_limit(spark):
    df = frame(spark, "d string", [("2023-01-05",)] * 8 + [("no",)] * 2)
    assert roles(df)["d"] == "categorical"


def test_integral_column_with_gaps_is_continuous(spark):
    df = frame(spark, "z bigint", [(i % 5,) for i in range(50)] + [(None,)])
    assert roles(df)["z"] == "continuous_numeric"


def test_protected_by_keyword_and_by_values(spark):
    df = frame(
        spark,
        "gender string, age_group bigint, region string, normal_col string, percentage bigint",
        [("M", 1, "N", f"x{i}", i) for i in range(25)],
    )
    found = profile.protected_attributes(profile.column_roles(df))
    assert rows(found, "column", "by_keyword") == [
        ("age_group", True), ("gender", True), ("percentage", True), ("region", True),
    ]


def test_approximate_profile_has_same_shape(spark, dirty6):
    exact, approx = profile.profile(dirty6, "d"), profile.column_roles(dirty6, approx=True)
    assert exact.count() == approx.count() == 7
    assert {r["column"]: r["role"] for r in approx.collect()} == roles(dirty6)


def _collected(df):
    return {r["column"]: r.asDict(True) for r in df.collect()}


def test_sketched_profile_agrees_where_it_is_exact(spark, dirty6):
    """Few distinct values: counts, roles, top values, dates and extremes are those of the exact profile."""
    exact, quick = _collected(profile.profile(dirty6, "d")), _collected(profile.profile(dirty6, "d", approx=True))
    for column, facts in exact.items():
        assert {k: v for k, v in quick[column].items() if k != "median"} == {k: v for k, v in facts.items() if k != "median"}
    tops = rows(profile.top_values(dirty6, 3).select("column", "value", "count", "place"))
    assert rows(profile.top_values(dirty6, 3, approx=True).select("column", "value", "count", "place")) == tops
    found, want = describe.metadata(dirty6, "d", approx=True).first(), describe.metadata(dirty6, "d").first()
    for part in ("columns", "sample_values", "relationships", "lists", "row_count", "column_count"):
        assert found[part] == want[part], part


def test_sketches_keep_their_error_bounds(spark):
    n = 60_000
    df = spark.range(0, n, 1, 7).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 20_011).cast("string"))).alias("skewed"),
        F.when(F.col("id") % 5 != 0, F.col("id")).alias("unique"), (F.col("id") % 700).cast("double").alias("few"),
    )
    got = _collected(profile.sketched(df))
    assert got["skewed"]["top_values"][0]["value"] == "hot"
    assert abs(got["skewed"]["top_values"][0]["count"] - n / 3) <= sketches.count_error(n)
    assert abs(got["skewed"]["unique_count"] / (20_011 + 1) - 1) < 0.05 and abs(got["unique"]["unique_count"] / (n * 0.8) - 1) < 0.05
    assert got["unique"]["null_count"] == n / 5 and got["few"]["unique_count"] == 700
    assert sum(abs(t["count"] - n / 700) <= 1 for t in got["few"]["top_values"]) == 5
    assert abs(got["few"]["median"] - 350) <= 2


def test_sketched_profile_exchanges_no_cells(spark, sf):
    """One pass: a single exchange of one row a task, below the aggregate, and nothing written."""
    df = spark.read.parquet(f"{sf}/orders.parquet")
    for frame in (profile.profile(df, "orders", approx=True), profile.top_values(df, approx=True)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange ", plan)) == 1 and "SinglePartition" in plan and plan.count("Scan parquet") == 1


def test_a_given_description_comes_first(spark, dirty6):
    stored = spark.createDataFrame([('{"columns": [{"name": "Age", "description": "Years lived"}, {"name": "Name", "description": ""}]}',)], "profile string")
    facts = describe.column_facts(dirty6, descriptions=describe.parse_profile(stored))
    said = {r["column"]: r["description"] for r in facts.collect()}
    assert said["Age"] == "Years lived" and said["Name"] == "Name" and len(said) == 7


def test_profile_statistics(spark):
    df = frame(spark, "v double", [(10.0,), (20.0,), (None,), (30.0,), (40.0,), (40.0,)])
    r = profile.profile(df, "d").first()
    assert (r["role"], r["median"], r["max"], r["null_count"]) == ("continuous_numeric", 30.0, 40.0, 1)


def test_top_values_break_ties_by_value(spark):
    df = frame(spark, "c string", [(v,) for v in "bbaaccdefg"])
    assert rows(profile.top_values(df, 3), "place", "value", "count") == [(1, "a", 2), (2, "b", 2), (3, "c", 2)]


def test_structure_limits(spark):
    df = frame(spark, "a bigint, b bigint", [(i, i) for i in range(5)])
    assert validate.structure(df, 5, 2).first()["valid"] and not validate.structure(df, 10, 2).first()["valid"]
    assert not validate.structure(df, 5, 3).first()["valid"]


@pytest.mark.parametrize("missing, threshold, valid", [(1, 0.5, True), (4, 0.2, False), (1, 0.2, True)])
def test_null_threshold(spark, missing, threshold, valid):
    df = frame(spark, "a bigint, b bigint", [(None if i < missing else i, i) for i in range(5)])
    assert validate.nulls(df, threshold).first()["valid"] is valid


@pytest.mark.parametrize("copies, threshold, share, valid", [(1, 0.3, 0.2, True), (2, 0.1, 0.4, False)])
def test_duplicates_count_extra_copies(spark, copies, threshold, share, valid):
    data = [(1, "a"), (2, "b"), (4, "d")][: 4 - copies] + [(3, "c")] * (copies + 1)
    r = validate.duplicates(frame(spark, "a bigint, b string", data), threshold).first()
    assert (r["duplicate_count"], r["duplicate_share"], r["valid"]) == (copies, share, valid)


def test_anomaly_bounds(spark):
    df = frame(spark, "value bigint", [(i,) for i in range(1, 11)] + [(1000,)])
    r = validate.anomalies(df).first()
    assert (r["outlier_count"], r["lower_bound"], r["upper_bound"]) == (1, -11.5, 23.5)
    assert validate.anomalies(frame(spark, "value bigint", [(i,) for i in range(10, 21)])).count() == 0
    assert validate.anomaly_flags(df).where("is_anomaly").count() == 1


def test_verdict_ignores_anomalies(spark):
    df = frame(spark, "value bigint, k bigint", [(i, i) for i in range(1, 11)] + [(1000, 11)])
    assert validate.verdict(df).first()["overall_valid"]


def test_names_are_normalised_and_kept_apart():
    assert clean.normal_names([" Order  ID ", "order-id", "Order.ID", "Ship_Mode", "Prix (€)"]) == [
        "order_id", "order_id_1", "order_id_2", "ship_mode", "prix",
    ]


def test_fills(spark):
    df = frame(spark, "c string, x double, n bigint", [("A", 10.0, 1), ("B", 20.0, 1), (None, None, None), ("A", 30.0, 2), ("B", 40.0, 2)])
    filled = clean.fill_missing(df, {"c": "categorical", "x": "continuous_numeric", "n": "discrete_numeric"})
    assert ("A", 25.0, 1) in rows(filled)  # ties go to the smallest value
    empty = clean.fill_missing(frame(spark, "c string, n bigint", [(None, None)]), {"c": "categorical", "n": "discrete_numeric"})
    assert rows(empty) == [("Unknown", 0)]


def test_cap_and_constant(spark):
    df = frame(spark, "value bigint, k bigint", [(v, 5) for v in (10, 12, 14, 16, 18, 20, 1000)])
    capped = clean.cap_outliers(df, {"value": "discrete_numeric"})
    assert capped.agg(F.max("value")).first()[0] == 37.0
    assert clean.cap_outliers(df, {"value": "discrete_numeric"}, method="none").agg(F.max("value")).first()[0] == 1000
    assert clean.remove_constant_columns(df).columns == ["value"]


def test_median_fill_can_flatten_and_drop_a_column(spark):
    df = frame(spark, "id bigint, postal double", [(i, float(i) if i % 5 == 0 else None) for i in range(100)])
    result = clean.clean(df, {"id": "identifier", "postal": "continuous_numeric"})
    assert result.columns == ["id"]


def test_whole_chain(spark, dirty6):
    result = clean.clean(dirty6, {"ID": "identifier", "Name": "text", "Age": "continuous_numeric", "Score": "continuous_numeric",
                                  "Category": "categorical", "Date": "datetime", "Constant": "categorical"})
    assert result.columns == ["id", "name", "age", "score", "category", "date"]
    by_id = {r["id"]: r for r in result.collect()}
    assert len(by_id) == 5 and by_id[1]["name"] == "Alice" and by_id[3]["name"] is None
    assert by_id[2]["age"] == 32.0 and by_id[4]["category"] == "B" and by_id[4]["score"] < 9999
    r = clean.summary(dirty6, result).first()
    assert (r["rows_removed"], r["columns_removed"]) == (1, 1)


def test_representation_and_unbalanced_groups(spark):
    df = frame(spark, "segment string, sales bigint", [("A", i) for i in range(8)] + [("B", 9)])
    got = {r["group"]: r for r in fairness.representation(df, ["segment"]).collect()}
    assert got["B"]["percentage"] == pytest.approx(100 / 9) and not got["B"]["under_represented"]


def test_disparate_impact(spark):
    df = frame(spark, "g string, o bigint", [("A", 100), ("A", 110), ("A", 120), ("B", 40), ("B", 50), (None, 1)])
    r = fairness.disparate_impact(fairness.group_facts(df, ["g"], ["o"])).first()
    assert r["ratio"] == pytest.approx(45 / 110) and not r["passes_80_percent_rule"]
    assert (r["privileged_group"], r["underprivileged_group"]) == ("A", "B")


def test_anova(spark):
    df = frame(spark, "g string, m bigint", [("A", 80 + i) for i in range(10)] + [("B", 40 + i) for i in range(10)])
    r = fairness.anova(fairness.group_facts(df, ["g"], ["m"])).first()
    assert r["f_statistic"] == pytest.approx(8000 / (82.5 / 9)) and (r["df_between"], r["df_within"]) == (1, 18)
    assert r["significant"] and r["p_value"] < 1e-10


def test_anova_with_missing_metric(spark):
    df = frame(spark, "g string, m double", [("A", 1.0), ("A", 2.0), ("B", 8.0), ("B", 9.0), ("B", None)])
    facts = fairness.group_facts(df, ["g"], ["m"])
    strict, loose = fairness.anova(facts).first(), fairness.anova(facts, "omit").first()
    assert strict["p_value"] is None and not strict["significant"] and loose["f_statistic"] == pytest.approx(98.0)


def test_group_statistics(spark):
    df = frame(spark, "g string, v bigint", [("A", 10), ("A", 20), ("B", 30), ("B", 40)])
    got = {r["group"]: r for r in fairness.group_statistics(df, ["g"], ["v"]).collect()}
    assert (got["A"]["mean"], got["A"]["median"], got["B"]["mean"], got["B"]["count"]) == (15.0, 15.0, 35.0, 2)


def test_bias_summary(spark):
    df = frame(spark, "g string, v bigint", [("A", 100)] * 19 + [("B", 10)])
    r = fairness.summarise(df, ["g"], ["v"]).first()
    assert (r["total_tests"], r["bias_flags"], r["overall_assessment"]) == (1, 2, fairness.ASSESSMENT_SIGNIFICANT)
    assert fairness.summarise(df, [], ["v"]).first()["status"] == "skipped"


def test_descriptions(spark):
    names = ["order_id", "customerID", "ship_date", "unit_price", "qty", "home_city", "sub_category"]
    df = spark.createDataFrame([(n,) for n in names], "column string")
    got = [r[0] for r in df.select(describe.description(F.col("column"))).collect()]
    assert got == [
        "Order Identifier", "Customer Identifier", "Ship Date Timestamp", "Unit Price Amount", "Qty Count",
        "Home City Location", "Sub Category",
    ]


def test_profile_json_shapes(spark):
    texts = ['{"columns": [{"name": "a", "description": "x"}, "b"]}', '{"columns": {"c": {"description": "y"}}}', "no json"]
    df = spark.createDataFrame([(t,) for t in texts], "profile string")
    assert rows(describe.parse_profile(df)) == [("a", "x"), ("b", None), ("c", "y")]


def test_relationships_are_the_first_twenty_pairs(spark):
    columns = [f"d{i}" for i in range(5)] + [f"m{i}" for i in range(5)] + ["x_id"]
    df = frame(spark, ", ".join(f"{c} {'string' if c[0] == 'd' else 'double'}" for c in columns),
               [tuple("v" if c[0] == "d" else float(i * 60 + j) for j, c in enumerate(columns)) for i in range(60)])
    got = describe.relationships(describe.column_facts(df)).orderBy("place").collect()
    assert len(got) == 20 and (got[0]["dimension"], got[0]["measure"]) == ("d0", "m0") and got[-1]["dimension"] == "d3"


@pytest.mark.parametrize("pattern, text", [("d/M/yyyy", "{d}/{m}/{y}"), ("M/d/yyyy", "{m}/{d}/{y}"), ("d-M-yyyy", "{d}-{m}-{y}"), ("yyyy/M/d", "{y}/{m}/{d}")])
def test_a_column_of_dates_has_one_pattern(spark, pattern, text):
    dates = [(2024, m, d) for m in range(1, 13) for d in (1, 4, 9, 12, 13, 20, 28)]
    df = spark.createDataFrame([("%d-%02d-%02d" % x, text.format(y=x[0], m=x[1], d=x[2])) for x in dates] + [(None, "soon"), (None, None)], "expected string, day string")
    read = clean.standardize_types(df, {"day": "datetime"}).select("expected", F.date_format("day", "yyyy-MM-dd").alias("day"))
    assert len(dates) == 84 and all(r["expected"] == r["day"] for r in read.collect())
    span = profile.date_ranges(df, ["day"]).first()
    assert (str(span["min_date"])[:10], str(span["max_date"])[:10]) == ("2024-01-01", "2024-12-28")


def test_given_rows_are_computed_once(spark, dirty6):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    n = dirty6.count()
    clean.clean(dirty6.mapInArrow(counted, dirty6.schema)).collect()
    assert seen.value == n


def test_each_distinct_date_is_parsed_once(spark):
    from orderlore.functions.dates import places_of

    df = spark.createDataFrame([("3/4/2020", "2020-01-02")] * 5 + [("25/4/2020", None)] * 6, "a string, b string")
    assert places_of(df, ["a", "b"]) == {"a": 2, "b": 0}
    assert places_of(df.where("b = ''"), ["a", "b"]) == {"a": 0, "b": 0}
