import json
import random

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from orderlore.operators import documents


def pairs(spark, truth, predicted):
    df = spark.createDataFrame([("p.json", json.dumps({"0_expected": truth}), json.dumps(predicted))], "prediction_file string, t string, d string")
    return df.select("prediction_file", F.parse_json("t").alias("truth"), F.parse_json("d").alias("document"))


def outcomes(spark, truth, predicted):
    return dict(rows(documents.compare_fields(pairs(spark, truth, predicted)), "path", "outcome"))


@pytest.mark.parametrize(
    "a, b, expected",
    [
        (1, 1.0, "exact"), (100, 100.9, "exact"), (100, 102, "wrong"), (0, 0, "exact"), (True, 1, "exact"), (None, None, "exact"),
        (None, "x", "wrong"), ("A b ", " a B", "exact"), ("customer 12", "customer 13", "partial"), ("abc", "xyz", "wrong"),
        ("1", 1, "wrong"), ([1, "x"], [1.0, "x"], "exact"), ([1, 2], [2, 1], "wrong"), ([{"b": 1, "a": 2}], [{"a": 2, "b": 1}], "exact"),
        ("", "", "exact"), ("v1.0, x", "v1, x", "partial"), (["x1.0, y"], ["x1, y"], "wrong"), (["x1.0, y"], ["x1.0, y"], "exact"),
        ([[], 1], [[], 1.0], "exact"), ([[]], [], "wrong"), ([{}], [[]], "wrong"), ([{"a": [1, {"b": 2.0}]}], [{"a": [1.0, {"b": 2}]}], "exact"),
        ([None], [None], "exact"), (["1"], [1], "wrong"), ([], [], "exact"), ([], {}, "missing"), ([True], [1], "exact"),
    ],
)
def test_matching(spark, a, b, expected):
    assert outcomes(spark, {"f": a}, {"f": b}) == {"f": expected}


def test_nested_paths_missing_and_extra(spark):
    truth = {"a": {"b": {"c": 1}}, "e": {}, "only": None, "l": [{"x": 1}]}
    got = outcomes(spark, truth, {"a": {"b": {"c": 1, "d": 2}}, "l": [{"x": 1}]})
    assert got == {"a.b.c": "exact", "a.b.d": "extra", "only": "missing", "l": "exact"}
    r = documents.report(documents.compare_fields(pairs(spark, truth, {"a": {"b": {"c": 1, "d": 2}}, "l": [{"x": 1}]}))).first()
    assert (r["tp"], r["fp"], r["fn"], r["extra_fields"], r["precision"], r["recall"], r["f1"]) == (2, 0, 1, 1, 1.0, 0.667, 0.8)


@pytest.mark.parametrize("levels", [3, documents.LEVELS_AT_ONCE, documents.LEVELS_AT_ONCE + 1, 40])
def test_documents_of_any_depth(spark, levels):
    deep, other = 1, 2
    for _ in range(levels):
        deep, other = {"n": deep}, {"n": other}
    path = ".".join("n" * levels)
    assert outcomes(spark, deep, deep) == {path: "exact"}
    assert outcomes(spark, deep, other) == {path: "wrong"}
    assert outcomes(spark, {"a": 1}, {"a": 1, "b": deep}) == {"a": "exact", f"b.{path}": "extra"}


def test_brackets_in_texts_and_empty_containers(spark):
    odd = {"a{{": "}]\"{", "b": [{"c": []}], "d": {"e": {}}, "f": [], "g": [[], {}]}
    assert outcomes(spark, odd, odd) == {"a{{": "exact", "b": "exact", "f": "exact", "g": "exact"}
    assert outcomes(spark, {"g": [[], {}]}, {"g": [{}, []]}) == {"g": "wrong"}


def test_deep_lists(spark):
    one, other = 1, 1.0
    for _ in range(20):
        one, other = [one, "1.0"], [other, "1.0"]
    assert outcomes(spark, {"l": one}, {"l": other}) == {"l": "exact"}
    assert outcomes(spark, {"l": one}, {"l": [other]}) == {"l": "wrong"}
    # numbers agree by value and text by text, below any number of lists and objects
    a, b, c = 5, 5.0, "5"
    for i in range(11):
        a, b, c = ([{"k": x}, None] if i % 2 else [x, [i]] for x in (a, b, c))
    made = outcomes(spark, {"same": a, "number": a, "text": a, "m": {"n": a}}, {"same": a, "number": b, "text": c, "m": {"n": b}})
    assert made == {"same": "exact", "number": "exact", "text": "wrong", "m.n": "exact"}


def test_the_last_of_repeated_keys_counts(spark):
    df = spark.createDataFrame([('{"a": 1, "a": 2, "b": 3}',)], "t string")
    got = df.select(F.to_json(documents.lenient_document(F.col("t"))).alias("j")).first()["j"]
    assert json.loads(got) == {"a": 2, "b": 3}


def test_lenient_parse_and_pairing(spark):
    df = spark.createDataFrame(
        [("a", "x/doc_1.pdf", 'text {"k": 1} end'), ("b", "doc_2.pdf", "nothing"), ("c", "", "{}"), ("d", "doc_9.pdf", "{}")],
        "prediction_file string, origin_file string, t string",
    ).withColumn("document", documents.lenient_document(F.col("t")))
    truths = spark.createDataFrame([("y/doc_1.json", "{}"), ("doc_2.json", "{}")], "path string, t string")
    truths = truths.select("path", F.parse_json("t").alias("document"))
    paired = documents.pair_documents(df, truths)
    assert rows(paired, "prediction_file", "stem") == [("a", "doc_1"), ("b", "doc_2")]
    assert rows(df.select("prediction_file", F.to_json("document")))[:2] == [("a", '{"k":1}'), ("b", "{}")]


def test_only_lists_that_may_be_deep_are_doubted(spark):
    df = spark.createDataFrame([('["x1.0, y", {"k": [1]}]',), ("[[[[[1]]]]]",), ('{"a": 1}',)], "t string").select(F.parse_json("t").alias("leaf"))
    assert [r[0] for r in df.select(documents._may_be_deep()).collect()] == [False, True, False]


def many_pairs(spark, made):
    df = spark.createDataFrame([(k, json.dumps({"0_expected": t}), json.dumps(p)) for k, t, p in made], "prediction_file string, t string, d string")
    return df.select("prediction_file", F.parse_json("t").alias("truth"), F.parse_json("d").alias("document"))


def some_value(rng, level=0):
    """A value of any kind, objects and lists of several levels among them."""
    kind = rng.randrange(12 if level < 5 else 9)
    if kind < 2:
        return rng.choice([0, 1, -1, 127, 128, -129, 40000, 2**31, 2**53 + 1, -(2**63), 10**25, 10**60, 1.5, 100.0, 100.9, 0.1, -1e-7, 1e10, 1e300])
    if kind < 6:
        return rng.choice(["", " a", "A\t", "Customer 12", "customer 13", "é" * 30, "É\U0001f600", "x" * 70, "x" * 69 + "Y", "null", "1", "İ", "ὈΔΥΣΣΕΎΣ", " a", '"\\'])
    if kind < 9:
        return rng.choice([None, True, False, [], {}])
    if kind == 9:
        return [some_value(rng, level + 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abcdefgh") * rng.choice([1, 1, 90]): some_value(rng, level + 1) for _ in range(rng.randrange(12))}


def changed(rng, value):
    """A value much like another."""
    if rng.random() < 0.1:
        return some_value(rng, 3)
    if isinstance(value, dict):
        return {k: changed(rng, v) for k, v in value.items() if rng.random() < 0.95}
    if isinstance(value, list):
        return [changed(rng, v) for v in value]
    return value * 1.005 if isinstance(value, float) else value


def test_rows_are_compared_as_rows_of_leaves(spark, monkeypatch):
    rng = random.Random(5)
    truths = [{k: some_value(rng) for k in rng.sample(["k", "l", "m", "n", "o", "p" * 300], 4)} for _ in range(300)]
    truths += [5, "x", None, [1, [2]], {"a" + str(i): i for i in range(300)}, {"long": ["z" * 70_000, {"t": list(range(300))}]}]
    made = [(f"{i}.json", t, changed(rng, t)) for i, t in enumerate(truths)]
    df = many_pairs(spark, made)
    want = rows(documents._compare_leaves(df, "prediction_file"), "prediction_file", "path", "outcome")
    assert {r[2] for r in want} == {"exact", "partial", "wrong", "missing", "extra"}
    monkeypatch.setattr(documents, "_compare_leaves", None)  # none of them is left to it
    assert rows(documents.compare_fields(df), "prediction_file", "path", "outcome") == want


def test_pairs_are_compared_without_writing_leaves(spark, monkeypatch):
    labels, write = [], documents.materialise
    monkeypatch.setattr(documents, "materialise", lambda df, label: labels.append(label) or write(df, label))
    deep = 1
    for i in range(40):
        deep = [deep] if i % 2 else {"n": deep}
    assert set(outcomes(spark, {"a": deep, "b": 1}, {"a": deep}).values()) == {"exact", "missing"}
    assert labels and "document-leaves" not in labels


def test_pairs_that_rows_do_not_settle(spark, monkeypatch):
    made = [
        ("same", {"a": 1, "b": 2, "c": 3}, {"a": 1, "b": 9}), ("same", {"a": 1, "b": 2, "d": 4}, {"a": 1, "b": 2}),
        (None, {"a": 1}, {"a": 2}), (None, {"a": 1}, {"a": 2}),
        ("path", {"a.b": 1, "a": {"b": 2}}, {"a": {"b": 2}}), ("long", {"t": "x" * 500}, {"t": "X" * 500}), ("plain", {"a": 1}, {"b": 1}),
    ]
    monkeypatch.setattr(documents, "LONG_PAIR", 900)
    df = many_pairs(spark, made)
    got = rows(documents.compare_fields(df), "prediction_file", "path", "outcome")
    assert got == rows(documents._compare_leaves(df, "prediction_file"), "prediction_file", "path", "outcome")
    assert [r for r in got if r[0] == "same"] == [("same", "a", "exact"), ("same", "b", "wrong"), ("same", "c", "missing"), ("same", "d", "missing")]
    assert {r for r in got if r[0] in (None, "path", "long", "plain")} == {
        (None, "a", "wrong"), ("path", "a.b", "exact"), ("long", "t", "exact"), ("plain", "a", "missing"), ("plain", "b", "extra")
    }


def test_prose_is_not_parsed_whole(spark):
    """What stands before a document makes no difference, and a text that can't be JSON is looked into for one."""
    heads = ["", " ", "Result: ", "result: ", "True ", "Infinity", "NaN ", "true", "false ", "null ", "e", "z", "É", "1 ", '"', "[", "{"]
    texts = [(h + body,) for h in heads for body in ('{"k": 1}', '{"k": {"l": 2}} end', "none", "")] + [(None,)]
    df = spark.createDataFrame(texts, "t string")
    documents.allow_repeated_keys()
    inner = F.regexp_extract("t", r"(?s)\{.*\}", 0)
    plain = F.coalesce(F.try_parse_json("t"), F.try_parse_json(inner), F.parse_json(F.lit("{}")))
    got = df.select("t", F.to_json(documents.lenient_document(F.col("t"))).alias("g"), F.to_json(plain).alias("w")).collect()
    assert len(got) == len(texts) and [r for r in got if r["g"] != r["w"]] == []
    tries = documents.lenient_document(F.lit("Result: {}"))
    assert "CASE WHEN" in str(tries)


def test_document_texts_are_not_shuffled(spark):
    """The orders are dealt out while they are short; no exchange carries the texts made of them."""
    from orderlore.plans.test_views import documents as made

    text = made(spark, SF)._jdf.queryExecution().executedPlan().toString()
    above, below = text.split("REPARTITION")
    assert all(name in above and name not in below for name in ("predicted_text", "truth_text"))


def test_reports_of_rows_and_of_leaves_agree(spark):
    rng = random.Random(8)
    truths = [{k: some_value(rng) for k in rng.sample("klmno", rng.randrange(5))} for _ in range(100)]
    df = many_pairs(spark, [(f"{i % 90}.json", t, changed(rng, t)) for i, t in enumerate(truths)])
    got = rows(documents.report(documents.compare_fields(df)))
    assert got == rows(documents.report(documents._compare_leaves(df, "prediction_file")))
    assert len({r[0] for r in got}) == len(got) > 60


def test_a_report_is_one_exchange_of_counts(spark):
    df = many_pairs(spark, [("a", {"x": 1, "y": {"z": 2}}, {"x": 1, "y": {"z": "2"}}), ("b", {"x": 1}, {})])
    report = documents.report(documents.compare_fields(df))
    exchanges = [line for line in report._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "path" not in exchanges[0]
    assert rows(report, "prediction_file", "tp", "fp", "fn") == [("a", 1, 1, 0), ("b", 0, 0, 1)]
