import json
import os
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from orderlore.operators import profile
from orderlore.session import fresh_path, materialise, shared_folder
from orderlore.sources import files, json_array, metadata, responses, stages


def test_formats():
    assert [files.file_format(p) for p in ("a.CSV", "b/c.xlsx", "d.json", "e.parquet", "f.txt", "g")] == [
        "csv", "excel", "json", "parquet", "text", "unknown",
    ]


def test_reading_by_ending(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,é\n2,b\n", encoding="latin-1")
    (tmp_path / "b.json").write_text(json.dumps([{"x": 1, "y": "a"}, {"x": 2, "y": "b"}]))
    assert rows(files.read_data_file(spark, str(tmp_path / "a.csv"))) == [(1, "é"), (2, "b")]
    assert rows(files.read_data_file(spark, str(tmp_path / "b.json"))) == [(1, "a"), (2, "b")]
    for refused in ("c.xlsx", "d.txt", "e.bin"):
        with pytest.raises(ValueError):
            files.read_data_file(spark, str(tmp_path / refused))


def test_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("é".encode())
    (tmp_path / "l.csv").write_bytes("é".encode("latin-1"))
    (tmp_path / "w.csv").write_bytes("é".encode("utf-16"))
    found = files.encodings(spark, str(tmp_path)).select(F.regexp_extract("path", r"(\w)\.csv", 1), "encoding")
    assert rows(found) == [("l", "iso-8859-1"), ("u", "utf-8"), ("w", "utf-16")]


def test_first_file_by_folder_then_format(spark, tmp_path):
    for folder, name in (("one", "z.parquet"), ("one", "b.csv"), ("one", "a.csv"), ("two", "0.csv"), ("one", "skip.bin")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("x")
    got = files.find_data_files(spark, [str(tmp_path / "one"), str(tmp_path / "two")]).first()["path"]
    assert got.endswith("/one/a.csv")


def test_data_url_has_no_line_breaks(spark):
    df = spark.createDataFrame([(bytearray(b"x" * 200),)], "c binary")
    url = df.select(files.data_url(F.col("c"))).first()[0]
    assert url.startswith("data:application/pdf;base64,eHh4") and "\n" not in url and "\r" not in url


def test_questions(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# head\n\n  What?  \r\n# note\nWhy?\n\n")
    assert rows(responses.read_questions(spark, str(tmp_path / "q.txt"))) == [(1, "What?"), (2, "Why?")]


def test_stages_reports_and_listing(spark):
    root = fresh_path(spark, "t")
    df = spark.range(5).withColumn("v", F.lit("x"))
    for name in ("orders", "items"):
        stages.write_stage(df, root, name, "validated")
    stages.write_stage(df, root, "orders", "processed", "csv")
    stages.write_report(profile.null_counts(df), root, "orders", "schema")
    assert rows(stages.list_datasets(spark, root)) == [("items",), ("orders",)]
    assert stages.latest_dataset(spark, root, "processed").first()["dataset"] == "orders"
    assert stages.load_stage(spark, root, "orders").count() == 5
    with pytest.raises(FileNotFoundError, match="items, orders"):
        stages.load_stage(spark, root, "nothing")
    with pytest.raises(ValueError):
        stages.stage_path(root, "orders", "final")
    summary = {r["dataset"]: r for r in stages.artifact_summary(spark, root).collect()}
    assert summary["orders"]["schema"] and summary["orders"]["processed"] and not summary["items"]["processed"]
    assert stages.read_report(spark, root, "orders", "bias", "a int").count() == 0


def test_latest_report_prefers_one_kind(spark, tmp_path):
    import os

    for i, name in enumerate(("model_comparison_1.json", "model_comparison_2.json", "a_evaluation_3.json")):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    got = stages.latest_report(spark, str(tmp_path), "model_comparison_", "_evaluation_").first()["path"]
    assert got.endswith("model_comparison_2.json")


def test_metadata_table(spark):
    stamp = lambda day: F.lit(f"2024-01-0{day}").cast("timestamp")
    record = lambda name, n, day: spark.range(1).select(
        F.lit(name).alias("dataset_name"), F.lit('{"a": 1}').alias("metadata"), F.lit("c").alias("llm_context"),
        F.lit(n).cast("bigint").alias("row_count"), F.lit(1).cast("bigint").alias("column_count"),
        stamp(day).alias("created_at"), stamp(day).alias("updated_at"),
    )
    root = fresh_path(spark, "m")
    metadata.write_version(record("x", 1, 1).unionByName(record("y", 5, 2)), root, 1)
    metadata.write_version(metadata.upsert(metadata.read_latest(spark, root), record("x", 2, 3)), root, 2)
    table = metadata.read_latest(spark, root)
    assert rows(table, "dataset_name", "row_count", F.dayofmonth("created_at"), F.dayofmonth("updated_at")) == [("x", 2, 1, 3), ("y", 5, 2, 2)]
    assert [r["dataset_name"] for r in metadata.list_all(table).collect()] == ["x", "y"]
    assert metadata.exists(table, "x") and not metadata.exists(metadata.delete(table, "x"), "x")
    assert metadata.lookup(table, "x").select(F.try_variant_get("metadata", "$.a", "int")).first()[0] == 1


def test_materialise_keeps_rows_and_uses_the_shared_folder(spark):
    df = materialise(spark.range(10), "rows")
    assert df.count() == 10 and df.inputFiles()[0].replace("file://", "").startswith(shared_folder(spark))


def test_the_shared_folder_is_never_local_to_a_cluster_driver(spark, monkeypatch):
    from types import SimpleNamespace

    from orderlore import session

    def fake(master, setting=None, given=None):
        option = SimpleNamespace(isDefined=lambda: given is not None, get=lambda: given)
        context = SimpleNamespace(master=master, applicationId=f"app-{master}", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option)))
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: setting or default))

    assert session.shared_folder(fake("spark://host:7077", setting="hdfs://x/shared/")) == "hdfs://x/shared"
    assert session.shared_folder(fake("spark://host:7077", given="hdfs://x/given")) == "hdfs://x/given"
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(fake(master))
    local = session.shared_folder(fake("local[4]"))
    assert os.path.isdir(local) and local == session.shared_folder(fake("local[4]"))


def test_only_committed_versions_are_read_and_old_ones_pruned(spark):
    root = fresh_path(spark, "metadata")
    assert metadata.read_latest(spark, root).count() == 0
    one = spark.createDataFrame([("x", "{}", "c", n, 1, None, None) for n in range(3)], metadata.SCHEMA)
    for version in range(1, 6):
        metadata.write_version(one.where(f"row_count < {version}"), root, version, keep=2)
    assert sorted(os.listdir(root.removeprefix("file://"))) == ["version=4", "version=5"]
    broken = metadata.write_version(one.limit(1), root, 6, keep=9)
    os.remove(broken.removeprefix("file://") + "/_SUCCESS")
    assert metadata.read_latest(spark, root).count() == 3


def test_json_array_is_read_in_ranges(spark, tmp_path):
    """Braces, quotes and escapes in strings, nested and very long records, whatever range boundary they meet."""
    made = random.Random(4)
    odd = ["plain", "a } b { c", 'quo"te {', "back\\slash\\", "]}[{", "é\n}", ""]
    want = [{"id": i, "text": made.choice(odd) * made.randint(1, 4), "in": {"list": [{"x": i}, {"y": made.choice(odd)}]}} for i in range(400)]
    want[77]["text"] = "long } record " * 2000
    (tmp_path / "a.json").write_text(json.dumps(want[:300], indent=1))
    (tmp_path / "b.json").write_text(json.dumps(want[300:]))
    (tmp_path / "c.json").write_text("[]\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = json_array.records(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 10
        got = sorted((json.loads(r["value"]) for r in lines.collect()), key=lambda r: r["id"])
    finally:
        for k, v in zip(("maxPartitionBytes", "openCostInBytes"), before):
            spark.conf.set(f"spark.sql.files.{k}", v)
    assert got == want
    frame = files.read_json(spark, str(tmp_path / "b.json"))
    assert sorted(frame.columns) == ["id", "in", "text"] and frame.count() == 100


def test_encoding_probe_reads_no_content_column(spark, tmp_path):
    (tmp_path / "late.csv").write_bytes(b"ascii line\n" * 5000 + "é".encode("latin-1"))
    found = files.encodings(spark, str(tmp_path))
    assert rows(found.select(F.regexp_extract("path", r"(\w+)\.csv", 1), "encoding")) == [("late", "iso-8859-1")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan
