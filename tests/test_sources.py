from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from driftwatch.operators import registry as reg
from driftwatch.sources import tables
from driftwatch.sources.schemas import SCHEMA_DDL, schema, subset
from driftwatch.sources.shared import materialize, shared_folder

NOW = dt.datetime(2024, 1, 30)


def test_schemas_parse_and_narrow(spark):
    assert all(len(schema(t)) > 2 for t in SCHEMA_DDL)
    assert subset("websites", ["id", "url"]).names == ["id", "url"]


def test_append_is_partitioned_by_date(spark, tmp_path):
    path = str(tmp_path / "snaps")
    df = spark.createDataFrame([(1, NOW)], "id int, captured_at timestamp_ntz")
    tables.append(df, path, "captured_at")
    tables.append(df.withColumn("id", F.lit(2)), path, "captured_at")
    stored = spark.read.parquet(path)
    assert sorted(r.id for r in stored.collect()) == [1, 2] and "captured_date" in stored.columns


def test_merge_keeps_old_values_for_nulls(spark):
    base = spark.createDataFrame([(1, 0.1, True), (2, 0.2, None)], "id int, score double, flag boolean")
    patch = spark.createDataFrame([(1, None, False)], "id int, score double, flag boolean")
    out = {r.id: r for r in tables.merge_patch(base, patch, "id", ["score", "flag"], ("stamp", F.lit(5))).collect()}
    assert (out[1].score, out[1].flag, out[1].stamp) == (0.1, False, 5) and out[2].stamp is None


def test_register_skips_known_and_names_by_host(spark):
    known = spark.createDataFrame([("http://a/",)], "url string")
    new = spark.createDataFrame(
        [("http://a/", None, None), ("http://b:81/x", None, None), ("http://b:81/x", None, 60)], "url string, name string, check_interval_seconds int"
    )
    rows = reg.register_sites(known, new, F.lit(NOW)).collect()
    assert [(r.url, r.name, r.check_interval_seconds) for r in rows] == [("http://b:81/x", "b:81", 60)]


def test_validation_issues(spark):
    rows = [("abc", "http://ok.example.com/", "* * * * *"), ("a!", None, "5m"), ("site", "not a url", None)]
    out = reg.validate_sites(spark.createDataFrame(rows, "id string, url string, interval string"))
    assert sorted((r.id, r.issue) for r in out.collect()) == [
        ("a!", "id too short"), ("a!", "invalid interval"), ("a!", "missing url"), ("site", "invalid url"),
    ]


def test_shared_folder_and_materialize(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark, "x")
    assert folder != shared_folder(spark, "x") and (not base or folder.startswith(base))
    assert materialize(spark.range(5), "ids").count() == 5
