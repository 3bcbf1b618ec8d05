from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from driftwatch.sources import manifest
from driftwatch.sources.cow import CopyOnWriteTable

SCHEMA = "id long, severity string, score double, seq int"


def rows_of(table, version=None):
    return sorted((r.id, r.severity, r.score, r.seq) for r in table.read(version).collect())


@pytest.fixture()
def table(spark, tmp_path):
    rows = spark.range(200).select("id", F.lit("low").alias("severity"), F.lit(0.5).alias("score"), F.lit(0).alias("seq"))
    return CopyOnWriteTable.create(rows, str(tmp_path / "table"), buckets=16)


def named(state):
    return {b: sorted(f) for b, f in state["files"].items()}


def test_a_write_keeps_the_files_it_does_not_touch(spark, table):
    before = table.state()
    requests = spark.createDataFrame([(5, "high", None, 1), (5, "medium", 0.9, 2), (5, None, None, 3), (999, "high", 1.0, 9)], SCHEMA)
    assert table.patch(requests, ["severity", "score"], [-F.col("seq")], ("seq", F.lit(77))) == 2
    after = table.state()
    touched = {b for b in after["files"] if named(after)[b] != named(before).get(b)}
    assert 1 <= len(touched) <= 2 and len(before["files"]) == 16
    got = {r[0]: r for r in rows_of(table)}
    assert got[5] == (5, "medium", 0.9, 77) and got[6] == (6, "low", 0.5, 0) and len(got) == 200 and 999 not in got
    assert rows_of(table, 1)[5] == (5, "low", 0.5, 0)  # the old version stays


def test_upsert_append_delete(spark, table):
    fresh = spark.createDataFrame([(5, "a", 1.0, 1), (5, "b", 2.0, 2), (300, "c", None, 1)], SCHEMA)
    table.upsert(fresh, [-F.col("seq")])
    got = {r[0]: r for r in rows_of(table)}
    assert got[5] == (5, "b", 2.0, 2) and got[300] == (300, "c", None, 1) and len(got) == 201
    before = named(table.state())
    table.append(spark.createDataFrame([(5, "no", 0.0, 0), (400, "d", 0.1, 1), (400, "d", 0.1, 1)], SCHEMA))
    after = named(table.state())
    assert all(set(f) <= set(after[b]) for b, f in before.items())  # appends copy nothing
    got = {r[0]: r for r in rows_of(table)}
    assert got[5][1] == "b" and got[400] == (400, "d", 0.1, 1) and len(got) == 202
    table.delete(spark.createDataFrame([(5,), (5,), (12345,)], "id long"))
    assert len(rows_of(table)) == 201 and 5 not in {r[0] for r in rows_of(table)}
    table.delete(table.read().select("id"))
    assert rows_of(table) == []
    table.append(fresh.filter("id = 300"))
    assert len(rows_of(table)) == 1


def test_an_aborted_write_leaves_the_old_version(spark, table, monkeypatch):
    want = rows_of(table)

    def fails(*_):
        raise OSError("lost")

    monkeypatch.setattr(manifest, "publish", fails)
    with pytest.raises(OSError):
        table.delete(spark.range(100))
    monkeypatch.undo()
    assert rows_of(table) == want and table.versions() == [1]
    bad = spark.createDataFrame([(7, "x", 1.0, 1), (None, "x", 1.0, 1)], SCHEMA)
    with pytest.raises(Exception, match="null id"):
        table.upsert(bad)
    assert rows_of(table) == want and table.versions() == [1]


def test_two_writers_from_one_version(spark, table):
    state = table.state()
    other = CopyOnWriteTable(spark, table.path)
    other.delete(spark.range(1))
    table.state = lambda version=None: state
    with pytest.raises(manifest.AlreadyPublished):
        table.delete(spark.range(2))
    assert other.read().count() == 199


def test_empty_tables_other_types_and_absent_columns(spark, tmp_path):
    empty = CopyOnWriteTable.create(spark.createDataFrame([], "id string, v array<double>"), str(tmp_path / "e"), buckets=2)
    assert empty.read().count() == 0
    empty.upsert(spark.createDataFrame([("k", 1)], "id string, other int"))
    assert [(r.id, r.v) for r in empty.read().collect()] == [("k", None)]
