from __future__ import annotations

import datetime as dt
import os
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from driftwatch.operators.alerts import suppress_alerts
from driftwatch.operators.history import change_pattern, snapshot_pairs
from driftwatch.plans.views import VIEW_SQL
from driftwatch.sources import manifest
from driftwatch.sources.schemas import schema
from driftwatch.streaming import jobs

SF = "/root/testdata/sf0.001/events.parquet"
START = dt.datetime(2024, 1, 1)


def write_files(frames, target):
    """Files that a stream reads one after the other."""
    target.mkdir()
    for i, frame in enumerate(frames):
        path = target / f"part-{i}.parquet"
        frame.to_parquet(path, coerce_timestamps="us")
        os.utime(path, (time.time() - 100 + i, time.time() - 100 + i))
    return str(target)


def shuffled_events(spark, tmp_path, parts=3):
    """The events in consecutive files, the rows of each in random order, and some of them a file late within the watermark's delay."""
    rows = spark.read.parquet(SF).orderBy("ts", "event_id").toPandas()
    place = rows.index.to_series() * parts // len(rows)
    frames = [rows[place == i].sample(frac=1, random_state=i) for i in range(parts)]
    return write_files(frames, tmp_path / "events")


def view(spark, name, events):
    return spark.sql(VIEW_SQL[name], events=events)


def run(spark, tmp_path, name, make, rows, at, mode="append"):
    closing = jobs.Closing(spark, str(tmp_path / f"{name}-end"), at)
    return jobs.run_to_table(make(closing.join(rows)), str(tmp_path / name), str(tmp_path / f"{name}-ck"), mode, closing)


def test_shuffled_files_equal_batch_results(spark, tmp_path):
    folder = shuffled_events(spark, tmp_path)
    batch = spark.read.parquet(SF)
    events = jobs.read_files(spark, folder, schema("events"))

    kept = run(spark, tmp_path, "suppress", jobs.suppressed, view(spark, "alerts_dense", events), "created_at")
    assert kept.select("batch_id").distinct().count() > 1 and jobs.late_rows(kept).isEmpty()
    assert {r.id for r in kept.collect()} == {r.id for r in suppress_alerts(view(spark, "alerts_dense", batch)).collect()}

    pairs = run(spark, tmp_path, "changes", jobs.changes, view(spark, "snaps", events), "captured_at")
    want = snapshot_pairs(view(spark, "snaps", batch), ["content_hash"])
    assert sorted((r.id, r.old_id, r.is_first_snapshot) for r in pairs.collect()) == sorted((r.id, r.old_id, r.is_first_snapshot) for r in want.collect())

    pattern = run(spark, tmp_path, "pattern", jobs.patterns, view(spark, "snaps", events), "captured_at", "update")
    pattern = jobs.last_update(jobs.on_time(pattern), ["website_id"], "last_at")
    want = {r.website_id: (r.history_size, r.change_count) for r in change_pattern(view(spark, "snaps", batch)).collect() if not r.insufficient_data}
    got = {r.website_id: (r.history_size, r.change_count) for r in pattern.collect()}
    assert all(got[k] == v for k, v in want.items())


def alerts_at(minutes, ids=None, site="s1"):
    import pandas as pd

    at = pd.to_datetime([START + dt.timedelta(minutes=m) for m in minutes]).astype("datetime64[us]")
    return pd.DataFrame({"id": ids or [f"a{m}" for m in minutes], "website_id": site, "alert_type": "x", "severity": "critical", "created_at": at})


ALERTS = "id string, website_id string, alert_type string, severity string, created_at timestamp_ntz"


def read_alerts(spark, folder):
    from pyspark.sql.types import StructType

    return jobs.read_files(spark, folder, StructType.fromDDL(ALERTS))


def state_rows(spark, checkpoint, name):
    found = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    return found.count()


def test_suppression_state_goes_and_late_alerts_are_told(spark, tmp_path):
    """Ids and keys are strings; the second file is out of order, the third has an alert that the watermark has passed."""
    frames = [alerts_at([0, 1]), alerts_at([40, 2, 300]), alerts_at([30, 301]), alerts_at([9000], site="s2")]
    every = [tuple(r) for f in (frames[0], frames[1], alerts_at([301]), frames[3]) for r in f.itertuples(index=False)]
    batch = spark.createDataFrame([(*r[:-1], r[-1].to_pydatetime()) for r in every], ALERTS)
    stream = jobs.suppressed(read_alerts(spark, write_files(frames, tmp_path / "in")))
    checkpoint = str(tmp_path / "ck")
    jobs.to_table(stream, str(tmp_path / "out"), checkpoint).awaitTermination()
    # all but s2's own alert (within the delay) are released, and s1 is forgotten after two hours
    assert state_rows(spark, checkpoint, "emitted") == 0 and state_rows(spark, checkpoint, "buckets") == 1
    out = jobs.published(spark, str(tmp_path / "out"))
    assert [r.id for r in jobs.late_rows(out).collect()] == ["a30"]
    want = {r.id for r in suppress_alerts(batch).collect()} - {"a9000"}
    assert {r.id for r in jobs.on_time(out).collect()} == want


def test_windows_are_told_once_and_late_rows_counted(spark, tmp_path):
    import pandas as pd

    def scans(minutes):
        at = pd.to_datetime([START + dt.timedelta(minutes=m) for m in minutes]).astype("datetime64[us]")
        return pd.DataFrame({"website_id": 1, "captured_at": at, "is_defaced": [m % 2 == 0 for m in minutes]})

    frames = [scans([5, 50, 58]), scans([65, 55, 300]), scans([310]), scans([56, 320])]  # the row of minute 56 comes after its window was told
    from pyspark.sql.types import StructType

    rows = StructType.fromDDL("website_id long, captured_at timestamp_ntz, is_defaced boolean")
    folder = write_files(frames, tmp_path / "in")
    out = run(spark, tmp_path, "counts", jobs.scan_counts, jobs.read_files(spark, folder, rows), "captured_at")
    got = sorted(((r.window_start - START).total_seconds() / 3600, r.scan_count, r.defacement_count) for r in out.collect())
    assert got == [(0, 4, 2), (1, 1, 0), (5, 3, 3)]
    assert jobs.dropped_rows(spark.read.schema(rows).parquet(folder), out) == 1


def test_a_batch_lost_between_write_and_commit_leaves_one_copy(spark, tmp_path, monkeypatch):
    folder = write_files([alerts_at([0, 1, 2])], tmp_path / "in")
    target, checkpoint, sent = str(tmp_path / "sink"), str(tmp_path / "ck"), []

    def start():
        stream = jobs.deliverable(read_alerts(spark, folder))
        return jobs.to_table(stream, target, checkpoint, send=lambda df, i: sent.append(df.count()))

    publish, calls = manifest.publish, []

    def lost_before(spark_, path, content):
        calls.append(path)
        raise OSError("lost before the manifest")

    monkeypatch.setattr(manifest, "publish", lost_before)
    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    assert len(calls) == 1 and len(manifest.files(spark, f"{target}/data/*")) == 1  # files without a manifest
    with pytest.raises(FileNotFoundError):
        jobs.published(spark, target)

    def lost_after(spark_, path, content):
        publish(spark_, path, content)
        raise OSError("lost after the manifest")

    monkeypatch.setattr(manifest, "publish", lost_after)
    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    monkeypatch.undo()
    start().awaitTermination()
    assert jobs.published(spark, target).count() == 3 and sum(sent) == 3


def test_held_rows_are_stored_in_blocks(spark, tmp_path, monkeypatch):
    """Rows of different minutes share a block; blocks that are split and filled out of order give the batch results."""
    from functools import partial

    minutes = list(range(0, 200, 2))
    frames = [alerts_at(minutes[::-1]), alerts_at([m + 1 for m in range(196, 240, 3)])]
    checkpoint = str(tmp_path / "ck")
    stream = jobs.suppressed(read_alerts(spark, write_files(frames[:1], tmp_path / "one")), delay="100 minutes")
    jobs.to_table(stream, str(tmp_path / "out"), checkpoint).awaitTermination()
    assert state_rows(spark, checkpoint, "buckets") == 1

    monkeypatch.setattr(jobs, "Suppression", partial(jobs.Suppression, block_rows=3))
    rows = read_alerts(spark, write_files(frames, tmp_path / "two"))
    out = run(spark, tmp_path, "split", partial(jobs.suppressed, delay="50 minutes"), rows, "created_at")
    batch = spark.createDataFrame([(*r[:-1], r[-1].to_pydatetime()) for f in frames for r in f.itertuples(index=False)], ALERTS)
    assert jobs.late_rows(out).isEmpty()
    assert {r.id for r in out.collect()} == {r.id for r in suppress_alerts(batch).collect()}
