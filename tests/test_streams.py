"""Versioned tables and streams: several writers, restarts, compaction, fan-out, frames and timers."""

import datetime
import pathlib
import threading

import pytest
from pyspark.sql import functions as F

from trackweave.operators import queue
from trackweave.sources import storage, versions
from trackweave.streaming import batches, status, transitions

AT = datetime.datetime(2024, 1, 1)
EVENTS = "key long, ts timestamp_ntz, seq long, status string"


def _event(key, minute, seq, state):
    return key, AT + datetime.timedelta(minutes=minute), seq, state


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


def _feed(spark, folder, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).parquet(f"{folder}/in")


def test_a_file_is_created_once(spark, folder, monkeypatch):
    assert versions.create_once(spark, f"{folder}/a", "first") and not versions.create_once(spark, f"{folder}/a", "second")
    assert versions.read_text(spark, f"{folder}/a") == "first"

    def no_link(*_):
        raise FileExistsError

    monkeypatch.setattr(versions.os, "link", no_link)
    assert not versions.create_once(spark, f"{folder}/b", "lost")
    assert versions.names_in(spark, folder) == ["a"] and versions.names_in(spark, f"{folder}/none") == []


def test_versions_append_compact_and_vacuum(spark, folder):
    schema = spark.createDataFrame([], "id long, v string").schema
    table = versions.VersionedTable(spark, folder, schema)
    assert table.read().count() == 0 and table.compact().number == -1
    for k in range(3):
        table.append(lambda rows, facts, k=k: (spark.createDataFrame([(k, "x")], schema), lambda new: {"n": facts.get("n", 0) + new.count()}))
    reader = table.read()
    assert table.compact().number == 3 and len(table.current().folders) == 1 and table.current().facts == {"n": 3}
    assert sorted(r.id for r in reader.collect()) == sorted(r.id for r in table.read().collect()) == [0, 1, 2]
    assert table.vacuum(keep=2) == [] and len(table.vacuum(keep=1)) == 3
    assert table.read().count() == 3 and table.current().number == 3


def test_two_writers_make_gapless_ids_and_no_url_twice(spark, folder):
    table = storage.downloads_table(spark, folder)
    requests = [spark.createDataFrame([(f"u{(k * step) % 30}", k) for k in range(20)], "url string, idx long").withColumn("title", F.lit(f"w{step}")) for step in (1, 7, 11)]
    errors = []

    def write(rows):
        try:
            queue.append_new(table, rows)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(r,)) for r in requests]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = table.read().collect()
    assert not errors
    assert sorted(r.id for r in got) == list(range(1, len(got) + 1))
    wanted = {f"u{(k * step) % 30}" for k in range(20) for step in (1, 7, 11)}
    assert sorted(r.url for r in got) == sorted(wanted) and {r.status for r in got} == {"queued"}
    assert table.current().facts == {"last_id": len(got)} and queue.append_new(table, requests[0]) == 0


def test_snapshot_and_deltas_over_batches(spark, folder, monkeypatch):
    snapshot = spark.createDataFrame([_event(1, 5, 1, "queued"), _event(2, 5, 2, "queued"), _event(9, 0, 0, None)], EVENTS)
    steps = [[_event(1, 6, 3, "downloading"), _event(1, 7, 4, "completed")], [_event(2, 1, 0, "late"), _event(3, 1, 5, "new")], [_event(3, 1, 6, "newer")], [_event(1, 6, 9, "late")]]
    seen = []
    for k, rows in enumerate(steps):
        seen += rows
        stream = _feed(spark, folder, rows)
        got = status.follow_snapshot(snapshot, stream, spark, folder, compact_every=2)
        want = status.with_snapshot(snapshot, spark.createDataFrame(seen, EVENTS))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), k
    assert len(versions.VersionedTable(spark, f"{folder}/table", snapshot.schema).current().folders) <= 2


def test_an_empty_source_leaves_the_snapshot(spark, folder):
    pathlib.Path(folder.removeprefix("file://"), "in").mkdir()
    stream = spark.readStream.schema(EVENTS).parquet(f"{folder}/in")
    snapshot = spark.createDataFrame([_event(1, 5, 1, "queued")], EVENTS)
    assert status.follow_snapshot(snapshot, stream, spark, f"{folder}/a").count() == 1
    assert status.run(status.latest(stream), spark, f"{folder}/b").collect() == []


def test_a_column_named_batch_stays(spark, folder):
    schema = EVENTS + ", batch long"
    stream = _feed(spark, folder, [(*_event(1, 1, 1, "queued"), 77)], schema)
    assert [r.batch for r in status.run(status.latest(stream), spark, folder).collect()] == [77]


@pytest.mark.parametrize("when", ["before the write", "after the write", "after the commit"])
def test_a_stopped_batch_is_neither_lost_nor_doubled(spark, folder, when):
    table = batches.BatchTable(spark, f"{folder}/table", spark.createDataFrame([], EVENTS).schema)
    calls = []

    def failing(rows, number):
        calls.append(number)
        if number == 1 and calls.count(1) == 1:
            if when == "after the write":
                table.table.write_folder(rows.withColumn(batches.BATCH, F.lit(1).cast("long")))
            if when == "after the commit":
                table.store(rows, number)
            raise RuntimeError("stopped")
        table.store(rows, number)

    rows = [_event(k, k, k, "queued") for k in range(6)]
    for start in range(0, 6, 2):
        stream = _feed(spark, folder, rows[start : start + 2])
        if start == 2:
            with pytest.raises(Exception, match="stopped"):
                batches.drain(stream, f"{folder}/state", failing)
        else:
            batches.drain(stream, f"{folder}/state", failing)
    assert sorted(map(tuple, table.rows().collect())) == rows and calls[:3] == [0, 1, 1]


def test_fan_out_drops_a_failing_sink_and_goes_on(spark, folder):
    got = {"good": [], "bad": [], "once": []}

    def sink(name, fails=()):
        def take(rows, number):
            if number in fails:
                raise OSError("closed")
            got[name] += [(number, r.seq) for r in rows.collect()]

        return take

    sinks = {"good": sink("good"), "bad": sink("bad", {1}), "once": sink("once")}
    fan = batches.FanOut(spark, f"{folder}/ledger", sinks)
    for k in range(3):
        batches.drain(_feed(spark, folder, [_event(1, k, k, "queued")]), f"{folder}/state", fan.store)
    assert got["good"] == got["once"] == [(0, 0), (1, 1), (2, 2)] and got["bad"] == [(0, 0)]
    assert fan.dropped() == {"bad"} and fan.has("good") == {0, 1, 2} and fan.has("bad") == {0}
    again = spark.createDataFrame([_event(1, 9, 9, "queued")], EVENTS)
    fan.store(again, 2)  # a repeated batch
    assert got["good"][-1] == (2, 2)
    fan.readmit("bad")
    fan.store(again, 2)
    assert got["bad"] == [(0, 0), (2, 9)] and fan.dropped() == set()


def test_frames_are_routed_and_malformed_ones_kept(spark, folder):
    rows = spark.createDataFrame([(1, "queued", 0.5, None), (2, "failed", 1.0, "t")], "id long, status string, progress double, updated_at string")
    values = [r.value for r in status.to_frames(rows, F.lit("download_update")).collect()]
    values += [values[0][:-1], "", "not json", "[1]", "3", '{"data": {"id": 5}}', '{"type": "pong"}', '{"type": "metadata_progress", "data": {"id": 7}}', '{"type": null}']
    for part in (values[:5], values[5:]):
        stream = _feed(spark, folder, [(v,) for v in part], "value string")
        found = status.route_stream(stream, spark, folder, ["download_update", "metadata_progress", "nothing"])
    assert sorted(map(tuple, found["download_update"].collect())) == [(1, "queued", 0.5, None), (2, "failed", 1.0, "t")]
    assert [r.id for r in found["metadata_progress"].collect()] == [7] and found["nothing"].count() == 0
    assert sorted(r.value for r in found["malformed"].collect()) == sorted([values[0][:-1], "", "not json", "[1]", "3"])


def _followed(spark, folder, steps, **more):
    rows = []
    for step in steps:
        stream = _feed(spark, folder, step, EVENTS + ", limited boolean")
        out = batches.BatchTable(spark, f"{folder}/out", transitions.follow(stream, **more).schema)
        batches.drain(transitions.follow(stream, **more), f"{folder}/state", out.store, mode="append")
    return sorted((r.kind, r.key, r.ts, r.seq, r.was, r.status) for r in out.rows().collect())


def test_invalid_changes_across_batches_and_restarts(spark, folder):
    states = ["queued", "downloading", "queued", "completed", "queued", "queued", "odd", "failed", None, "queued", "completed", "failed"]
    events = [_event(k % 2, k, k, s) for k, s in enumerate(states * 3)]
    got = _followed(spark, folder, [[(*e, False) for e in part] for part in (events[:7], events[7:8], events[8:30], events[30:])])
    want = queue.invalid_transitions(spark.createDataFrame(events, EVENTS)).collect()
    assert [(k, s, w, t) for _, k, _, s, w, t in got] == sorted((r.key, r.seq, r.was, r.status) for r in want) and len(got) > 5


def test_timers_requeue_after_a_rate_limit(spark, folder):
    limited = lambda key, minute, seq: (*_event(key, minute, seq, "failed"), True)
    plain = lambda key, minute, seq, state: (*_event(key, minute, seq, state), False)
    steps = [
        [plain(1, 0, 1, "downloading"), limited(1, 1, 2), limited(2, 1, 3), plain(3, 1, 4, "failed")],
        [plain(2, 1.5, 5, "queued"), plain(9, 30, 6, "queued")],  # 2 goes on by itself; the watermark passes the timer of 1
        [plain(9, 60, 7, "queued")],
        [plain(1, 61, 8, "downloading"), limited(1, 62, 9), plain(9, 90, 10, "queued")],  # the second attempt in a row
        [plain(9, 120, 11, "queued")],
    ]
    got = _followed(spark, folder, steps, lateness="1 minute")
    at = lambda minute: AT + datetime.timedelta(minutes=minute)
    assert [(k, key, ts) for k, key, ts, *_ in got] == [("requeued", 1, at(2)), ("requeued", 1, at(64))]


def test_events_without_a_time_or_number_come_last_in_their_batch(spark, folder):
    rows = [(1, None, 1, "queued", False), (*_event(1, 5, None, "completed"), False), (*_event(1, 5, 2, "processing"), False), (2, None, None, "failed", None)]
    want = [(1, 1, "completed", "queued"), (2, 5, "failed", "completed")]
    got = _followed(spark, folder, [rows, [(*_event(2, 9, 5, "completed"), False)]])
    assert sorted((k, s, w, t) for _, k, _, s, w, t in got) == want
