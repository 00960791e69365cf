"""Scans with borders against plain loops."""

import datetime
import random

import pytest

from trackweave.operators import queue, scans

@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small tables would otherwise be put together into one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


AT = datetime.datetime(2024, 1, 1)


def _rows(n, keys, seed):
    chance = random.Random(seed)
    return [(chance.choice(keys), chance.randrange(n), i, chance.choice(["queued", "downloading", "failed", None])) for i in range(n)]


@pytest.mark.parametrize("keys", [[1], [1, 2, None], list(range(40)) + [7] * 60], ids=["one key", "null key", "hot key"])
def test_previous_row_of_each_key(spark, keys):
    rows = _rows(300, keys, 1)
    frame = spark.createDataFrame(rows, "k long, ts long, seq long, status string").repartition(5)
    got = {r.seq: (r.was, r.was_seq) for r in scans.with_previous(frame, "k", ["ts", "seq"], {"status": "was", "seq": "was_seq"}).collect()}
    last, want = {}, {}
    for k, _, seq, status in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        want[seq] = last.get(k, (None, None))
        last[k] = status, seq
    assert got == want


def test_a_hot_key_is_in_all_tasks_and_no_window_has_its_name(spark):
    frame = spark.createDataFrame(_rows(2000, [1], 2), "k long, ts long, seq long, status string").repartition(4)
    found = scans.with_previous(frame, "k", ["ts", "seq"], {"status": "was"})
    assert "hashpartitioning(k" not in found._jdf.queryExecution().executedPlan().toString()
    scanned = scans._scanned(frame, ["k", "ts", "seq"])
    assert scanned.select("__part").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("keys", [None, [1, 2, None], list(range(30)) + [7] * 50], ids=["all", "three", "hot"])
@pytest.mark.parametrize("interval", [0, 3, 1000])
def test_starts_are_apart(spark, keys, interval):
    rows = _rows(400, keys or [1], 3)
    frame = spark.createDataFrame(rows, "k long, ts long, seq long, status string").repartition(5)
    from pyspark.sql import functions as F

    got = {r.seq: r.start for r in scans.throttled(frame, F.col("ts"), interval, ["ts", "seq"], key="k" if keys else None).collect()}
    before, want = {}, {}
    for k, ts, seq, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        k = k if keys else 0
        want[seq] = before[k] = max(ts, before[k] + interval) if k in before else ts
    assert got == want


def test_scans_of_nothing(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], "k long, ts long, seq long, status string")
    assert scans.with_previous(none, "k", ["ts"], {"status": "was"}).collect() == []
    assert scans.throttled(none, F.col("ts"), 5, ["ts"]).collect() == []
    with pytest.raises(ValueError, match="arrival"):
        scans.throttled(spark.createDataFrame([(1, None)], "k long, ts long"), F.col("ts"), 5, ["k"])


def test_invalid_transitions_follow_ts_and_seq(spark):
    rows = [(1, AT, 2, "completed", 1), (1, AT, 1, "downloading", 2), (1, AT, 3, "queued", 3), (2, AT, 4, "queued", 4), (2, AT, 5, "queued", 5), (2, AT, 6, None, 6), (2, AT, 7, "odd", 7), (2, AT, 8, "queued", 8)]
    frame = spark.createDataFrame(rows, "key long, ts timestamp_ntz, seq long, status string, was long")
    got = queue.invalid_transitions(frame.drop("was")).collect()
    assert sorted((r.seq, r.was, r.status) for r in got) == [(3, "completed", "queued")]
