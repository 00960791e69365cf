"""Layout by key, cursor pages, and cases of the state changes."""

import datetime
import types

import pytest
from pyspark.sql import functions as F

from trackweave.operators import listing, queue
from trackweave.plans import enrichment
from trackweave.sources import storage

SF = "/root/testdata/sf0.001"


def _files_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numFiles").get().value() for i in range(leaves.length()))


def test_a_lookup_reads_one_file(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    for key, path in (("o_orderkey", f"file://{tmp_path}/k"), ("o_orderpriority", f"file://{tmp_path}/p")):
        storage.write_by_key(orders.repartition(6), path, key, 16)
        some = orders.select(key).distinct().limit(5).collect()
        for (value,) in some:
            found = storage.read_by_key(spark, path, orders.schema, key, value, 16)
            assert _files_read(found) == 1
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, orders.where(F.col(key) == value).collect()))
    assert _files_read(spark.read.parquet(f"file://{tmp_path}/k")) == 16
    assert storage.read_by_key(spark, f"file://{tmp_path}/k", orders.schema, "o_orderkey", None, 16).count() == 0


def test_pages_behind_a_cursor_give_each_old_row_once(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(k, at + datetime.timedelta(hours=k % 5) if k % 7 else None) for k in range(40)]
    frame = lambda r: spark.createDataFrame(r, "id long, created_at timestamp_ntz")
    seen, last, table = [], None, frame(rows)
    for k in range(20):
        page = listing.page_after(table, last, 7)
        got = [r.id for r in page.collect()]
        if not got:
            break
        seen += got
        last = listing.cursor(page)
        table = table.unionByName(frame([(1000 + k, at + datetime.timedelta(days=1 + k))]))
    assert seen == [r.id for r in listing.newest_first(frame(rows)).collect()]
    assert listing.cursor(page) is None
    plan = listing.page_after(spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")), (at, 5), 10)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" in plan.split("PushedFilters:")[1] and "TakeOrderedAndProject" in plan
    with pytest.raises(ValueError):
        listing.page_after(table, None, -1)


def test_the_last_of_repeated_results_and_changes_counts(spark):
    rows = spark.createDataFrame([(1, "a", "b", "c", "queued", 0.0, None, None)], "id long, title string, artist string, album string, status string, progress double, done_tracks long, total_tracks long")
    results = spark.createDataFrame([(1, "old", None, None, 1, 9, 1), (1, "new", None, None, 2, 9, 2), (5, "else", None, None, 1, 1, 1)], "id long, title string, artist string, album string, done_tracks long, total_tracks long, seq long")
    got = queue.complete(rows, results).collect()
    assert [(r.title, r.artist, r.done_tracks, r.status) for r in got] == [("new", "b", 2, "completed")]
    at = datetime.datetime(2024, 1, 1)
    snapshot = spark.createDataFrame([(1, "x", at), (2, "y", at)], "id long, v string, updated_at timestamp_ntz")
    changes = spark.createDataFrame([(1, "zz", at), (1, "b", at + datetime.timedelta(1)), (3, "new", None), (3, "newer", at)], "id long, v string, updated_at timestamp_ntz")
    assert sorted((r.id, r.v) for r in queue.upsert(snapshot, changes).collect()) == [(1, "b"), (2, "y"), (3, "newer")]


def test_a_column_named_part_stays(spark):
    items = spark.createDataFrame([("a", 3, "z"), ("a", 30, "y")], "processing_job_id string, id long, part string")
    got = enrichment.job_snapshot_parts(items, 10).collect()
    assert sorted((r.part, [x["part"] for x in r.metadata_results]) for r in got) == [(0, ["z"]), (3, ["y"])]


def test_a_cluster_without_a_shared_folder_is_refused():
    conf = types.SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_folder(types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="spark://host:7077")))


def test_counts_of_unknown_states(spark):
    rows = spark.createDataFrame([("queued",), (None,), ("odd",), ("queued",), ("failed",)], "status string")
    assert queue.depth(rows).first().depth == 2
    assert tuple(listing.client_histogram(rows).first()) == (2, 0, 0, 1, 5)
    assert queue.depth(rows.limit(0)).first().depth == 0


def test_records_are_written_compressed_and_read_back(spark, tmp_path):
    from trackweave.schemas import CHANNEL
    from trackweave.sources import fixtures
    from trackweave.sources.storage import read_records, write_records

    records, path = fixtures.channel_records(spark, "/root/testdata/sf0.001"), f"file://{tmp_path}/records"
    write_records(records, path)
    assert all(f.endswith(".json.gz") for f in read_records(spark, path, CHANNEL).inputFiles())
    back = read_records(spark, path, CHANNEL)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, records.select(*CHANNEL.names).collect()))


def test_channel_records_shuffle_no_texts(spark):
    """Only columns of lines are shuffled: texts are made of them when they are in their order's list."""
    from trackweave.sources import fixtures

    plan = fixtures.channel_records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Aggregate":
        plan = plan.children().apply(0)
    assert "playlist" not in plan.children().apply(0).schema().simpleString()
