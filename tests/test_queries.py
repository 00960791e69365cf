"""Every registered query against its SQL twin on the smallest fixture."""

import datetime
import math

import duckdb
import pytest

from trackweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v.isoformat() if isinstance(v, datetime.datetime) else v


PAIRS = {name: (query, registry.oracle_sql()[name]) for name, query in registry.queries().items()} | registry.cases()


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_query_equals_sql(spark, oracle, name):
    query, sql = PAIRS[name]
    df = query(spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cursor = oracle.execute(sql)
    at = [d[0] for d in cursor.description]
    assert sorted(at) == names
    want = sorted((tuple(plain(r[at.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_queries_read_tables(spark):
    """None runs on literal rows alone."""
    assert not set(registry.queries()) & set(registry.cases()) and set(registry.queries()) == set(registry.oracle_sql())


def test_release_histogram_counts(spark):
    rows = {r["release_type"]: r["n"] for r in registry.queries()["release_histogram"](spark, SF).collect()}
    assert rows == {"album": 77, "ep": 470, "single": 953}


def test_job_snapshot_takes_all_items(spark):
    from trackweave.plans import enrichment

    rows = sorted((r for r in registry.queries()["job_snapshot_whole"](spark, SF).collect()), key=lambda r: (r["processing_job_id"], r["begin"]))
    assert {r["processing_job_id"] for r in rows} == {"j1", "j2"}
    assert sum(len(r["ids"].split(",")) for r in rows) == spark.read.parquet(f"{SF}/orders.parquet").count()
    items = spark.createDataFrame([("a", k * 3) for k in range(50)] + [("b", 7), (None, 1)], "processing_job_id string, id long")
    parts = enrichment.job_snapshot_parts(items, 10).collect()
    assert max(len(r["metadata_results"]) for r in parts) <= 10
    for job, want in (("a", [k * 3 for k in range(50)]), ("b", [7]), (None, [1])):
        own = sorted((r for r in parts if r["processing_job_id"] == job), key=lambda r: r["part"])
        assert [x["id"] for r in own for x in r["metadata_results"]] == want
        assert [r["begin"] for r in own] == [0, *[r["end"] for r in own][:-1]] and own[-1]["end"] == len(want)


def test_entries_nested_takes_all_orders(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert registry.queries()["entries_nested_whole"](spark, SF).count() == lines.select("l_orderkey").distinct().count()


def test_ids_follow_the_order(spark):
    from trackweave.sources.storage import with_ids

    rows = spark.createDataFrame([((k * 7919) % 1000,) for k in range(1000)], "v long").repartition(7)
    got = {r["v"]: r["id"] for r in with_ids(rows, "v", start=5).collect()}
    assert got == {v: v + 5 for v in range(1000)}
    assert with_ids(rows.limit(0), "v").count() == 0


def test_stream_keeps_the_last_row_of_each_key(spark, tmp_path):
    from trackweave.streaming import status

    schema = "key long, ts timestamp_ntz, seq long, status string"
    at = datetime.datetime(2024, 1, 1)
    batches = [[(1, at, 1, "queued"), (2, at, 2, "queued")], [(1, at, 3, "downloading"), (3, at, 4, "queued")], [(1, at, 0, "failed")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{k}")
    for name, every in (("now", None), ("polled", "1 second")):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        got = status.run(status.latest(stream), spark, f"file://{tmp_path}/{name}", every).collect()
        assert {r["key"]: (r["seq"], r["status"]) for r in got} == {1: (3, "downloading"), 2: (2, "queued"), 3: (4, "queued")}


def test_state_changes_leave_other_rows_alone(spark):
    from pyspark.sql import functions as F

    from trackweave.operators import queue

    old, now = datetime.datetime(2020, 1, 1), datetime.datetime(2025, 1, 1)
    rows = spark.createDataFrame([(1, "queued", 3.0, None, old), (2, "failed", 4.0, "x", old), (3, None, 5.0, None, None)],
                                 "id long, status string, progress double, error_message string, updated_at timestamp_ntz")
    got = {r["id"]: tuple(r)[1:] for r in queue.retry(rows, F.lit(True), F.lit(now).cast("timestamp_ntz")).collect()}
    assert got == {1: ("queued", 3.0, None, old), 2: ("queued", 0.0, None, now), 3: (None, 5.0, None, None)}
    later = {r["id"]: r["updated_at"] for r in queue.cancel(rows, F.lit(True)).collect()}
    assert later[1] > now and later[2] == old and later[3] is None


def test_entries_are_numbered_within_each_record(spark):
    from trackweave.plans import enrichment
    from trackweave.schemas import CHANNEL

    entry = CHANNEL["entries"].dataType.elementType.names
    titles = ["a", "Live at b", None, "c"]
    rows = [(None, "U", None, None, None, [None] + [tuple({"id": str(k), "title": t}.get(f) for f in entry) for k, t in enumerate(titles)]), (None, None, None, "x", None, None), (None, None, None, "y", None, [])]
    got = enrichment.flat_entries(spark.createDataFrame(rows, CHANNEL), live=False).collect()
    assert [(r["pos"], r["nth"], r["of"], r["title"]) for r in got] == [(1, 1, 3, "a"), (3, 2, 3, "Unknown Playlist"), (4, 3, 3, "c")]
