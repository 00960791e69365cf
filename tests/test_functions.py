"""Column functions on literal rows, with results read from the rules."""

import pytest
from pyspark.sql import functions as F

from trackweave.functions import classify as C
from trackweave.functions import predicates as P
from trackweave.functions import scalars as S
from trackweave.operators import listing as L
from trackweave.operators import queue as Q
from trackweave.settings import Settings
from trackweave.sources import storage


def one(spark, expression, *values):
    names = "abcdefgh"[: len(values)]
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", type(None): "string"}
    schema = ", ".join(f"{n} {kinds[type(v)]}" for n, v in zip(names, values, strict=True))
    return spark.createDataFrame([tuple(values)], schema).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [
    (None, "Unknown Artist"), ("", "Unknown Artist"), ("  ", "Unknown Artist"), ("Artist A, Artist B feat. Artist C", "Artist A"), ("Artist A feat. Artist B", "Artist A"),
    ("Artist A & Artist B", "Artist A"), ("A (ft. B)", "A"), ("AC/DC", "ACDC"), ("Daft Punk", "Da"), ("Left Boy", "Le"), ("x ft.B", "x ft.B"), ("Name...", "Name"), ("???", "Unknown Artist"),
    ("a\u00a0b", "a b")])
def test_artist_folder(spark, raw, want):
    assert one(spark, S.artist_folder(F.col("a")), raw) == want


def test_word_boundary_ignores_accents(spark):
    assert one(spark, C.is_live(F.col("a")), "Olive") is False
    assert one(spark, C.is_live(F.col("a")), "Great Club") is True


def test_null_title_is_no_live_album(spark):
    assert one(spark, F.coalesce(C.is_live(F.col("a")), F.lit(False)), None) is False


@pytest.mark.parametrize(("bytes_", "want"), [(0, None), (1048576, 1.0), (1572864, 1.5)])
def test_megabytes(spark, bytes_, want):
    assert one(spark, S.megabytes(F.col("a")), bytes_) == want


def test_iso_keeps_microseconds(spark):
    row = spark.sql("select timestamp_ntz'2024-01-02 03:04:05' as a, timestamp_ntz'2024-01-02 03:04:05.000120' as b, cast(null as timestamp_ntz) as c")
    assert row.select(S.iso(F.col("a")), S.iso(F.col("b")), S.iso(F.col("c"))).first()[:] == ("2024-01-02T03:04:05", "2024-01-02T03:04:05.000120", None)


def test_pages_are_checked(spark):
    rows = spark.createDataFrame([(1, "a")], "id long, status string")
    for bad in ((-1, 0), (1001, 0), (1, -1)):
        with pytest.raises(ValueError):
            L.page(rows, *bad)
    with pytest.raises(ValueError):
        Q.bulk_delete(rows, "queued")


def test_empty_list(spark):
    rows = spark.createDataFrame([], "id long, status string")
    assert L.envelope(rows, 10).first().asDict() == {"total": 0, "page_rows": 0, "limit": 10, "offset": 0, "has_more": False}
    assert L.client_page(rows, 3, 25).first().asDict() == {"n": 0, "pages": 1, "page": 1, "from": 0, "to": 0}


def test_search_blank_means_all(spark):
    rows = spark.createDataFrame([("x",), (None,)], "title string")
    assert rows.where(P.contains_text("  ", F.col("title"))).count() == 2
    assert rows.where(P.contains_text("X", F.col("title"))).count() == 1


def test_batch_queues_each_url_once(spark):
    down = spark.createDataFrame([("u1", "completed"), ("u2", "failed")], "url string, status string")
    cand = spark.createDataFrame([("u1", 0), ("u2", 1), ("u3", 2), ("u3", 3)], "url string, idx long")
    assert sorted(r["idx"] for r in Q.enqueue_new(cand, down).collect()) == [1, 2]
    assert sorted(r["idx"] for r in Q.enqueue_skipped(cand, down).collect()) == [0, 3]


def test_ids_follow_the_order(spark):
    rows = storage.with_ids(spark.createDataFrame([("c",), ("a",), ("b",)], "name string"), "name")
    assert {r["name"]: r["id"] for r in rows.collect()} == {"a": 1, "b": 2, "c": 3}


def test_settings_from_environment(monkeypatch):
    monkeypatch.setenv("TRACKWEAVE_DOWNLOADS_PAGE", "7")
    assert Settings.from_env().downloads_page == 7 and Settings.from_env().mp3_quality == "320k"


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_last_page_of_a_list_of_any_length(spark):
    """The query shows the last page, as its SQL twin does, also of more than 9,999 pages."""
    from unittest import mock

    from trackweave.plans import list_queries

    rows = spark.range(250_030).select("id", F.lit("failed").alias("status"))
    with mock.patch.object(list_queries.X, "downloads", lambda s, d: rows):
        got = list_queries.QUERIES["client_page"][0](spark, "").first().asDict()
    assert got == {"n": 250_030, "pages": 10_002, "page": 10_002, "from": 250_026, "to": 250_030}


def test_batch_status_lists_all_that_was_queued(spark):
    from trackweave.plans import api

    rows = [("b", k, "queued" if k % 3 else "skipped") for k in range(40, 0, -1)] + [("c", 1, "skipped"), ("d", 1, "queued")]
    outcomes = spark.createDataFrame(rows, "batch string, idx long, outcome string")
    got = sorted(api.batch_status(outcomes, "b").collect(), key=lambda r: r["nth"])
    assert [(r["nth"], r["download_id"]) for r in got] == list(enumerate([k for k in range(1, 41) if k % 3], 1))
    assert {(r["batch"], r["total"], r["queued"], r["skipped"], r["failed"], r["progress"]) for r in got} == {("b", 40, 27, 13, 0, 100.0)}
    assert [tuple(r) for r in api.batch_status(outcomes, "c").collect()] == [("c", 1, 0, 1, 0, 100.0, None, None)]
    assert api.batch_status(outcomes, "none").count() == 0
