"""One function for each route of a download service's interface, from relations to relations.

What a route answers with "not found" is an empty DataFrame here; what it refuses raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import formats as M
from ..operators import listing as L
from ..operators import queue as Q
from ..settings import Settings
from ..sources.storage import with_ids
from . import enrichment as E

DEFAULTS = Settings()


def list_downloads(downloads: DataFrame, status: str | None = None, search: str | None = None, limit: int = DEFAULTS.downloads_page, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, envelope) of the downloads, newest first."""
    found = L.find(downloads, status, search)
    return L.wire_download(L.page(L.newest_first(found), limit, offset, DEFAULTS.downloads_page_most)), L.envelope(found, limit, offset, DEFAULTS.downloads_page_most)


def download_stats(downloads: DataFrame) -> DataFrame:
    return L.status_stats(downloads)


def get_download(downloads: DataFrame, key: int) -> DataFrame:
    return L.wire_download(L.lookup(downloads, key))


def create_downloads(requests: DataFrame, downloads: DataFrame, info: DataFrame, format_id: str = M.AUTO_FORMAT) -> DataFrame:
    """Rows to append for requests (url, idx): valid urls without an active download, described by their info records."""
    wanted = Q.enqueue_new(requests.withColumn("url", S.strip(F.col("url"))).where(S.is_accepted_url(F.col("url"))), downloads)
    about = E.normalise_info(info)
    return wanted.join(about, "url", "left").select(
        "idx", "url", "title", "artist", "album", F.coalesce("download_type", F.lit("song")).alias("download_type"), F.lit("queued").alias("status"),
        F.lit(0.0).alias("progress"), "total_tracks", F.lit(0).cast("long").alias("done_tracks"), F.lit(format_id).alias("format_id"))


def existing_downloads(requests: DataFrame, downloads: DataFrame) -> DataFrame:
    """The newest active download of each requested url."""
    active = downloads.where(F.col("status").isin(P.ACTIVE_FOR_DEDUPE)).join(requests.select("url").distinct(), "url", "left_semi")
    return L.wire_download(L.latest_per(active, "url"))


def cancel_download(downloads: DataFrame, key: int, now: Column | None = None) -> DataFrame:
    return Q.cancel(downloads, F.col("id") == key, now)


def retry_download(downloads: DataFrame, key: int, now: Column | None = None) -> DataFrame:
    return Q.retry(downloads, F.col("id") == key, now)


def retry_all(downloads: DataFrame, now: Column | None = None) -> DataFrame:
    return Q.retry(downloads, F.col("status") == "failed", now)


def delete_downloads(downloads: DataFrame, status: str) -> DataFrame:
    return Q.bulk_delete(downloads, status)


def active_downloads(downloads: DataFrame) -> DataFrame:
    return L.wire_download(L.oldest_first(downloads.where(F.col("status").isin(P.ACTIVE_IN_LIST))))


def format_options(formats: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Options of each record; of ``records`` without any format, the fixed ones."""
    own = M.format_options(formats)
    if records is None:
        return own
    bare = M.fallback_options(records.join(formats.select("record").distinct(), "record", "left_anti"))
    return own.unionByName(bare.withColumn("rank", F.col("rank").cast("long")), allowMissingColumns=True)


def channel_playlists(channels: DataFrame, full: DataFrame) -> DataFrame:
    return E.channel_releases(channels, E.full_metadata(full))


def queue_channel(playlists: DataFrame, downloads: DataFrame, batch: str, format_id: str = M.AUTO_FORMAT) -> DataFrame:
    """Outcomes (batch, idx, url, outcome, format_id) of queueing playlists (pos, url)."""
    cand = playlists.select("url", F.col("pos").cast("long").alias("idx"))
    new = Q.enqueue_new(cand, downloads).withColumn("outcome", F.lit("queued"))
    skipped = Q.enqueue_skipped(cand, downloads).withColumn("outcome", F.lit("skipped"))
    return new.unionByName(skipped).withColumns({"batch": F.lit(batch), "format_id": F.lit(format_id)})


def queue_selected_items(items: DataFrame, downloads: DataFrame, job: str, batch: str, format_id: str = M.AUTO_FORMAT) -> DataFrame:
    """Outcomes (batch, id, url, outcome, format_id) of queueing a job's selected items, in the order of their ids."""
    chosen = Q.queue_selected(items, job).select("url", F.col("id").alias("pos"))
    return queue_channel(chosen, downloads, batch, format_id).withColumnRenamed("idx", "id")


def _of_batch(outcomes: DataFrame, batch: str) -> DataFrame:
    own = outcomes.where(F.col("batch") == batch)
    return own.withColumnRenamed("idx", "id") if "id" not in own.columns else own


def batch_status(outcomes: DataFrame, batch: str) -> DataFrame:
    """Counts and progress of a batch of any size, on a row for each download that it queued: ``nth`` and ``download_id``, both null where
    it queued none. What it says of the format stays inside."""
    own = _of_batch(outcomes, batch)
    told = Q.batch_summary(own).drop("format_id")
    ids = with_ids(own.where("outcome = 'queued'").select(F.col("id").alias("download_id")), "download_id").withColumnRenamed("id", "nth")
    rows = ids.crossJoin(F.broadcast(told)).select(*told.columns, "nth", "download_id")  # one row of counts
    return rows.unionByName(told.where("queued = 0"), allowMissingColumns=True)


def batch_label(outcomes: DataFrame, batch: str) -> DataFrame:
    """Counts and progress of a batch of any size on one row, with the first ids as text."""
    own = _of_batch(outcomes, batch)
    ids = Q.first_batch_ids(own).withColumnRenamed("ids", "download_ids")
    return Q.batch_summary(own).drop("format_id").join(ids, "batch", "left")


def process_channel(channels: DataFrame, full: DataFrame, job: str) -> DataFrame:
    return E.processed_items(channels, E.full_metadata(full), job)


def get_job(jobs: DataFrame, job: str) -> DataFrame:
    return L.wire_job(L.lookup(jobs, job))


def list_jobs(jobs: DataFrame, limit: int = DEFAULTS.jobs_page, offset: int = 0) -> DataFrame:
    return L.wire_job(L.page(L.newest_first(jobs), limit, offset, DEFAULTS.jobs_page_most))


def job_items(items: DataFrame, job: str, limit: int = DEFAULTS.items_page, offset: int = 0) -> DataFrame:
    return L.wire_item(L.page(L.oldest_first(items.where(F.col("processing_job_id") == job)), limit, offset, DEFAULTS.items_page_most))


def cancel_job(jobs: DataFrame, job: str, now: Column | None = None) -> DataFrame:
    return Q.cancel_job(jobs, F.col("id") == job, now)


def select_items(items: DataFrame, ids: DataFrame, selected: bool = True) -> tuple[DataFrame, DataFrame]:
    """(items, updated_count)"""
    return Q.select_items(items, ids, selected), Q.updated_count(items, ids)


def queue_selected(items: DataFrame, job: str) -> DataFrame:
    return L.queue_playlist(Q.queue_selected(items, job))


def initial_snapshot(downloads: DataFrame, size: int = DEFAULTS.downloads_page) -> tuple[DataFrame, DataFrame]:
    """What a new listener gets: the newest rows, and how many there are."""
    return L.wire_download(L.page(L.newest_first(downloads), size)), L.envelope(downloads, size)


def is_done(status: Column) -> Column:
    return status.isin("completed", "failed", "cancelled")
