"""Queueing and state changes as transforms from one relation to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..sources.storage import with_ids
from ..sources.versions import VersionedTable
from .scans import with_previous

#: Which state may follow which.
TRANSITIONS = {
    "queued": ["downloading", "cancelled"], "downloading": ["processing", "completed", "failed", "queued", "cancelled"],
    "processing": ["completed", "failed"], "failed": ["queued"], "cancelled": ["queued"], "completed": []}


def _first_of_batch(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("url").agg(F.min("idx").alias("idx"))


def enqueue_new(candidates: DataFrame, downloads: DataFrame) -> DataFrame:
    """Candidates (url, idx) to queue: the first of each url that no active download has."""
    active = downloads.where(F.col("status").isin(P.ACTIVE_FOR_DEDUPE)).select("url")
    first = _first_of_batch(candidates).join(active, "url", "left_anti")
    return candidates.join(first, ["url", "idx"], "left_semi")


def enqueue_skipped(candidates: DataFrame, downloads: DataFrame) -> DataFrame:
    """All other candidates: with an active download, or later in the batch."""
    active = downloads.where(F.col("status").isin(P.ACTIVE_FOR_DEDUPE)).select("url").distinct().withColumn("active", F.lit(True))
    tagged = candidates.join(_first_of_batch(candidates).withColumnRenamed("idx", "first"), "url").join(active, "url", "left")
    return tagged.where(F.coalesce("active", F.lit(False)) | (F.col("idx") > F.col("first"))).select(*candidates.columns)


def append_new(table: VersionedTable, requests: DataFrame) -> int:
    """Queue requests (url, idx, title) in a table that others write to as well; how many were new.

    Ids follow the last committed one, in the order of ``idx``; where another writer was first, urls are compared with
    its rows and ids are given again. So ids have no gaps, and no url is active twice.
    """
    added = 0

    def make(rows: DataFrame, facts: dict):
        last = facts.get("last_id", 0)
        new = with_ids(enqueue_new(requests, rows).select("idx", "url", "title"), "idx", start=last + 1)

        def told(written: DataFrame) -> dict:
            nonlocal added
            added = written.count()
            return {"last_id": last + added}

        return new.withColumns({"status": F.lit("queued"), "progress": F.lit(0.0)}), told

    if not enqueue_new(requests, table.read()).isEmpty():
        table.append(make)
    return added


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """(batch, outcome queued, skipped or failed) -> counts and progress of each batch, and the format it asked for, if there is one."""
    counts = {x: F.count_if(F.col("outcome") == x) for x in ("queued", "skipped", "failed")}
    more = [F.max("format_id").alias("format_id")] if "format_id" in outcomes.columns else []
    return outcomes.groupBy("batch").agg(F.count("*").alias("total"), *[c.alias(x) for x, c in counts.items()], *more).withColumn(
        "progress", S.batch_progress(F.col("queued"), F.col("skipped"), F.col("failed"), F.col("total")))


def batch_ids(outcomes: DataFrame) -> DataFrame:
    """The ids that each batch queued, in order. A batch is a request, whose size the caller bounds; of others ``first_batch_ids`` tells the first."""
    return outcomes.where("outcome = 'queued'").groupBy("batch").agg(F.sort_array(F.collect_list("id")).alias("download_ids"))


def first_batch_ids(outcomes: DataFrame, shown: int = 5) -> DataFrame:
    """(batch, ids): the first ids that a batch of any size queued, and how many more. Each task keeps ``shown`` of a batch."""
    queued = outcomes.where("outcome = 'queued'").select("batch", "id")
    first = queued.withColumn("nth", F.row_number().over(Window.partitionBy("batch").orderBy("id"))).where(F.col("nth") <= shown)
    lists = first.groupBy("batch").agg(F.sort_array(F.collect_list("id")).alias("first"))
    counts = queued.groupBy("batch").agg(F.count("*").alias("n"))
    return lists.join(counts, "batch").select("batch", S.first_ids(F.col("first"), shown, F.col("n")).alias("ids"))


def utc_now() -> Column:
    """The time of the query in UTC, without a zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())


def _changed(rows: DataFrame, when: Column, now: Column | None = None, **values: Column) -> DataFrame:
    """``rows`` with new values where ``when`` holds; a column ``updated_at`` is set to ``now`` in these rows."""
    if "updated_at" in rows.columns:
        values["updated_at"] = utc_now() if now is None else now
    return rows.withColumns({k: F.when(when, v).otherwise(F.col(k)) for k, v in values.items()})


def resume(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """After a restart what was downloading is queued again; what was processing stays as it is."""
    return _changed(rows, F.col("status") == "downloading", now, status=F.lit("queued"), progress=F.lit(0.0))


def pending(rows: DataFrame) -> DataFrame:
    """What to queue after a restart, oldest first."""
    return resume(rows).where("status = 'queued'").orderBy(F.asc_nulls_first("created_at"), "id")


def depth(rows: DataFrame) -> DataFrame:
    """One row: how many rows wait in the queue."""
    return rows.agg(F.count_if(F.coalesce(F.col("status") == "queued", F.lit(False))).alias("depth"))


def cancel(rows: DataFrame, which: Column, now: Column | None = None) -> DataFrame:
    return _changed(rows, which & F.col("status").isin(P.CANCELLABLE), now, status=F.lit("cancelled"))


def cancel_job(jobs: DataFrame, which: Column, now: Column | None = None) -> DataFrame:
    return _changed(jobs, which & F.col("status").isin(P.CANCELLABLE_JOBS), now, status=F.lit("cancelled"))


def retry(rows: DataFrame, which: Column, now: Column | None = None) -> DataFrame:
    return _changed(rows, which & F.col("status").isin(P.RETRYABLE), now, status=F.lit("queued"), progress=F.lit(0.0), error_message=F.lit(None).cast("string"))


def bulk_delete(rows: DataFrame, status: str) -> DataFrame:
    P.checked_deletable(status)
    return rows.where(F.col("status") != status)


def _last_of(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The last row of each id by those of the columns ``order`` that there are; of equal ones the largest."""
    by = F.struct(*[F.col(c) for c in order if c in rows.columns], *[F.col(c) for c in rows.columns if c not in order])
    return rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), by).alias("r")).select("r.*")


def complete(rows: DataFrame, results: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows after results (id, title, artist, album, done_tracks, total_tracks): the track counts are always
    overwritten, the names only by what is there; ``updated_at``, if there is one, becomes ``now``. Of several results
    of an id the last counts, by their own ``updated_at`` and ``seq`` if they have them."""
    results = _last_of(results, ("updated_at", "seq"))
    new = results.select("id", *[F.col(c).alias(f"new_{c}") for c in ("title", "artist", "album", "done_tracks", "total_tracks")], F.lit(True).alias("done"))
    joined = rows.join(new, "id", "left")
    kept = {c: F.coalesce(f"new_{c}", c) for c in ("title", "artist", "album")}
    over = {c: F.when(F.col("done"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("done_tracks", "total_tracks")}
    state = {"status": F.when(F.col("done"), "completed").otherwise(F.col("status")), "progress": F.when(F.col("done"), 100.0).otherwise(F.col("progress"))}
    if "updated_at" in rows.columns:
        state["updated_at"] = F.when(F.col("done"), utc_now() if now is None else now).otherwise(F.col("updated_at"))
    return joined.withColumns(kept | over | state).select(*rows.columns)


def is_invalid(was: Column, status: Column) -> Column:
    """Whether a state may not follow another: what is known may only go where TRANSITIONS says, or stay."""
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return was.isNotNull() & (was != status) & ~F.array_contains(F.try_element_at(allowed, was), status)


def invalid_transitions(events: DataFrame, tie: str = "seq") -> DataFrame:
    """(key, ts, status, ``tie``) -> events whose state may not follow the one before (``was``), in the order of ``ts`` and ``tie``.

    The state before comes from a scan over sorted ranges, so that a key with any share of the events is spread over all tasks.
    """
    return with_previous(events, "key", ["ts", tie], {"status": "was"}).where(is_invalid(F.col("was"), F.col("status")))


def select_items(items: DataFrame, ids: DataFrame, selected: bool = True) -> DataFrame:
    """Items with the flag set for the given ids."""
    hit = ids.select(F.col("id")).distinct().withColumn("__hit", F.lit(True))
    flag = F.when(F.col("__hit"), F.lit(selected)).otherwise(F.col("selected_for_download"))
    return items.join(hit, "id", "left").withColumn("selected_for_download", flag).drop("__hit")


def updated_count(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("updated_count"))


def queue_selected(items: DataFrame, job: str) -> DataFrame:
    """All selected items of a job, also those of earlier selections."""
    return items.where((F.col("processing_job_id") == job) & F.col("selected_for_download"))


def visible(items: DataFrame, kinds: list[str]) -> DataFrame:
    """Items of the release types that are shown; without a type they are not."""
    return items.where(F.col("release_type").isin(kinds))


def all_selected(items: DataFrame) -> DataFrame:
    """One row: whether all are selected; none is not all."""
    return items.agg(F.coalesce(F.bool_and("selected_for_download"), F.lit(False)).alias("all_selected"))


def add_to_selection(selection: DataFrame, ids: DataFrame) -> DataFrame:
    return selection.union(ids).distinct()


def remove_from_selection(selection: DataFrame, ids: DataFrame) -> DataFrame:
    return selection.join(ids, "id", "left_anti")


def upsert(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """A snapshot with changed rows in place of its own, and new ones added; of an id's changes the last, by ``updated_at`` and ``seq``."""
    changes = _last_of(changes, ("updated_at", "seq"))
    return snapshot.join(changes.select("id"), "id", "left_anti").unionByName(changes)
