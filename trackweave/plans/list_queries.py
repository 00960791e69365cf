"""Queries over the downloads list: filters, counts, pages, queueing and state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import listing as L
from ..operators import queue as Q
from ..sources import fixtures as X

WIRE = ["id", "url", "title", "artist", "album", "download_type", "status", "progress", "error_message", "total_tracks", "done_tracks", "created_at"]
WIRE_SQL = """id, url, title, artist, album, download_type, status, round(progress, 1) as progress, error_message, total_tracks, done_tracks,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at"""
D = f"with {X.DOWNLOADS_SQL} "
S_ = f"with {X.SEARCHABLE_SQL} "
C_ = f"with {X.DOWNLOADS_SQL}, {X.CANDIDATES_SQL} "


def _wire(rows: DataFrame) -> DataFrame:
    return rows.select(*WIRE[:-1], "created_at").withColumns({"progress": F.round("progress", 1), "created_at": S.iso(F.col("created_at"))})


def _over_downloads(f):
    return lambda spark, sf_dir: f(X.downloads(spark, sf_dir))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    down, cand = X.downloads(spark, sf_dir), X.candidates(spark, sf_dir)
    valid = cand.where(F.col("idx") % 11 != 0)
    new = Q.enqueue_new(valid, down).withColumn("outcome", F.lit("queued"))
    skipped = Q.enqueue_skipped(valid, down).withColumn("outcome", F.lit("skipped"))
    failed = cand.where(F.col("idx") % 11 == 0).withColumn("outcome", F.lit("failed"))
    return new.unionByName(skipped).unionByName(failed).withColumnRenamed("idx", "id")


OUTCOMES_SQL = C_ + """, valid as (select * from candidates where idx % 11 <> 0), firsts as (select url, min(idx) as first from valid group by url),
  active as (select distinct url from downloads where status in ('queued', 'downloading', 'processing', 'completed')),
  outcomes as (select batch, idx as id, case when idx % 11 = 0 then 'failed' when url in (select url from active) or idx > first then 'skipped' else 'queued' end as outcome
  from candidates left join firsts using (url))"""

_CHANGED = "select id, status, progress, error_message"


def _reduced(rows: DataFrame) -> DataFrame:
    return rows.select("id", "status", "progress", "error_message")


def _invalid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.invalid_transitions(X.status_events(spark, sf_dir).select("key", "ts", "seq", "status")).select("key", "seq", "was", "status")


#: Which state may follow which, written out again.
ALLOWED_SQL = """allowed(was, status) as (values ('queued', 'downloading'), ('queued', 'cancelled'), ('downloading', 'processing'), ('downloading', 'completed'), ('downloading', 'failed'),
  ('downloading', 'queued'), ('downloading', 'cancelled'), ('processing', 'completed'), ('processing', 'failed'), ('failed', 'queued'), ('cancelled', 'queued'))"""
STEPS_SQL = f"with {X.EVENTS_SQL}" + """, steps as (select key, seq, status, lag(status) over (partition by key order by ts, seq) as was from status_events)"""
INVALID_SQL = f"{STEPS_SQL}, {ALLOWED_SQL} select key, seq, was, status from steps where was is not null and was <> status and (was, status) not in (select was, status from allowed)"


QUERIES = {
    "status_counts": (_over_downloads(L.count_by_status), D + "select status, count(id) as n from downloads group by status"),
    "status_pivot": (_over_downloads(L.status_stats), D + "select " + ", ".join(
        f"count(*) filter (status = '{s}') as {s}" for s in ("queued", "downloading", "processing", "completed", "failed", "cancelled")) + ", count(id) as total from downloads"),
    "list_page": (_over_downloads(lambda d: _wire(L.page(L.newest_first(L.find(d, "completed")), 500, 100))),
                  D + f"select {WIRE_SQL} from downloads where status = 'completed' order by created_at desc, id desc limit 500 offset 100"),
    "list_envelope": (_over_downloads(lambda d: L.envelope(L.find(d, "completed"), 500, 100)),
                      D + """select count(*) as total, least(greatest(count(*) - 100, 0), 500) as page_rows, 500::int as "limit", 100::int as "offset",
                      least(greatest(count(*) - 100, 0), 500) + 100 < count(*) as has_more from downloads where status = 'completed'"""),
    "list_unknown_status": (_over_downloads(lambda d: L.envelope(L.find(d, "paused"), 500)),
                            D + """select count(*) as total, least(count(*), 500) as page_rows, 500::int as "limit", 0::int as "offset", false as has_more
                            from downloads where status = 'paused'"""),
    "wire_rows": (_over_downloads(_wire), D + f"select {WIRE_SQL} from downloads"),
    "first_snapshot": (_over_downloads(lambda d: _wire(L.page(L.newest_first(d), 500))),
                       D + f"select {WIRE_SQL} from downloads order by downloads.created_at desc, id desc limit 500"),
    "recent_five": (_over_downloads(lambda d: L.page(L.newest_first(d), 5).select("id", "title")),
                    D + "select id, title from downloads order by created_at desc, id desc limit 5"),
    "point_lookup": (_over_downloads(lambda d: _wire(L.lookup(d, 77))), D + f"select {WIRE_SQL} from downloads where id = 77"),
    "search_like": (lambda s, d: L.find(X.searchable(s, d), search="b_lt"),
                    S_ + "select * from searchable where title ilike '%b_lt%' or artist ilike '%b_lt%' or album ilike '%b_lt%'"),
    "search_literal": (lambda s, d: X.searchable(s, d).where(P.contains_text("Bolt", F.col("title"), F.col("artist"), F.col("album"))),
                       S_ + "select * from searchable where contains(lower(coalesce(title, '')), 'bolt') or contains(lower(coalesce(artist, '')), 'bolt') or contains(lower(coalesce(album, '')), 'bolt')"),
    "client_search": (_over_downloads(lambda d: L.find_in_client(d, "active", "artist 1").select("id")),
                      D + "select id from downloads where status in ('downloading', 'processing') and (contains(lower(title), 'artist 1') or contains(lower(coalesce(artist, '')), 'artist 1') or contains(lower(album), 'artist 1'))"),
    "active_dedupe": (_over_downloads(lambda d: d.where(F.col("status").isin(P.ACTIVE_FOR_DEDUPE)).select("id", "status")),
                      D + "select id, status from downloads where status in ('queued', 'downloading', 'processing', 'completed')"),
    "active_list": (_over_downloads(lambda d: _wire(L.oldest_first(d.where(F.col("status").isin(P.ACTIVE_IN_LIST))))),
                    D + f"select {WIRE_SQL} from downloads where status in ('queued', 'downloading')"),
    "active_client": (_over_downloads(lambda d: d.where(F.col("status").isin(P.ACTIVE_IN_CLIENT)).select("id", "status")),
                      D + "select id, status from downloads where status in ('downloading', 'processing')"),
    "client_histogram": (_over_downloads(L.client_histogram),
                         D + "select " + ", ".join(f"count(*) filter (status = '{x}') as {x}" for x in ("queued", "downloading", "completed", "failed")) + ", count(*) as total from downloads"),
    "open_histogram": (_over_downloads(lambda d: d.groupBy(F.coalesce("artist", F.lit("?")).alias("artist")).agg(F.count("*").alias("n"))),
                       D + "select coalesce(artist, '?') as artist, count(*) as n from downloads group by 1"),
    "tab_counts": (_over_downloads(L.tab_counts), D + """select tab, count(*) as n from (select 'all' as tab from downloads union all select status from downloads
                   union all select 'active' from downloads where status in ('downloading', 'processing')) group by tab"""),
    "failed_badge": (_over_downloads(lambda d: L.badge(d, "failed")), D + "select nullif(count(*) filter (status = 'failed'), 0) as badge from downloads"),
    "no_badge": (_over_downloads(lambda d: L.badge(d, "paused")), D + "select nullif(count(*) filter (status = 'paused'), 0) as badge from downloads"),
    "any_processing": (_over_downloads(lambda d: L.any_with(d, ["pending", "processing"])),
                       D + """select coalesce(bool_or(status in ('pending', 'processing')), false) as "any" from downloads"""),
    "any_processing_of_none": (_over_downloads(lambda d: L.any_with(d.where("id < 0"), ["processing"])), D + """select coalesce(bool_or(status = 'processing'), false) as "any" from downloads where id < 0"""),
    "queue_depth": (_over_downloads(Q.depth), D + "select count(*) as depth from downloads where status = 'queued'"),
    "status_labels": (_over_downloads(lambda d: d.select("id", S.state_label(F.col("status")).alias("label"), S.release_label(
        F.col("artist"), F.col("album"), F.col("done_tracks"), F.col("total_tracks")).alias("detail"))),
        D + """select id, upper(substr(status, 1, 1)) || substr(status, 2) as label, concat_ws(' · ', nullif(artist, ''), nullif(nullif(album, 'Unknown Album'), ''),
        case when total_tracks > 1 then coalesce(done_tracks, 0) || ' / ' || total_tracks || ' tracks' end) as detail from downloads"""),
    "latest_per_url": (_over_downloads(lambda d: L.latest_per(d.where(F.col("status").isin(P.ACTIVE_FOR_DEDUPE)).select("id", "url", "status", "created_at"), "url").select("id", "url", "status")),
                       D + """select id, url, status from downloads where status in ('queued', 'downloading', 'processing', 'completed')
                       qualify row_number() over (partition by url order by created_at desc, id desc) = 1"""),
    "enqueue_new": (lambda s, d: Q.enqueue_new(X.candidates(s, d), X.downloads(s, d)).select("idx", "url"),
                    C_ + """select idx, url from candidates where url not in (select url from downloads where status in ('queued', 'downloading', 'processing', 'completed'))
                    qualify row_number() over (partition by url order by idx) = 1"""),
    "enqueue_skipped": (lambda s, d: Q.enqueue_skipped(X.candidates(s, d), X.downloads(s, d)).select("idx", "url"),
                        C_ + """, ranked as (select *, row_number() over (partition by url order by idx) as rn from candidates)
                        select idx, url from ranked where rn > 1 or url in (select url from downloads where status in ('queued', 'downloading', 'processing', 'completed'))"""),
    "batch_summary": (lambda s, d: Q.batch_summary(_outcomes(s, d)), OUTCOMES_SQL + """select batch, count(*) as total, count(*) filter (outcome = 'queued') as queued,
                      count(*) filter (outcome = 'skipped') as skipped, count(*) filter (outcome = 'failed') as failed, 100.0::double as progress from outcomes group by batch"""),
    "batch_ids": (lambda s, d: Q.first_batch_ids(_outcomes(s, d)),
                  OUTCOMES_SQL + """, lists as (select batch, list(id order by id) as ids from outcomes where outcome = 'queued' group by batch)
                  select batch, array_to_string(ids[1:5], ', ') || case when len(ids) > 5 then ' +' || (len(ids) - 5) || ' more' else '' end as ids from lists"""),
    "resume_reset": (_over_downloads(lambda d: _reduced(Q.resume(d))),
                     D + "select id, case when status = 'downloading' then 'queued' else status end as status, case when status = 'downloading' then 0.0 else progress end as progress, error_message from downloads"),
    "resume_queue": (_over_downloads(lambda d: Q.pending(d).select("id", "created_at")), D + "select id, created_at from downloads where status in ('queued', 'downloading')"),
    "cancel_rows": (_over_downloads(lambda d: _reduced(Q.cancel(d, F.col("id") % 2 == 0))),
                    D + "select id, case when id % 2 = 0 and status in ('queued', 'downloading') then 'cancelled' else status end as status, progress, error_message from downloads"),
    "retry_reset": (_over_downloads(lambda d: _reduced(Q.retry(d, F.lit(True)))),
                    D + """select id, case when status in ('failed', 'cancelled') then 'queued' else status end as status, case when status in ('failed', 'cancelled') then 0.0 else progress end as progress,
                    case when status in ('failed', 'cancelled') then null else error_message end as error_message from downloads"""),
    "retry_failed": (_over_downloads(lambda d: d.where("status = 'failed'").select("id")), D + "select id from downloads where status = 'failed'"),
    "bulk_delete": (_over_downloads(lambda d: Q.bulk_delete(d, "failed").select("id", "status")), D + "select id, status from downloads where status <> 'failed'"),
    "complete_rows": (_over_downloads(lambda d: Q.complete(d, d.where("id % 3 = 0").select("id", F.lit(None).cast("string").alias("title"), F.lit("New").alias("artist"), "album", F.lit(9).cast("long").alias("done_tracks"), F.lit(None).cast("long").alias("total_tracks"))).select("id", "title", "artist", "album", "status", "progress", "done_tracks", "total_tracks")),
                      D + """select id, title, case when id % 3 = 0 then 'New' else artist end as artist, album, case when id % 3 = 0 then 'completed' else status end as status,
                      case when id % 3 = 0 then 100.0 else progress end as progress, case when id % 3 = 0 then 9 else done_tracks end as done_tracks,
                      case when id % 3 = 0 then null else total_tracks end as total_tracks from downloads"""),
    "invalid_transitions": (_invalid_rows, INVALID_SQL),
    "client_page": (_over_downloads(lambda d: L.client_page(d.where("status = 'failed'"), L.BEYOND_LAST, 25)),
                    D + """select count(*) as n, ceil(count(*) / 25)::bigint as pages, ceil(count(*) / 25)::bigint as page, ((ceil(count(*) / 25) - 1) * 25 + 1)::bigint as "from", count(*) as "to"
                    from downloads where status = 'failed'"""),
    "page_pills": (lambda s, d: L.page_pills(s.createDataFrame([(1, 1), (5, 3), (20, 1), (20, 10), (20, 20), (9, 4)], "pages long, page long")),
                   """with t(pages, page) as (values (1, 1), (5, 3), (20, 1), (20, 10), (20, 20), (9, 4)), shown as (select pages::bigint as pages, page::bigint as page, unnest(generate_series(1, pages))::bigint as p from t),
                   kept as (select * from shown where p = 1 or p = pages or abs(p - page) <= 2)
                   select pages, page, p, coalesce(p - lag(p) over (partition by pages, page order by p) > 1, false) as gap from kept"""),
    "append_page": (_over_downloads(lambda d: L.page(L.newest_first(d), 100).select("id").unionAll(L.page(L.newest_first(d), 100, 100).select("id"))),
                    D + "select id from downloads order by created_at desc, id desc limit 200"),
}
