"""Routes, sinks and record pipelines over whole tables, and functions that no other query calls."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import formats as M
from ..operators import listing as L
from ..operators import queue as Q
from ..operators.scans import with_previous
from ..schemas import CHANNEL
from ..sources import fixtures as X
from ..sources.storage import append, job_ids, new_folder, read_records, read_table, with_ids, write_records
from . import api
from . import enrichment as E
from .catalogue_queries import AUDIO_SQL
from .edge_queries import FOLDER_SQL, RELEASE_SQL
from .list_queries import INVALID_SQL, WIRE_SQL

NOW = datetime.datetime(2025, 1, 2, 3, 4, 5)
NOW_SQL = "timestamp '2025-01-02 03:04:05'"
D = f"with {X.DOWNLOADS_SQL} "
C_ = f"with {X.DOWNLOADS_SQL}, {X.CANDIDATES_SQL} "
I = f"with {X.RELEASES_SQL}, {X.ITEMS_SQL}, {X.WIDE_ITEMS_SQL} "
ACTIVE = "('queued', 'downloading', 'processing', 'completed')"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.downloads(spark, sf_dir).withColumn("updated_at", F.col("created_at"))


def _touched(rows: DataFrame) -> DataFrame:
    """How many rows are in each state, and how many of them were changed now."""
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("updated_at") == _now()).alias("changed"), F.count("error_message").alias("errors"))


def _touched_sql(which: str, to: str) -> str:
    return D + f"""select case when {which} then '{to}' else status end as status, count(*) as n, count(*) filter ({which}) as changed,
      count(error_message) filter (not ({which}) or '{to}' <> 'queued') as errors from downloads group by 1"""


# requests for downloads: some with blanks around the url, some of another scheme, a quarter of urls that no download has
REQUESTS_SQL = """requests as (select case when idx % 11 = 0 then 'ftp://bad/' || idx when idx % 4 = 1 then 'https://music.youtube.com/playlist?list=N' || idx % 800 else url end as url, idx from candidates)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("idx")
    url = F.when(key % 4 == 1, F.concat(F.lit("https://music.youtube.com/playlist?list=N"), (key % 800).cast("string"))).otherwise(F.col("url"))
    blank = F.when(key % 13 == 0, F.concat(F.lit("  "), url, F.lit(" "))).otherwise(url)
    return X.candidates(spark, sf_dir).select(F.when(key % 11 == 0, F.concat(F.lit("ftp://bad/"), key.cast("string"))).otherwise(blank).alias("url"), "idx")


def _created(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.create_downloads(_requests(spark, sf_dir), X.downloads(spark, sf_dir), X.info_records(spark, sf_dir))


CREATED_SQL = C_ + f""", {REQUESTS_SQL}, {X.INFO_SQL}, created as (select idx, requests.url, title, artist, album, coalesce(download_type, 'song') as download_type, 'queued' as status, 0.0::double as progress,
  total_tracks, 0::bigint as done_tracks, 'bestaudio/best' as format_id from requests left join described on described.url = requests.url
  where idx % 11 <> 0 and requests.url not in (select url from downloads where status in {ACTIVE}) qualify row_number() over (partition by requests.url order by idx) = 1) """


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even requests are written first, then odd ones with the ids that follow."""
    new, path = _created(spark, sf_dir).select("idx", "url", "title", "status"), new_folder(spark, "downloads")
    append(with_ids(new.where("idx % 2 = 0"), "idx"), path)
    last = spark.read.parquet(path).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    append(with_ids(new.where("idx % 2 = 1"), "idx", start=last + 1), path)
    return spark.read.parquet(path)


def _stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "items")
    append(_processed(spark, sf_dir), path)
    return E.release_counts(spark.read.parquet(path))


def _records_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as lines of JSON and read back by their schema."""
    path = new_folder(spark, "records")
    write_records(X.channel_records(spark, sf_dir), path)
    return E.flat_entries(read_records(spark, path, CHANNEL)).select("channel", "channel_url", "pos", "id", "url", "title", "track_count", "kind")


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.process_channel(X.channel_records(spark, sf_dir), X.full_records(spark, sf_dir), "j")


# titles of these records that are live albums; the rule itself is tested by its own queries
LIVE_SQL = "title in ('Night Live', 'At the Opera House')"


def _typed_sql(count: str, first: str) -> str:
    return f"""with {X.ENTRIES_SQL}, {X.FULL_SQL}, usable as (select *, {count} as tracks, 'releases' as tab from entries {first}),
      studio as (select *, row_number() over w as nth, count(*) over (partition by l_orderkey) as n_all from usable where not ({LIVE_SQL}) window w as (partition by l_orderkey order by pos)),
      rich as (select studio.* replace (coalesce(full_meta.n, tracks) as tracks), release_year, case when secs > 0 then secs end as total_duration from studio left join full_meta on full_url = link),
      typed as (select *, {RELEASE_SQL} as release_type from rich)
      """


RELEASES_SQL = _typed_sql("coalesce(counted, listed)", "qualify row_number() over (partition by l_orderkey, coalesce(key, link) order by pos) = 1")
PROCESSED_SQL = _typed_sql("counted", "")

FALLBACK_SQL = " union all ".join(f"select {a}::bigint as rank, '{b}' as format_id, '{c}' as label, '{e}' as ext, {'null' if f is None else repr(f)} as codec, {str(g).lower()} as recommended"
                                  for a, b, c, e, f, g in M.FALLBACK)


def _all_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.format_options(X.formats(spark, sf_dir), read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record")))


def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = X.info_records(spark, sf_dir)
    return E.normalise_info(info).join(E.download_result(info).withColumnRenamed("total_tracks", "result_tracks"), "url")


def _waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that each event of a user would have waited, one an hour being allowed."""
    rows = with_previous(X.status_events(spark, sf_dir).select("key", "ts", "seq"), "key", ["ts", "seq"], {"ts": "before"})
    since = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.col("before").cast("timestamp")) / 1e6
    return rows.where("before is not null").select("seq", F.round(S.throttle_wait(since, F.lit(3600.0)), 3).alias("wait"))


def _by_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.invalid_transitions(X.status_events(spark, sf_dir)).groupBy("was", "status").agg(F.count("*").alias("n"))


def _labels(rows: DataFrame) -> DataFrame:
    status = F.col("status")
    return rows.select("id", F.length(S.short_error(F.repeat("error_message", F.lit(200)))).alias("error_chars"), S.counted(F.col("total_tracks"), "track").alias("tracks"),
                       S.display_date(F.col("created_at")).alias("shown"), api.is_done(status).alias("done"), S.state_colour(status).alias("colour"))


QUERIES = {
    "api_create_downloads": (_created, CREATED_SQL + "select * from created"),
    "api_retry_download": (lambda s, d: _touched(api.retry_download(_wide(s, d), 14, _now())), _touched_sql("id = 14 and status in ('failed', 'cancelled')", "queued")),
    "retry_updates_time": (lambda s, d: _touched(api.retry_all(_wide(s, d), _now())), _touched_sql("status = 'failed'", "queued")),
    "cancel_updates_time": (lambda s, d: _touched(Q.cancel(_wide(s, d), F.col("id") % 2 == 0, _now())), _touched_sql("id % 2 = 0 and status in ('queued', 'downloading')", "cancelled")),
    "resume_updates_time": (lambda s, d: _touched(Q.resume(_wide(s, d), _now())).drop("errors"), D + f"""select case when status = 'downloading' then 'queued' else status end as status, count(*) as n,
                            count(*) filter (status = 'downloading') as changed from downloads group by 1"""),
    "api_delete_downloads": (lambda s, d: api.delete_downloads(_wide(s, d), "failed").groupBy("status").agg(F.count("*").alias("n")), D + "select status, count(*) as n from downloads where status <> 'failed' group by 1"),
    "api_active_downloads": (lambda s, d: api.active_downloads(_wide(s, d)).drop("updated_at"), D + f"select {WIRE_SQL} from downloads where status in ('queued', 'downloading')"),
    "api_download_stats": (lambda s, d: api.download_stats(_wide(s, d)),
                           D + "select " + ", ".join(f"count(*) filter (status = '{x}') as {x}" for x in ("queued", "downloading", "processing", "completed", "failed", "cancelled")) + ", count(*) as total from downloads"),
    "api_format_options": (_all_options, AUDIO_SQL.replace("select * from options", f"""select * from options union all by name select * from (select o_orderkey as record from orders
                           where o_orderkey not in (select record from formats)) r, ({FALLBACK_SQL}) f""")),
    "api_job_items": (lambda s, d: api.job_items(X.wide_items(s, d), "j1", 700, 30).select("id", "title", "url", "track_count", "release_type", "created_at"),
                      I + """select id, title, url, track_count, release_type, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at from wide_items where processing_job_id = 'j1' order by wide_items.created_at, id limit 700 offset 30"""),
    "api_queue_selected": (lambda s, d: api.queue_selected(X.wide_items(s, d), "j1"),
                           I + "select playlist_id as id, title, url, thumbnail, track_count, channel, channel_url, source_tab, release_type from wide_items where processing_job_id = 'j1' and selected_for_download"),
    "api_select_items": (lambda s, d: (lambda i: api.select_items(i, i.where("id % 6 = 0").select("id"))[0].groupBy("selected_for_download").agg(F.count("*").alias("n")))(X.items(s, d)),
                         I + "select selected_for_download or id % 6 = 0 as selected_for_download, count(*) as n from items group by 1"),
    "api_channel_playlists": (lambda s, d: api.channel_playlists(X.channel_records(s, d), X.full_records(s, d)).select("channel", "channel_url", "pos", "id", "title", "url", "track_count", "release_type", "release_year", "total_duration"),
                              RELEASES_SQL + "select channel, channel_url, pos::int as pos, key as id, title, link as url, tracks as track_count, release_type, release_year, total_duration from typed where release_type <> 'music_video'"),
    "api_process_channel": (lambda s, d: _processed(s, d).select("channel_url", "pos", "id", "title", "url", "track_count", "release_type", F.round("progress", 6).alias("progress")),
                            PROCESSED_SQL + "select channel_url, pos::int as pos, key as id, title, link as url, tracks as track_count, release_type, round(10 + nth / n_all * 80, 6) as progress from typed where release_type <> 'music_video'"),
    "record_entries": (_records_from_text, f"with {X.ENTRIES_SQL} select channel, channel_url, pos::int as pos, key as id, link as url, title, coalesce(counted, listed) as track_count, kind from entries"),
    "info_of_customers": (_info, f"with {X.INFO_SQL} select url, title, artist, {FOLDER_SQL.replace('trim(v)', 'trim(artist)')} as folder_artist, album, download_type, total_tracks, done_tracks, result_tracks from described"),
    "append_downloads": (_appended, CREATED_SQL + """select idx, url, title, status, row_number() over (partition by idx % 2 order by idx) + case when idx % 2 = 1 then (select count(*) from created where idx % 2 = 0) else 0 end as id from created"""),
    "append_job_items": (_stored_items, PROCESSED_SQL + "select coalesce(release_type, 'unknown') as release_type, count(*) as n from typed where release_type <> 'music_video' group by 1"),
    "client_upsert": (lambda s, d: (lambda rows: Q.upsert(rows, api.retry_all(rows, _now()).where(F.col("updated_at") == _now())).select("id", "status", "progress"))(_wide(s, d)),
                      D + "select id, case when status = 'failed' then 'queued' else status end as status, case when status = 'failed' then 0.0 else progress end as progress from downloads"),
    "status_histogram": (lambda s, d: L.count_by_status(X.downloads(s, d).withColumn("status", F.when(F.col("id") % 40 == 0, "paused").otherwise(F.col("status")))),
                         D + "select case when id % 40 = 0 then 'paused' else status end as status, count(*) as n from downloads group by 1"),
    "download_labels": (lambda s, d: _labels(X.downloads(s, d)), D + """select id, length(left(repeat(error_message, 200), 2048))::int as error_chars, total_tracks || ' track' || case when total_tracks <> 1 then 's' else '' end as tracks,
                        strftime(created_at, '%-d %b, %I:%M %p') as shown, status in ('completed', 'failed', 'cancelled') as done,
                        case status when 'downloading' then '#8B5CF6' when 'processing' then '#8B5CF6' when 'completed' then '#10B981' when 'failed' then '#EF4444' when 'cancelled' then '#6B7280' else '#F59E0B' end as colour from downloads"""),
    "release_colours": (lambda s, d: X.items(s, d).groupBy(S.release_colour(F.col("release_type")).alias("colour")).agg(F.count("*").alias("n")),
                        I + "select case release_type when 'album' then 'primary' when 'ep' then 'info' when 'single' then 'secondary' else 'default' end as colour, count(*) as n from items group by 1"),
    "new_job_ids": (lambda s, d: job_ids(X.channel_records(s, d).select("channel_url")).agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("ids"), F.max(F.length(S.short_id(F.col("job_id")))).alias("short")),
                    "select count(distinct l_orderkey) as n, count(distinct l_orderkey) as ids, 8 as short from lineitem"),
    "throttle_waits": (_waits, f"with {X.EVENTS_SQL}, steps as (select seq, epoch_us(ts) / 1e6 - epoch_us(lag(ts) over (partition by key order by ts, seq)) / 1e6 as since from status_events) "
                       "select seq, round(greatest(3600.0::double - since, 0), 3) as wait from steps where since is not null"),
    "invalid_transitions_in_order": (_by_seq, f"select was, status, count(*) as n from ({INVALID_SQL}) group by all"),
}
