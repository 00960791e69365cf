"""Progress, waits, error rules, labels and selections over the given tables; the twins write their rules out again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import scalars as S
from ..operators import listing as L
from ..settings import Settings
from ..sources import fixtures as X
from ..sources.storage import read_table
from . import api
from .list_queries import WIRE_SQL


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _nth(key: Column, *values: object) -> Column:
    """One of the values by turns."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


MESSAGES = ("HTTP Error 429: Too Many Requests", "Rate limit reached", "was throttled", "not found", None, "(sqlite) database is locked", "Database Is Locked", "too many REQUESTS", "error 4290")
MESSAGES_SQL = "[" + ", ".join("null" if m is None else f"'{m}'" for m in MESSAGES) + "]"


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's error message, and whether it is a rate limit or a lock."""
    key = F.col("event_id")
    message = F.when(key % 2 == 0, _text(F.col("event_type"), ": ", _nth(key, *MESSAGES))).otherwise(_nth(key, *MESSAGES))
    rows = read_table(spark, sf_dir, "events").select(key, message.alias("message"))
    return rows.select("event_id", S.is_rate_limit(F.col("message")).alias("limited"), S.is_locked(F.col("message")).alias("locked"), S.short_error(F.col("message")).alias("message"))


ERRORS_SQL = f"""with told as (select event_id, case when event_id % 2 = 0 then event_type || ': ' || m else m end as message from (select *, ({MESSAGES_SQL})[event_id % 9 + 1] as m from events))
  select event_id, contains(lower(message), '429') or contains(lower(message), 'too many requests') or contains(lower(message), 'rate limit') or contains(lower(message), 'throttled') as limited,
  contains(message, 'database is locked') as locked, message from told"""


def _waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits of each event, with a part of its number as the attempt."""
    attempt = F.col("event_id") % 8
    jitter = F.pmod(F.col("value"), F.lit(1.0))
    return read_table(spark, sf_dir, "events").select(
        "event_id", S.linear_backoff(F.lit(60), attempt).alias("limited"), F.round(S.jittered_backoff(F.lit(0.1), attempt, jitter), 9).alias("locked"), S.reconnect_delay(attempt).alias("reconnect"))


WAITS_SQL = """select event_id, 60 * (event_id % 8) as limited, round(0.1::double * (1 << (event_id % 8)::int) * (0.5::double + 0.5::double * fmod(value, 1)), 9) as locked,
  case event_id % 8 when 0 then 1000.0 when 1 then 2000.0 when 2 then 4000.0 when 3 then 8000.0 when 4 then 16000.0 else 30000.0 end::double as reconnect from events"""


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as progress events of playlists; some without sizes, places or counts."""
    part, supp, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber").cast("long")
    event = F.struct(
        _nth(part, "downloading", "finished", "downloading", "error").alias("status"), F.when(supp % 3 != 0, part * (n % 2)).alias("total_bytes"), F.when(supp % 4 != 0, part + 7).alias("total_bytes_estimate"),
        F.when(supp % 5 != 0, F.floor(part * F.col("l_discount") * 5)).alias("downloaded_bytes"),
        F.struct(F.when(part % 6 != 0, n).alias("playlist_index"), F.when(part % 7 != 0, (n + supp) % 9).alias("playlist_count"), F.when(part % 5 != 0, n + 1).alias("n_entries")).alias("info_dict"))
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("line"), "l_partkey", "l_suppkey", event.alias("p"))
    overall = S.overall_progress(F.col("p"))
    return rows.select("l_orderkey", "line", "l_partkey", "l_suppkey", F.round(overall, 6).alias("overall"), F.round(S.stored_progress(overall), 6).alias("stored"), F.round(S.stored_progress(F.col("p.downloaded_bytes") / 10.0), 6).alias("capped"))


PROGRESS_SQL = """with raw as (select l_orderkey, l_linenumber::bigint as line, l_partkey, l_suppkey, (['downloading', 'finished', 'downloading', 'error'])[l_partkey % 4 + 1] as status,
    case when l_suppkey % 3 <> 0 then l_partkey * (l_linenumber % 2) end as total, case when l_suppkey % 4 <> 0 then l_partkey + 7 end as estimate, case when l_suppkey % 5 <> 0 then floor(l_partkey * l_discount * 5)::bigint end as done,
    case when l_partkey % 6 <> 0 then l_linenumber else 1 end as nth, case when l_partkey % 7 <> 0 and (l_linenumber + l_suppkey) % 9 <> 0 then (l_linenumber + l_suppkey) % 9 when l_partkey % 5 <> 0 then l_linenumber + 1 else 1 end as n_all from lineitem),
  sized as (select *, case when total <> 0 then total else estimate end as size from raw),
  told as (select *, case status when 'downloading' then least((nth - 1 + case when size > 0 then coalesce(done, 0)::double / size else 0 end) / n_all * 100, 99) when 'finished' then least(nth::double / n_all * 100, 99) end as overall from sized)
  select l_orderkey, line, l_partkey, l_suppkey, round(overall, 6) as overall, round(case when overall is not null then least(overall, 99.9) end, 6) as stored, round(case when done is not null then least(done / 10.0::double, 99.9) end, 6) as capped from told"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as settings: a quality, a list of origins and a size each."""
    key, size = F.col("p_partkey"), F.col("p_size")
    quality = F.when(key % 4 == 0, _text(size % 14)).when(key % 4 == 1, _text(size * 10, "k")).when(key % 4 == 2, _text("k", size, "k")).otherwise("")
    origins = F.when(key % 5 == 0, " * ").when(key % 5 == 1, "").otherwise(_text(" http://", F.col("p_brand"), " , ,https://", F.col("p_name"), ",", key))
    mb = F.when(key % 6 == 0, None).when(key % 6 == 1, 0.0).when(key % 6 == 2, size / 64.0).otherwise(F.col("p_retailprice") / 8)
    return read_table(spark, sf_dir, "part").select(key, S.mp3_quality(quality).alias("quality"), F.array_join(S.origins(origins), ";").alias("origins"), S.size_label(mb).alias("size"))


LABELS_SQL = """with raw as (select p_partkey, case p_partkey % 4 when 0 then (p_size % 14)::varchar when 1 then p_size * 10 || 'k' when 2 then 'k' || p_size || 'k' else '' end as quality,
    case p_partkey % 5 when 0 then ' * ' when 1 then '' else ' http://' || p_brand || ' , ,https://' || p_name || ',' || p_partkey end as origins,
    case p_partkey % 6 when 0 then null when 1 then 0.0 when 2 then p_size / 64.0::double else p_retailprice / 8 end::double as mb from part)
  select p_partkey, case when regexp_full_match(quality, '[0-9]+') and try_cast(quality as bigint) <= 10 then quality else replace(quality, 'k', '') end as quality,
  case when trim(origins) = '*' then '*' else array_to_string(list_filter(list_transform(string_split(origins, ','), lambda x: trim(x)), lambda x: x <> ''), ';') end as origins,
  case when coalesce(mb, 0) = 0 then '~Unknown size' when mb < 1 then '~' || floor(mb * 1024 + 0.5)::bigint || ' KB' else '~' || printf('%.1f', floor(mb * 10 + 0.5) / 10) || ' MB' end as size from raw"""


def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as refused requests: none to three errors, each at a place of one to three names."""
    key = F.col("o_orderkey")
    place = F.array(F.lit("body"), F.col("o_orderstatus"), F.lit("url"))
    error = lambda i: F.struct(F.slice(place, 1, (key + i) % 3 + 1).alias("loc"), _text("bad ", i).alias("msg"))
    errors = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < key % 4), error)
    return read_table(spark, sf_dir, "orders").select(key, S.validation_message(errors).alias("message"))


VALIDATION_SQL = """with errors as (select o_orderkey, i, array_to_string((['body', o_orderstatus, 'url'])[1 : ((o_orderkey + i) % 3 + 1)], '.') || ': bad ' || i as one from orders, range(3) t(i) where i < o_orderkey % 4)
  select o_orderkey, coalesce(string_agg(one, ', ' order by i), '') as message from orders left join errors using (o_orderkey) group by o_orderkey"""


def _pills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page numbers shown to each customer, whose list has up to 30 pages."""
    pages = F.col("c_custkey") % 30 + 1
    rows = read_table(spark, sf_dir, "customer").select(pages.alias("pages"), (F.col("c_nationkey") % pages + 1).alias("page")).distinct()
    return L.page_pills(rows)


PILLS_SQL = """with t as (select distinct c_custkey % 30 + 1 as pages, (c_nationkey % (c_custkey % 30 + 1) + 1)::bigint as page from customer), shown as (select *, unnest(range(1, pages + 1)) as p from t)
  select pages, page, p, coalesce(p - lag(p) over (partition by pages, page order by p) > 1, false) as gap from shown where p in (1, pages) or p between page - 2 and page + 2"""


def _toggled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's selection of up to five nations with the own one added, or taken away if it is there."""
    nation = F.col("c_nationkey").cast("long")
    chosen = F.filter(F.sequence(F.lit(0), F.lit(24)), lambda i: (i * 7 + F.col("c_custkey")) % 5 == 0)
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", F.transform(chosen, lambda i: i.cast("long")).alias("chosen"), nation.alias("nation"))
    return rows.select("c_custkey", F.array_join(F.transform(S.toggled(F.col("chosen"), F.col("nation")), lambda x: x.cast("string")), ",").alias("chosen"))


TOGGLED_SQL = """with t as (select c_custkey, c_nationkey::bigint as nation, list_filter(range(0, 25), lambda i: (i * 7 + c_custkey) % 5 = 0) as chosen from customer)
  select c_custkey, array_to_string(case when list_contains(chosen, nation) then list_filter(chosen, lambda i: i <> nation) else list_append(chosen, nation) end, ',') as chosen from t"""

TITLES = ("Night Live", "Olive Session", "Great Club", "Song (Official Video)", "Plain", "Some MV", "Recorded Live 1999", "Alive")


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as downloads of playlists, channels, artists and songs, with titles that name live albums and videos."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    title = _text(_nth(key, *TITLES), F.when(key % 3 == 0, _text(" ", cust)).otherwise(""))
    url = F.when(cust % 5 == 0, _text("https://x/Channel/", cust)).when(cust % 5 == 1, _text("https://x/artist/", cust)).otherwise(_text("https://x/playlist?list=", cust))
    kind, ident = F.when(key % 4 != 0, "playlist"), F.when(cust % 3 == 0, _text("OLAK5uy_", key)).when(cust % 7 != 0, _text("PL", key))
    tracks = F.when(cust % 4 != 0, cust % 3)
    return read_table(spark, sf_dir, "orders").select(
        key, C.download_type(url, kind, ident).alias("download_type"), C.is_live(title).alias("live"),
        C.is_music_video(title, tracks, F.when(key % 5 == 0, "video"), F.when(key % 2 == 0, (cust % 500).cast("double"))).alias("video"))


TYPES_SQL = r"""with t as (select o_orderkey, lower((['Night Live', 'Olive Session', 'Great Club', 'Song (Official Video)', 'Plain', 'Some MV', 'Recorded Live 1999', 'Alive'])[o_orderkey % 8 + 1] || case when o_orderkey % 3 = 0 then ' ' || o_custkey else '' end) as title,
    case o_custkey % 5 when 0 then 'channel' when 1 then 'artist' end as place, o_orderkey % 4 <> 0 as many, o_custkey % 3 = 0 as listed, case when o_custkey % 4 <> 0 then o_custkey % 3 end as tracks,
    o_orderkey % 5 = 0 as is_video, case when o_orderkey % 2 = 0 then o_custkey % 500 end as secs from orders)
  select o_orderkey, case when not many then 'song' when listed then 'album' when place is not null then 'artist' else 'playlist' end as download_type,
  starts_with(title, 'night live') or starts_with(title, 'recorded live') or starts_with(title, 'great club') or starts_with(title, 'olive session') as live,
  (tracks is null or tracks = 1) and (contains(title, 'official video') or contains(title, 'some mv') or (coalesce(tracks = 1, false) and (is_video or coalesce(secs between 120 and 480, false)))) as video from t"""

D = f"with {X.DOWNLOADS_SQL} "
B = f"with {X.DOWNLOADS_SQL}, {X.RELEASES_SQL}, {X.ITEMS_SQL}, {X.WIDE_ITEMS_SQL} "
#: A quarter of a job's selected items have a url that an active download has.
SELECTED_SQL = B + """, chosen as (select id, case when id % 4 = 0 and id % 16 = 0 then 'https://music.youtube.com/playlist?list=C' || id % 500 else url end as url, format_id
    from (select *, 'bestaudio/best' as format_id from wide_items) where processing_job_id = 'j1' and selected_for_download),
  placed as (select *, row_number() over (partition by url order by id) as nth from chosen),
  outcomes as (select id, url, case when nth > 1 or url in (select url from downloads where status in ('queued', 'downloading', 'processing', 'completed')) then 'skipped' else 'queued' end as outcome from placed)"""


def _selected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when((F.col("id") % 4 == 0) & (F.col("id") % 16 == 0), _text("https://music.youtube.com/playlist?list=C", F.col("id") % 500)).otherwise(F.col("url"))
    return X.wide_items(spark, sf_dir).withColumn("url", url)


def _selected_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.queue_selected_items(_selected_items(spark, sf_dir), X.downloads(spark, sf_dir), "j1", "b7")


def _selected_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.batch_label(_selected_outcomes(spark, sf_dir), "b7")


def _page_by_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of active downloads, its size, most size and offset from settings; the envelope beside each row."""
    given = Settings.from_env(environ={"TRACKWEAVE_DOWNLOADS_PAGE": "70", "TRACKWEAVE_DOWNLOADS_PAGE_MOST": "80", "OTHER_DOWNLOADS_PAGE": "5"})
    rows = X.downloads(spark, sf_dir).where(F.col("status").isin("queued", "downloading"))
    page = L.page(L.newest_first(rows), given.downloads_page, given.max_retries, given.downloads_page_most).select("id", "status")
    return page.crossJoin(F.broadcast(L.envelope(rows, given.downloads_page, given.max_retries, given.downloads_page_most)))  # one row


def _snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.initial_snapshot(X.downloads(spark, sf_dir).withColumn("updated_at", F.col("created_at")))[0].drop("updated_at")


QUERIES = {
    "event_errors": (_errors, ERRORS_SQL),
    "event_waits": (_waits, WAITS_SQL),
    "line_progress": (_progress, PROGRESS_SQL),
    "part_settings": (_labels, LABELS_SQL),
    "order_validation": (_validation, VALIDATION_SQL),
    "customer_pills": (_pills, PILLS_SQL),
    "customer_toggles": (_toggled, TOGGLED_SQL),
    "order_types": (_types, TYPES_SQL),
    "queue_selected_outcomes": (lambda s, d: _selected_outcomes(s, d).select("id", "url", "outcome", "format_id"), SELECTED_SQL + "select id, url, outcome, 'bestaudio/best' as format_id from outcomes"),
    "queue_selected_batch": (_selected_batch, SELECTED_SQL + """, ids as (select row_number() over (order by id) as rn, id from outcomes where outcome = 'queued')
                             select 'b7' as batch, count(*) as total, count(*) filter (outcome = 'queued') as queued, count(*) filter (outcome = 'skipped') as skipped, 0::bigint as failed, 100.0::double as progress,
                             (select string_agg(id::varchar, ', ' order by rn) filter (rn <= 5) || case when count(*) > 5 then ' +' || (count(*) - 5) || ' more' else '' end from ids) as download_ids from outcomes"""),
    "page_by_settings": (_page_by_settings, D + """, active as (select * from downloads where status in ('queued', 'downloading')), n as (select count(*) as total from active)
                         select id, status, total, least(greatest(total - 5, 0), 70) as page_rows, 70::int as "limit", 5::int as "offset", 75 < total as has_more
                         from (select * from active order by created_at desc, id desc limit 70 offset 5), n"""),
    "api_initial_snapshot_rows": (_snapshot_rows, D + f"select {WIRE_SQL} from downloads order by downloads.created_at desc, id desc limit 500"),
}
