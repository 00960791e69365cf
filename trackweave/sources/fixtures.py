"""The driver's star schema in the shape of the library's relations, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FLAT_ENTRY, FULL_PLAYLIST, INFO
from .storage import read_table

DOWNLOADS_SQL = """downloads as (select o_orderkey as id, 'https://music.youtube.com/playlist?list=C' || o_custkey as url,
  'Title ' || o_orderkey as title, case when o_custkey % 5 = 0 then null else 'Artist ' || o_custkey end as artist,
  case when o_custkey % 3 = 0 then '' else 'Album ' || o_custkey end as album, 'album' as download_type,
  case substr(o_orderpriority, 1, 1) when '1' then 'downloading' when '2' then 'processing' when '3' then 'queued' when '4' then 'completed'
    else case when o_orderstatus = 'F' then 'failed' else 'cancelled' end end as status,
  (o_orderkey % 1000) / 8.0::double as progress, case when o_orderstatus = 'F' then 'HTTP Error 429' end as error_message,
  o_custkey % 20 as total_tracks, o_custkey % 7 as done_tracks, o_orderdate as created_at from orders)"""


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    level = F.substring("o_orderpriority", 1, 1)
    status = F.when(level == "1", "downloading").when(level == "2", "processing").when(level == "3", "queued").when(level == "4", "completed") \
        .when(F.col("o_orderstatus") == "F", "failed").otherwise("cancelled")
    return o.select(
        key.alias("id"), F.concat(F.lit("https://music.youtube.com/playlist?list=C"), cust.cast("string")).alias("url"),
        F.concat(F.lit("Title "), key.cast("string")).alias("title"), F.when(cust % 5 != 0, F.concat(F.lit("Artist "), cust.cast("string"))).alias("artist"),
        F.when(cust % 3 == 0, "").otherwise(F.concat(F.lit("Album "), cust.cast("string"))).alias("album"), F.lit("album").alias("download_type"),
        status.alias("status"), ((key % 1000) / 8.0).alias("progress"), F.when(F.col("o_orderstatus") == "F", "HTTP Error 429").alias("error_message"),
        (cust % 20).alias("total_tracks"), (cust % 7).alias("done_tracks"), F.col("o_orderdate").alias("created_at"))


SEARCHABLE_SQL = "searchable as (select p_partkey as id, p_name as title, p_brand as artist, p_type as album from part)"


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"))


RELEASES_SQL = """releases as (select o_orderkey as id, 'Release ' || o_orderkey as title, count(l_orderkey) as track_count,
  sum(l_quantity) as total_duration, year(o_orderdate) as release_year from orders left join lineitem on l_orderkey = o_orderkey
  group by o_orderkey, o_orderdate)"""


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are counted before the join, so only one row of each order is joined."""
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total_duration"))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Release "), F.col("o_orderkey").cast("string")).alias("title"),
        F.coalesce("n", F.lit(0)).alias("track_count"), "total_duration", F.year("o_orderdate").cast("long").alias("release_year"))


FORMATS_SQL = """formats as (select l_orderkey as record,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as pos,
  'f' || (l_partkey % 6) as format_id, case when l_partkey % 2 = 0 then 'webm' else 'm4a' end as ext,
  case when l_returnflag = 'A' then 'opus' when l_returnflag = 'N' then 'aac' else 'none' end as acodec,
  case when l_suppkey % 4 = 0 then 'avc1' else 'none' end as vcodec, case when l_linenumber % 3 = 0 then 0.0::double else l_quantity * 8 end as abr,
  l_quantity * 4 as tbr, case when l_linenumber % 2 = 0 then 0 else l_partkey * 1048576 + l_suppkey * 131072 end as filesize,
  l_partkey * 524288 as filesize_approx from lineitem)"""


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    part, flag = F.col("l_partkey"), F.col("l_returnflag")
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("record"), (F.row_number().over(order) - 1).alias("pos"), F.concat(F.lit("f"), (part % 6).cast("string")).alias("format_id"),
        F.when(part % 2 == 0, "webm").otherwise("m4a").alias("ext"), F.when(flag == "A", "opus").when(flag == "N", "aac").otherwise("none").alias("acodec"),
        F.when(F.col("l_suppkey") % 4 == 0, "avc1").otherwise("none").alias("vcodec"),
        F.when(F.col("l_linenumber") % 3 == 0, 0.0).otherwise(F.col("l_quantity") * 8).alias("abr"), (F.col("l_quantity") * 4).alias("tbr"),
        F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(part * 1048576 + F.col("l_suppkey") * 131072).alias("filesize"), (part * 524288).alias("filesize_approx"))


EVENTS_SQL = """status_events as (select user_id as key, ts, event_id as seq, case event_type when 'signup' then 'queued' when 'view' then 'downloading'
  when 'click' then 'processing' when 'purchase' then 'completed' else 'failed' end as status, value from events)"""
STATES_OF_EVENTS = {"signup": "queued", "view": "downloading", "click": "processing", "purchase": "completed"}


def as_status_events(events: DataFrame) -> DataFrame:
    status = F.lit("failed")
    for kind, state in STATES_OF_EVENTS.items():
        status = F.when(F.col("event_type") == kind, state).otherwise(status)
    return events.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), status.alias("status"), "value")


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_status_events(read_table(spark, sf_dir, "events"))


ITEMS_SQL = """items as (select id, case when id % 10 = 0 then 'j2' else 'j1' end as processing_job_id, 'P' || id as playlist_id, title,
  'https://music.youtube.com/playlist?list=P' || id as url, track_count, case when id % 97 = 0 then null when id % 89 = 0 then 'mixtape' when track_count <= 4 then 'single' when track_count <= 7
  then 'ep' else 'album' end as release_type, id % 4 = 0 as selected_for_download, release_year from releases)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n = F.col("id"), F.col("track_count")
    kind = F.when(key % 97 == 0, None).when(key % 89 == 0, "mixtape").when(n <= 4, "single").when(n <= 7, "ep").otherwise("album")
    return releases(spark, sf_dir).select(
        "id", F.when(key % 10 == 0, "j2").otherwise("j1").alias("processing_job_id"), F.concat(F.lit("P"), key.cast("string")).alias("playlist_id"), "title",
        F.concat(F.lit("https://music.youtube.com/playlist?list=P"), key.cast("string")).alias("url"), "track_count", kind.alias("release_type"),
        (key % 4 == 0).alias("selected_for_download"), "release_year")


CANDIDATES_SQL = """candidates as (select 'https://music.youtube.com/playlist?list=C' || (c_custkey % 2000 + 1) as url, c_custkey as idx,
  c_custkey % 50 as batch from customer)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("https://music.youtube.com/playlist?list=C"), (key % 2000 + 1).cast("string")).alias("url"), key.alias("idx"), (key % 50).alias("batch"))


#: Lines as the entries of one channel record for each order; titles, ids and counts that the rules tell apart.
ENTRIES_SQL = """flat as (select l_orderkey, 'https://x/@o' || l_orderkey as channel_url, case when l_orderkey % 3 = 0 then 'Uploader ' else 'Channel ' end || l_orderkey as channel,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1 as pos,
  case when l_partkey % 11 <> 0 then 'e' || (l_partkey % 5) when l_suppkey % 2 = 0 then 'q' || l_partkey end as key,
  case when l_suppkey % 3 <> 0 then 'https://music.youtube.com/playlist?list=P' || l_partkey end as raw_url,
  case l_partkey % 9 when 0 then 'Unknown Playlist' when 1 then 'Night Live' when 2 then 'Song (Official Video)' when 3 then 'Nine - EP' when 4 then 'One – Single' when 5 then 'At the Opera House'
    else 'Title ' || l_partkey end as title,
  coalesce(nullif(case when l_linenumber % 3 = 0 then 0 else l_partkey % 13 end, 0), case when l_suppkey % 9 <> 4 then l_suppkey % 9 end) as counted,
  case when l_partkey % 4 = 0 then nullif(l_suppkey % 4, 0) end as listed, l_quantity * 10 as duration,
  case l_partkey % 17 when 0 then ' EP ' when 1 then 'compilation' end as explicit, case when l_partkey % 5 = 0 then 'video' end as kind from lineitem),
  entries as (select *, coalesce(raw_url, 'https://www.youtube.com/playlist?list=' || key) as link from flat where raw_url is not null or key is not null)"""


def channel_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested record (schema CHANNEL) for each order; an order has a few lines.

    Only the columns that entries are made of are shuffled; lines become entries when they are in their order's list.
    """
    text = lambda c: c.cast("string")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*order).alias("x")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("lines"))
    lists = lines.select("l_orderkey", F.transform("lines", _entry).alias("entries"))
    key, none = text(F.col("l_orderkey")), F.lit(None).cast("string")
    return lists.select(F.when(F.col("l_orderkey") % 3 != 0, F.concat(F.lit("Channel "), key)).alias("channel"), F.concat(F.lit("Uploader "), key).alias("uploader"), none.alias("title"),
                        F.concat(F.lit("https://x/@o"), key).alias("channel_url"), none.alias("uploader_url"), "entries")


def _entry(line: Column) -> Column:
    """A line as an entry (schema FLAT_ENTRY)."""
    part, supp, text = line["l_partkey"], line["l_suppkey"], lambda c: c.cast("string")
    title = F.when(part % 9 == 0, "").when(part % 9 == 1, "Night Live").when(part % 9 == 2, "Song (Official Video)").when(part % 9 == 3, "Nine - EP") \
        .when(part % 9 == 4, "One – Single").when(part % 9 == 5, "At the Opera House").otherwise(F.concat(F.lit("Title "), text(part)))
    listed = F.when((part % 4 == 0) & (supp % 4 > 0), F.transform(F.sequence(F.lit(1), supp % 4), lambda i: F.struct(text(i).alias("id"))))
    given = {
        "id": F.when(part % 11 != 0, F.concat(F.lit("e"), text(part % 5))), "playlist_id": F.when((part % 11 == 0) & (supp % 2 == 0), F.concat(F.lit("q"), text(part))),
        "url": F.when(supp % 3 != 0, F.concat(F.lit("https://music.youtube.com/playlist?list=P"), text(part))), "title": title,
        "playlist_count": F.when(line["l_linenumber"] % 3 == 0, 0).otherwise(part % 13), "track_count": F.when(supp % 9 != 4, supp % 9), "entries": listed,
        "release_type": F.when(part % 17 == 0, " EP ").when(part % 17 == 1, "compilation"), "_type": F.when(part % 5 == 0, "video"), "duration": line["l_quantity"] * 10}
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FLAT_ENTRY.fields])


FULL_SQL = """full_meta as (select 'https://music.youtube.com/playlist?list=P' || p_partkey as full_url, p_size % 12 as n, p_size % 12 * 10.0::double as secs, 1990 + p_size as release_year
  from part where p_partkey % 3 = 0)"""


def full_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full records (schema FULL_PLAYLIST) of every third part."""
    n, part = F.col("p_size") % 12, F.col("p_partkey")
    entries = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.cast("string").alias("id"), F.lit(10.0).alias("duration"))))
    given = {"url": F.concat(F.lit("https://music.youtube.com/playlist?list=P"), part.cast("string")), "entries": entries, "release_year": 1990 + F.col("p_size")}
    return read_table(spark, sf_dir, "part").where(part % 3 == 0).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FULL_PLAYLIST.fields])


INFO_SQL = """info as (select *, case when many then n_list - (n_list >= 2)::int else 1 end as n_there from (select c_custkey as k, 'https://music.youtube.com/playlist?list=' || case when c_custkey % 4 = 1 and c_custkey < 800 then 'N' else 'C' end || c_custkey as url,
  c_custkey % 2 = 0 as many, case when c_custkey % 4 = 0 then 'OLAK5uy_' else 'PL' end || c_custkey as list_id, case when c_custkey % 7 <> 0 then c_name end as raw_title,
  case when c_custkey % 3 <> 0 then 'Artist ' || c_custkey end as raw_artist, case when c_custkey % 5 = 0 then '' else 'Up & Co ' || c_nationkey end as uploader,
  case when c_custkey % 15 <> 0 then 'Channel ' || c_nationkey end as channel, case when c_custkey % 6 <> 0 then 'Album ' || c_custkey end as raw_album,
  case when c_custkey % 8 = 0 then 0 else c_custkey % 12 end as stated, c_nationkey % 5 as n_list from customer)),
  described as (select k, url, coalesce(raw_title, 'Unknown') as title,
    case when many then coalesce(nullif(uploader, ''), channel, case when n_list > 0 and k % 10 <> 0 then 'EA1' when n_list > 0 then 'EU1' end, 'Unknown Artist')
      else coalesce(raw_artist, nullif(uploader, ''), channel, 'Unknown Artist') end as artist,
    case when many then coalesce(raw_title, 'Unknown Album') else coalesce(raw_album, raw_title, 'Unknown Album') end as album,
    case when not many then 'song' when starts_with(list_id, 'OLAK5uy_') then 'album' else 'playlist' end as download_type, n_there as total_tracks, n_there as done_tracks,
    case when many then coalesce(nullif(stated, 0), n_list) else 1 end as result_tracks from info)"""


def info_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Info records (schema INFO) of customers; every second entry of a list is missing."""
    key, nation, text = F.col("c_custkey"), F.col("c_nationkey"), lambda c: c.cast("string")
    entries = F.when(nation % 5 > 0, F.transform(F.sequence(F.lit(1), nation % 5), lambda i: F.when(i != 2, F.struct(
        text(i).alias("id"), F.when(key % 10 != 0, F.concat(F.lit("EA"), text(i))).alias("artist"), F.concat(F.lit("EU"), text(i)).alias("uploader"), F.lit("u").alias("url")))))
    given = {
        "url": F.concat(F.lit("https://music.youtube.com/playlist?list="), F.when((key % 4 == 1) & (key < 800), "N").otherwise("C"), text(key)), "_type": F.when(key % 2 == 0, "playlist"),
        "id": F.concat(F.when(key % 4 == 0, "OLAK5uy_").otherwise("PL"), text(key)), "title": F.when(key % 7 != 0, F.col("c_name")), "artist": F.when(key % 3 != 0, F.concat(F.lit("Artist "), text(key))),
        "uploader": F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("Up & Co "), text(nation))), "channel": F.when(key % 15 != 0, F.concat(F.lit("Channel "), text(nation))),
        "album": F.when(key % 6 != 0, F.concat(F.lit("Album "), text(key))), "playlist_count": F.when(key % 8 == 0, 0).otherwise(key % 12), "entries": F.when(key % 2 == 0, entries)}
    return read_table(spark, sf_dir, "customer").select(*[given[f.name].cast(f.dataType).alias(f.name) for f in INFO.fields])


WIDE_ITEMS_SQL = """wide_items as (select *, 'https://t/' || id as thumbnail, 'Channel ' || id % 50 as channel, 'https://x/@c' || id % 50 as channel_url, 'releases' as source_tab,
  timestamp '2024-01-01' + (id % 500) * interval 1 hour as created_at from items)"""


def wide_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id")
    of = (key % 50).cast("string")
    return items(spark, sf_dir).select(
        "*", F.concat(F.lit("https://t/"), key.cast("string")).alias("thumbnail"), F.concat(F.lit("Channel "), of).alias("channel"), F.concat(F.lit("https://x/@c"), of).alias("channel_url"),
        F.lit("releases").alias("source_tab"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id % 500 as int))").alias("created_at"))
