"""Queries over releases, items, formats and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import scalars as S
from ..operators import formats as M
from ..operators import listing as L
from ..operators import queue as Q
from ..sources import fixtures as X
from . import enrichment as E

R = f"with {X.RELEASES_SQL} "
I = f"with {X.RELEASES_SQL}, {X.ITEMS_SQL} "
FM = f"with {X.FORMATS_SQL} "
ITEM = ["id", "processing_job_id", "playlist_id", "title", "url", "track_count", "release_type", "selected_for_download", "release_year"]


def release_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    kind = C.release_type(F.lit("releases"), F.col("title"), F.col("track_count"), none, F.lit(None).cast("double"))
    return E.release_counts(X.releases(spark, sf_dir).withColumn("release_type", kind))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a full record, its lines as entries in order; some without an id."""
    from ..sources.storage import read_table

    line = read_table(spark, sf_dir, "lineitem")
    entry = F.struct(F.when(F.col("l_partkey") % 9 == 0, "").otherwise(F.concat(F.lit("v"), F.col("l_partkey").cast("string"))).alias("id"),
                     F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("duration"))
    whole = line.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", entry.alias("e")))), lambda x: x["e"]).alias("entries"))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    return whole.select(F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("url"), "entries", number.alias("playlist_count"), text.alias("release_date"), number.alias("release_year"),
                        text.alias("description"), text.alias("availability"), text.alias("modified_date"), number.alias("view_count"), number.alias("like_count"))


def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.format_options(X.formats(spark, sf_dir))


AUDIO_SQL = FM + """, audio as (select record, pos, format_id, ext, acodec as codec, coalesce(nullif(abr, 0), nullif(tbr, 0), 0) as quality, coalesce(nullif(filesize, 0), filesize_approx) as filesize
  from formats where vcodec = 'none' and acodec <> 'none'),
  dedup as (select record, format_id, codec, min(pos) as pos, max_by(ext, pos) as ext, max_by(quality, pos) as quality, max_by(filesize, pos) as filesize from audio group by record, format_id, codec),
  placed as (select *, row_number() over w as place, first_value(format_id) over w as best from dedup window w as (partition by record order by quality desc, pos)),
  ranked as (select *, sum(case when place > 1 and format_id <> best then 1 else 0 end) over (partition by record order by place) as rank from placed),
  kept as (select * from ranked where (place = 1 or format_id <> best) and rank <= 3),
  options as (select record, rank::bigint as rank, format_id, case when place = 1 then 'Best Quality (' || upper(codec) || ', ~' || trunc(quality)::bigint || 'kbps)' else upper(codec) || ' (~' || trunc(quality)::bigint || 'kbps)' end as label,
    ext, codec, trunc(quality)::bigint as bitrate, case when filesize > 0 then round(filesize / 1048576, 1) end as filesize_mb, place = 1 as recommended from kept
  union all select record, 4, 'bestaudio/best', 'Auto-select Best', 'auto', null, null, null, count(*) filter (vcodec = 'none' and acodec <> 'none') = 0 from formats group by record)
  select * from options"""


def _items(f):
    return lambda spark, sf_dir: f(X.items(spark, sf_dir))


def _visible(items: DataFrame, *kinds: str) -> DataFrame:
    return Q.visible(items, list(kinds)).select("id")


def _selection(items: DataFrame) -> DataFrame:
    return items.where("selected_for_download").select("id")


QUERIES = {
    "release_histogram": (release_histogram, R + "select case when track_count <= 4 then 'single' when track_count <= 7 then 'ep' else 'album' end as release_type, count(*) as n from releases group by 1"),
    "release_type_buckets": (_items(E.release_buckets), I + "select case when release_type in ('album', 'ep', 'single', 'playlist') then release_type else 'other' end as bucket, count(*) as n from items group by 1"),
    "release_type_counts": (_items(E.release_counts), I + "select coalesce(release_type, 'unknown') as release_type, count(*) as n from items group by 1"),
    "total_duration": (lambda s, d: X.releases(s, d).select("id", F.when(F.col("total_duration") > 0, F.col("total_duration")).alias("total_duration")),
                       R + "select id, case when total_duration > 0 then total_duration end as total_duration from releases"),
    "entries_nested_whole": (lambda s, d: E.full_metadata(_nested(s, d)).select("url", "track_count", "total_duration"),
                             """with numbered as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as rn from lineitem)
                             select 'u' || l_orderkey as url, count(*) filter (l_partkey % 9 <> 0) as track_count,
                             nullif(coalesce(sum(l_quantity) filter (l_partkey % 9 <> 0 and l_quantity > 10), 0), 0) as total_duration from numbered where rn <= 100 group by l_orderkey"""),
    "format_options": (_options, AUDIO_SQL),
    "default_format": (lambda s, d: M.default_format(_options(s, d)), AUDIO_SQL.replace("select * from options", "select record, coalesce(min_by(format_id, rank) filter (recommended), min_by(format_id, rank)) as format_id from options group by record")),
    "fallback_formats": (lambda s, d: M.fallback_options(s.createDataFrame([(1,), (2,)], "record long")),
                         "select * from (values (1::bigint), (2::bigint)) r(record), (values " + ", ".join(f"({a}, '{b}', '{c}', '{e}', {'null' if f is None else repr(f)}, {str(g).lower()})" for a, b, c, e, f, g in M.FALLBACK)
                         + ") f(rank, format_id, label, ext, codec, recommended)"),
    "item_wire": (_items(lambda i: i.select(*ITEM)), I + f"select {', '.join(ITEM)} from items"),
    "items_page": (_items(lambda i: L.page(i.where("processing_job_id = 'j1'").orderBy("id"), 1000, 0, 5000).select("id", "title")), I + "select id, title from items where processing_job_id = 'j1' order by id limit 1000"),
    "selected_to_queue": (_items(lambda i: Q.queue_selected(i, "j1").select(F.col("playlist_id").alias("id"), "title", "url", "track_count", "release_type")),
                          I + "select playlist_id as id, title, url, track_count, release_type from items where processing_job_id = 'j1' and selected_for_download"),
    "visible_types": (_items(lambda i: Q.visible(i, ["ep", "single"]).select("id", "release_type")), I + "select id, release_type from items where release_type in ('ep', 'single')"),
    "selection_union": (_items(lambda i: Q.add_to_selection(_selection(i), _visible(i, "ep"))), I + "select id from items where selected_for_download union select id from items where release_type = 'ep'"),
    "selection_except": (_items(lambda i: Q.remove_from_selection(_selection(i), _visible(i, "ep"))), I + "select id from items where selected_for_download except select id from items where release_type = 'ep'"),
    "selection_visible": (_items(lambda i: _visible(i, "album", "ep")), I + "select id from items where release_type in ('album', 'ep')"),
    "selection_toggle": (lambda s, d: s.createDataFrame([(1, [1, 2, 3], 2), (2, [1, 3], 2), (3, [], 5)], "k long, ids array<long>, item long").select("k", F.array_join(F.transform(S.toggled(F.col("ids"), F.col("item")), lambda x: x.cast("string")), ",").alias("ids")),
                         "select * from (values (1::bigint, '1,3'), (2::bigint, '1,3,2'), (3::bigint, '5')) t(k, ids)"),
    "type_fully_selected": (_items(lambda i: Q.all_selected(i.where("release_type = 'ep'"))), I + "select coalesce(bool_and(selected_for_download), false) as all_selected from items where release_type = 'ep'"),
    "no_type_fully_selected": (_items(lambda i: Q.all_selected(i.where("release_type = 'nothing'"))), I + "select coalesce(bool_and(selected_for_download), false) as all_selected from items where release_type = 'nothing'"),
    "select_items": (_items(lambda i: Q.select_items(i, i.where("id % 7 = 0").select("id")).select("id", "selected_for_download")),
                     I + "select id, selected_for_download or id % 7 = 0 as selected_for_download from items"),
    "deselect_items": (_items(lambda i: Q.select_items(i, i.where("id % 8 = 0").select("id"), False).select("id", "selected_for_download")),
                       I + "select id, selected_for_download and id % 8 <> 0 as selected_for_download from items"),
    "updated_count": (_items(lambda i: Q.updated_count(i, i.where("id % 7 = 0").select("id"))), I + "select count(*) as updated_count from items where id % 7 = 0"),
    "job_snapshot_whole": (_items(lambda i: E.job_snapshot_parts(i).select("processing_job_id", "part", "begin", "end", F.array_join(F.transform("metadata_results", lambda x: x["id"].cast("string")), ",").alias("ids"))),
                           I + f"""select processing_job_id, part, min(rn) - 1 as begin, max(rn) as "end", string_agg(id, ',' order by id) as ids
                           from (select processing_job_id, id, floor(id / {E.PART_IDS})::bigint as part, row_number() over (partition by processing_job_id order by id) as rn from items) group by all"""),
}
#: Both names read whole tables; a job's ids come in parts of bounded size.
QUERIES |= {name: QUERIES[f"{name}_whole"] for name in ("entries_nested", "job_snapshot")}
