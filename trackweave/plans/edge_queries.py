"""Queries over literal edge cases, which the driver's invented text has none of, and over status events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import scalars as S
from ..sources import fixtures as X
from ..sources.storage import new_folder, read_table
from ..streaming import status as T
from . import enrichment as E


def _sql_value(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        text = v.replace("'", "''")
        for control in {c for c in text if c < " "}:
            text = text.replace(control, f"' || chr({ord(control)}) || '")
        return f"'{text}'"
    return str(v)


def _literal(rows: list[tuple], schema: str):
    """Rows for Spark and, with the same names and types, for SQL."""
    kinds = {"string": "varchar", "long": "bigint", "double": "double", "boolean": "boolean"}
    fields = [f.split() for f in schema.split(", ")]
    inner = ", ".join(f'"c{i}"' for i in range(len(fields)))
    cast = ", ".join(f'"c{i}"::{kinds[k]} as "{n}"' for i, (n, k) in enumerate(fields))
    sql = f"edge as (select {cast} from (values {', '.join('(' + ', '.join(map(_sql_value, r)) + ')' for r in rows)}) v({inner}))"
    return (lambda spark: spark.createDataFrame(rows, schema)), sql


def _projected(rows: list[tuple], schema: str, name: str, expression: Callable[[], Column], sql: str, keep: str):
    make, values = _literal(rows, schema)
    return (lambda spark, sf_dir: make(spark).select(*keep.split(", "), expression().alias(name)), f"with {values} select {keep}, {sql} as {name} from edge")


ARTISTS = [(1, None), (2, ""), (3, "   "), (4, "Artist A, Artist B feat. Artist C"), (5, "Artist A feat. Artist B"), (6, "Artist A & Artist B"), (7, "A (ft. B)"),
           (8, "AC/DC"), (9, "Daft Punk"), (10, "Left Boy"), (11, "x ft.B"), (12, "Name..."), (13, "???"), (14, "  Spaced   Out "), (15, "A [featuring X Y]"), (16, "Tab\tbed"), (17, ", later")]
#: SQL of the same steps; the fixed patterns are stated in functions.scalars.
SAFE_SQL = r"""regexp_replace(trim(regexp_replace(regexp_replace({x}, '[<>:"/\\|?*\x00-\x1f]', '', 'g'), '\s+', ' ', 'g')), '[. ]+$', '')"""
MAIN_SQL = r"regexp_replace(trim(split_part(trim(split_part(trim(v), ',', 1)), '&', 1)), '\s*[\(\[]?(?:feat(?:uring)?|ft)\.?\s+.+?[\)\]]?\s*$', '', 'ig')"
FOLDER_SQL = "coalesce(nullif(" + SAFE_SQL.format(x=f"trim({MAIN_SQL})") + ", ''), 'Unknown Artist')"

TITLES = [(1, None), (2, ""), (3, 'a<b>c:"d"'), (4, "  two  words . "), (5, "..."), (6, "back\\slash|pipe?*")]
URLS = [(1, "https://youtube.com/watch?v=1"), (2, "http://WWW.YOUTUBE.COM/x"), (3, " https://music.youtube.com/playlist?list=A "), (4, "https://youtu.be/abc"), (5, "https://m.youtube.com/x"),
        (6, "ftp://youtube.com/x"), (7, "https://example.com/youtube.com/"), (8, "https://notyoutube.com/x"), (9, "youtube.com/x"), (10, "https://youtube.com")]
CHANNELS = [(1, "https://x/@A/releases"), (2, "https://x/@A/releases/"), (3, "https://x/@A//"), (4, "https://x/channel/UC1/videos"), (5, "https://x/@A/live"), (6, "https://x/releases/playlists"), (7, "https://x/@storefront")]

RELEASES = [
    ("releases", "Plain", 0, None, None, None), ("releases", "Plain", 4, None, None, None), ("releases", "Plain", 5, None, None, None), ("releases", "Plain", 7, None, None, None),
    ("releases", "Plain", 8, None, None, None), ("releases", "Plain", None, None, None, None), ("releases", "Plain", 12, None, " EP ", None), ("releases", "Plain", 12, None, "compilation", None),
    ("releases", "x – Single", 9, None, None, None), ("releases", "y - EP", 9, None, None, None), ("releases", "z - Album", 2, None, None, None),
    ("releases", "Song (Official Video)", None, None, None, None), ("releases", "Song (Official Video)", 1, None, "album", None), ("releases", "Song (Official Video)", 2, None, None, None),
    ("releases", "Song", 1, 119.0, None, None), ("releases", "Song", 1, 120.0, None, None), ("releases", "Song", 1, 480.0, None, None), ("releases", "Song", 1, 481.0, None, None),
    ("releases", "Step", 1, 200.0, None, None), ("releases", "Song", 1, None, None, "video"), ("releases", "Some MV", 1, None, None, None), ("releases", "Deep Visualiser (Visualiser)", None, None, None, None),
    ("playlists", "Plain", 3, None, None, None), ("releases", "The Album", 1, 200.0, None, None), ("releases", "y - ep  ", 9, None, None, None)]
RELEASE_SCHEMA = "tab string, title string, tracks long, duration double, explicit string, kind string"
#: The rules again, for the twins.
LIVE_RULE = r"\blive\b|\(live\)|\blive at\b|\blive from\b|\blive in\b|in concert|concert at|recorded live|live recording|live session|live performance|at.*(arena|stadium|hall|center|theatre|theater|opera house|club)"
VIDEO_RULE = r"\((official|music|official\s+music|lyric|official\s+lyric|live|performance)\s+video\)|\((official\s+)?visuali[sz]er\)|\bmv\b|official\s+mv\b"
TABS_RULE = "/(videos|shorts|streams|about|community|featured|store|playlists|releases)$"
VIDEO_SQL = f"""((tracks is null or tracks = 1) and (regexp_matches(lower(title), '{VIDEO_RULE}') or (coalesce(tracks = 1, false) and contains(lower(coalesce(kind, '')), 'video'))
  or (coalesce(tracks = 1, false) and coalesce(duration between 120 and 480, false) and not regexp_matches(lower(title), '(album|ep)\\b'))))"""
RELEASE_SQL = f"""case when tab <> 'releases' then 'playlist' when {VIDEO_SQL} then 'music_video' when lower(trim(explicit)) in ('ep', 'album', 'single') then lower(trim(explicit))
  when regexp_matches(lower(title), '[-–]\\s*single\\s*$') then 'single' when regexp_matches(lower(title), '[-–]\\s*ep\\s*$') then 'ep' when regexp_matches(lower(title), '[-–]\\s*album\\s*$') then 'album'
  when tracks <= 4 then 'single' when tracks <= 7 then 'ep' else 'album' end"""
LIVE_TITLES = [(i, t) for i, t in enumerate(["oh live ok", "Great Club", "Chat Hall", "Olive Session", "In Concert", "Alive", "Plain", "Live at Z", "X (Live)", "Recorded Live 1999", "Delivered", "At the Opera House", "Live Recording"])]
DOWNLOADS = [("https://x/playlist?list=1", None, "1"), ("https://x/playlist?list=2", "playlist", "OLAK5uy_abc"), ("https://x/channel/UC1", "playlist", "UC1"), ("https://x/@handle", "playlist", "UC2"),
             ("https://x/Artist/1", "playlist", None), ("https://x/playlist?list=OLAK5uy_zz", "playlist", "PL1"), ("https://x/channel/9", "video", "9")]
ERRORS = [(1, "HTTP Error 429: Too Many Requests"), (2, "Rate limit reached"), (3, "was throttled"), (4, "not found"), (5, None), (6, "database is locked"), (7, "too many REQUESTS")]
PROGRESS = [(1, "downloading", 100, None, 50, 1, 1, None), (2, "downloading", 0, 200, 50, 3, 10, None), (3, "downloading", None, None, 70, 2, None, 4), (4, "downloading", 100, None, 100, 1, 1, None),
            (5, "finished", None, None, None, 2, 4, None), (6, "finished", None, None, None, 4, 4, None), (7, "error", 1, 1, 1, 1, 1, 1), (8, "downloading", 10, None, None, None, None, None), (9, "downloading", 100, None, 25, 2, 0, 8)]
PROGRESS_SCHEMA = "k long, status string, total_bytes long, total_bytes_estimate long, downloaded_bytes long, playlist_index long, playlist_count long, n_entries long"
QUALITIES = [(1, "0"), (2, "10"), (3, "11"), (4, "320k"), (5, "192"), (6, "k128k"), (7, "")]
SIZES = [(1, None), (2, 0.0), (3, 0.5), (4, 0.99), (5, 1.0), (6, 12.34)]
CORS = [(1, "*"), (2, "http://a, http://b ,, "), (3, ""), (4, " * ")]
COALESCE = [(1, 0, None, 5), (2, None, 0, 0), (3, None, None, None), (4, 7, 0, 1), (5, 0, 0, 3)]



def _progress() -> Column:
    return F.struct("status", "total_bytes", "total_bytes_estimate", "downloaded_bytes", F.struct("playlist_index", "playlist_count", "n_entries").alias("info_dict"))


_total = "coalesce(nullif(total_bytes, 0), nullif(total_bytes_estimate, 0), 0)"
_index, _of = "coalesce(playlist_index, 1)", "coalesce(nullif(playlist_count, 0), coalesce(n_entries, 1))"
PROGRESS_SQL = f"""case when status = 'downloading' then least(({_index} - 1 + case when {_total} > 0 then coalesce(downloaded_bytes, 0)::double / {_total} else 0.0 end) / {_of} * 100, 99.0)
  when status = 'finished' then least({_index}::double / {_of} * 100, 99.0) end"""

CHANNEL = ("Band", None, None, "https://x/@band", None)
FLAT = [  # pos, id, playlist_id, url, title, playlist_count, track_count, listed entries, duration
    (0, "a", None, "ua", "First", 3, None, 0, None), (1, "a", None, "ua2", "First again", 3, None, 0, None), (2, None, "b", None, "From id", 0, 6, 0, None), (3, None, None, None, "Nothing", 1, None, 0, None),
    (4, "c", None, "uc", None, None, None, 9, None), (5, "d", None, "ud", "Live at Home", 8, None, 0, None), (6, "e", None, "ue", "Song (Official Video)", 1, None, 0, None), (7, "f", None, "uf", "Full", 2, None, 0, None),
    (8, "g", None, "ug", "Empty full", 12, None, 0, None), (9, "h", None, "uh", "Plain", None, None, 0, None), (10, "i", None, "ui", "Nine - EP", 9, None, 0, 300.0)]
FULL = [("uf", 9, 2001), ("ug", 0, None), ("unknown", 3, 1999)]


def _channels(spark: SparkSession) -> DataFrame:
    from ..schemas import CHANNEL as CHANNEL_SCHEMA

    entries = [{"id": i, "playlist_id": p, "url": u, "title": t, "playlist_count": c, "track_count": n, "entries": [{"id": str(k)} for k in range(e)] or None, "duration": d}
               for _, i, p, u, t, c, n, e, d in FLAT]
    names = ("channel", "uploader", "title", "channel_url", "uploader_url")
    full = [{f: x.get(f) for f in CHANNEL_SCHEMA["entries"].dataType.elementType.names} for x in entries]
    return spark.createDataFrame([dict(zip(names, CHANNEL, strict=True)) | {"entries": [None, *full]}], CHANNEL_SCHEMA)


def _full(spark: SparkSession) -> DataFrame:
    from ..schemas import FULL_PLAYLIST

    rows = [{"url": u, "entries": [{"id": f"{u}{k}", "duration": 10.0} for k in range(n)], "release_year": y} for u, n, y in FULL]
    return E.full_metadata(spark.createDataFrame([{f: r.get(f) for f in FULL_PLAYLIST.names} for r in rows], FULL_PLAYLIST))


def _flat_sql(dedupe: bool, listed: bool) -> str:
    _, flat = _literal(FLAT, "pos long, id string, playlist_id string, url string, raw_title string, playlist_count long, track_count long, listed long, duration double")
    _, full = _literal(FULL, "url string, n long, release_year long")
    count = "coalesce(nullif(playlist_count, 0), track_count" + (", case when listed > 0 then listed end" if listed else "") + ")"
    first = "qualify row_number() over (partition by coalesce(key, link) order by pos) = 1" if dedupe else ""
    return f"""with {flat}, {full.replace('edge as', 'full_meta as')}, named as (select pos, coalesce(nullif(id, ''), playlist_id) as key, raw_title, {count} as tracks, duration,
      coalesce(nullif(url, ''), 'https://www.youtube.com/playlist?list=' || coalesce(nullif(id, ''), playlist_id)) as link from edge),
    usable as (select *, coalesce(nullif(raw_title, ''), 'Unknown Playlist') as title, 'releases' as tab, null::varchar as explicit, null::varchar as kind from named where link is not null {first}),
    studio as (select *, row_number() over (order by pos) as idx, count(*) over () as n_all from usable where not regexp_matches(lower(title), '{LIVE_RULE}')),
    rich as (select studio.* replace (coalesce(full_meta.n, tracks) as tracks), release_year, full_meta.n * 10.0::double as secs from studio left join full_meta on link = url),
    typed as (select *, {RELEASE_SQL} as release_type from rich)"""


def _duration_sql() -> str:
    return "case when secs > 0 then secs end as total_duration"


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest(X.status_events(spark, sf_dir)).select("key", "status", "seq", "value")


def _latest_stream(spark: SparkSession, sf_dir: str, every: str | None = None) -> DataFrame:
    schema = read_table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    latest = T.latest(X.as_status_events(stream)).select("key", "status", "seq", "value")
    return T.run(latest, spark, new_folder(spark, "latest"), every)


def _snapshot_then_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.status_events(spark, sf_dir)
    return T.with_snapshot(T.latest(events.where("seq % 2 = 0")), events.where("seq % 2 = 1")).select("key", "status", "seq", "value")


LATEST_SQL = f"with {X.EVENTS_SQL} select key, status, seq, value from status_events qualify row_number() over (partition by key order by ts desc, seq desc) = 1"

FRAMES = [(1, '{"type": "download_update", "data": {"id": 1, "status": "queued", "progress": 0.0}}'), (2, "not json"), (3, '{"type": "metadata_progress", "data": {"id": 2, "status": "processing", "progress": 40.5}}'),
          (4, '{"type": "download_update", "data": {"id": 3, "status": "failed", "progress": 12.5}}'), (5, '{"data": {}}'), (6, "")]
_frames, _ = _literal(FRAMES, "k long, value string")

INFOS = [("https://x/1", None, "1", "Song", "A", "U", "C", "Al", None, None), ("https://x/2", None, "2", "Song", None, "", "C", None, None, None), ("https://x/p", "playlist", "OLAK5uy_1", "Set", None, None, None, None, 5, [None, ("1", "EA", "EU", "u1"), ("2", None, None, "u2")]),
         ("https://x/channel/3", "playlist", "PL", None, None, "Up & Co", "C", None, None, []), ("https://x/5", None, "5", None, "", None, None, "", None, None)]
INFO_RESULTS = [("https://x/1", "Song", "A", "A", "Al", "song", 1, 1, 1), ("https://x/2", "Song", "C", "C", "Song", "song", 1, 1, 1), ("https://x/p", "Set", "EA", "EA", "Set", "album", 2, 2, 5),
                ("https://x/channel/3", "Unknown", "Up & Co", "Up", "Unknown Album", "artist", 0, 0, 0), ("https://x/5", "Unknown", "Unknown Artist", "Unknown Artist", "Unknown Album", "song", 1, 1, 1)]


def _infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..schemas import INFO

    info = spark.createDataFrame(INFOS, INFO)
    return E.normalise_info(info).join(E.download_result(info).withColumnRenamed("total_tracks", "result_tracks"), "url")


QUERIES = {
    "artist_folder": _projected(ARTISTS, "k long, v string", "folder", lambda: S.artist_folder(F.col("v")), FOLDER_SQL, "k"),
    "artist_folder_of_parts": (lambda s, d: X.searchable(s, d).select("id", S.artist_folder(F.col("title")).alias("folder")), f"with {X.SEARCHABLE_SQL} select id, {FOLDER_SQL.replace('trim(v)', 'trim(title)')} as folder from searchable"),
    "safe_text": (lambda s, d: read_table(s, d, "documents").select("doc_id", F.md5(S.safe_name(F.col("text")).cast("binary")).alias("digest")), "select doc_id, md5(" + SAFE_SQL.format(x="text") + ") as digest from documents"),
    "track_titles": _projected(TITLES, "k long, v string", "title", lambda: S.track_title(F.col("v")), "case when coalesce(v, '') = '' then 'Unknown Track' else " + SAFE_SQL.format(x="v") + " end", "k"),
    "url_valid": _projected(URLS, "k long, v string", "ok", lambda: S.is_accepted_url(F.col("v")), r"regexp_matches(trim(v), '^https?://((music\.|www\.|m\.)?youtube\.com/|youtu\.be/)', 'i')", "k"),
    "page_urls_valid": (lambda s, d: read_table(s, d, "pages").groupBy(S.is_accepted_url(F.col("url")).alias("ok")).agg(F.count("*").alias("n")),
                        r"select regexp_matches(trim(url), '^https?://((music\.|www\.|m\.)?youtube\.com/|youtu\.be/)', 'i') as ok, count(*) as n from pages group by 1"),
    "channel_root": _projected(CHANNELS, "k long, v string", "root", lambda: S.channel_root(F.col("v")), f"regexp_replace(regexp_replace(v, '/+$', ''), '{TABS_RULE}', '')", "k"),
    "page_root": (lambda s, d: read_table(s, d, "pages").select("page_id", S.channel_root(F.col("url")).alias("root")), f"select page_id, regexp_replace(regexp_replace(url, '/+$', ''), '{TABS_RULE}', '') as root from pages"),
    "classify_edge": _projected(RELEASES, RELEASE_SCHEMA, "release_type", lambda: C.release_type(F.col("tab"), F.col("title"), F.col("tracks"), F.col("kind"), F.col("duration"), F.col("explicit")), RELEASE_SQL, "title, tracks, duration, explicit, kind"),
    "music_video_edge": _projected(RELEASES, RELEASE_SCHEMA, "is_video", lambda: C.is_music_video(F.col("title"), F.col("tracks"), F.col("kind"), F.col("duration")), VIDEO_SQL, "title, tracks, duration, kind"),
    "live_edge": _projected(LIVE_TITLES, "k long, v string", "live", lambda: C.is_live(F.col("v")), f"regexp_matches(lower(v), '{LIVE_RULE}')", "k"),
    "download_type_edge": _projected(DOWNLOADS, "url string, kind string, id string", "download_type", lambda: C.download_type(F.col("url"), F.col("kind"), F.col("id")),
                                     "case when coalesce(kind, '') <> 'playlist' then 'song' when starts_with(coalesce(id, ''), 'OLAK5uy_') then 'album' when contains(lower(url), 'channel') or contains(lower(url), 'artist') then 'artist' else 'playlist' end", "url"),
    "rate_limit_errors": _projected(ERRORS, "k long, v string", "limited", lambda: S.is_rate_limit(F.col("v")), "regexp_matches(lower(v), '429|too many requests|rate limit|throttled')", "k"),
    "locked_errors": _projected(ERRORS, "k long, v string", "locked", lambda: S.is_locked(F.col("v")), "contains(v, 'database is locked')", "k"),
    "mp3_quality": _projected(QUALITIES, "k long, v string", "quality", lambda: S.mp3_quality(F.col("v")), "case when regexp_matches(v, '^[0-9]+$') and try_cast(v as bigint) <= 10 then v else replace(v, 'k', '') end", "k"),
    "size_labels": _projected(SIZES, "k long, mb double", "label", lambda: S.size_label(F.col("mb")), "case when mb is null or mb = 0 then '~Unknown size' when mb < 1 then '~' || floor(mb * 1024 + 0.5)::bigint || ' KB' else '~' || printf('%.1f', mb) || ' MB' end", "k"),
    "origin_lists": _projected(CORS, "k long, v string", "origins", lambda: F.array_join(S.origins(F.col("v")), ";"), "case when trim(v) = '*' then '*' else array_to_string(list_filter(list_transform(string_split(v, ','), lambda x: trim(x)), lambda x: x <> ''), ';') end", "k"),
    "first_true": _projected(COALESCE, "k long, a long, b long, c long", "x", lambda: S.first_true(F.col("a"), F.col("b"), F.col("c"), empty=0), "coalesce(nullif(a, 0), nullif(b, 0), c)", "k"),
    "progress_overall": _projected(PROGRESS, PROGRESS_SCHEMA, "progress", lambda: S.stored_progress(S.overall_progress(_progress())), f"(select case when x is not null then least(x, 99.9) end from (select {PROGRESS_SQL} as x))", "k"),
    "backoff": (lambda s, d: s.range(0, 8).select(F.col("id").alias("attempt"), S.linear_backoff(F.lit(60), F.col("id")).alias("linear"), S.jittered_backoff(F.lit(0.1), F.col("id"), F.lit(0.5)).alias("jittered"), S.reconnect_delay(F.col("id")).alias("reconnect")),
                "select i as attempt, 60 * i as linear, 0.1::double * pow(2.0::double, i) * (0.5::double + 0.5::double * 0.5::double) as jittered, least(1000 * pow(2.0, i), 30000.0)::double as reconnect from range(0, 8) t(i)"),
    "media_paths": (lambda s, d: X.searchable(s, d).select("id", S.media_path(F.lit("/music"), F.col("artist"), F.col("album"), F.col("id") % 100, F.col("title"), F.lit("mp3")).alias("path")),
                    f"with {X.SEARCHABLE_SQL} select id, '/music/' || {FOLDER_SQL.replace('trim(v)', 'trim(artist)')} || '/' || {SAFE_SQL.format(x='album')} || '/' || lpad((id % 100)::varchar, 2, '0') || ' - ' || {SAFE_SQL.format(x='title')} || '.mp3' as path from searchable"),
    "validation_messages": (lambda s, d: s.createDataFrame([(1, [(["body", "url"], "bad"), (["q"], "long")])], "k long, e array<struct<loc:array<string>,msg:string>>").select("k", S.validation_message(F.col("e")).alias("message")),
                            "select 1::bigint as k, 'body.url: bad, q: long' as message"),
    "info_records": (_infos, f"with {_literal(INFO_RESULTS, 'url string, title string, artist string, folder_artist string, album string, download_type string, total_tracks long, done_tracks long, result_tracks long')[1]} select * from edge"),
    "channel_releases": (lambda s, d: E.channel_releases(_channels(s), _full(s)).select("id", "title", "url", "track_count", "release_type", "release_year", "total_duration"),
                         _flat_sql(True, True) + f"select key as id, title, link as url, tracks as track_count, release_type, release_year, {_duration_sql()} from typed where release_type <> 'music_video'"),
    "processed_items": (lambda s, d: E.processed_items(_channels(s), _full(s), "j").select("id", "title", "url", "track_count", "release_type", F.round("progress", 6).alias("progress")),
                        _flat_sql(False, False) + "select key as id, title, link as url, tracks as track_count, release_type, round(10 + idx / n_all * 80, 6) as progress from typed where release_type <> 'music_video'"),
    "frame_routing": (lambda s, d: T.route(T.parse_frames(_frames(s)), "download_update").select("id", "status", "progress"), "select * from (values (1::bigint, 'queued', 0.0::double), (3, 'failed', 12.5)) t(id, status, progress)"),
    "latest_status_batch": (_latest, LATEST_SQL),
    "latest_status_stream": (_latest_stream, LATEST_SQL),
    "polled_status_stream": (lambda s, d: _latest_stream(s, d, "2 seconds"), LATEST_SQL),
    "snapshot_then_deltas": (_snapshot_then_deltas, LATEST_SQL),
}
