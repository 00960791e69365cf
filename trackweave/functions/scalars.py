"""Column functions for text, numbers, dates and arrays of catalogue records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that file names must not have, the "featuring" tail, the tabs of a channel, accepted hosts.
UNSAFE = r'[<>:"/\\|?*\x00-\x1f]'
FEATURING = r"(?i)(?U)\s*[\(\[]?(?:feat(?:uring)?|ft)\.?\s+.+?[\)\]]?\s*$"
CHANNEL_TABS = r"/(videos|shorts|streams|about|community|featured|store|playlists|releases)$"
ACCEPTED_URL = r"(?i)^https?://((music\.|www\.|m\.)?youtube\.com/|youtu\.be/)"
PLAYLIST_URL = "https://www.youtube.com/playlist?list="
ALBUM_PREFIX = "OLAK5uy_"
RATE_LIMIT = "429|too many requests|rate limit|throttled"
LOCKED = "database is locked"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_true(*columns: Column, empty: object = "") -> Column:
    """The first that is neither null nor ``empty`` ('' or 0); the last one as it is."""
    return F.coalesce(*[F.nullif(c, F.lit(empty)) for c in columns[:-1]], columns[-1])


def safe_name(c: Column) -> Column:
    """A file name: unsafe characters go, white space runs become one space, no dots or spaces at the end."""
    spaced = strip(F.regexp_replace(F.regexp_replace(c, UNSAFE, ""), r"(?U)\s+", " "))
    return F.regexp_replace(spaced, r"[. ]+$", "")


def artist_folder(c: Column) -> Column:
    """The main artist as a folder name: before the first comma and ampersand, without a "featuring" tail.

    The tail needs no word boundary on its left, so "Daft Punk" gives "Da".
    """
    main = strip(F.substring_index(strip(F.substring_index(strip(c), ",", 1)), "&", 1))
    name = safe_name(strip(F.regexp_replace(main, FEATURING, "")))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("Unknown Artist"))


def track_title(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "Unknown Track").otherwise(safe_name(c))


def channel_root(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "/+$", ""), CHANNEL_TABS, "")


def playlist_url(playlist_id: Column) -> Column:
    return F.concat(F.lit(PLAYLIST_URL), playlist_id)


def is_accepted_url(url: Column) -> Column:
    return strip(url).rlike(ACCEPTED_URL)


def is_rate_limit(message: Column) -> Column:
    return F.lower(message).rlike(RATE_LIMIT)


def is_locked(message: Column) -> Column:
    return F.contains(message, F.lit(LOCKED))


def short_error(message: Column) -> Column:
    return F.substring(message, 1, 2048)


def short_id(job_id: Column) -> Column:
    return F.substring(job_id, 1, 8)


def release_label(artist: Column, album: Column, done_tracks: Column, total_tracks: Column) -> Column:
    """Artist and album with a dot between, without what is missing; done and all tracks if there are more than one."""
    tracks = F.concat(F.coalesce(done_tracks, F.lit(0)).cast("string"), F.lit(" / "), total_tracks.cast("string"), F.lit(" tracks"))
    return F.concat_ws(" · ", F.nullif(artist, F.lit("")), F.nullif(F.nullif(album, F.lit("Unknown Album")), F.lit("")), F.when(total_tracks > 1, tracks))


def mp3_quality(quality: Column) -> Column:
    plain = quality.rlike("^[0-9]+$") & (F.try_to_number(quality, F.lit("99999999999999999999")) <= 10)
    return F.when(plain, quality).otherwise(F.replace(quality, F.lit("k"), F.lit("")))


def origins(setting: Column) -> Column:
    """``*`` alone, or the parts between commas, trimmed, without blanks."""
    parts = F.filter(F.transform(F.split(setting, ","), strip), lambda x: x != "")
    return F.when(strip(setting) == "*", F.array(F.lit("*"))).otherwise(parts)


def counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n != 1, "s").otherwise(""))


def megabytes(n_bytes: Column) -> Column:
    """To one decimal; null for 0 and null. Halves round up."""
    return F.when(n_bytes > 0, F.round(n_bytes / 1048576, 1))


def size_label(mb: Column) -> Column:
    kilo = F.concat(F.lit("~"), F.floor(mb * 1024 + 0.5).cast("string"), F.lit(" KB"))
    return F.when(mb.isNull() | (mb == 0), "~Unknown size").when(mb < 1, kilo).otherwise(F.concat(F.lit("~"), F.format_string("%.1f", mb), F.lit(" MB")))


def overall_progress(p: Column) -> Column:
    """Percent of a playlist (struct PROGRESS); at most 99 until all is done; null for other events."""
    info = p["info_dict"]
    index, of = F.coalesce(info["playlist_index"], F.lit(1)), first_true(info["playlist_count"], F.coalesce(info["n_entries"], F.lit(1)), empty=0)
    total = first_true(p["total_bytes"], p["total_bytes_estimate"], F.lit(0), empty=0)
    part = F.when(total > 0, F.coalesce(p["downloaded_bytes"], F.lit(0)) / total).otherwise(0.0)
    return F.when(p["status"] == "downloading", F.least((index - 1 + part) / of * 100, F.lit(99.0))) \
        .when(p["status"] == "finished", F.least(index / of * 100, F.lit(99.0)))


def stored_progress(percent: Column) -> Column:
    """At most 99.9; null for what tells no progress."""
    return F.when(percent.isNotNull(), F.least(percent, F.lit(99.9)))


def batch_progress(queued: Column, skipped: Column, failed: Column, total: Column) -> Column:
    return F.when(total > 0, (queued + skipped + failed) / total * 100).otherwise(0.0)


def linear_backoff(base: Column, attempt: Column) -> Column:
    return base * attempt


def jittered_backoff(base: Column, attempt: Column, jitter: Column) -> Column:
    """``jitter`` from 0 to 1, such as ``F.rand(seed)``."""
    return base * F.pow(F.lit(2.0), attempt) * (0.5 + 0.5 * jitter)


def reconnect_delay(attempt: Column) -> Column:
    return F.least(1000 * F.pow(F.lit(2.0), attempt), F.lit(30000.0))


def throttle_wait(since_last: Column, interval: Column) -> Column:
    return F.greatest(interval - since_last, F.lit(0.0))


def iso(ts: Column) -> Column:
    """ISO 8601, with microseconds if there are any; null stays null."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def display_date(ts: Column) -> Column:
    return F.date_format(ts, "d MMM, hh:mm a")


def media_path(root: Column, artist: Column, album: Column, track: Column, title: Column, ext: Column) -> Column:
    """root/artist/album/NN - title.ext"""
    name = F.concat(F.lpad(track.cast("string"), 2, "0"), F.lit(" - "), track_title(title), F.lit("."), ext)
    return F.concat_ws("/", root, artist_folder(artist), safe_name(album), name)


def first_ids(ids: Column, shown: int = 5, n: Column | None = None) -> Column:
    """The first ids, and how many more there are: of ``n``, or of the array's own."""
    more = (F.size(ids) if n is None else n) - shown
    return F.concat(F.array_join(F.transform(F.slice(ids, 1, shown), lambda x: x.cast("string")), ", "),
                    F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def validation_message(errors: Column) -> Column:
    """``errors``: array of structs (loc array<string>, msg string)."""
    return F.array_join(F.transform(errors, lambda e: F.concat(F.array_join(e["loc"], "."), F.lit(": "), e["msg"])), ", ")


def toggled(selection: Column, item: Column) -> Column:
    return F.when(F.array_contains(selection, item), F.array_remove(selection, item)).otherwise(F.array_append(selection, item))


#: How states and types are shown.
STATE_LABELS = {"queued": "Queued", "downloading": "Downloading", "processing": "Processing", "completed": "Completed", "failed": "Failed", "cancelled": "Cancelled"}


def state_label(status: Column) -> Column:
    pairs = [F.lit(x) for kv in STATE_LABELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), status), status)


#: The colours of states and of release types, and what unknown ones have.
STATE_COLOURS = {"queued": "#F59E0B", "downloading": "#8B5CF6", "processing": "#8B5CF6", "completed": "#10B981", "failed": "#EF4444", "cancelled": "#6B7280"}
UNKNOWN_STATE = "queued"
RELEASE_COLOURS = {"album": "primary", "ep": "info", "single": "secondary", "playlist": "default"}
UNKNOWN_RELEASE = "default"


def _looked_up(table: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(other))


def state_colour(status: Column) -> Column:
    return _looked_up(STATE_COLOURS, status, STATE_COLOURS[UNKNOWN_STATE])


def release_colour(kind: Column) -> Column:
    return _looked_up(RELEASE_COLOURS, kind, UNKNOWN_RELEASE)
