"""Rules that classify releases, videos and URLs, as chains of conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import ALBUM_PREFIX, first_true, strip

#: What marks live albums and music videos in a lower-cased title.
LIVE = "|".join([
    r"\blive\b", r"\(live\)", r"\blive at\b", r"\blive from\b", r"\blive in\b", "in concert", "concert at", "recorded live",
    "live recording", "live session", "live performance", "at.*(?:arena|stadium|hall|center|theatre|theater|opera house|club)"])
VIDEO = "|".join([
    r"\(official\s+video\)", r"\(music\s+video\)", r"\(official\s+music\s+video\)", r"\(lyric\s+video\)", r"\(official\s+lyric\s+video\)",
    r"\(live\s+video\)", r"\(performance\s+video\)", r"\(visuali[sz]er\)", r"\(official\s+visuali[sz]er\)", r"\bmv\b", r"official\s+mv\b"])
VIDEO_SECONDS = (120, 480)
#: Word boundaries and white space of patterns are Unicode's on every version of Java.
UNICODE = "(?U)"
RELEASE_TYPES = ["album", "ep", "single", "playlist"]


def is_live(title: Column) -> Column:
    return F.lower(title).rlike(UNICODE + LIVE)


def is_music_video(title: Column, tracks: Column, kind: Column, duration: Column) -> Column:
    """One track or an unknown number, and a title, a type or a length (2 to 8 minutes) of a video."""
    lower = F.lower(title)
    one = F.coalesce(tracks == 1, F.lit(False))
    typed = F.contains(F.lower(F.coalesce(kind, F.lit(""))), F.lit("video"))
    long_enough = F.coalesce(duration.between(*VIDEO_SECONDS), F.lit(False)) & ~lower.rlike(UNICODE + r"(album|ep)\b")
    return (tracks.isNull() | (tracks == 1)) & (lower.rlike(UNICODE + VIDEO) | (one & typed) | (one & long_enough))


def release_type(tab: Column, title: Column, tracks: Column, kind: Column, duration: Column, *explicit: Column) -> Column:
    """playlist, music_video, album, ep or single. ``explicit``: types that the record itself gives, first one first."""
    given = F.lower(strip(first_true(*explicit))) if explicit else F.lit(None)
    lower = F.lower(title)
    chain = F.when(tab != "releases", "playlist").when(is_music_video(title, tracks, kind, duration), "music_video")
    chain = chain.when(given.isin("ep", "album", "single"), given)
    for name in ("single", "ep", "album"):
        chain = chain.when(lower.rlike(UNICODE + rf"[-–]\s*{name}\s*$"), name)
    return chain.when(tracks <= 4, "single").when(tracks <= 7, "ep").otherwise("album")


def release_bucket(kind: Column) -> Column:
    return F.when(kind.isin(RELEASE_TYPES), kind).otherwise("other")


def download_type(url: Column, kind: Column, playlist_id: Column) -> Column:
    lower = F.lower(url)
    return F.when(F.coalesce(kind, F.lit("")) != "playlist", "song") \
        .when(F.startswith(F.coalesce(playlist_id, F.lit("")), F.lit(ALBUM_PREFIX)), "album") \
        .when(F.contains(lower, F.lit("channel")) | F.contains(lower, F.lit("artist")), "artist").otherwise("playlist")
