"""From a channel's flat entries to classified releases: explode, clean, enrich by a join, classify, filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import scalars as S
from ..operators.listing import first_per

#: How many entries a full record is read up to, and what stands in for a missing title.
FULL_ENTRIES = 100
UNTITLED = "Unknown Playlist"
#: Ids that a part of a job's snapshot spans.
PART_IDS = 1000


def full_metadata(playlists: DataFrame) -> DataFrame:
    """Full records (FULL_PLAYLIST) -> url, track_count of valid entries, total_duration and the other fields.

    Only the first entries count; valid ones have an id. Durations that are missing or 0 add nothing, and a total of 0 is null.
    """
    entries = F.slice(F.coalesce("entries", F.array().cast("array<struct<id:string,duration:double>>")), 1, FULL_ENTRIES)
    valid = F.filter(entries, lambda e: e.isNotNull() & (F.coalesce(e["id"], F.lit("")) != ""))
    total = F.aggregate(valid, F.lit(0.0), lambda s, e: s + F.coalesce(e["duration"], F.lit(0.0)))
    return playlists.select(
        "url", F.size(valid).cast("long").alias("track_count"), F.when(total > 0, total).alias("total_duration"),
        "playlist_count", "release_date", "release_year", "description", "availability", "modified_date", "view_count", "like_count")


def flat_entries(channels: DataFrame, tab: str = "releases", count_entries: bool = True, live: bool = True) -> DataFrame:
    """Channel records -> one row for each entry with a url or an id, in order: pos, id, url, title, track_count, ...

    ``count_entries``: without any count, the entries that the record itself lists are counted. ``live``: keep live
    albums. ``nth`` and ``of`` number the kept entries within their record. All this is done inside each record, which
    lists one channel, so nothing is shuffled.
    """
    texts = {"release_type": "explicit", "album_type": "album_type", "playlist_type": "playlist_type", "_type": "kind", "duration": "duration"}

    def named(e: Column, pos: Column) -> Column:
        key = S.first_true(e["id"], e["playlist_id"])
        link = S.first_true(e["url"], e["webpage_url"], F.when(S.first_true(key, F.lit(None).cast("string")).isNotNull(), S.playlist_url(key)))
        counts = S.first_true(*[e[n] for n in ("playlist_count", "n_entries", "entry_count", "video_count", "track_count")], empty=0)
        if count_entries:
            counts = F.coalesce(counts, F.when(F.size(e["entries"]) > 0, F.size(e["entries"]).cast("long")))
        thumb = S.first_true(F.try_element_at(e["thumbnails"], F.lit(-1))["url"], e["thumbnail"])
        return F.when(e.isNotNull(), F.struct(
            pos.alias("pos"), key.alias("id"), link.alias("url"), thumb.alias("thumbnail"), counts.alias("track_count"),
            S.first_true(e["title"], F.lit(UNTITLED)).alias("title"), F.lit(tab).alias("source_tab"), *[e[n].alias(to) for n, to in texts.items()]))

    kept = F.filter(F.transform("entries", named), lambda x: F.coalesce(x["url"], F.lit("")) != "")
    if not live:
        kept = F.filter(kept, lambda x: ~C.is_live(x["title"]))
    rows = channels.select(S.first_true(F.col("channel"), F.col("uploader"), F.col("title")).alias("channel"),
                           S.first_true(F.col("channel_url"), F.col("uploader_url")).alias("channel_url"), kept.alias("kept"))
    rows = rows.select("channel", "channel_url", F.size("kept").alias("of"), F.posexplode("kept").alias("nth", "e"))
    return rows.select("channel", "channel_url", (F.col("nth") + 1).alias("nth"), "of", "e.*")


def _classified(entries: DataFrame, full: DataFrame, extra: list[Column]) -> DataFrame:
    """Entries with their full metadata where there is any, its track count (also 0) first, and their type."""
    names = ["release_date", "release_year", "description", "total_duration", "view_count", "like_count"]
    more = full.select("url", F.col("track_count").alias("full_count"), *names)
    rows = entries.join(more, "url", "left").withColumn("track_count", F.coalesce("full_count", "track_count"))
    kind = C.release_type(F.col("source_tab"), F.col("title"), F.col("track_count"), F.col("kind"), F.col("duration"),
                          F.col("explicit"), F.col("album_type"), F.col("playlist_type"))
    return rows.withColumn("release_type", kind).where("release_type <> 'music_video'").select(
        "pos", "id", "title", "url", "thumbnail", "track_count", "channel", "channel_url", "source_tab", "release_type", *names, *extra)


def channel_releases(channels: DataFrame, full: DataFrame) -> DataFrame:
    """The listing path: a channel's first entry of each id (or url), then no live albums, enriched and without music videos."""
    entries = flat_entries(channels)
    key = F.struct("channel_url", S.first_true(F.col("id"), F.col("url")))
    entries = first_per(entries, key, F.col("pos")).where(~C.is_live(F.col("title")))
    return _classified(entries, full, [])


def processed_items(channels: DataFrame, full: DataFrame, job: str) -> DataFrame:
    """The processing path: no dedupe, no counting of listed entries; with the job's progress at each kept entry.

    Progress is 10 to 90 over all entries that are not live, also those left out later.
    """
    entries = flat_entries(channels, count_entries=False, live=False).withColumn("progress", 10 + F.col("nth") / F.col("of") * 80)
    return _classified(entries, full, [F.lit(job).alias("processing_job_id"), F.col("progress")])


def release_counts(items: DataFrame) -> DataFrame:
    return items.groupBy(F.coalesce("release_type", F.lit("unknown")).alias("release_type")).agg(F.count("*").alias("n"))


def release_buckets(items: DataFrame) -> DataFrame:
    return items.groupBy(C.release_bucket(F.col("release_type")).alias("bucket")).agg(F.count("*").alias("n"))


def job_snapshot_parts(items: DataFrame, part_ids: int = PART_IDS) -> DataFrame:
    """All items of each job in order as rows (processing_job_id, part, begin, end, metadata_results).

    A part spans ``part_ids`` ids, so its array has no more items than that, as ids are unique; parts without items have no
    row. ``begin`` and ``end`` are the positions of its first item and after its last in the job's whole list. Counts are
    summed over the parts of a job alone, one row each; the arrays are not moved for it.
    """
    names = [c for c in items.columns if c not in ("processing_job_id", "progress")]
    # an item goes as one struct, so that no column of its own clashes with the part's
    dealt = items.select("processing_job_id", F.floor(F.col("id") / part_ids).alias("part"), F.struct(*names).alias("item"))
    key = ["processing_job_id", "part"]
    end = F.sum("n").over(Window.partitionBy("processing_job_id").orderBy("part"))
    places = dealt.groupBy(*key).agg(F.count("*").alias("n")).select(*[F.col(c).alias(f"of_{c}") for c in key], (end - F.col("n")).alias("begin"), end.alias("end"))
    arrays = dealt.groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("metadata_results"))
    same = F.col("processing_job_id").eqNullSafe(F.col("of_processing_job_id")) & F.col("part").eqNullSafe(F.col("of_part"))
    return arrays.join(places, same).select(*key, "begin", "end", "metadata_results")


def normalise_info(info: DataFrame) -> DataFrame:
    """Info records -> title, artist, folder_artist, album, download_type, total_tracks."""
    entries = F.filter(F.coalesce("entries", F.array().cast(info.schema["entries"].dataType)), lambda e: e.isNotNull())
    first = F.try_element_at(entries, F.lit(1))
    many = F.coalesce(F.col("_type") == "playlist", F.lit(False))
    unknown = F.lit("Unknown Artist")
    artist = F.when(many, S.first_true(F.col("uploader"), F.col("channel"), first["artist"], first["uploader"], unknown)) \
        .otherwise(S.first_true(F.col("artist"), F.col("uploader"), F.col("channel"), unknown))
    titled = F.coalesce("title", F.lit("Unknown Album"))
    album = F.when(many, titled).otherwise(S.first_true(F.col("album"), titled))
    return info.select(
        "url", F.coalesce("title", F.lit("Unknown")).alias("title"), artist.alias("artist"), S.artist_folder(artist).alias("folder_artist"), album.alias("album"),
        C.download_type(F.col("url"), F.col("_type"), F.col("id")).alias("download_type"), F.when(many, F.size(entries)).otherwise(1).cast("long").alias("total_tracks"))


def download_result(info: DataFrame) -> DataFrame:
    """done_tracks: entries that are there; total_tracks: the stated count, or all entries. A single has one of one."""
    many = F.coalesce(F.col("_type") == "playlist", F.lit(False))
    listed = F.coalesce(F.size("entries"), F.lit(0))
    done = F.size(F.filter("entries", lambda e: e.isNotNull()))
    total = S.first_true(F.col("playlist_count"), listed.cast("long"), empty=0)
    return info.select("url", F.when(many, F.coalesce(done, F.lit(0))).otherwise(1).cast("long").alias("done_tracks"), F.when(many, total).otherwise(1).cast("long").alias("total_tracks"))
