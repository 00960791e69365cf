"""Schemas of the tables, of the extractor's nested records and of status events."""

from __future__ import annotations

from pyspark.sql import types as T


_SIMPLE = {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType()}


def _parts(text: str) -> list[str]:
    """Split at commas outside of angle brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _type(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(_type(text[6:-1]))
    if text.startswith("struct<"):
        return T.StructType([T.StructField(n, _type(t)) for n, t in (x.split(":", 1) for x in _parts(text[7:-1]))])
    return _SIMPLE[text]


def _struct(text: str) -> T.StructType:
    """"name type[ not null], ..." as a schema, without a session."""
    fields = []
    for part in _parts(text):
        name, kind = part.removesuffix(" not null").split(" ", 1)
        fields.append(T.StructField(name, _type(kind), not part.endswith(" not null")))
    return T.StructType(fields)


DOWNLOADS = _struct(
    "id long not null, url string not null, title string, artist string, album string, download_type string not null, "
    "status string not null, progress double not null, error_message string, file_path string, total_tracks long, "
    "done_tracks long, format_id string, created_at timestamp_ntz, updated_at timestamp_ntz")
QUEUED = _struct("id long, url string, title string, status string, progress double")
PROCESSING_ITEMS = _struct(
    "id long not null, processing_job_id string not null, playlist_id string, title string not null, url string not null, "
    "thumbnail string, track_count long, channel string, channel_url string, source_tab string, release_type string, "
    "selected_for_download boolean not null, release_date string, release_year long, description string, "
    "total_duration long, view_count long, like_count long, created_at timestamp_ntz")
FLAT_ENTRY = _struct(
    "id string, playlist_id string, url string, webpage_url string, title string, thumbnail string, "
    "thumbnails array<struct<url:string>>, playlist_count long, n_entries long, entry_count long, video_count long, "
    "track_count long, entries array<struct<id:string>>, release_type string, album_type string, playlist_type string, "
    "_type string, duration double")
CHANNEL = T.StructType([
    T.StructField("channel", T.StringType()), T.StructField("uploader", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("channel_url", T.StringType()), T.StructField("uploader_url", T.StringType()),
    T.StructField("entries", T.ArrayType(FLAT_ENTRY))])
FULL_PLAYLIST = _struct(
    "url string, entries array<struct<id:string,duration:double>>, playlist_count long, release_date string, release_year long, "
    "description string, availability string, modified_date string, view_count long, like_count long")
FORMAT = _struct("format_id string, ext string, acodec string, vcodec string, abr double, tbr double, filesize long, filesize_approx long")
INFO = _struct(
    "url string, _type string, id string, title string, artist string, uploader string, channel string, album string, "
    "playlist_count long, entries array<struct<id:string,artist:string,uploader:string,url:string>>")
PROGRESS = _struct(
    "status string, total_bytes long, total_bytes_estimate long, downloaded_bytes long, "
    "info_dict struct<playlist_index:long,playlist_count:long,n_entries:long>")
FRAME = _struct("type string, data struct<id:long,status:string,progress:double,updated_at:string>")
PROCESSING_JOBS = T.StructType([
    *_struct("id string not null, channel_url string not null, channel_name string, status string not null, progress double not null, "
             "total_items long, processed_items long not null, error_message string").fields,
    T.StructField("metadata_results", T.ArrayType(_struct(
        "id string, title string, url string, thumbnail string, track_count long, channel string, channel_url string, source_tab string, "
        "release_type string, release_date string, release_year long, description string, total_duration long, view_count long, like_count long"))),
    *_struct("created_at timestamp_ntz, updated_at timestamp_ntz").fields])

#: The states of a download and of a processing job.
DOWNLOAD_STATES = ["queued", "downloading", "processing", "completed", "failed", "cancelled"]
PROCESSING_STATES = ["pending", "processing", "completed", "failed", "cancelled"]
