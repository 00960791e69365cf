"""All registered queries of the library proper, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import api_queries, catalogue_queries, edge_queries, list_queries, route_queries, stream_queries, table_queries

Pair = tuple[Callable[[SparkSession, str], DataFrame], str]

_ALL: dict[str, Pair] = list_queries.QUERIES | catalogue_queries.QUERIES | edge_queries.QUERIES | api_queries.QUERIES | route_queries.QUERIES | stream_queries.QUERIES | table_queries.QUERIES
#: Edge cases on literal rows, which tests compare with SQL; no table is read, so they are no queries.
_LITERAL = set("""artist_folder track_titles url_valid channel_root classify_edge music_video_edge live_edge download_type_edge rate_limit_errors locked_errors mp3_quality size_labels
origin_lists first_true progress_overall backoff validation_messages info_records channel_releases processed_items frame_routing page_pills selection_toggle fallback_formats""".split())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items() if name not in _LITERAL}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if name not in _LITERAL}


def cases() -> dict[str, Pair]:
    return {name: _ALL[name] for name in sorted(_LITERAL)}
