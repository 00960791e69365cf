"""Filtered lists of rows: search, counts, pages and wire projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..schemas import DOWNLOAD_STATES


def find(rows: DataFrame, status: str | None = None, search: str | None = None) -> DataFrame:
    """Rows with the status whose title, artist or album matches the search pattern; both optional."""
    found = rows.where(P.has_status(F.col("status"), status))
    return found.where(P.matches_pattern(search, F.col("title"), F.col("artist"), F.col("album"))) if search else found


def find_in_client(rows: DataFrame, tab: str = "all", search: str = "") -> DataFrame:
    """Rows of a tab (all, active or a status) that hold the search text as it stands."""
    found = rows if tab == "all" else rows.where(F.col("status").isin(P.ACTIVE_IN_CLIENT)) if tab == "active" else rows.where(F.col("status") == tab)
    return found.where(P.contains_text(search, F.col("title"), F.col("artist"), F.col("album")))


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("created_at"), F.desc("id"))


def oldest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.asc_nulls_first("created_at"), "id")


def page(rows: DataFrame, limit: int, offset: int = 0, most: int = 1000) -> DataFrame:
    """A page of ordered rows; a top-k of limit + offset rows on each task, not a sort of all."""
    P.checked_page(limit, offset, most)
    return rows.offset(offset).limit(limit) if offset else rows.limit(limit)


def page_after(rows: DataFrame, last: tuple[object, int] | None, limit: int, most: int = 1000) -> DataFrame:
    """The page, newest first, behind the row with (created_at, id) ``last``; the first page for None.

    What it costs does not grow with the rows before it: each task keeps ``limit`` of those behind the cursor, which the
    scan filters by. Rows that are added meanwhile, newer than the cursor, shift nothing. Without a time means the end of the list.
    """
    P.checked_page(limit, 0, most)
    if last is None:
        return newest_first(rows).limit(limit)
    at, key = F.lit(last[0]).cast(rows.schema["created_at"].dataType), F.col("id") < F.lit(last[1])
    time = F.col("created_at")
    behind = time.isNull() & key if last[0] is None else ((time <= at) | time.isNull()) & ((time < at) | time.isNull() | key)
    return newest_first(rows.where(behind)).limit(limit)


def cursor(page_rows: DataFrame) -> tuple[object, int] | None:
    """(created_at, id) of a page's last row; None for an empty page, behind which there is nothing."""
    last = page_rows.orderBy(F.asc_nulls_first("created_at"), "id").select("created_at", "id").first()
    return None if last is None else tuple(last)


def envelope(rows: DataFrame, limit: int, offset: int = 0, most: int = 1000) -> DataFrame:
    """One row: how many rows there are, how many the page has, and whether more follow."""
    P.checked_page(limit, offset, most)
    total = F.count("*")
    size = F.least(F.greatest(total - offset, F.lit(0)), F.lit(limit))
    return rows.agg(total.alias("total"), size.alias("page_rows"), F.lit(limit).alias("limit"), F.lit(offset).alias("offset"),
                    (size + offset < total).alias("has_more"))


def wire_download(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"progress": F.round("progress", 1), "created_at": S.iso(F.col("created_at")), "updated_at": S.iso(F.col("updated_at"))})


wire_job = wire_download


def wire_item(rows: DataFrame) -> DataFrame:
    return rows.withColumn("created_at", S.iso(F.col("created_at")))


def queue_playlist(items: DataFrame) -> DataFrame:
    """Items as playlists to queue: renamed, without the further metadata."""
    names = ["title", "url", "thumbnail", "track_count", "channel", "channel_url", "source_tab", "release_type"]
    return items.select(F.col("playlist_id").alias("id"), *names)


def lookup(rows: DataFrame, key: object) -> DataFrame:
    return rows.where(F.col("id") == key).limit(1)


def count_by_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("id").alias("n"))


def status_stats(rows: DataFrame) -> DataFrame:
    """One row: a column for each known state, and the total of all rows, also in unknown states."""
    return rows.agg(*[F.count_if(F.coalesce(F.col("status") == s, F.lit(False))).alias(s) for s in DOWNLOAD_STATES], F.count("id").alias("total"))


def client_histogram(rows: DataFrame) -> DataFrame:
    """One row: how many rows the client's list has in the states that it counts, and in all."""
    return rows.agg(*[F.count_if(F.coalesce(F.col("status") == s, F.lit(False))).alias(s) for s in ("queued", "downloading", "completed", "failed")], F.count("*").alias("total"))


def tab_counts(rows: DataFrame) -> DataFrame:
    """(tab, n) for all, active and each state that there is."""
    tabs = F.array(F.lit("all"), F.col("status"), F.when(F.col("status").isin(P.ACTIVE_IN_CLIENT), "active"))
    return rows.select(F.explode(tabs).alias("tab")).where("tab is not null").groupBy("tab").agg(F.count("*").alias("n"))


def badge(rows: DataFrame, status: str) -> DataFrame:
    """How many rows have the status; null for none."""
    return rows.agg(F.nullif(F.count_if(F.col("status") == status), F.lit(0)).alias("badge"))


def any_with(rows: DataFrame, states: list[str]) -> DataFrame:
    return rows.agg(F.coalesce(F.bool_or(F.col("status").isin(states)), F.lit(False)).alias("any"))


def latest_per(rows: DataFrame, key: str) -> DataFrame:
    """The newest row of each key, by partial aggregation; no group is gathered."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct("created_at", "id")).alias("r"))
    return best.select("r.*")


def first_per(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    best = rows.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*rows.columns), order).alias("r"))
    return best.select("r.*")


#: Number of a page beyond the last of any list.
BEYOND_LAST = 2**63 - 1


def client_page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """One row: pages, the page shown (the last if too high), and its first and last row number."""
    n = F.count("*")
    pages = F.greatest(F.lit(1), F.ceil(n / size))
    shown = F.least(F.lit(number), pages)
    return rows.agg(n.alias("n"), pages.alias("pages"), shown.alias("page")).select(
        "n", "pages", "page", F.when(F.col("n") == 0, 0).otherwise((F.col("page") - 1) * size + 1).cast("long").alias("from"),
        F.least(F.col("page") * size, F.col("n")).alias("to"))


def page_pills(pages: DataFrame) -> DataFrame:
    """(pages, page) -> the page numbers to show, and whether a gap stands before each: the first, the last and two around."""
    shown = pages.select("pages", "page", F.explode(F.sequence(F.lit(1), "pages")).alias("p")).where(
        (F.col("p") == 1) | (F.col("p") == F.col("pages")) | (F.abs(F.col("p") - F.col("page")) <= 2))
    before = F.lag("p").over(Window.partitionBy("pages", "page").orderBy("p"))
    return shown.withColumn("gap", F.coalesce(F.col("p") - before > 1, F.lit(False)))
