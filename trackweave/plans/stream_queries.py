"""Streams, scans, shared tables and layouts over the events and the lists, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import listing as L
from ..operators import queue as Q
from ..operators.scans import throttled
from ..schemas import FRAME
from ..sources import fixtures as X
from ..sources.storage import downloads_table, new_folder, read_by_key, write_by_key
from ..streaming import batches as B
from ..streaming import status as T
from ..streaming import transitions
from .edge_queries import LATEST_SQL
from .list_queries import INVALID_SQL

#: Ends of the parts in which events come.
TIMES = ("2024-01-08", "2024-01-20")


def _parts(events: DataFrame) -> list[DataFrame]:
    """All events in three parts by their time; each goes on where the one before ended."""
    first, second = (F.lit(t).cast("timestamp_ntz") for t in TIMES)
    ts = F.col("ts")
    return [events.where(ts < first), events.where((ts >= first) & (ts < second)), events.where((ts >= second) | ts.isNull())]


def _in_parts(parts: list[DataFrame], path: str, step) -> None:
    """Each part is written to the source folder, and ``step`` is given the stream: the same query, stopped and started again."""
    spark = parts[0].sparkSession
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        step(spark.readStream.schema(part.schema).parquet(f"{path}/in"))


def _snapshot_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the even events, and the odd ones as a stream in three runs; two batches make one folder."""
    events, path = X.status_events(spark, sf_dir), new_folder(spark, "merged")
    snapshot, found = T.latest(events.where("seq % 2 = 0")), []
    _in_parts(_parts(events.where("seq % 2 = 1")), path, lambda stream: found.append(T.follow_snapshot(snapshot, stream, spark, path, compact_every=2)))
    return found[-1].select("key", "status", "seq", "value")


def _restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, by a stream that stops twice and goes on from its checkpoint."""
    events, path = X.status_events(spark, sf_dir).select("key", "seq", "status"), new_folder(spark, "restarted")
    table = B.BatchTable(spark, f"{path}/table", events.schema)
    timed = X.status_events(spark, sf_dir).select("key", "seq", "status", "ts")
    _in_parts(_parts(timed), path, lambda stream: B.drain(stream.select("key", "seq", "status"), f"{path}/state", table.store))
    return table.rows()


def _invalid_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, path = X.status_events(spark, sf_dir).withColumn("limited", F.lit(False)), new_folder(spark, "invalid")
    tables = []

    def step(stream: DataFrame) -> None:
        found = transitions.follow(stream)
        tables.append(B.BatchTable(spark, f"{path}/out", found.schema))
        B.drain(found, f"{path}/state", tables[-1].store, mode="append")

    _in_parts(_parts(events), path, step)
    return tables[-1].rows().select("key", "seq", "was", "status")


def _fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to three sinks, of which one fails in the second batch: how many rows each has."""
    events, path = X.status_events(spark, sf_dir), new_folder(spark, "fan")
    tables = {n: B.BatchTable(spark, f"{path}/{n}", events.schema) for n in ("all", "failed", "closing")}

    def closing(rows: DataFrame, number: int) -> None:
        if number:
            raise OSError("the listener is gone")
        tables["closing"].store(rows, number)

    sinks = {"all": tables["all"].store, "failed": lambda rows, n: tables["failed"].store(rows.where("status = 'failed'"), n), "closing": closing}
    fan = B.FanOut(spark, f"{path}/ledger", sinks)
    _in_parts(_parts(events), path, lambda stream: B.drain(stream, f"{path}/state", fan.store))
    dropped = fan.dropped()
    each = [t.rows().agg(F.lit(n).alias("sink"), F.count("*").alias("n"), F.max("seq").alias("last"), F.lit(n in dropped).alias("dropped")) for n, t in tables.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text frames, every fiftieth cut off, through a stream: the frames of each table, by state."""
    seq, path = F.col("seq"), new_folder(spark, "frames")
    kind = F.when(seq % 3 == 0, "metadata_progress").when(seq % 10 == 1, "pong").otherwise("download_update")
    rows = X.status_events(spark, sf_dir).select(seq.alias("id"), "status", F.col("value").alias("progress"), S.iso(F.col("ts")).alias("updated_at"), "seq", "ts")

    def texts(part: DataFrame) -> DataFrame:
        value = F.to_json(F.struct(kind.alias("type"), F.struct(*FRAME["data"].dataType.names).alias("data")))
        return part.select(F.when(seq % 50 == 7, F.substr(value, F.lit(1), F.length(value) - 3)).otherwise(value).alias("value"))

    found = []
    _in_parts([texts(p) for p in _parts(rows)], path, lambda stream: found.append(T.route_stream(stream, spark, path, ["download_update", "metadata_progress"])))
    by_state = [t.groupBy("status").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.min("updated_at").alias("first")).withColumn("kind", F.lit(k)) for k, t in found[-1].items() if k != "malformed"]
    bad = found[-1]["malformed"].agg(F.lit(None).cast("string").alias("status"), F.count("*").alias("n"), F.lit(None).cast("long").alias("ids"), F.lit(None).cast("string").alias("first"), F.lit("malformed").alias("kind"))
    return by_state[0].unionByName(by_state[1]).unionByName(bad)


FRAMES_SQL = f"""with {X.EVENTS_SQL}, typed as (select *, case when seq % 50 = 7 then 'malformed' when seq % 3 = 0 then 'metadata_progress' when seq % 10 = 1 then 'pong' else 'download_update' end as kind from status_events)
  select status, count(*) as n, sum(seq)::bigint as ids, min(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')) as first, kind from typed where kind in ('metadata_progress', 'download_update') group by status, kind
  union all select null, count(*), null, null, 'malformed' from typed where kind = 'malformed'"""

#: Microseconds between starts: of all events, and of a user's.
ALL_GAP, USER_GAP = 240_000_000, 3_600_000_000


def _schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.status_events(spark, sf_dir).select("key", "ts", "seq")
    arrival = F.unix_micros(F.col("ts").cast("timestamp"))
    of_all = throttled(events, arrival, ALL_GAP, ["ts", "seq"])
    return throttled(of_all, arrival, USER_GAP, ["ts", "seq"], "key", "own_start").select("seq", "start", "own_start")


SCHEDULE_SQL = f"""with {X.EVENTS_SQL}, placed as (select *, epoch_us(ts) as came, row_number() over (order by ts, seq) - 1 as i, row_number() over (partition by key order by ts, seq) - 1 as own from status_events)
  select seq, (i * {ALL_GAP} + max(came - i * {ALL_GAP}) over (order by i))::bigint as start, (own * {USER_GAP} + max(came - own * {USER_GAP}) over (partition by key order by own))::bigint as own_start from placed"""


def _append_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of even batches, then those of odd ones: what the second finds queued it leaves out."""
    table = downloads_table(spark, new_folder(spark, "downloads"))
    cand = X.candidates(spark, sf_dir).withColumn("title", F.concat(F.lit("T"), F.col("idx").cast("string")))
    for rest in (0, 1):
        Q.append_new(table, cand.where(F.col("batch") % 2 == rest).select("url", "idx", "title"))
    table.compact()
    return table.read()


VERSIONS_SQL = f"""with {X.CANDIDATES_SQL}, firsts as (select url, batch % 2 as rest, min(idx) as idx from candidates group by all),
  new as (select * from firsts where rest = 0 or url not in (select url from firsts where rest = 0))
  select row_number() over (order by rest, idx) as id, url, 'T' || idx as title, 'queued' as status, 0.0::double as progress from new"""


def _job_by_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, path = X.items(spark, sf_dir), new_folder(spark, "by-job")
    write_by_key(items, path, "processing_job_id")
    return L.oldest_first(read_by_key(spark, path, items.schema, "processing_job_id", "j2").withColumn("created_at", F.lit(None))).select("id", "title", "track_count", "release_type")


def _lookups_by_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = X.downloads(spark, sf_dir), new_folder(spark, "by-id")
    write_by_key(rows, path, "id")
    return read_by_key(spark, path, rows.schema, "id", 77).select("id", "url", "status")


def _cursor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of a hundred rows; before each further one newer rows come in."""
    old = X.downloads(spark, sf_dir).select("id", "title", "created_at")
    newer = old.withColumns({"id": F.col("id") + 10_000_000, "created_at": F.expr("created_at + interval 40 years")})
    pages = [L.page_after(old, None, 100)]
    for n in (1, 2):
        rows = old.unionByName(newer.where(F.col("id") % 3 < n))
        pages.append(L.page_after(rows, L.cursor(pages[-1]), 100))
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).select("id", "title")


QUERIES = {
    "snapshot_stream": (_snapshot_stream, LATEST_SQL),
    "restarted_stream": (_restarted, f"with {X.EVENTS_SQL} select key, seq, status from status_events"),
    "invalid_transitions_stream": (_invalid_stream, INVALID_SQL),
    "fan_out_stream": (_fan_out, f"""with {X.EVENTS_SQL} select 'all' as sink, count(*) as n, max(seq) as last, false as dropped from status_events
                       union all select 'failed', count(*), max(seq), false from status_events where status = 'failed' union all select 'closing', count(*), max(seq), true from status_events where ts < timestamp '{TIMES[0]}'"""),
    "frames_stream": (_frames, FRAMES_SQL),
    "throttle_schedule": (_schedule, SCHEDULE_SQL),
    "append_versions": (_append_versions, VERSIONS_SQL),
    "job_items_by_layout": (_job_by_layout, f"with {X.RELEASES_SQL}, {X.ITEMS_SQL} select id, title, track_count, release_type from items where processing_job_id = 'j2'"),
    "lookup_by_layout": (_lookups_by_layout, f"with {X.DOWNLOADS_SQL} select id, url, status from downloads where id = 77"),
    "cursor_pages": (_cursor_pages, f"with {X.DOWNLOADS_SQL} select id, title from downloads order by created_at desc, id desc limit 300"),
}
