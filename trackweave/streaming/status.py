"""Status events: frames are parsed and routed, and the latest row of each key is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import FRAME
from .batches import BatchTable, FanOut, KeyedTable, drain

_TOLD = StructType([*FRAME.fields, StructField("__bad", StringType())])


def to_frames(rows: DataFrame, kind: Column) -> DataFrame:
    """Rows (id, status, progress, updated_at) -> text frames (value) of the given type."""
    return rows.select(F.to_json(F.struct(kind.alias("type"), F.struct(*FRAME["data"].dataType.names).alias("data"))).alias("value"))


def read_frames(frames: DataFrame) -> DataFrame:
    """Text frames (value) -> value, type, data, malformed: whether the text is no JSON object."""
    parsed = frames.select("value", F.from_json("value", _TOLD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("f"))
    bad = F.col("f").isNull() | F.col("f.__bad").isNotNull()
    return parsed.select("value", F.when(~bad, F.col("f.type")).alias("type"), F.when(~bad, F.col("f.data")).alias("data"), bad.alias("malformed"))


def parse_frames(frames: DataFrame) -> DataFrame:
    """Text frames (value) -> type and data; malformed ones and those without a type are dropped."""
    return read_frames(frames).where("type is not null").select("type", "data")


def route(frames: DataFrame, kind: str) -> DataFrame:
    return frames.where(F.col("type") == kind).select("data.*")


def route_stream(frames: DataFrame, spark: SparkSession, path: str, kinds: list[str]) -> dict[str, DataFrame]:
    """Text frames of a stream to a table for each type that has a listener, and the malformed ones to "malformed".

    Frames of other types, or of none, have no listener and go nowhere. Returns what the tables hold now; a later call
    with the same path goes on.
    """
    tables = {k: BatchTable(spark, f"{path}/{k}", FRAME["data"].dataType) for k in kinds}
    dead = BatchTable(spark, f"{path}/malformed", StructType([StructField("value", StringType())]))

    def to(kind: str):
        return lambda rows, number: tables[kind].store(route(rows, kind), number)

    sinks = {k: to(k) for k in kinds} | {"malformed": lambda rows, number: dead.store(rows.where("malformed").select("value"), number)}
    drain(read_frames(frames), f"{path}/state", FanOut(spark, f"{path}/ledger", sinks).store)
    return {k: t.rows() for k, t in tables.items()} | {"malformed": dead.rows()}


def latest(events: DataFrame) -> DataFrame:
    """(key, ts, seq, ...) -> the last row of each key by (ts, seq), on a batch or a stream alike.

    On a stream the state is one row for each key; partial aggregation keeps hot keys cheap.
    """
    rest = [c for c in events.columns if c != "key"]
    return events.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("r")).select("key", "r.*")


def with_snapshot(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """A snapshot's rows brought up to date by later events."""
    return latest(snapshot.unionByName(events))


def follow_snapshot(snapshot: DataFrame, stream: DataFrame, spark: SparkSession, path: str, every: str | None = None, compact_every: int = 16) -> DataFrame:
    """A snapshot brought up to date by a stream of events (key, ts, seq, ...): the last row of each key by (ts, seq).

    The first call writes the snapshot; each batch adds its keys' last rows, and every ``compact_every`` batches one
    folder takes the place of all, with a row for each key, so that what readers read does not grow with time. Events that come late
    do not undo later ones. A later call with the same path goes on; an empty source leaves the snapshot.
    """
    table = KeyedTable(spark, f"{path}/table", snapshot.schema, ("ts", "seq"))
    table.begin(snapshot)
    drain(stream, f"{path}/state", _compacting(table, compact_every), every)
    return table.rows()


def _compacting(table: BatchTable, compact_every: int):
    def store(batch: DataFrame, number: int) -> None:
        if table.store(batch, number) and (number + 1) % compact_every == 0:
            table.compact()

    return store


def run(stream: DataFrame, spark: SparkSession, path: str, every: str | None = None, compact_every: int = 16) -> DataFrame:
    """Run an aggregation by ``key`` over what is there now and return the last row of each key.

    In update mode each batch adds the keys it changed; readers take each key's row of the last batch, and every
    ``compact_every`` batches one folder takes the place of all. A source without files gives no rows.
    """
    table = KeyedTable(spark, f"{path}/table", stream.schema)
    drain(stream, f"{path}/state", _compacting(table, compact_every), every)
    return table.rows()
