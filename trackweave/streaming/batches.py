"""What micro-batches write: each batch once, readable while batches and compactions go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.versions import ATTEMPTS, Conflict, VersionedTable, create_once, names_in

BATCH = "__batch"


class BatchTable:
    """Rows of batches with their batch's number; a batch that is repeated after a failure adds nothing.

    A batch's folder and its number are committed together: what stopped before the commit is written again and never
    read, what stopped after it is left out.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.names = list(schema.names)
        self.table = VersionedTable(spark, path, StructType([*schema.fields, StructField(BATCH, LongType())]))

    def store(self, rows: DataFrame, number: int) -> bool:
        if self.table.current().facts.get("batch", -2) >= number:
            return False
        folder = self.table.write_folder(rows.withColumn(BATCH, F.lit(number).cast("long")))
        for _ in range(ATTEMPTS):
            version = self.table.current()
            if version.facts.get("batch", -2) >= number:
                return False
            if self.table.commit(version, [*version.folders, folder], version.facts | {"batch": number}) is not None:
                return True
        raise Conflict(f"batch {number}")

    def rows(self) -> DataFrame:
        return self.table.read().select(*self.names)

    def compact(self) -> None:
        self.table.compact()


class KeyedTable(BatchTable):
    """The last row of each ``key``: by the columns ``order``, then by batch. Compaction leaves one row for each key."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, order: tuple[str, ...] = ()):
        super().__init__(spark, path, schema)
        self.order = order

    def _last(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != "key"]
        return rows.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct(*self.order, BATCH)).alias("r")).select("key", "r.*")

    def begin(self, snapshot: DataFrame) -> None:
        """Rows to start from; nothing if the table has begun already."""
        self.store(snapshot.select(*self.names), -1)

    def store(self, rows: DataFrame, number: int) -> bool:
        """Of a key's several rows in a batch the last is written."""
        own = self._last(rows.withColumn(BATCH, F.lit(number).cast("long"))).drop(BATCH) if self.order else rows
        return super().store(own.select(*self.names), number)

    def rows(self) -> DataFrame:
        return self._last(self.table.read()).select(*self.names)

    def compact(self) -> None:
        self.table.compact(self._last)


def drain(stream: DataFrame, state: str, store: Callable[[DataFrame, int], object], every: str | None = None, mode: str = "update") -> StreamingQuery:
    """Give ``store`` each batch of what is there now, and stop.

    ``every``: poll at that interval, such as "2 seconds", until all that is there was read; without it all available
    data is read at once. A later call with the same ``state`` goes on where this one ended, also after a failure.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(lambda batch, number: store(batch, number) and None)
    if every is None:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    query = writer.trigger(processingTime=every).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


class FanOut:
    """Each batch to several sinks, with a ledger of what each has; a sink that fails is dropped and the others go on.

    A sink that took a batch is not given it again when the batch is repeated. One that stops between taking a batch and
    the ledger's note is: sinks must stand that, as ``BatchTable.store`` does. A dropped sink stays so until ``readmit``.
    """

    def __init__(self, spark: SparkSession, path: str, sinks: dict[str, Callable[[DataFrame, int], object]]):
        self.spark, self.path, self.sinks = spark, path.rstrip("/"), sinks

    def has(self, name: str) -> set[int]:
        return {int(x) for x in names_in(self.spark, f"{self.path}/taken/{name}") if x.isdigit()}

    def dropped(self) -> set[str]:
        return {x for x in names_in(self.spark, f"{self.path}/dropped") if "." not in x}

    def readmit(self, name: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/dropped/{name}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, False)

    def store(self, rows: DataFrame, number: int) -> None:
        dropped = self.dropped()
        wanting = [n for n in self.sinks if n not in dropped and not names_in(self.spark, f"{self.path}/taken/{n}/{number}")]
        if not wanting:
            return
        rows.persist()
        try:
            for name in wanting:
                try:
                    self.sinks[name](rows, number)
                except Exception as e:  # whatever a sink raises is its own: the others go on
                    create_once(self.spark, f"{self.path}/dropped/{name}", f"{number}: {e}"[:2048])
                else:
                    create_once(self.spark, f"{self.path}/taken/{name}/{number}", "")
        finally:
            rows.unpersist()
