"""Scans over ordered rows without a window by key: a hot key is spread over all tasks.

Rows are sorted in ranges of (key, order), as many as there are shuffle partitions. Each task scans its own range once, and
what a range passes on to the next comes from a small table with a row or two for each range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.storage import new_folder

#: The range of a row and its place there, in one long; the number of places that a range can have.
PLACE, PLACES = "__place", 1 << 33


def _scanned(rows: DataFrame, order: list[str], step: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]] | None = None,
             more: list[StructField] | None = None) -> DataFrame:
    """Rows in sorted ranges with PLACE, and what ``step`` adds to the batches of each range in turn; written once.

    The sorted table is written to the shared folder, so that a lost executor costs no second sort and ranges stay as they are.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PLACE, F.monotonically_increasing_id())
    if step is not None:
        schema = StructType([*placed.schema.fields, *(more or [])])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = step()
            for batch in batches:
                if batch.num_rows:
                    yield scan(batch)

        placed = placed.mapInArrow(run, schema)
    path = new_folder(spark, "scan")
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path).withColumn("__part", F.shiftright(PLACE, 33))


def with_previous(rows: DataFrame, key: str, order: list[str], columns: dict[str, str]) -> DataFrame:
    """Rows with the values that the row before of the same key has: ``columns`` names them (old name -> new name).

    The order inside a key is that of ``order``; the first row of a key has nulls, null keys are one key. In a range the
    values come from the row before in the task; only the first row of each range takes them from the last row of the range before.
    """
    names = [key, *columns]
    fields = [StructField(f"__{i}", rows.schema[c].dataType) for i, c in enumerate(names)]

    def step() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        last: list[pa.Array] = []

        def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal last
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            before = last or [pa.nulls(1, c.type) for c in own]
            last = [c.slice(len(c) - 1) for c in own]
            shifted = [pa.concat_arrays([b, c.slice(0, len(c) - 1)]) for b, c in zip(before, own, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns, *shifted], names=[*batch.schema.names, *(f.name for f in fields)])

        return scan

    scanned = _scanned(rows, [key, *order], step, fields)
    ends = scanned.groupBy("__part").agg(F.max_by(F.struct(*[F.col(c).alias(f"__{i}") for i, c in enumerate(names)]), PLACE).alias("__end"))
    after = F.lead("__part").over(Window.orderBy("__part"))  # a row for each range
    borders = F.broadcast(ends.select(after.alias("__part"), "__end").where("__part is not null"))
    at_border = scanned.join(borders, "__part", "left")
    first = F.col(PLACE) % F.lit(PLACES) == 0
    before = [F.when(first, F.col(f"__end.__{i}")).otherwise(F.col(f"__{i}")) for i in range(len(names))]
    there = F.when(first, F.col("__end").isNotNull()).otherwise(F.lit(True)) & before[0].eqNullSafe(F.col(key))
    return at_border.select(*rows.columns, *[F.when(there, b).alias(columns[c]) for b, c in zip(before[1:], columns, strict=True)])


def throttled(rows: DataFrame, arrival: Column, interval: int, order: list[str], key: str | None = None, name: str = "start") -> DataFrame:
    """Rows with the time at which each may start, if starts of a key are ``interval`` apart at least and in order.

    ``arrival`` and ``interval`` are whole numbers, such as microseconds; rows wait in the order of ``order`` (and of
    ``key``, of which each has a schedule of its own; one schedule for all without it). A wait counts from when the row
    before *started*: start_i = max(arrival_i, start_(i-1) + interval), which is i * interval plus the largest
    arrival_j - j * interval of all j <= i. Each range finds that with places of its own; a range's first key is moved on by
    the rows, and raised by the largest value, of the same key in the ranges before it.
    """
    by = "__key" if key is None else key
    keyed = rows.withColumn("__key", F.lit(0)) if key is None else rows
    keyed = keyed.withColumn("__arrival", arrival.cast("long"))
    if keyed.where(F.col("__arrival").isNull()).limit(1).count():
        raise ValueError("a row has no arrival")
    fields = [StructField("__nth", LongType()), StructField("__best", LongType())]

    def step() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        state: tuple | None = None  # key, rows of it so far, largest value so far

        def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal state
            keys = batch.column(batch.schema.get_field_index(by))
            # runs of equal keys: sorted keys make each key one run
            runs = pd.Series(keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False))
            nth = runs.groupby(runs).cumcount().to_numpy(copy=True)
            first = keys[0].as_py()
            same = (runs == runs.iloc[0]).to_numpy()
            goes_on = state is not None and state[0] == first
            if goes_on:
                nth[same] += state[1]
            value = pd.Series(batch.column(batch.schema.get_field_index("__arrival")).to_numpy() - nth * interval)
            best = value.groupby(runs).cummax().to_numpy(copy=True)
            if goes_on:
                best[same] = best[same].clip(min=state[2])
            state = keys[len(keys) - 1].as_py(), int(nth[-1]) + 1, int(best[-1])
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64()), pa.array(best, pa.int64())], names=[*batch.schema.names, "__nth", "__best"])

        return scan

    scanned = _scanned(keyed, [by, *order], step, fields)
    # of each range the last row of its first and of its last key: no other key goes over a border
    at = F.struct(PLACE, by, "__nth", "__best")
    last = scanned.groupBy("__part").agg(F.min(F.struct(by))[by].alias("__first"), F.max(at).alias("__tail"))
    firsts = F.broadcast(last.select("__part", "__first"))
    head = scanned.join(firsts, "__part").where(F.col(by).eqNullSafe(F.col("__first"))).groupBy("__part").agg(F.max(at).alias("__tail"))
    ends = head.unionByName(last.select("__part", "__tail")).distinct().select("__part", F.col(f"__tail.{by}").alias("__of"), (F.col("__tail.__nth") + 1).alias("__n"), F.col("__tail.__best").alias("__best"))
    earlier = Window.partitionBy("__of").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # two rows for each range
    moved = ends.withColumn("__moved", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    carried = moved.withColumn("__raised", F.max(F.col("__best") - F.col("__moved") * F.lit(interval)).over(earlier))
    carried = F.broadcast(carried.where("__raised is not null").select(F.col("__part").alias("__in"), "__of", "__moved", "__raised"))
    joined = scanned.join(carried, (F.col("__part") == F.col("__in")) & F.col(by).eqNullSafe(F.col("__of")), "left")
    moved_by = F.coalesce("__moved", F.lit(0))
    best = F.greatest(F.col("__best") - moved_by * F.lit(interval), F.coalesce("__raised", F.col("__best") - moved_by * F.lit(interval)))
    return joined.select(*rows.columns, ((F.col("__nth") + moved_by) * F.lit(interval) + best).alias(name))
