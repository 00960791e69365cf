"""Reading and writing the library's relations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..schemas import QUEUED
from .versions import VersionedTable


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Nested extractor records as JSON lines, with an explicit schema: what is missing is null."""
    return spark.read.schema(schema).json(path)


#: Records of a file of text at most: a compressed one is read by one task.
FILE_RECORDS = 500_000


def write_records(records: DataFrame, path: str) -> None:
    """Nested records as lines of compressed JSON, for ``read_records``; fields that are null are left out."""
    records.write.option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).json(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def with_ids(rows: DataFrame, *order: str, start: int = 1) -> DataFrame:
    """Ids from ``start`` in the given order, without gathering all rows.

    Sorted ranges are written to the shared folder once, each task's as a folder of its own; a row's id is its number in
    its range plus the rows of the ranges before. Only one count of each range is summed in one place.
    """
    spark = rows.sparkSession
    path = new_folder(spark, "ranges")
    # a number of its own for each row: the range in the upper bits, the place in the lower 33
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    part, nth = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    numbered = placed.withColumn("__part", part).join(before, "__part")
    return numbered.select(*rows.columns, (F.col("__before") + nth + start).alias("id"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; in local mode one of the session's own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.trackweave.scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="trackweave-")
        spark.conf.set("spark.trackweave.scratch", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def downloads_table(spark: SparkSession, path: str) -> VersionedTable:
    """A table of downloads that several writers append to; ``queue.append_new`` adds rows."""
    return VersionedTable(spark, path, QUEUED)


#: Parts that a table is dealt to by a hash of its key; rows of a file at most.
KEY_PARTS, FILE_ROWS = 64, 4_000_000


def _part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def write_by_key(rows: DataFrame, path: str, key: str, parts: int = KEY_PARTS) -> None:
    """Rows in folders by a hash of ``key`` and sorted by it, for ``read_by_key``.

    The rows of a hot key are split over tasks where they are too many for one (a rebalance), and files have a bounded
    number of rows. A column named ``__of`` must not be there.
    """
    dealt = rows.withColumn("__of", _part_of(F.col(key), parts)).hint("rebalance", "__of")
    dealt.sortWithinPartitions("__of", key).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("__of").parquet(path)


def read_by_key(spark: SparkSession, path: str, schema: StructType, key: str, value: object, parts: int = KEY_PARTS) -> DataFrame:
    """The rows whose key is ``value``: of one folder, and inside its files of the row groups that can hold it."""
    whole = StructType([*schema.fields, StructField("__of", IntegerType())])
    wanted = F.lit(value).cast(schema[key].dataType)
    found = spark.read.schema(whole).parquet(path)
    return found.where((F.col("__of") == _part_of(wanted, parts)) & (F.col(key) == wanted)).select(*schema.names)


def job_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("job_id", F.uuid())
