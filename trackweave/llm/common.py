"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name for ``F.col``, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def packed_rows(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One column ``row`` that holds the columns ``names`` (all by default), so that no name clashes with what is added."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in names or df.columns]).alias("row"))


def unpacked_rows(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in names])


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; in local mode one of the session's own where that is unset (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.conf.get("spark.trackweave.scratch", None)
        if not configured:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = "file://" + tempfile.mkdtemp(prefix="trackweave-")
            spark.conf.set("spark.trackweave.scratch", configured)
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that a lost executor costs no recomputation."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back.

    Unlike a checkpoint, the table read back has a size in its statistics, from which Spark
    chooses between broadcasting and shuffling it.
    """
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, if they have no copy of their own; and let whole
    texts come to them BATCH_ROWS at a time, unless the session says otherwise: Spark's 10,000 are too many for a
    worker and its executor where texts are long."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_ROWS)
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, paths) if p)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once all that was made from it is written itself."""
    spark = df.sparkSession
    root = scratch_dir(spark).rstrip("/") + "/table-"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()):
            delete_folder(spark, folder)


def small_array(rows: DataFrame, size: int) -> DataFrame:
    """One row with an array of ``size`` longs: of each place that is left out 0, of others the bitwise or of their values.

    ``rows``: (place, value). Queries read it by ``scalar()``, so that no plan holds its text.
    """
    zeros = rows.sparkSession.range(size).select(F.col("id").alias("place"), F.lit(0).cast("long").alias("value"))
    each = rows.groupBy("place").agg(F.bit_or("value").alias("value")).unionByName(zeros).groupBy("place").agg(F.bit_or("value").alias("value"))
    return materialise(each.agg(F.sort_array(F.collect_list(F.struct("place", "value")))["value"].alias("values")))


class HashFilter:
    """A filter on hashes: all that is wanted pass, few others do. Its size follows the number of rows up to MOST bits;
    beyond some millions of rows it lets more through, which costs time only."""

    LEAST, MOST = 1 << 20, 1 << 23

    def __init__(self, wanted: DataFrame, value: Column):
        self.size = min(self.MOST, max(self.LEAST, 1 << (8 * wanted.count()).bit_length()))
        at = value.bitwiseAND(F.lit(self.size - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
        self.table = small_array(wanted.select(F.shiftright(at, 6).alias("place"), bit.alias("value")), self.size >> 6)

    def passes(self, value: Column) -> Column:
        at = value.bitwiseAND(F.lit(self.size - 1))
        word = F.get(self.table.scalar(), F.shiftright(at, 6).cast("int"))
        return F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
