"""Packed sequences as raw binary files with an index, and their read-back.

A data file holds ``input_ids`` and ``position_ids`` matrices of little-endian unsigned 32-bit ids, row after row. The
index is a Parquet table: of each sequence its file, the places of both rows in it, cumulative segment lengths and documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes after which a task begins another file.
FILE_BYTES = 1 << 30


def write_binary(sequences: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``packed_matrices`` rows under ``path`` (a URI of a file system that pyarrow knows); the index.

    Each attempt of a task writes files of its own names, and the index names only those of the attempts that
    succeeded: a lost executor, a repeated or a speculative task leaves files that nobody reads. The index is written last,
    so a folder without one is not complete. A table without rows has an index without rows. A folder with an index is refused.
    """
    spark = sequences.sparkSession
    root = path.rstrip("/")
    files, at = pa.fs.FileSystem.from_uri(root)
    if files.get_file_info(f"{at}/index").type != pa.fs.FileType.NotFound:
        raise FileExistsError(f"{root}/index")
    kept = ["sequence_id", "n_tokens", "n_segments", "cu_seqlens", "doc_ids", "starts"]
    schema = sequences.select(*kept).schema.add("file", "string").add("ids_at", "long").add("positions_at", "long").add("row_bytes", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pa.fs.FileSystem.from_uri(root)
        store.create_dir(f"{folder}/data", recursive=True)
        context, out, name, size = TaskContext.get(), None, "", 0
        try:
            for batch in batches:
                named, ids_at, positions_at, lengths = [], [], [], []
                for ids, positions in zip(batch.column("input_ids"), batch.column("position_ids"), strict=True):
                    if out is None or size >= file_bytes:
                        if out is not None:
                            out.close()
                        name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.bin"
                        out, size = store.open_output_stream(f"{folder}/data/{name}"), 0
                    named.append(name)
                    lengths.append(len(ids.as_py()))
                    for places, row in ((ids_at, ids.as_py()), (positions_at, positions.as_py())):
                        places.append(size)
                        out.write(row)
                        size += len(row)
                own = [batch.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(named, pa.string()), *(pa.array(x, pa.int64()) for x in (ids_at, positions_at, lengths))], names=schema.names)
        finally:
            if out is not None:
                out.close()

    sequences.select(*kept, "input_ids", "position_ids").mapInArrow(run, schema).write.parquet(f"{root}/index")
    return spark.read.schema(schema).parquet(f"{root}/index")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``write_binary`` wrote. Sequences of a file are read together, in the order of their places."""
    root = path.rstrip("/")
    index = spark.read.parquet(f"{root}/index")
    kept = index.drop("file", "ids_at", "positions_at", "row_bytes").schema
    schema = kept.add("input_ids", "binary").add("position_ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pa.fs.FileSystem.from_uri(root)
        source, name = None, None
        for batch in batches:
            found: tuple[list[bytes], list[bytes]] = [], []
            for file, *places, length in zip(*(batch.column(c).to_pylist() for c in ("file", "ids_at", "positions_at", "row_bytes")), strict=True):
                if file != name:
                    source, name = store.open_input_file(f"{folder}/data/{file}"), file
                for out, place in zip(found, places, strict=True):
                    out.append(source.read_at(length, place))
            own = [batch.column(c) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.binary()) for x in found)], names=schema.names)

    return index.repartitionByRange("file", "ids_at").sortWithinPartitions("file", "ids_at").mapInArrow(run, schema)


def documents_of(sequences: DataFrame) -> DataFrame:
    """(doc_id, ids): each document's ids, put together from its segments again; ids are little-endian unsigned 32-bit ones.

    A document's segments meet in one task, which its own length bounds. Documents must have different ids.
    """
    kind = sequences.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ids, bounds, docs, starts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                row = np.frombuffer(ids, "<u4")
                rows += [(d, s, row[a:b].tobytes()) for d, s, a, b in zip(docs, starts, bounds, bounds[1:], strict=False)]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(2).type.value_type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["doc_id", "start", "ids"])

    pieces = sequences.select("input_ids", "cu_seqlens", "doc_ids", "starts").mapInArrow(run, f"doc_id {kind}, start long, ids binary")
    in_order = F.sort_array(F.collect_list(F.struct("start", "ids")))
    return pieces.groupBy("doc_id").agg(in_order.alias("p")).select("doc_id", F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"))
