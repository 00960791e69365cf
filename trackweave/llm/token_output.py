"""Packed token-id matrices: best-fit decreasing with a segment tree over the free capacities."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import vocabulary

END_OF_TEXT = 50256
#: Ids that are packed together; bounds a task's memory at about four bytes an id.
SHARD_TOKENS = 4_000_000


class CapacityTree:
    """Bins by free capacity; finds a bin with the least capacity that is still enough."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, bin_id: int) -> None:
        self.bins[free].append(bin_id)
        node = free + self.leaves
        while node:
            self.count[node] += 1
            node //= 2

    def take(self, size: int) -> tuple[int, int] | None:
        """A (free capacity, bin) with the least free capacity of ``size`` or more; it leaves the tree."""
        node = size + self.leaves
        if not self.count[node]:
            while node > 1 and (node % 2 or not self.count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.leaves
        while node:
            self.count[node] -= 1
            node //= 2
        return free, self.bins[free].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``sizes`` (1 to capacity) by bin; ties in the order given."""
    tree, bins = CapacityTree(capacity), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.take(sizes[k])
        if found is None:
            found = capacity, len(bins)
            bins.append([])
        free, b = found
        bins[b].append(k)
        if free > sizes[k]:
            tree.add(free - sizes[k], b)
    return bins


def packed_matrices(docs: DataFrame, capacity: int = 2048, end_id: int = END_OF_TEXT, pad_id: int = END_OF_TEXT,
                    shard_tokens: int = SHARD_TOKENS, vocabulary_file: str = vocabulary.DEFAULT_FILE,
                    digest: bool = False) -> DataFrame:
    """One row for each packed sequence.

    input_ids: ``capacity`` little-endian unsigned 32-bit ids, padded with ``pad_id``; position_ids: the same
    format, from 0 again at each segment and in the padding; cu_seqlens: segment bounds from 0 to n_tokens;
    doc_ids, starts: each segment's document and its first id there. A document is its text's ids and
    ``end_id``; one longer than ``capacity`` is split into full rows and a rest, so concatenating its segments by
    start gives all its ids. With ``digest``, crc32 checksums stand in for the two matrices.

    Each partition packs its own documents in shards of ``shard_tokens``, which bounds memory and the
    padding: nothing is shuffled, and a lost task is redone alone. ``sequence_id`` is the partition's number
    and the row's number in it.

    A null text is an empty one (the end id alone). Null and repeated ids and repeated rows are packed each
    for itself; an empty table has no rows. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    matrices = "ids_crc32 long, positions_crc32 long" if digest else "input_ids binary, position_ids binary"
    end = end_id.to_bytes(4, "little")

    def run(batches):
        words, task, written = vocabulary.load(vocabulary_file), TaskContext.get().partitionId(), 0
        pad = pad_id.to_bytes(4, "little")
        count = np.arange(capacity, dtype="<u4")

        def flush(pieces):
            nonlocal written
            rows = []
            for members in best_fit_decreasing([len(p[2]) // 4 for p in pieces], capacity):
                own = [pieces[k] for k in members]
                sizes = [len(p[2]) // 4 for p in own]
                total = sum(sizes)
                ids = b"".join(p[2] for p in own) + pad * (capacity - total)
                positions = np.concatenate([count[:n] for n in (*sizes, capacity - total)]).tobytes()
                rows.append((task << 32 | written, total, len(own), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32),
                             [p[0] for p in own], [p[1] for p in own],
                             *((zlib.crc32(ids), zlib.crc32(positions)) if digest else (ids, positions))))
                written += 1
            last = pa.int64() if digest else pa.binary()
            types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int64()), last, last]
            names = ["sequence_id", "n_tokens", "n_segments", "cu_seqlens", "doc_ids", "starts",
                     *(("ids_crc32", "positions_crc32") if digest else ("input_ids", "position_ids"))]
            for k in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[k : k + 512], strict=True), types, strict=True)], names=names)

        pieces, held, id_type = [], 0, pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = words.ids_bytes(text.as_py() or "") + end
                for start in range(0, len(ids), 4 * capacity):
                    pieces.append((doc_id.as_py(), start // 4, ids[start : start + 4 * capacity]))
                held += len(ids) // 4
                if held >= shard_tokens:
                    yield from flush(pieces)
                    pieces, held = [], 0
        yield from flush(pieces)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"sequence_id long, n_tokens long, n_segments int, cu_seqlens array<int>, doc_ids array<{kind}>, starts array<long>, {matrices}")
