"""Sequence packing by the length histogram: shortest pack first, patterns joined back by rank."""

from __future__ import annotations

import zlib
from bisect import insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vocabulary
from .common import materialise

#: Ids between the documents.
SEPARATOR = 1


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in order, how many sequences) for ``counts[length]`` pieces of each length.

    Lengths are placed longest first, each into the packs with most room; all packs of one pattern are
    filled at a time, so the work follows the number of lengths and not of pieces. Where no pack has room, new ones are
    opened one after the other and each filled with that length before the next, as if pieces came one by one. Each step
    uses up a pattern, or else a length with at most two patterns more.
    """
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = capacity - sum(pattern)
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append((pattern, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            if not rooms or rooms[-1] < length:
                full, rest = divmod(left, capacity // length)
                if full:
                    put((length,) * (capacity // length), full)
                if rest:
                    put((length,) * rest, 1)
                break
            room = rooms[-1]
            pattern, n = by_room[room].pop()
            if not by_room[room]:
                rooms.pop()
            used = min(n, left)
            if used < n:
                put(pattern, n - used)
            put((*pattern, length), used)
            left -= used
    return [x for room in sorted(by_room) for x in by_room[room]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each run of pieces that fill the same slot."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            runs[length].append((taken[length], sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    return {length: tuple(np.array(x, np.int64) for x in zip(*found, strict=True)) for length, found in runs.items()}


def cut_documents(docs: DataFrame, capacity: int, separator: int = SEPARATOR, with_ids: bool = False,
                  vocabulary_file: str = vocabulary.DEFAULT_FILE) -> DataFrame:
    """Pieces of at most ``capacity`` ids: (doc_id, start, length, ids_crc32, doc_tokens, task, nth[, ids]).

    A document's ids are those of its text, then the separator. ``nth`` counts the pieces of the same length
    that the task has made before.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth", *["ids"] * with_ids]
    end = separator.to_bytes(4, "little")

    def run(batches):
        words, task = vocabulary.load(vocabulary_file), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows, at = [], []
            for i, text in enumerate(batch.column(1)):
                ids = words.ids_bytes(text.as_py() or "") + end
                for start in range(0, len(ids), 4 * capacity):
                    piece = ids[start : start + 4 * capacity]
                    n = len(piece) // 4
                    rows.append((start // 4, n, zlib.crc32(piece), len(ids) // 4, task, seen[n], *[piece] * with_ids))
                    seen[n] += 1
                    at.append(i)
            columns = list(zip(*rows, strict=True)) or [[] for _ in names[1:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:6]),
                 *(pa.array(c, pa.binary()) for c in columns[6:])], names=names)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, task long, nth long" + ", ids binary" * with_ids)


def pack_documents(docs: DataFrame, capacity: int = 2048, separator: int = SEPARATOR, with_ids: bool = False,
                   vocabulary_file: str = vocabulary.DEFAULT_FILE) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids; one row for each piece.

    Texts are encoded once and their pieces written to the shared folder. Only the histogram, of at most
    ``capacity`` rows, reaches the driver. A piece's rank among those of its length is its number within
    the task plus the sum over earlier tasks, and its rank picks the slot of a pattern: no length is
    gathered in one place, whatever share of the pieces it has.

    A null text is an empty one: the separator alone. A text of any length is cut into full sequences and a rest, and
    loses nothing. Pieces of equal length are alike to the patterns; they are dealt out in the order of tasks and rows.
    Null and repeated ids and repeated rows are packed each for itself; an empty table has no rows. Other columns
    are not read, whatever they are named.
    """
    pieces = materialise(cut_documents(docs, capacity, separator, with_ids, vocabulary_file))
    per_task = materialise(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(pack_histogram(counts, capacity))
    before = per_task.withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).drop("n")
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    sent = docs.sparkSession.sparkContext.broadcast(table)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    ranked = ranked.select(*names[:5], "rank", *names[7:])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, to, at = sent.value[int(length[own[0]])]
                k = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own], offset[own] = to[k] + rank[own] - first[k], at[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset), *batch.columns[6:]], names=names)

    return ranked.mapInArrow(
        place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


