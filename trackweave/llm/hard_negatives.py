"""Hard negatives by norm-bucketed search.

Candidates are sorted by label and norm and cut into buckets. By the Cauchy-Schwarz inequality no row of a bucket scores
more with an anchor than the product of the anchor's norm and the bucket's largest; so a bucket is left out for every
anchor of which all windows have a lower limit, or a k-th score so far, above that product. Buckets with the largest
norms are searched in a first round, whose k-th scores decide which others are sent to an anchor at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Rows of a bucket; of a chunk of buckets, which are searched together; anchors in a tile.
BUCKET_ROWS, CHUNK_ROWS, TILE_ANCHORS = 1024, 16_384, 2048
#: Squares of norms beyond which scores times ten need not fit a long.
LARGEST = float(1 << 59)
#: A limit below every score, and one above.
NONE, ALL = -(1 << 62), 1 << 62
#: Norms are rounded: bounds are made larger by more than that.
SLACK = 1e-9

_BLOCK = "block long, n int, label_low long, label_high long, top double, ids binary, labels binary, norms binary, width int, matrix binary"
_FOUND = "piece long, place int, nth int, norm double, anchor_id long, id long, score long"


class Share(NamedTuple):
    """Between which tenths of a positive's score its negatives lie."""

    low: int = 3
    high: int = 9


def integer_rows(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(id, label, norm, q): rows that take part, with q = floor(scale * component) as longs.

    Null ids, labels and vectors, vectors with null or non-finite components, and those whose squared norm is beyond
    LARGEST take no part; nor do vectors of another length than most have (of equally frequent lengths the larger counts).
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * F.lit(scale) < F.lit(LARGEST)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
        F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("long")).alias("q"))
    square = F.aggregate("q", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    rows = rows.withColumn("square", square).where(F.col("square") < F.lit(LARGEST)).select("id", "label", F.sqrt("square").alias("norm"), "q")
    length = rows.groupBy(F.size("q").alias("d")).agg(F.count("*").alias("c")).agg(F.max_by("d", F.struct("c", "d")).alias("d"))
    return rows.where(F.size("q") == materialise(length).scalar())


def blocks(rows: DataFrame, size: int, partition_rows: int) -> DataFrame:
    """Rows sorted by label and falling norm, cut into blocks of at most ``size``: one row with arrays for each, written."""
    n = max(1, -(-rows.count() // partition_rows))
    order = F.col("label"), F.col("norm").desc(), F.col("id")
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in _rebatched(batches, size):
            ids, labels, norms = (batch.column(i).to_numpy() for i in range(3))
            q = batch.column(3).flatten().to_numpy()
            largest = int(np.abs(q).max(initial=0))
            kind = next(k for k in (np.int16, np.int32, np.int64) if largest <= np.iinfo(k).max)
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([labels[0]], pa.int64()), pa.array([labels[-1]], pa.int64()),
                pa.array([norms.max()], pa.float64()), *[pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, norms)],
                pa.array([np.dtype(kind).itemsize], pa.int32()), pa.array([q.astype(kind).tobytes()], pa.binary())],
                names=[c.split()[0] for c in _BLOCK.split(", ")])
            number += 1

    return materialise(dealt.select("id", "label", "norm", "q").mapInArrow(run, _BLOCK))


def _rebatched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``size``, the last of what is left."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while n + batch.num_rows >= size:
            held.append(batch.slice(0, size - n))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            batch, held, n = batch.slice(size - n), [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Search:
    """Candidates in written buckets, anchors in written pieces that are put together into tiles."""

    def __init__(self, candidates: DataFrame, anchors: DataFrame):
        chunk = F.shiftright("block", 33) * F.lit(1 << 20) + F.floor(F.col("block").bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(CHUNK_ROWS // BUCKET_ROWS))
        self.buckets = blocks(candidates, BUCKET_ROWS, CHUNK_ROWS).withColumn("chunk", chunk)
        chunks = self.buckets.groupBy("chunk").agg(F.min("label_low").alias("from"), F.max("label_high").alias("to"), F.max("top").alias("top"))
        # of each label, the tenth of the chunks with the largest norms goes first: all of them, if norms are equal
        first = chunks.groupBy("from").agg(F.percentile_approx("top", 0.9).alias("high"))
        self.chunks = materialise(chunks.join(first, "from").withColumn("first", F.col("top") >= F.col("high")).drop("high"))
        pieces = blocks(anchors, TILE_ANCHORS, TILE_ANCHORS).withColumnRenamed("block", "piece")
        # a row for each piece: as many neighbours as fill a tile go together
        ended = F.sum("n").over(Window.orderBy("piece"))
        tiles = pieces.select("piece", F.floor((ended - F.col("n")) / F.lit(TILE_ANCHORS)).alias("tile"))
        self.pieces = materialise(pieces.join(tiles, "piece"))

    def whole(self) -> DataFrame:
        """One window for each anchor, without limits."""
        places = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
        return self.pieces.select("piece", places.alias("place"), F.lit(1).alias("nth"), F.lit(NONE).alias("low"), F.lit(ALL).alias("high"), F.lit(1.0).alias("norm"))

    def best(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """The ``k`` best rows of each window (piece, place, nth, low, high, norm), of the anchor's label or of others.

        Result: the columns of _FOUND and rank.
        """
        found = materialise(_ranked(self._round(windows, F.col("first"), k, same), k))
        full = found.where(F.col("rank") == k).select("piece", "place", "nth", F.col("score").alias("kth"), F.col("norm").alias("length"))
        later = windows.join(full, ["piece", "place", "nth"], "left").select(
            "piece", "place", "nth", F.greatest("low", F.coalesce("kth", F.lit(NONE))).alias("low"), "high", F.coalesce("length", "norm").alias("norm"))
        more = self._round(materialise(later), ~F.col("first"), k, same)
        return _ranked(found.drop("rank").unionByName(more), k)

    def _round(self, windows: DataFrame, which: Column, k: int, same: bool) -> DataFrame:
        """Pairs of tiles and chunks that the bound leaves, then the search in each; both sides are blocks of bounded size."""
        reach = windows.groupBy("piece").agg(F.min(F.col("low") / F.greatest(F.col("norm"), F.lit(1e-300))).alias("reach"))
        tiles = self.pieces.select("piece", "tile", "label_low", "label_high").join(reach, "piece").groupBy("tile").agg(
            F.min("label_low").alias("label_low"), F.max("label_high").alias("label_high"), F.min("reach").alias("reach"))
        overlap = (F.col("label_low") <= F.col("to")) & (F.col("from") <= F.col("label_high"))
        alone = (F.col("from") == F.col("to")) & (F.col("label_low") == F.col("label_high")) & (F.col("from") == F.col("label_low"))
        reached = F.col("top") * F.lit(1 + SLACK) >= F.col("reach") * F.when(F.col("reach") > 0, 1 - SLACK).otherwise(1.0)
        pairs = materialise(self.chunks.where(which).join(tiles, (overlap if same else ~alone) & reached).select("tile", "chunk"))
        window = F.sort_array(F.collect_list(F.struct("place", "nth", "low", "high"))).alias("windows")  # of a piece: bounded
        left = self.pieces.join(windows.groupBy("piece").agg(window), "piece").join(pairs, "tile").select(
            "tile", "chunk", "piece", "n", "ids", "labels", "norms", "width", "matrix",
            *[F.col(f"windows.{c}").alias(c) for c in ("place", "nth", "low", "high")])
        right = self.buckets.join(pairs, "chunk").select("tile", "chunk", "n", "top", "ids", "labels", "width", "matrix")

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            return _searched(a, b, k, same)

        return left.groupBy("tile", "chunk").cogroup(right.groupBy("tile", "chunk")).applyInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("piece", "place", "nth").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _floored_tenth(number: str) -> Column:
    return F.expr(f"({number} - pmod({number}, 10)) div 10")


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(row["matrix"], f"i{row['width']}").reshape(len(ids), -1)


def _searched(left: pa.Table, right: pa.Table, k: int, same: bool) -> pa.Table:
    """The ``k`` best rows of a chunk for each window of a tile, among those that beat its limit."""
    out: list[tuple[np.ndarray, ...]] = []
    buckets = sorted(right.to_pylist(), key=lambda r: -r["top"])
    for piece in left.to_pylist():
        ids, labels, own = _read(piece)
        norms = np.frombuffer(piece["norms"])
        place, nth, low, high = (np.array(piece[c], np.int64) for c in ("place", "nth", "low", "high"))
        w_best, i_best, s_best = (np.empty(0, np.int64) for _ in range(3))
        for bucket in buckets:
            open_ = np.flatnonzero(norms[place] * bucket["top"] * (1 + SLACK) >= low)
            if not len(open_):
                continue
            b_ids, b_labels, b = _read(bucket)
            rows, at = np.unique(place[open_], return_inverse=True)
            exact = norms[rows].max() * bucket["top"] * (1 + SLACK) < 1 << 53  # no partial sum is larger either
            kind = np.float64 if exact else np.int64
            scores = own[rows].astype(kind) @ b.astype(kind).T
            allowed = labels[rows][:, None] == b_labels[None, :]
            allowed = allowed & (ids[rows][:, None] != b_ids[None, :]) if same else ~allowed
            for start in range(0, len(open_), 512):
                w = open_[start : start + 512]
                r = at[start : start + 512]
                s = scores[r]
                fits = allowed[r] & (s >= low[w][:, None]) & (s <= high[w][:, None])
                if fits.sum() > 2 * k * len(w) and s.shape[1] > k:  # else there is little to leave out
                    kth = np.partition(np.where(fits, s, NONE), -k, axis=1)[:, -k]
                    fits &= s >= kth[:, None]
                i, j = np.nonzero(fits)
                w_best, i_best, s_best = (np.concatenate(x) for x in ((w_best, w[i]), (i_best, b_ids[j]), (s_best, s[i, j].astype(np.int64))))
            order = np.lexsort((i_best, -s_best, w_best))
            w_best, i_best, s_best = w_best[order], i_best[order], s_best[order]
            begin = np.flatnonzero(np.r_[True, w_best[1:] != w_best[:-1]]) if len(w_best) else np.empty(0, np.int64)
            rank = np.arange(len(w_best)) - np.repeat(begin, np.diff(np.r_[begin, len(w_best)]))
            last = rank == k - 1
            low[w_best[last]] = np.maximum(low[w_best[last]], s_best[last])
            keep = rank < k
            w_best, i_best, s_best = w_best[keep], i_best[keep], s_best[keep]
        p = place[w_best]
        out.append((np.full(len(p), piece["piece"], np.int64), p.astype(np.int32), nth[w_best].astype(np.int32), norms[p], ids[p], i_best, s_best))
    names = [c.split()[0] for c in _FOUND.split(", ")]
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)


def mine(vectors: DataFrame, anchors: Column | None = None, positives: int = 5, negatives: int = 10, scale: float = 256.0,
         share: Share = Share()) -> DataFrame:
    """For each anchor and each of its best positives, the best rows of other labels inside the positive's window.

    ``vectors``: vec_id, embedding, label (whole numbers); ``anchors``: which rows are anchors, by ``id`` (all by default).
    A score is the inner product of the integer vectors; higher ones come first, ties by smaller id. A window goes from
    share.low to share.high tenths of the positive's score, both included, without rounding. Rows of the anchor's own id are
    no positives; repeated rows count each for itself. Rows that ``integer_rows`` names take no part; an anchor without
    positives, or a window without rows, has no result; an empty table has none. Vectors of any length work as long as
    BUCKET_ROWS of them fit a task. Other columns are not read, whatever they are named.
    Result: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = integer_rows(vectors.select("vec_id", "embedding", "label"), scale)
    search = Search(rows, rows if anchors is None else rows.where(anchors))
    found = materialise(search.best(search.whole(), positives, True).withColumn("nth", F.col("rank")).drop("rank"))
    low, high = _floored_tenth(f"score * {share.low} + 9"), _floored_tenth(f"score * {share.high}")
    windows = found.select("piece", "place", "nth", low.alias("low"), high.alias("high"), "norm").where("low <= high")
    best = search.best(windows, negatives, False)
    positive = found.select("piece", "place", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return best.join(positive, ["piece", "place", "nth"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
