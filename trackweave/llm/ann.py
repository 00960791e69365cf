"""Nearest neighbours by vantage-point trees: one of few levels that deals vectors and queries to regions, one for each shard of a region."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Distinct vectors in a shard, about; queries in a block; vectors in a leaf.
SHARD_ROWS, BLOCK_QUERIES, LEAF = 4096, 256, 48
#: Vectors of the sample, chosen by a hash, that the upper levels are fitted on. All vectors are dealt by them.
SAMPLE_ROWS = 16_384
#: Distances of unit vectors are off by less: the root of a few rounding errors.
ROUNDING = 1e-6
#: Pairs of vectors that are compared at a time.
PAIRS = 20_000


class VantagePointTree:
    """Distinct unit vectors in a binary tree of balls, in arrays.

    A node splits its points at the median distance from its vantage point; for both halves it knows the least and
    largest of these distances, from which the triangle inequality bounds the distance of any query.
    """

    #: Of each node: its vantage point or -1 for a leaf; bounds of both halves; both children; a leaf's part of ``order``.
    ARRAYS = ("units", "point", "bounds", "child", "span", "order")

    def __init__(self, units: np.ndarray, **arrays: np.ndarray):
        self.units = units
        if arrays:
            self.__dict__.update(arrays)
            return
        self._rows: list[tuple] = []
        self._leaves: list[np.ndarray] = []
        self._placed = 0
        if len(units):
            self._build(np.arange(len(units)))
        columns = list(zip(*self._rows, strict=True)) or [[]] * 4
        self.point, self.bounds = np.array(columns[0], np.int64), np.array(columns[1], np.float64).reshape(-1, 4)
        self.child, self.span = np.array(columns[2], np.int64).reshape(-1, 2), np.array(columns[3], np.int64).reshape(-1, 2)
        self.order = np.concatenate([np.empty(0, np.int64), *self._leaves])

    def _build(self, own: np.ndarray) -> int:
        at = len(self._rows)
        if len(own) <= LEAF:
            self._rows.append((-1, (0.0,) * 4, (-1, -1), (self._placed, self._placed + len(own))))
            self._leaves.append(own)
            self._placed += len(own)
            return at
        self._rows.append(())
        # the point farthest from the middle sees the widest spread of distances
        middle = self.units[own].mean(0)
        point = own[np.argmax(((self.units[own] - middle) ** 2).sum(1))]
        own = own[own != point]
        d = np.sqrt(np.maximum(0, 2 - 2 * (self.units[own] @ self.units[point])))
        order = np.argsort(d, kind="stable")
        inner, outer = np.split(order, [len(own) // 2])
        bounds = d[inner[0]], d[inner[-1]], d[outer[0]], d[outer[-1]]
        self._rows[at] = (point, bounds, (self._build(own[inner]), self._build(own[outer])), (0, 0))
        return at

    def arrays(self) -> dict[str, np.ndarray]:
        return {x: getattr(self, x) for x in self.ARRAYS}

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """For each query the indices (-1: none) and distances of its ``k`` nearest vectors, unordered.

        A branch is left out if its bound times ``factor`` is beyond the k-th distance so far: 1 is exact.
        """
        best = np.full((len(queries), k), -1, np.int64)
        far = np.full((len(queries), k), np.inf)

        def offer(who: np.ndarray, points: np.ndarray, d: np.ndarray) -> None:
            every = np.concatenate([far[who], d], 1)
            which = np.concatenate([best[who], np.broadcast_to(points, d.shape)], 1)
            keep = np.argpartition(every, k - 1, axis=1)[:, :k]
            far[who], best[who] = np.take_along_axis(every, keep, 1), np.take_along_axis(which, keep, 1)

        def visit(node: int, who: np.ndarray, bound: np.ndarray) -> None:
            near = bound * factor <= far[who].max(1) + 1e-9
            who, bound = who[near], bound[near]
            if not len(who):
                return
            point = self.point[node]
            if point < 0:
                own = self.order[slice(*self.span[node])]
                offer(who, own, np.sqrt(np.maximum(0, 2 - 2 * (queries[who] @ self.units[own].T))))
                return
            a, b, c, e = self.bounds[node]
            inner, outer = self.child[node]
            d = np.sqrt(np.maximum(0, 2 - 2 * (queries[who] @ self.units[point])))
            offer(who, np.array([point]), d[:, None])
            inside = np.maximum(bound, np.maximum(d - b, a - d))
            outside = np.maximum(bound, np.maximum(d - e, c - d))
            # all queries of a block go together, to the half first that is nearer to most
            halves = (inner, inside), (outer, outside)
            for half, limit in halves if (inside <= outside).mean() >= 0.5 else halves[::-1]:
                visit(half, who, limit)

        if len(self.point) and len(queries):
            visit(0, np.arange(len(queries)), np.zeros(len(queries)))
        return best, far

    def within(self, queries: np.ndarray, reach: np.ndarray, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (query, vector) no further apart than the query's ``reach``, by their indices."""
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def visit(node: int, who: np.ndarray, bound: np.ndarray) -> None:
            near = bound * factor <= reach[who]
            who, bound = who[near], bound[near]
            if not len(who):
                return
            point = self.point[node]
            own = self.order[slice(*self.span[node])] if point < 0 else np.array([point])
            d = np.sqrt(np.maximum(0, 2 - 2 * (queries[who] @ self.units[own].T)))
            q, p = np.nonzero(d <= reach[who][:, None])
            found.append((who[q], own[p]))
            if point >= 0:
                a, b, c, e = self.bounds[node]
                d = d[:, 0]
                for half, limit in zip(self.child[node], (np.maximum(d - b, a - d), np.maximum(d - e, c - d)), strict=True):
                    visit(half, who, np.maximum(bound, limit))

        if len(self.point) and len(queries):
            visit(0, np.arange(len(queries)), np.zeros(len(queries)))
        return tuple(np.concatenate(x) for x in zip((np.empty(0, np.int64),) * 2, *found, strict=True))


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, initial=0, keepdims=True)  # else squares of very large or small numbers are lost
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the vectors as they are; of their directions where their squares are beyond double precision."""
    with np.errstate(all="ignore"):
        squares = (a * a).sum(1), (b * b).sum(1)
        score = (a * b).sum(1) / (np.sqrt(squares[0]) * np.sqrt(squares[1]))
    lost = ~np.isfinite(score) | (np.minimum(*squares) < 1e-290)
    score[lost] = (_units(a[lost]) * _units(b[lost])).sum(1)
    return score


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part, repeated rows once."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(fine & F.exists("v", lambda x: x != 0))
    return rows.select("vec_id", "v", F.size("v").alias("dim")).distinct()


class Router:
    """The upper levels of a vantage-point tree: each leaf is a region of all unit vectors of one dimension.

    A node sends what is no further from its vantage point than ``limit`` to its first child. That rule, not the sample it
    was fitted on, bounds how near a region can be.
    """

    def __init__(self, units: np.ndarray, leaves: int):
        self.point: list[np.ndarray] = []
        self.limit: list[float] = []
        self.child: list[list[int]] = []  # a leaf is given as -1 minus its number
        self.leaves = 0
        self.root = self._split(np.unique(units, axis=0), leaves)

    def _split(self, own: np.ndarray, leaves: int) -> int:
        if leaves > 1 and len(own) > 1:
            point = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
            d = _distances(own, point)
            limit = float(np.median(d))
            inside = d <= limit
            if not inside.all():
                at = len(self.point)
                self.point.append(point)
                self.limit.append(limit)
                self.child.append([])
                self.child[at] = [self._split(own[inside], leaves - leaves // 2), self._split(own[~inside], leaves // 2)]
                return at
        self.leaves += 1
        return -self.leaves

    def reached(self, units: np.ndarray, far: np.ndarray, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(vector, leaf): the regions that may hold something as near as ``far`` to a vector; its own one always is."""
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def visit(node: int, who: np.ndarray, bound: np.ndarray) -> None:
            near = bound * factor <= far[who] + ROUNDING
            who, bound = who[near], bound[near]
            if not len(who):
                return
            if node < 0:
                found.append((who, np.full(len(who), -1 - node)))
                return
            over = _distances(units[who], self.point[node]) - self.limit[node]
            for child, limit in zip(self.child[node], (over, -over), strict=True):
                visit(child, who, np.maximum(bound, limit))

        visit(self.root, np.arange(len(units)), np.zeros(len(units)))
        return tuple(np.concatenate(x) for x in zip((np.empty(0, np.int64),) * 2, *found, strict=True))

    def home(self, units: np.ndarray) -> np.ndarray:
        """The leaf that each vector is dealt to."""
        leaf = np.zeros(len(units), np.int64)

        def visit(node: int, who: np.ndarray) -> None:
            if node < 0:
                leaf[who] = -1 - node
            elif len(who):
                inside = _distances(units[who], self.point[node]) <= self.limit[node]
                visit(self.child[node][0], who[inside])
                visit(self.child[node][1], who[~inside])

        visit(self.root, np.arange(len(units)))
        return leaf


def _distances(units: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (units @ point)))


def _routers(usable: DataFrame, n: int, shard_rows: int) -> dict[int, Router]:
    """A router for each dimension that the sample holds; vectors of others are one region."""
    sample = usable.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE_ROWS).select("v", "dim").toArrow()
    dims, rows = sample["dim"].to_numpy(), sample["v"].to_pylist()
    routers = {}
    for dim in np.unique(dims):
        own = np.array([v for v, d in zip(rows, dims, strict=True) if d == dim], np.float64)
        routers[int(dim)] = Router(_units(own), -(-n * len(own) // (len(rows) * shard_rows)))
    return routers


def build_index(vectors: DataFrame, k: int, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """(dim, leaf, shard, tree) and (dim, leaf, shards): the vectors (vec_id, v, dim, leaf) of each shard, with the ids that share a vector.

    A region of more than ``shard_rows`` vectors is dealt to several shards by a hash of the ids, so that copies of one
    vector fill no shard. Of ids with the very same vector the least k + 1 can be among any query's k nearest, so a shard keeps those.
    """

    def build(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        points = np.array(table["v"].to_pylist(), np.float64).reshape(len(ids), -1)
        order = np.lexsort((ids, *points.T[::-1]))
        ids, points = ids[order], points[order]
        new = np.concatenate([[True], (points[1:] != points[:-1]).any(1)])
        begin = np.flatnonzero(new)
        nth = np.arange(len(ids)) - begin[np.cumsum(new) - 1]
        kept = nth <= k
        tree = _packed(points=points[begin], ids=ids[kept], owner=(np.cumsum(new) - 1)[kept], **VantagePointTree(_units(points[begin])).arrays())
        return pa.table({**{c: table[c][:1] for c in ("dim", "leaf", "shard")}, "tree": pa.array([tree], pa.binary())})

    # a row for each region, written, so that its size decides whether it is broadcast
    shards = materialise(vectors.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / shard_rows).alias("shards")))
    dealt = vectors.join(shards, ["dim", "leaf"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards"))).drop("shards")
    key = ["dim", "leaf", "shard"]
    # dealt anew by shard: a join by region would leave all shards of a hot one together
    return materialise(dealt.repartition(*key).groupBy(*key).applyInArrow(build, "dim int, leaf long, shard long, tree binary")), shards


def _blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """(dim, leaf, queries): the queries that go to a region, in blocks."""
    def pack(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        points = np.array(table["v"].to_pylist(), np.float64).reshape(len(ids), -1)
        return pa.table({"dim": table["dim"][:1], "leaf": table["leaf"][:1], "queries": pa.array([_packed(ids=ids, points=points)], pa.binary())})

    dealt = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dim", "leaf", "block").applyInArrow(pack, "dim int, leaf long, queries binary")


def _found(blocks: DataFrame, index: DataFrame, shards: DataFrame, k: int, factor: float) -> DataFrame:
    """(query_id, vec_id, score): the best of each shard that a block of queries meets. A block is sent to the shards of its region one by one."""
    def run(batches):
        for batch in batches:
            for tree_bytes, query_bytes in zip(batch.column(0), batch.column(1), strict=True):
                held, asked = np.load(io.BytesIO(tree_bytes.as_py())), np.load(io.BytesIO(query_bytes.as_py()))
                points, ids, owner, own, at = held["points"], held["ids"], held["owner"], asked["ids"], asked["points"]
                tree = VantagePointTree(**{x: held[x] for x in VantagePointTree.ARRAYS})
                # one more than asked for, as a query finds itself; then all that are as near but for rounding, so that ties are whole
                units = _units(at)
                _, far = tree.search(units, min(k + 1, len(points)), factor)
                who, point = tree.within(units, far.max(1) + ROUNDING, factor)
                first, last = np.searchsorted(owner, point), np.searchsorted(owner, point, side="right")
                each = np.repeat(np.arange(len(point)), last - first)
                member = np.arange(len(each)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[each]
                who, point, found = who[each], point[each], ids[member]
                parts = [slice(x, x + PAIRS) for x in range(0, len(who), PAIRS)]
                score = np.concatenate([np.empty(0), *[_cosine(at[who[x]], points[point[x]]) for x in parts]])
                other = own[who] != found
                who, found, score = who[other], found[other], score[other]
                order = np.lexsort((found, -score, who))
                who, found, score = who[order], found[order], score[order]
                nth = np.arange(len(who)) - np.searchsorted(who, who)
                top = nth < k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[who[top]]), pa.array(found[top]), pa.array(score[top])], names=["query_id", "vec_id", "score"])

    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")
    sent = blocks.join(shards, ["dim", "leaf"]).select("dim", "leaf", each, "queries")
    return sent.join(index, ["dim", "leaf", "shard"]).select("tree", "queries").mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, factor: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` nearest by cosine of each row whose vec_id is divisible by ``every``: (query_id, rank, vec_id, score).

    Vectors are dealt to regions, and each region's to shards with a tree. A query first searches its own region; then it goes to the other
    regions that its k-th distance reaches. The best of all are ranked, nearest first, ties to the smaller vec_id. Scores are computed on the
    original vectors in double precision. With ``factor`` 1 the search is exact, more prunes more.

    Vectors that are null or zero or hold null or non-finite components take no part, nor do null ids; rows that
    repeat id and vector count once, and a query's own id is never its neighbour. Vectors of different lengths are
    never compared. Multiples of one vector are as near as each other, and any number of ties is ranked by id. An empty
    table has no rows; other columns are not read.
    """
    usable = materialise(_usable(vectors))
    n = usable.count()
    sent = usable.sparkSession.sparkContext.broadcast(_routers(usable, n, shard_rows) if n else {})

    def regions(batches):
        """The home of each vector; with a column ``far``, the other regions within that distance."""
        for batch in batches:
            dims, at, leaf = batch.column("dim").to_numpy(), [], []
            for dim in np.unique(dims):
                who, router = np.flatnonzero(dims == dim), sent.value.get(int(dim))
                if router is None:
                    one, to = np.arange(len(who)), np.zeros(len(who), np.int64)
                    home = to
                else:
                    units = _units(np.array(batch.column("v").take(pa.array(who)).to_pylist(), np.float64))
                    home = router.home(units)
                    one, to = np.arange(len(who)), home
                if "far" in batch.schema.names:
                    if router is None:
                        one = to = one[:0]
                    else:
                        one, to = router.reached(units, batch.column("far").to_numpy()[who], factor)
                        one, to = one[to != home[one]], to[to != home[one]]
                at.append(who[one])
                leaf.append(to)
            at, leaf = (np.concatenate([np.empty(0, np.int64), *x]) for x in (at, leaf))
            own = [batch.column(c).take(pa.array(at)) for c in ("vec_id", "v", "dim")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(leaf, pa.int64())], names=["vec_id", "v", "dim", "leaf"])

    schema = "vec_id long, v array<double>, dim int, leaf long"
    homes = materialise(usable.mapInArrow(regions, schema))
    index, shards = build_index(homes, k, shard_rows)
    queries = homes.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    near = materialise(_found(_blocks(queries, blocks), index, shards, k, factor))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = near.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("kth"))
    waiting = queries.drop("leaf").join(kth, "vec_id", "left").withColumn("far", F.coalesce("kth", F.lit(float("inf")))).drop("kth")
    more = _found(_blocks(waiting.mapInArrow(regions, schema), blocks), index, shards, k, factor)
    return near.union(more).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
