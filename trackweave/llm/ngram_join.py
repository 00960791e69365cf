"""Exact similarity join of word-shingle sets in the Jaccard metric, by pivots.

Documents with the same set are one class. Two classes can only be linked if they share one of their rarest
shingles (their prefix), so each prefix shingle is a cell; the class of a cell that holds most shared shingles
is its pivot. The pivot's region is the cells it rules: every class of a cell, also one that lies nearer to
another pivot, is measured against the cell's pivot, so a class on a border is in each region that it could
have a link in. Classes linked to one pivot are one component and need no pairs among themselves. What is
left of a cell gets its next pivot, again and again, while large; then classes of different
components meet in pairs if the triangle inequality on their distances to the pivot allows a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashFilter, checkpoint, drop_table, materialise, quoted

#: A-Z in lower case, ASCII white space as spaces.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
#: The first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of texts that are hashed at a time.
TOGETHER = 200_000
#: Buckets whose shingles are counted, and a chunk of them in a row.
BUCKETS, CHUNK = 1 << 18, 1 << 14
#: Cells of up to this many classes are joined in pairs; larger ones get further pivots first, while these pay.
SMALL_CELL = 32


def _mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = h ^ (h >> np.uint64(shift))
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and 64 bits for each, mixed eight bytes at a time after the word's length."""
    raw = b" " + raw + b" " * 8
    blank = np.frombuffer(raw, np.uint8) == 0x20
    begins = starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    left = np.flatnonzero(~blank[:-1] & blank[1:]) - starts
    eight = np.ndarray(len(raw) - 8, "<u8", raw, 1, (1,))
    found = _mixed(left.astype(np.uint64))
    own = slice(None)
    while len(starts):
        found[own] = _mixed(found[own] ^ (eight[starts] & _FIRST[np.minimum(left, 8)]))
        longer = np.flatnonzero(left > 8)
        own = longer if isinstance(own, slice) else own[longer]
        starts, left = starts[longer] + 8, left[longer] - 8
    return begins, found


def _mixed_runs(words: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(words) - width + 1)
    found = np.full(n, width, np.uint64)
    for k in range(width):
        found += words[k : k + n]
        found = _mixed(found)
    return found


def _distinct(found: np.ndarray) -> np.ndarray:
    found = np.sort(found)
    new = np.empty(len(found), bool)
    new[:1] = True
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return found[new]


def all_shingles(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct ``width``-word shingles; a shorter text, if not empty, is one.

    Texts are hashed some at a time, a long one alone, which takes about 40 bytes for each of theirs.
    """
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        begins, words = _word_hashes(b" ".join(held))
        runs = _mixed_runs(words, width)
        bounds = np.searchsorted(begins, np.cumsum([0, *(len(x) + 1 for x in held)])).tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield _distinct(runs[a : b - width + 1]) if b - a >= width else _mixed_runs(words[a:b], b - a)[: b - a]

    for text in texts:
        held.append((text or "").encode().translate(_PLAIN))
        size += len(held[-1])
        if size >= TOGETHER:
            yield from flush()
            held, size = [], 0
    yield from flush()


def shingles(text: str | None, width: int) -> np.ndarray:
    return next(all_shingles([text], width))


def _class_of(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def _bucket(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(46)).astype(np.int64)


def _classified(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, t1, n_shingles, cls) for each row, t1 a hash of its text; and the shingles counted by bucket in rows
    (chunk, counts) of each task."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "t1", "n_shingles", "cls", "chunk", "counts"]

    def run(batches):
        counts, empty = np.zeros(BUCKETS, np.int32), None
        for batch in batches:
            sizes, classes = [], []
            for found in all_shingles(batch.column(2).to_pylist(), width):
                np.add.at(counts, _bucket(found), np.int32(1))
                sizes.append(len(found))
                classes.append(_class_of(found))
            n, empty = len(sizes), pa.nulls(1, batch.column(0).type)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if empty is not None:
            for k in range(BUCKETS // CHUNK):
                part = counts[k * CHUNK : (k + 1) * CHUNK]
                yield pa.RecordBatch.from_arrays(
                    [empty, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([part.astype("<i4").tobytes()], pa.binary())],
                    names=names)

    return docs.select("doc_id", F.xxhash64("text").alias("t1"), "text").mapInArrow(run, f"doc_id {kind}, t1 long, n_shingles long, cls binary, chunk int, counts binary")


def _bucket_counts(classified: DataFrame) -> np.ndarray:
    """The sums over all tasks, BUCKETS numbers whatever the input; a task adds up the chunks that it gets one by one."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts.as_py(), "<i4").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    rows = classified.where("chunk is not null").select("chunk", "counts")
    total = np.zeros(BUCKETS, np.int64)
    for r in rows.repartition(BUCKETS // CHUNK, "chunk").mapInArrow(add, "chunk int, counts binary").collect():
        total[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    return total


def _prefixes(docs: DataFrame, counts: np.ndarray, width: int, num: int, den: int) -> DataFrame:
    """(cls, doc_id, n, central, keys): a document of each class, the class's prefix, rarest first, and how shared its shingles are."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            rows, at = [], []
            for i, found in enumerate(all_shingles(batch.column(1).to_pylist(), width)):
                cls = _class_of(found)
                if cls is None or cls in seen:
                    continue
                seen.add(cls)
                rarity, n = sent.value[_bucket(found)], len(found)
                keep = n - -(-num * n // den) + 1
                order = np.lexsort((found, rarity))[:keep]
                rows.append((cls, n, float(np.log2(rarity[order] + 1).mean()), found[order].view(np.int64)))
                at.append(i)
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.float64(), pa.list_(pa.int64())), strict=True))],
                names=["doc_id", "cls", "n", "central", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, cls binary, n long, central double, keys array<long>").groupBy("cls").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "n", "central", "keys")])


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cls, elements) of the wanted classes (cls, doc_id). Few other documents pass the filter on their ids."""
    near = docs.where(HashFilter(wanted, F.xxhash64("doc_id")).passes(F.xxhash64("doc_id"))).select("text")

    def run(batches):
        seen = set()
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                rows = []
                for found in all_shingles(batch.column(0)[begin : begin + 500].to_pylist(), width):
                    cls = _class_of(found)
                    if cls is not None and cls not in seen:
                        seen.add(cls)
                        rows.append((cls, found.view(np.int64)))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.list_(pa.int64())), strict=True)], names=["cls", "elements"])

    return near.mapInArrow(run, "cls binary, elements array<long>").join(wanted.select("cls"), "cls", "left_semi").groupBy("cls").agg(
        F.first("elements").alias("elements"))


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the undirected ``links`` (a, b); a component is named by its least node.

    Labels spread to neighbours; from the third turn on they also jump to their label's label, so that long chains shrink
    by half. Every turn is written to the shared folder.
    """
    ends = materialise(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpoint(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    turn = 0
    while True:
        near = ends.join(labels.toDF("b", "of_b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("of_b").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        if turn >= 2:
            jump = labels.toDF("component", "further")
            lower = lower.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "was")
        lower, turn = checkpoint(lower), turn + 1
        labels = lower.select("node", "component")
        if lower.where("component <> was").limit(1).count() == 0:
            drop_table(ends)
            return labels


def _fits(na: Column, nb: Column, a: Column, b: Column, num: int, den: int) -> Column:
    """Sets of these sizes that share the shingle at these places of their prefixes could be similar enough."""
    length = F.least(na, nb) * den >= F.greatest(na, nb) * num
    return length & (F.least(na - a, nb - b) * (num + den) >= (na + nb) * num)


def _promising(pairs: DataFrame, prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose prefixes share enough: one of both sets has no further common shingle outside its prefix's rest."""
    own = prefixes.select("cls", "n", "keys")
    both = pairs.join(own.toDF("a", "na", "ka"), "a").join(own.toDF("b", "nb", "kb"), "b")
    most = F.size(F.array_intersect("ka", "kb")) + F.greatest(F.col("na") - F.size("ka"), F.col("nb") - F.size("kb"))
    return both.where(most * (num + den) >= (F.col("na") + F.col("nb")) * num).select("a", "b")


def _measured(docs: DataFrame, pairs: DataFrame, prefixes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The promising ones of the pairs (a, b), with the sizes of their sets' intersection and union."""
    pairs = materialise(_promising(pairs, prefixes, num, den))
    ends = pairs.select("a").union(pairs.select("b")).toDF("cls").distinct()
    wanted = materialise(prefixes.select("cls", "doc_id").join(ends, "cls", "left_semi"))
    sets = _sets(docs, wanted, width)
    shared = F.size(F.array_intersect("ea", "eb")).cast("long")
    out = materialise(pairs.join(sets.toDF("a", "ea"), "a").join(sets.toDF("b", "eb"), "b").select(
        "a", "b", shared.alias("both"), (F.size("ea") + F.size("eb") - shared).alias("either")))
    drop_table(pairs)
    drop_table(wanted)
    return out


def find_links(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(classified rows, classes with their component); classes without a link are not in the latter."""
    classified = materialise(_classified(docs, width))
    counts = _bucket_counts(classified)
    prefixes = materialise(_prefixes(docs, counts, width, num, den))
    each = prefixes.select("cls", "n", "central", F.posexplode("keys").alias("pos", "key"))
    # the smaller set of a linked pair has the cell's shingle early enough for a set of its own size
    early = (F.col("n") - F.col("pos")) * (num + den) >= 2 * F.col("n") * num
    # one number counts a cell's classes and, in its upper half, those that have the shingle early
    size = each.select("key", F.when(early, (1 << 32) + 1).otherwise(1).alias("one")).groupBy("key").agg(F.sum("one").alias("size"))
    shared = materialise(size.where((F.col("size") % (1 << 32) > 1) & (F.col("size") >= 1 << 32)).select("key"))
    # what most entries carry through the shuffle in vain is one number too: 9 bits central, 28 n, 26 pos
    packed = F.shiftleft(F.least(F.lit(511), F.round(F.col("central") * 10)).cast("long"), 54) + F.shiftleft(F.col("n"), 26) + F.col("pos")
    met = each.select("cls", "key", packed.alias("x")).join(shared, "key")
    open_cells = materialise(met.select("key", "cls", (F.shiftright("x", 26) % (1 << 28)).alias("n"), F.shiftright("x", 54).alias("central"),
                                        (F.col("x") % (1 << 26)).alias("pos")))
    close = F.col("both") * den >= F.col("either") * num
    found, turn, left = [], 0, None
    while True:
        pivot = F.struct(F.col("cls").alias("p"), F.col("n").alias("pn"), F.col("pos").alias("pp"))
        pivots = open_cells.groupBy("key").agg(F.max_by(pivot, F.struct("central", "cls")).alias("x"), F.count("*").alias("size"))
        pivots = pivots.where(F.col("size") > (SMALL_CELL if turn else 1)).select("key", "x.*")
        met = materialise(open_cells.join(pivots, "key", "left"))
        drop_table(open_cells)
        pairs = met.where("cls <> p").where(_fits(F.col("n"), F.col("pn"), F.col("pos"), F.col("pp"), num, den)).select(F.col("cls").alias("a"), F.col("p").alias("b")).distinct()
        measured = _measured(docs, pairs, prefixes, width, num, den)
        found.append(measured)
        # one component for sure: a pivot and what is linked to it, each class with the least of its pivots
        sure = _all(found).where(close).groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("component"))
        distance = measured.select(F.col("a").alias("cls"), F.col("b").alias("p"), (1 - F.col("both") / F.col("either")).alias("distance"))
        rest = met.where("p is null or cls <> p").join(distance, ["cls", "p"], "left").select("key", "cls", "n", "central", "pos", *_distances(turn), F.col("distance").alias(f"at{turn}"))
        rest = rest.join(sure, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        mixed = rest.groupBy("key").agg(F.count("*").alias("cell"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
        open_cells, turn = materialise(rest.join(mixed.select("key", "cell"), "key")), turn + 1
        drop_table(met)
        # a further pivot has to halve the pairs that large cells would make
        now = open_cells.where(F.col("cell") > SMALL_CELL).agg(F.sum("cell")).first()[0] or 0
        if now == 0 or left is not None and 2 * now > left:
            break
        left, open_cells = now, open_cells.drop("cell")
    pairs = materialise(_window_pairs(open_cells, _distances(turn), num, den))
    if pairs.limit(1).count():
        found.append(_measured(docs, pairs, prefixes, width, num, den))
    components = connected(_all(found).where(close).select("a", "b"))
    for done in (open_cells, pairs, prefixes, shared, *found):
        drop_table(done)
    return classified.where("chunk is null"), components


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _distances(turns: int) -> list[str]:
    """The columns of the distances to a cell's pivots, one for each round; null where a class was not measured in it."""
    return [f"at{k}" for k in range(turns)]


def _window_pairs(cells: DataFrame, distances: list[str], num: int, den: int) -> DataFrame:
    """Classes of a cell that are in different components and could be linked: their sizes, the places of the shared
    shingle and, by the triangle inequality, their distances to each pivot that both were measured against differ little enough."""
    a, b = cells.alias("a"), cells.alias("b")
    near = F.lit(True)
    for at in distances:
        near &= F.coalesce(F.abs(F.col(f"a.{at}") - F.col(f"b.{at}")) <= 1 - num / den + 1e-9, F.lit(True))
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.cls") < F.col("b.cls")) & (F.col("a.component") != F.col("b.component"))
    fits = _fits(F.col("a.n"), F.col("b.n"), F.col("a.pos"), F.col("b.pos"), num, den)
    return a.join(b, met & fits & near).select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) for each input row.

    A text's words stand between ASCII white space, A-Z lower-cased; its set holds the distinct runs of ``width``
    words, or the whole text as one if shorter. Two rows are linked if the Jaccard similarity of their sets is
    ``num/den`` or more; component_id is the least doc_id that links reach. Null and empty texts have no
    shingles and no links and are their own component. A null id is no candidate for component_id (rows with
    only null ids have a null one); rows with one id but different texts are linked only if their texts are.
    Repeated rows each get theirs; ties in rarity are ordered by hash and change no result; an empty table has no rows; other
    columns are not read. Whole texts count, of up to 2**28 distinct shingles. Shingles are told apart by
    64 bits and sets by 128 bits of their hashes, which are not polynomials of the text.
    """
    rows, components = find_links(docs, width, num, den)
    least = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    of_class = least.join(components.withColumnRenamed("node", "cls"), "cls", "left")
    of_component = of_class.where("component is not null").groupBy("component").agg(F.min("least").alias("lowest"))
    of_class = of_class.join(of_component, "component", "left").select("cls", F.coalesce("lowest", "least").alias("component_id"))
    return rows.join(materialise(of_class), "cls", "left").select(
        "doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One document of each component, all its columns as they were: that with the least doc_id (nulls last), among equal
    ids that with the least hash of its text, of repeated rows any one. Texts without shingles stay.
    """
    names = docs.columns
    rows, components = find_links(docs, width, num, den)
    own = rows.where("cls is not null").join(components.withColumnRenamed("node", "cls"), "cls", "left").select(
        F.coalesce("component", "cls").alias("component"), F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "t1").alias("row"))
    best = own.groupBy("component").agg(F.min("row").alias("row"), F.count("*").alias("size")).select("row.*")
    bare = rows.where("cls is null").select(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "t1").distinct()
    stay = materialise(best.union(bare))
    packed = docs.select(F.struct(*[F.col(quoted(c)) for c in names]).alias("__doc"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__t1"))

    def those(keys: DataFrame) -> DataFrame:
        met = F.col("__id").eqNullSafe(F.col("id")) & (F.col("__t1") == F.col("t1"))
        return packed.join(keys, met, "left_semi")

    repeated = rows.where("cls is not null").groupBy(F.col("doc_id").alias("id"), "t1").count().where("count > 1").select("id", "t1")
    again = F.col("s.id").eqNullSafe(F.col("r.id")) & (F.col("s.t1") == F.col("r.t1"))
    twice = materialise(stay.alias("s").join(repeated.alias("r"), again, "left_semi"))
    if twice.limit(1).count() == 0:
        kept = those(stay)
    else:  # only the few rows that repeat are compared with each other
        once = stay.alias("s").join(twice.alias("r"), again, "left_anti")
        kept = those(once).unionByName(those(twice).dropDuplicates(["__id", "__t1"]))
    return kept.select(*[F.col(f"__doc.{quoted(c)}").alias(c) for c in names])
