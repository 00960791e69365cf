"""Document fingerprints by consistent weighted sampling.

Each sample picks one weighted term of a text, and two texts pick the same one with a probability equal to their
generalised Jaccard similarity, sum(min(weights)) / sum(max(weights)). For a term of weight w, sample k draws from the
term's hash r, c ~ Gamma(2, 1) and b uniform, and takes t = floor(ln w / r + b), y = exp(r (t - b)) and
a = c / (y exp(r)); the term of the least a is picked, and the sample is the pair (term, t).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Samples of a fingerprint; hex digits that each of them takes.
SAMPLES, DIGITS = 64, 4
#: A word of more code points counts by its pieces of PIECE: a text without spaces still changes by degrees.
LONG_WORD, PIECE = 24, 8
#: Terms whose draws are held at a time, terms of one text that are compared at a time, and terms drawn at a time.
HELD, AT_ONCE, DRAWN = 32_768, 4_096, 128

_U = np.uint64
_STEPS = (np.arange(1, SAMPLES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))[None, :]


def _gamma_quantiles(bits: int = 16) -> np.ndarray:
    """Gamma(2, 1) values at the middles of 2**bits equal parts of (0, 1): the roots of 1 - (1 + x) exp(-x) = p, halved in."""
    p = (np.arange(1 << bits) + 0.5) / (1 << bits)
    low, high = np.zeros(len(p)), np.full(len(p), 64.0)
    for _ in range(60):
        x = (low + high) / 2
        under = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(under, x, low), np.where(under, high, x)
    return x


_GAMMA = _gamma_quantiles()
_R, _LOG_C = _GAMMA.astype(np.float32), np.log(_GAMMA).astype(np.float32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def draws(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each term (row) and sample (column): r, b and ln c, fixed by the term's 64-bit hash.

    Of 64 mixed bits r and c take 16 each, by the inverse of their distribution, and b takes 24.
    """
    bits = _mixed(hashes[:, None] + _STEPS)
    parts = bits.view(np.uint16).reshape(*bits.shape, 4)
    b = (bits >> _U(40)).astype(np.float32) * np.float32(2.0**-24)
    return _R.take(parts[..., 0]), b, _LOG_C.take(parts[..., 1])


def terms_of(text: str) -> Counter:
    """Lower-cased words between white space with their frequencies; of long words the pieces."""
    words = Counter(text.lower().split())
    for word in [w for w in words if len(w) > LONG_WORD]:
        n = words.pop(word)
        for i in range(len(word) - PIECE + 1):
            words[word[i : i + PIECE]] += n
    return words


class Sampler:
    """Fingerprints one text after another; the draws of up to HELD terms are kept for the next texts."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.hashes = np.empty(HELD, np.uint64)
        # the last is ln a of weight 1
        self.r, self.b, self.log_c, self.unit = (np.empty((HELD, SAMPLES), np.float32) for _ in range(4))

    def _places(self, terms: list[str]) -> np.ndarray:
        at = list(map(self.place.get, terms))
        if None not in at:
            return np.array(at, np.int64)
        new = [t for t, i in zip(terms, at, strict=True) if i is None]
        if len(self.place) + len(new) > HELD:
            self.place, new = {}, terms
        begin = len(self.place)
        self.place.update(zip(new, range(begin, begin + len(new)), strict=True))
        self.hashes[begin : begin + len(new)] = [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in new]
        for start in range(begin, begin + len(new), DRAWN):
            own = slice(start, min(start + DRAWN, begin + len(new)))
            r, b, log_c = draws(self.hashes[own])
            self.r[own], self.b[own], self.log_c[own], self.unit[own] = r, b, log_c, log_c - r * (1 - b)
        return np.fromiter(map(self.place.__getitem__, terms), np.int64, len(terms))

    def samples(self, weights: dict[str, float]) -> np.ndarray:
        """One 16-bit mark for each sample; zeros if there is no term."""
        best, mark, every = np.full(SAMPLES, np.inf), np.zeros(SAMPLES, np.uint64), np.arange(SAMPLES)
        terms = list(weights)
        for start in range(0, len(terms), AT_ONCE):
            some = terms[start : start + AT_ONCE]
            at = self._places(some)
            weight = np.fromiter(map(weights.__getitem__, some), np.float32, len(some))
            a = self.unit.take(at, 0)
            heavy = np.flatnonzero(weight != 1)
            own = at[heavy]
            t = np.floor(np.log(weight[heavy])[:, None] / self.r[own] + self.b[own])
            a[heavy] = self.log_c[own] - self.r[own] * (t - self.b[own] + 1)
            value = a.min(0)
            row, column = np.divmod(np.flatnonzero(a == value), SAMPLES)
            least = np.empty(SAMPLES, np.int64)
            least[column[::-1]] = row[::-1]  # the first, if there are several
            level = np.zeros(SAMPLES, np.int64)
            if len(heavy):
                nth = np.minimum(np.searchsorted(heavy, least), len(heavy) - 1)
                level = np.where(heavy[nth] == least, t[nth, every], 0).astype(np.int64)
            new = _mixed(self.hashes[at[least]] + _mixed(level.view(np.uint64)) + _STEPS[0])
            better = value < best
            best[better], mark[better] = value[better], new[better] % _U(65535) + _U(1)
        return mark.astype(np.uint16)

    def of_text(self, text: str) -> np.ndarray:
        return self.samples(terms_of(text))


def as_hex(marks: np.ndarray) -> str:
    return marks.astype(">u2").tobytes().hex()


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints, an estimate of the texts' generalised Jaccard similarity."""
    places = F.sequence(F.lit(0), F.lit(SAMPLES - 1))
    same = F.filter(places, lambda i: F.substr(a, i * DIGITS + 1, F.lit(DIGITS)) == F.substr(b, i * DIGITS + 1, F.lit(DIGITS)))
    return F.size(same) / F.lit(float(SAMPLES))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text, without a shuffle.

    A null text is an empty one, whose fingerprint is all zeros: like other empty texts and nothing else. Texts of any
    length are read whole, in parts of AT_ONCE terms. Ids may be null or repeat, each row has its own result; equal
    texts have equal fingerprints. An empty table has no rows; further columns are not read, whatever they are named.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            marks = [as_hex(sampler.of_text(x.as_py() or "")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (range, border, doc_id, text) sorted inside partitions, so that each row's next document follows it.

    Ranges of ids are dealt to a partition each, as many as ``spark.sql.shuffle.partitions``; the first document of a
    range also goes, as a border row, to the end of the range before (the first of all to the last range). Texts are
    shuffled once; the tables of bounds and firsts have a row for each range.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    at = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    bounds = materialise(ids.agg(F.percentile_approx("doc_id", at, 20 * n).alias("bounds")))
    placed = F.size(F.filter(F.coalesce("bounds", F.array().cast("array<long>")), lambda b: b <= F.col("doc_id"))).alias("range")
    in_range = lambda df: df.select("*", bounds.scalar().alias("bounds")).select(*df.columns, placed)
    firsts = in_range(ids).groupBy("range").agg(F.min(F.struct("doc_id"))["doc_id"].alias("first"))
    order = Window.orderBy("range")  # a row for each range
    last = F.max("range").over(Window.partitionBy())
    firsts = materialise(firsts.select("range", "first", F.coalesce(F.lag("range").over(order), last).alias("before")))
    rows = in_range(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    f = F.broadcast(firsts.select(F.col("range").alias("r"), "first", "before"))  # at most n rows
    rows = rows.join(f, (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    own = F.struct(F.col("range"), F.lit(False).alias("border"))
    copy = F.struct(F.col("before").alias("range"), F.lit(True).alias("border"))
    to = F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy)))
    dealt = rows.select(to.alias("to"), "doc_id", "text").select("to.range", "to.border", "doc_id", "text")
    return dealt.repartitionById(n, F.col("range")).sortWithinPartitions("range", "border", "doc_id", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how like they are.

    The edited text has the last quarter of the code points (rounded down) replaced by the first as many (or all) of the
    next document, in the order of ids; after the last comes the first. A null text is an empty one; empty texts are like
    each other alone. Texts of any length are taken whole. Of rows with equal ids the text decides the order; null ids
    come first. A table of one row has that as its own next; an empty one has no rows. Further columns are not read,
    whatever they are named. Result: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, waiting = Sampler(), None
        for batch in batches:
            out = []
            for part, border, doc_id, text in zip(*[c for c in map(_values, batch.columns)], strict=True):
                if border and (waiting is None or waiting[0] != part):
                    continue  # a later copy of the border's id
                marks = sampler.of_text(text)
                if waiting is not None and waiting[0] == part:
                    out.append(_edited(sampler, *waiting[1:], text, marks))
                waiting = None if border else (part, doc_id, text, marks)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=names)

    return with_next(docs).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _values(column: pa.Array) -> Iterator:
    return iter(column.to_pylist())


def _edited(sampler: Sampler, doc_id: int | None, text: str, marks: np.ndarray, after: str, after_marks: np.ndarray) -> tuple:
    n = len(text) // 4
    edited = text[: len(text) - n] + after[:n]
    other = sampler.of_text(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(marks), as_hex(other),
            float((marks == other).mean()), float((marks == after_marks).mean()))
