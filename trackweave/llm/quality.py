"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import packed_rows, unpacked_rows

#: Labelled rows that training looks at, at most; which ones is decided by a hash of their ids.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, L2, LEAST_ROWS = 60, 4, 0.2, 64, 1.0, 10
#: Score from which a document counts as good.
THRESHOLD = 0.3
_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"|", b"#$%&*+=^~<>@", b"\"'()[]{}-_/\\:;"]
FEATURES = ["log_bytes", "log_words", "upper", "lower", "digit", "space", "newline", "stop", "comma", "exclaim", "bar", "symbol", "other_mark", "beyond_ascii",
            "word_length", "word_length_spread", "short_words", "long_words", "distinct_words", "top_word", "repeats", "upper_words", "capital_words", "marked_words",
            "log_lines", "line_words", "short_lines", "distinct_lines", "alone_marks"]
_OF = np.zeros((256, len(_GROUPS) + 1))
for _k, _g in enumerate(_GROUPS):
    _OF[list(_g), _k] = 1
_OF[128:, len(_GROUPS)] = 1


def statistics(text: str | None) -> np.ndarray:
    """The features of a text, from all of it; a null or empty text has zeros."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = np.frombuffer(text.encode(), np.uint8)
    out[0] = np.log1p(len(raw))
    out[2:14] = np.bincount(raw, minlength=256) @ _OF / len(raw)
    words = text.split()
    n = len(words)
    if not n:
        return out
    out[1] = np.log1p(n)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    out[14:18] = lengths.mean(), lengths.std(), (lengths <= 3).mean(), (lengths >= 14).mean()
    out[18:21] = len(counts) / n, max(counts.values()) / n, sum(map(str.__eq__, words, words[1:])) / n
    out[21:24] = sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n, sum(not w[-1].isalnum() for w in words) / n
    lines = text.split("\n")
    out[24:28] = np.log1p(len(lines)), n / len(lines), sum(len(x) < 30 for x in lines) / len(lines), len(set(lines)) / len(lines)
    out[28] = sum(not w.isalnum() for w in words if len(w) == 1) / n
    return out


@dataclass
class Forest:
    """All trees in one set of arrays: a leaf leads to itself, so DEPTH steps reach every leaf."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        each = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(DEPTH):
                node = np.where(rows[each, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def train(rows: np.ndarray, labels: np.ndarray) -> Forest:
    """Boosted trees for the log-odds of label 1. Without rows the score is 0.5; with one class it is near that class."""
    n, width = rows.shape
    share = (labels.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if n and 0 < labels.sum() < n:
        edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)], 1)
        flat = binned + np.arange(width) * BINS
        total = np.full(n, base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            grad, hess = labels - p, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([])
            open_nodes = [(roots[-1], np.arange(n))]
            for depth in range(DEPTH + 1):
                below = []
                for node, own in open_nodes:
                    g, h = grad[own], hess[own]
                    leaf = RATE * g.sum() / (h.sum() + L2)
                    split = None
                    if depth < DEPTH and len(own) >= 2 * LEAST_ROWS:
                        keys = flat[own].ravel()
                        size = width * BINS
                        sums = [np.bincount(keys, w, size).reshape(width, BINS).cumsum(1) for w in (np.repeat(g, width), np.repeat(h, width), None)]
                        gl, hl, nl = sums
                        gain = gl**2 / (hl + L2) + (g.sum() - gl) ** 2 / (h.sum() - hl + L2) - g.sum() ** 2 / (h.sum() + L2)
                        gain[(nl < LEAST_ROWS) | (len(own) - nl < LEAST_ROWS)] = -1
                        f, b = divmod(int(gain.argmax()), BINS)
                        if gain[f, b] > 1e-6 and b < len(edges[f]):
                            split = f, b
                    if split is None:
                        nodes[node] = [0, 0.0, node, node, leaf]
                        total[own] += leaf
                        continue
                    f, b = split
                    goes = binned[own, f] <= b
                    nodes[node] = [f, edges[f][b], len(nodes), len(nodes) + 1, 0.0]
                    below += [(len(nodes), own[goes]), (len(nodes) + 1, own[~goes])]
                    nodes += [[], []]
                open_nodes = below
    columns = list(zip(*nodes, strict=True)) or [[]] * 5
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    return Forest(base, np.array(roots, np.int64), *(np.array(c, k) for c, k in zip(columns, kinds, strict=True)))


def _held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Train on at most ``sample_rows`` labelled documents whose crc32(doc_id) mod 5 is not 0.

    The labels of an id count as one, their mean; null labels and ids don't count. The sample of labels is
    bounded, so it is broadcast; so is what comes back, also where ids repeat in ``docs``.
    """
    sample = labels.where("doc_id is not null and quality is not null").where(~_held_out()).groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches):
        for batch in batches:
            rows = [statistics(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = known.select("doc_id", "text", "label").mapInArrow(run, f"doc_id {kind}, label int, x array<double>") \
        .orderBy(F.xxhash64("doc_id", "x"), "doc_id", "label").limit(sample_rows).toArrow()
    rows = np.array(found["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return train(rows, found["label"].to_numpy().astype(np.float64))


def _with_scores(docs: DataFrame, forest: Forest, keep: list[str], least: float | None = None) -> DataFrame:
    """(row, score): the columns ``keep`` of each row as a struct; with ``least``, only rows with that score or more."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    names = list(dict.fromkeys([*keep, "text"]))
    rows = packed_rows(docs, names)
    at = names.index("text")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            score = sent.value.scores(np.stack([statistics(t.as_py()) for t in batch.column(0).field(at)]))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["row", "score"])
            yield out if least is None else out.filter(pa.array(score >= least))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) for each document.

    Labels, ids and all columns but the text have no part in a score. A null text scores as an empty one; a null
    id is not held out; repeated rows each get their row; without usable labels every score is 0.5; an empty
    table has no rows; other columns are not read. All of a text counts, however long. Ties: of an id's labels the
    mean decides, a half is label 1; a score of just ``threshold`` is predicted 1.
    """
    out = _with_scores(docs, fit(docs, labels, sample_rows), ["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "score")
    return out.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents with a score of ``threshold`` or more, all their columns as they were, whatever their names.

    Nulls, long texts, ties, repeated rows and empty tables: see score_documents.
    """
    return unpacked_rows(_with_scores(docs, fit(docs, labels, sample_rows), docs.columns, threshold), docs.columns)
