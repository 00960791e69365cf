"""Binary outputs by round trip, repeated benchmark rows, and the classifier against slow versions."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import binary_output, common, decontaminate, quality, token_output, vocabulary

TEXTS = ["one two three", "", None, "some words again " * 900, "x", "one two three"]


@pytest.mark.parametrize("file_bytes", [1 << 30, 1])
def test_binary_files_round_trip(spark, tmp_path, file_bytes):
    common.ensure_importable(spark)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    path = f"file://{tmp_path}/out"
    sequences = token_output.packed_matrices(docs, 512)
    index = binary_output.write_binary(sequences, path, file_bytes)
    back = binary_output.read_binary(spark, path)
    want, got = (sorted((r.asDict() for r in x.collect()), key=lambda r: r["sequence_id"]) for x in (sequences, back))
    assert got == want and index.count() == len(want)
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in binary_output.documents_of(back).collect()}
    words = vocabulary.load()
    assert ids == {k: [*np.frombuffer(words.ids_bytes(t or ""), "<u4").tolist(), token_output.END_OF_TEXT] for k, t in enumerate(TEXTS)}
    files = os.listdir(tmp_path / "out" / "data")
    assert len(files) == (len(want) if file_bytes == 1 else index.select("file").distinct().count())
    assert sum(os.path.getsize(tmp_path / "out" / "data" / f) for f in files) == 2 * 4 * 512 * len(want)
    with pytest.raises(FileExistsError):
        binary_output.write_binary(sequences, path)


def test_binary_files_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    binary_output.write_binary(token_output.packed_matrices(docs), f"file://{tmp_path}/none")
    assert binary_output.read_binary(spark, f"file://{tmp_path}/none").count() == 0


def test_repeated_benchmark_rows_count_once(spark):
    item = "one two three four five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([("a", item)] * 20_000 + [(None, item), ("null", item), ("b", None), (None, None)], "item_id string, text string").repartition(8)
    shards = decontaminate._shards(benchmark, "item_id", "text", 10, 600_000)
    assert len(shards) == 1 and shards[0].count() == 5
    docs = spark.createDataFrame([(1, f"before {item}, after"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    for size in (600_000, 20):
        found = {r.doc_id: r.found for r in decontaminate.find_contamination(docs, benchmark, shard_bytes=size).collect()}
        assert found[1]["items"] == [None, "a", "null"] and found[1]["n_hit"] == 11 and found[2]["items"] == [] and found[3]["n_words"] == 0
    digest = {r.doc_id: r for r in decontaminate.contamination_digest(docs, benchmark).collect()}
    assert digest[1].n_items == 3 and digest[1].items_sha256 == decontaminate.items_digest(["a", "null"])
    assert decontaminate.drop_contaminated(docs, benchmark).select(F.sum("doc_id")).first()[0] == 5


def _slow_tree(rows, edges, grad, hess, own, depth):
    """A tree as nested tuples, each split found by trying all edges of all features on the rows themselves."""
    g, h = sum(grad[i] for i in own), sum(hess[i] for i in own)
    best = None
    if depth < quality.DEPTH and len(own) >= 2 * quality.LEAST_ROWS:
        for f, limits in enumerate(edges):
            for limit in limits:
                left = [i for i in own if rows[i][f] <= limit]
                if len(left) < quality.LEAST_ROWS or len(own) - len(left) < quality.LEAST_ROWS:
                    continue
                gl, hl = sum(grad[i] for i in left), sum(hess[i] for i in left)
                gain = gl**2 / (hl + quality.L2) + (g - gl) ** 2 / (h - hl + quality.L2) - g**2 / (h + quality.L2)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                    best = gain, f, limit, left
    if best is None:
        return quality.RATE * g / (h + quality.L2)
    _, f, limit, left = best
    rest = sorted(set(own) - set(left))
    return f, limit, _slow_tree(rows, edges, grad, hess, left, depth + 1), _slow_tree(rows, edges, grad, hess, rest, depth + 1)


def _walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("seed", range(3))
def test_forest_against_a_slow_trainer_and_a_recursive_walk(monkeypatch, seed):
    monkeypatch.setattr(quality, "TREES", 6)
    random = np.random.default_rng(seed)
    rows = random.standard_normal((160, 4))
    rows[:, 3] = random.integers(0, 3, 160)  # ties
    labels = ((rows[:, 0] * rows[:, 1] > 0) ^ (random.random(160) < 0.1)).astype(float)
    forest = quality.train(rows, labels)
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, quality.BINS)[1:-1])) for f in range(4)]
    total, new = np.full(160, forest.base), random.standard_normal((50, 4))
    outside = np.full(50, forest.base)
    for _ in range(quality.TREES):
        p = 1 / (1 + np.exp(-total))
        tree = _slow_tree(rows.tolist(), [e.tolist() for e in edges], (labels - p).tolist(), (p * (1 - p)).tolist(), list(range(160)), 0)
        total += [_walk(tree, r) for r in rows]
        outside += [_walk(tree, r) for r in new]
    assert np.allclose(forest.scores(rows), 1 / (1 + np.exp(-total)), atol=1e-9)
    assert np.allclose(forest.scores(new), 1 / (1 + np.exp(-outside)), atol=1e-9)
