"""Nearest neighbours dealt to regions, against all pairs."""

import numpy as np
import pytest

from trackweave.llm import ann, common


def _brute(vectors, every, k):
    out = set()
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    for q in range(0, len(vectors), every):
        score = (vectors[q] * vectors).sum(1) / (np.sqrt((vectors[q] ** 2).sum()) * np.sqrt((vectors**2).sum(1)))
        order = [i for i in np.lexsort((np.arange(len(vectors)), -score)) if i != q][:k]
        out |= {(q, rank, int(i)) for rank, i in enumerate(order, 1)}
    assert units.shape == vectors.shape
    return out


def _clusters(n, d, seed, spread=0.05):
    random = np.random.default_rng(seed)
    centres = random.standard_normal((12, d))
    v = centres[random.integers(0, 12, n)] + spread * random.standard_normal((n, d))
    v[: n // 3] = v[0]  # a third are copies
    return v[random.permutation(n)]


@pytest.mark.parametrize("spread", [0.05, 3.0], ids=["clusters", "no clusters"])
def test_regions_lose_no_neighbour(spark, spread):
    common.ensure_importable(spark)
    v = _clusters(900, 8, 1, spread)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(frame, every=20, shard_rows=40).collect()}
    assert got == _brute(v, 20, 5)


def test_a_relaxed_factor_finds_most(spark):
    v = _clusters(900, 8, 2)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(frame, every=20, shard_rows=40, factor=2.0).collect()}
    want = _brute(v, 20, 5)
    assert len(got & want) >= 0.9 * len(want)


def test_clusters_need_few_regions():
    units = ann._units(_clusters(3000, 8, 3))
    router = ann.Router(units[:1000], 16)
    leaf = router.home(units)
    assert router.leaves > 8 and leaf.max() < router.leaves
    nearest = np.sort(np.sqrt(np.maximum(0, 2 - 2 * units @ units.T)), axis=1)[:, 6]
    who, to = router.reached(units, nearest)
    assert len(who) < 0.4 * len(units) * router.leaves
    assert {(i, leaf[i]) for i in range(len(units))} <= set(zip(who.tolist(), to.tolist(), strict=True))
    one = ann.Router(np.ones((50, 3)) / np.sqrt(3), 8)  # copies alone can't be parted
    assert one.leaves == 1 and (one.home(np.eye(3)) == 0).all()
