"""Whitening, fingerprints and hard negatives against plain versions."""

import hashlib
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from trackweave.llm import fingerprints, hard_negatives, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def _numpy_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = (n * fit - s) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return n, ((n * x - s) ** 2).sum(1), (n * x - s) / n @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize("size,d,k", [(300, 40, 6), (50, 5, 16), (400, 70, 3)])
def test_whitening_against_numpy(spark, size, d, k):
    random = np.random.default_rng(size)
    vectors = random.standard_normal((size, d)) * np.linspace(1, 3, d)
    vectors[size // 2 :] = vectors[0]  # half of all rows are copies
    rows = [(i, [float(c) for c in np.float32(v)], 0) for i, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS), k).orderBy("vec_id").collect()
    n, deviation, whitened, explained = _numpy_whitening(vectors, k)
    assert [r.deviation for r in got] == list(deviation) and {r.n for r in got} == {n}
    found = np.array([r.whitened for r in got])
    assert found.shape == whitened.shape
    signs = np.sign((found * whitened).sum(0))
    assert np.abs(found * signs - whitened).max() < 1e-7
    assert np.allclose(got[0].explained, explained, rtol=1e-9) and got[0].identity_error < 1e-9


def test_whitening_leaves_out_what_is_no_vector(spark):
    base = [(1, [1.0, 2.0], 0), (2, [2.0, 5.0], None), (2, [2.0, 5.0], None), (None, [4.0, -1.0], 1)]
    odd = [(5, None, 0), (6, [1.0, None], 0), (7, [float("nan"), 1.0], 0), (8, [1.0, -math.inf], 0), (9, [1.0], 0), (10, [], 0), (11, [3e38, 0.0], 0)]
    got = whitening.whitened_rows(spark.createDataFrame(base + odd, VECTORS))
    assert sorted((r.vec_id or 0, r.component) for r in got.collect()) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]
    assert got.first().n == 3
    for few in (odd[:2], base[:1]):  # nothing, and a covariance of rank 0
        assert whitening.whitened_rows(spark.createDataFrame(few, VECTORS)).collect() == []
    clash = spark.createDataFrame([(1, [1.0, 0.0], 5, 6, 7), (2, [0.0, 1.0], 5, 6, 7)], "vec_id long, embedding array<double>, x int, n int, id int")
    rank_one = whitening.whitened_rows(clash).collect()
    assert [(r.vec_id, r.component, r.n) for r in rank_one] == [(1, 1, 2), (2, 1, 2)]


def test_deviation_beyond_a_long_is_null():
    assert whitening._deviation(np.array([1 << 31]), 2, [0]) is None
    assert whitening._deviation(np.array([3, -1]), 5, [1, 2]) == 14**2 + 7**2


def _jaccard(a, b):
    low = sum(min(v, b[t]) for t, v in a.items())
    return low / (sum(a.values()) + sum(b.values()) - low)


def test_collisions_estimate_the_generalised_jaccard_similarity():
    random = np.random.default_rng(1)
    sampler, errors = fingerprints.Sampler(), []
    for _ in range(300):
        n = int(random.integers(5, 60))
        a, b = ({f"t{i}": float(w) for i, w in enumerate(random.integers(0, 9, n)) if w} for _ in range(2))
        if not a or not b:
            continue
        near = (sampler.samples(a) == sampler.samples(b)).mean()
        low = sum(min(v, b.get(t, 0)) for t, v in a.items())
        errors.append(near - low / (sum(a.values()) + sum(b.values()) - low))
    # unbiased, with the spread of a share of that many samples
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 1.3 * 0.5 / math.sqrt(fingerprints.SAMPLES)


def test_samples_do_not_depend_on_parts_or_memory(monkeypatch):
    weights = {f"w{i}": float(1 + i % 4) for i in range(500)}
    whole = fingerprints.Sampler().samples(weights)
    monkeypatch.setattr(fingerprints, "AT_ONCE", 64)
    monkeypatch.setattr(fingerprints, "HELD", 100)
    sampler = fingerprints.Sampler()
    assert (sampler.samples(weights) == whole).all()
    assert (sampler.samples(dict(reversed(weights.items()))) == whole).all()


def test_terms_of_texts_without_spaces():
    assert fingerprints.terms_of("A a b b") == {"a": 2, "b": 2}
    long = "x" * 20 + "y" * 20
    assert sum(fingerprints.terms_of(long).values()) == 33
    assert not fingerprints.terms_of(" \n")


DOCUMENTS = [(3, "gamma delta epsilon zeta"), (1, "alpha beta gamma"), (2, None), (5, ""), (4, "long " * 6000), (7, "gamma delta epsilon zeta"), (None, "no id"), (7, "another")]


def _brute_force(rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    sampler, out = fingerprints.Sampler(), []
    for i, (k, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        a, b, c = map(sampler.of_text, (text, edited, after))
        out.append((k, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.as_hex(a), fingerprints.as_hex(b), (a == b).mean(), (a == c).mean()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [DOCUMENTS, DOCUMENTS[:1], [], [(9, f"text {i}") for i in range(40)]], ids=["mixed", "one", "none", "one id"])
def test_edited_fingerprints_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as range", "2 as border", "3 as bounds", "4 as first")
    got = sorted((tuple(r) for r in fingerprints.edited_fingerprints(docs.repartition(3)).collect()), key=str)
    assert got == _brute_force(rows)
    plain = {(r.doc_id, r.fingerprint) for r in fingerprints.fingerprint_documents(docs).collect()}
    assert plain == {(r[0], r[3]) for r in got}


def test_likeness_of_columns(spark):
    a, b = (fingerprints.as_hex(fingerprints.Sampler().of_text(t)) for t in ("one two three four", "one two three five"))
    share = sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / fingerprints.SAMPLES
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.likeness("a", "b").alias("l")).first()
    assert row.l == share and 0 < share < 1


def _brute_negatives(rows, is_anchor, positives=5, negatives=10, scale=256):
    valid = [(k, y, [math.floor(scale * c) for c in v]) for k, v, y in rows if k is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for k, y, q in valid:
        if not is_anchor(k):
            continue
        scored = sorted((-dot(q, r), i, z == y) for i, z, r in valid)
        for s, p, _ in [x for x in scored if x[2] and x[1] != k][:positives]:
            inside = [x for x in scored if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(k, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(inside, 1)]
    return sorted(out)


def _mined(spark, rows, **more):
    kind = "vec_id long, embedding array<double>, label int, id int, norm int, q int"
    data = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], kind)
    return sorted(map(tuple, hard_negatives.mine(data, F.col("id") % 4 == 0, **more).collect()))


def _vectors(n, d, labels, spread, seed):
    random = np.random.default_rng(seed)
    v = random.standard_normal((n, d)) * np.exp(random.uniform(0, spread, (n, 1)))
    return [(i, [float(c) for c in x], int(random.integers(0, labels))) for i, x in enumerate(v)]


@pytest.mark.parametrize("spread,labels", [(0.0, 3), (3.0, 2), (3.0, 40)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, spread, labels):
    for name, value in (("BUCKET_ROWS", 8), ("CHUNK_ROWS", 16), ("TILE_ANCHORS", 10)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = _vectors(240, 6, labels, spread, labels)
    rows[100:180] = [(i, rows[0][1], y) for i, _, y in rows[100:180]]  # a third of all are copies
    rows += rows[4:8] + [(300, [0.0] * 6, 1), (304, [0.0] * 6, 1)]  # repeated ids, zero vectors
    assert _mined(spark, rows) == _brute_negatives(rows, lambda k: k % 4 == 0)


def test_hard_negatives_of_large_and_missing_values(spark):
    rows = [(k, [c * 1e5 for c in v], y) for k, v, y in _vectors(60, 4, 2, 0.5, 3)]  # products beyond 2**53
    odd = [(60, None, 1), (64, [1.0, None, 0.0, 0.0], 1), (68, [float("nan")] * 4, 1), (72, [1.0] * 4, None), (None, [1.0] * 4, 1), (76, [math.inf] * 4, 0)]
    assert _mined(spark, rows + odd) == _brute_negatives(rows, lambda k: k % 4 == 0)
    assert _mined(spark, rows + [(80, [1e30] * 4, 1), (84, [1.0], 1), (88, [], 1)]) == _brute_negatives(rows, lambda k: k % 4 == 0)
    assert _mined(spark, odd) == [] and _mined(spark, rows[:1]) == []
    assert _mined(spark, rows, positives=2, negatives=3) == _brute_negatives(rows, lambda k: k % 4 == 0, 2, 3)


def test_norm_bounds_leave_buckets_out(spark, monkeypatch):
    for name, value in (("BUCKET_ROWS", 8), ("CHUNK_ROWS", 8), ("TILE_ANCHORS", 8)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = [(i, [math.exp(-i / 20), 0.0], i % 2) for i in range(400)]
    plain = hard_negatives.integer_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    search = hard_negatives.Search(plain, plain.where("id < 4"))
    seen = []
    real = hard_negatives.materialise
    monkeypatch.setattr(hard_negatives, "materialise", lambda df: seen.append(df.columns == ["tile", "chunk"] and df.count()) or real(df))
    search.best(search.whole(), 5, True).collect()
    pairs = [n for n in seen if n is not False]
    assert len(pairs) == 2 and pairs[1] < search.chunks.count() / 2
