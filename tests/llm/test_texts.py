"""Operators on single texts against brute force: tokens, packing, contamination, quality."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trackweave.llm import common, decontaminate, packing, quality, token_counts, token_output, vocabulary

LONG = "the quick brown fox jumps over it\n" * 20_000
TEXTS = [None, "", " ", "a", "one two three", "one two three", "  two  spaces ", "tab\tand\nline \n x", "<|endoftext|> inside", "naïve café 日本語 🙂", LONG, "x" * 5000]
SCHEMA = "doc_id long, text string, n_tokens string, sequence_id string, __text_1 string"


@pytest.fixture(scope="module")
def docs(spark):
    common.ensure_importable(spark)
    rows = [(k, t, "clash", "clash", "c") for k, t in enumerate(TEXTS)] + [(None, "no id", None, None, None), (4, "one two three", "clash", "clash", "c")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary.DEFAULT_FILE)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sédtre.,!1²½_日\u00a0|"), st.characters(codec="utf-8")), max_size=60))
def test_ids_equal_the_library(text):
    own = vocabulary.load()
    want = Tokenizer.from_file(vocabulary.DEFAULT_FILE) if not hasattr(test_ids_equal_the_library, "lib") else test_ids_equal_the_library.lib
    test_ids_equal_the_library.lib = want
    ids = want.encode(text, add_special_tokens=False).ids
    assert own.ids(text) == ids
    assert own.count_batch([text]) == [len(ids)]


def test_counts(docs, none, library):
    rows = token_counts.count_tokens(docs).collect()
    assert len(rows) == len(TEXTS) + 2 and token_counts.count_tokens(none).count() == 0
    for r in rows:
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)


def test_packing_is_lossless(docs, none, library):
    rows = packing.pack_documents(docs, with_ids=True).collect()
    assert packing.pack_documents(none).count() == 0
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, own in by_doc.items():
        text = "no id" if k is None else TEXTS[k] or ""
        want = [*library.encode(text, add_special_tokens=False).ids, 1]
        copies = 2 if k == 4 else 1
        assert sum(r["length"] for r in own) == copies * len(want)
        if copies == 1:
            ids = b"".join(r["ids"] for r in sorted(own, key=lambda r: r["start"]))
            assert np.frombuffer(ids, "<u4").tolist() == want and own[0]["doc_tokens"] == len(want)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_patterns_use_each_piece_once(counts):
    patterns = packing.pack_histogram(counts, 64)
    used = {}
    for pattern, n in patterns:
        assert sum(pattern) <= 64
        for length in pattern:
            used[length] = used.get(length, 0) + n
    assert used == counts and len(patterns) <= 2 * max(1, len(counts))


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 300), st.data())
def test_patterns_fill_like_piece_by_piece(capacity, data):
    """The same free room as placing one piece after the other, longest first, where there is most room."""
    pieces = sorted(data.draw(st.lists(st.integers(1, capacity), max_size=200)), reverse=True)
    rooms = []
    for length in pieces:
        at = max(range(len(rooms)), key=rooms.__getitem__, default=None)
        if at is None or rooms[at] < length:
            rooms.append(capacity - length)
        else:
            rooms[at] -= length
    patterns = packing.pack_histogram({n: pieces.count(n) for n in set(pieces)}, capacity)
    assert sorted(capacity - sum(pattern) for pattern, n in patterns for _ in range(n)) == sorted(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_decreasing(sizes):
    free = []
    want = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [f for f in free if f >= sizes[k]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - sizes[k])
        else:
            free.append(32 - sizes[k])
        want.append(k)
    bins = token_output.best_fit_decreasing(sizes, 32)
    assert sorted(k for b in bins for k in b) == sorted(want) and len(bins) == len(free)
    assert sorted(32 - sum(sizes[k] for k in b) for b in bins) == sorted(free)


def test_matrices_round_trip(docs, none, library):
    rows = token_output.packed_matrices(docs, shard_tokens=5000).collect()
    assert token_output.packed_matrices(none).count() == 0
    found = {}
    for r in rows:
        ids, positions, cuts = np.frombuffer(r["input_ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4"), r["cu_seqlens"]
        assert len(ids) == len(positions) == 2048 and cuts[0] == 0 and cuts[-1] == r["n_tokens"] and len(cuts) == r["n_segments"] + 1
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], cuts, cuts[1:], strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
            found.setdefault(doc, []).append((start, ids[a:b].tolist()))
        assert positions[cuts[-1] :].tolist() == list(range(2048 - cuts[-1])) and (ids[cuts[-1] :] == 50256).all()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for k, parts in found.items():
        if k != 4:
            text = "no id" if k is None else TEXTS[k] or ""
            assert [i for _, x in sorted(parts) for i in x] == [*library.encode(text, add_special_tokens=False).ids, 50256]
    digest = {r["sequence_id"]: r for r in token_output.packed_matrices(docs, shard_tokens=5000, digest=True).collect()}
    assert all(digest[r["sequence_id"]]["ids_crc32"] == zlib.crc32(r["input_ids"]) for r in rows)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute_hits(text, items, width=10):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, body in items:
        own = WORD.findall(lower(body))
        for w in {tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))} if own else ():
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (3, ""), (4, None), (10, "SHORT item"), (5, "é ü 1 2 3 4 5 6 7 8 9 10 11 12"), (5, "é ü 1 2 3 4 5 6 7 8 9 10 11 12")]
DOCS = [(0, "x alpha BETA gamma, delta epsilon zeta eta theta iota kappa lambda. y"), (1, "a short\nitem and short-item"), (2, None), (3, ""), (4, "é ü 1 2 3 4 5 6 7 8 9 10 11"), (5, "clean words only"),
        (6, "beta gamma delta epsilon zeta eta theta iota kappa"), (7, "word " * 30_000 + "short item"), (7, "a short item"), (None, "short item")]


@pytest.mark.parametrize("shard_bytes", [10**6, 40])
def test_contamination(spark, shard_bytes):
    common.ensure_importable(spark)
    docs = spark.createDataFrame([(k, t, "clash") for k, t in DOCS], "doc_id long, text string, found string").drop("found")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.find_contamination(docs, bench, shard_bytes=shard_bytes, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        f = r["found"]
        assert (f["n_words"], f["n_hit"], f["items"]) == brute_hits(r["text"], ITEMS)
        for s in f["spans"]:
            assert WORD.findall(lower(r["text"][s["start"] : s["end"]]))[0] in ("alpha", "beta", "gamma", "short", "é", "ü", "1", "2", "3", "4", "5")


def test_contamination_digest_and_filter(spark):
    docs = spark.createDataFrame([(k, t, "c") for k, t in DOCS], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    digest = {(r["doc_id"], r["n_words"]): r for r in decontaminate.contamination_digest(docs, bench).collect()}
    assert digest[(1, 6)]["items_sha256"] == hashlib.sha256(b"10,2").hexdigest() and digest[(1, 6)]["n_items"] == 2
    assert digest[(5, 3)]["items_sha256"] == hashlib.sha256(b"").hexdigest() and not digest[(5, 3)]["contaminated"]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect())) == [2, 3, 5, 6]
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(docs, nothing).count() == len(DOCS)
    assert decontaminate.contamination_digest(docs.limit(0), bench).count() == 0


def test_long_items_are_dealt_out(spark):
    item = " ".join(f"w{k}" for k in range(5000))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(k, k + 10))) for k in range(1980, 2010)], "doc_id long, text string")
    assert decontaminate.contamination_digest(docs, bench).where("n_hit = 10").count() == 30


def test_quality_on_held_out_rows(spark):
    common.ensure_importable(spark)
    docs, labels = (common.read_table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    scored = quality.score_documents(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", "quality", "score").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    assert len(rows) > 700 and right > 0.98
    assert sum(r["predicted"] == 0 and r["quality"] == 1 for r in rows) <= 0.005 * len(rows)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "t", "x"), (1, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == len(TEXTS) + 2 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    some = spark.createDataFrame([(k, k % 2, 0) for k in range(12)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    kept = quality.drop_low_quality(docs, some)
    assert kept.columns == docs.columns and quality.score_documents(docs.limit(0), some).count() == 0


def test_forest_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.3)).astype(float)
    assert ((quality.train(x[:1500], y[:1500]).scores(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97
    assert np.isfinite(quality.train(x[:5], np.ones(5)).scores(x)).all()
