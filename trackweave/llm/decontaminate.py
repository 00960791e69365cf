"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise, packed_rows, quoted, unpacked_rows

#: Words of a text that is not lower-cased yet: runs of ASCII letters and digits and of all characters beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: As bytes of UTF-8: every separator becomes a space, A-Z lower case, all else stays.
_TABLE = bytes(
    c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else 0x20 for c in _LOWER)
#: Benchmark bytes that one automaton may hold. Windows of ten words make ten trie nodes of each byte,
#: of about 40 bytes each, so this takes some 250 MB of a worker.
AUTOMATON_BYTES = 600_000
#: Words of an item that go together; a longer item is dealt out in overlapping parts with the same windows.
PART_WORDS = 2_000
_STATE = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int,item:string>>"


def normalised_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def windows(text: str | None, width: int) -> list[bytes]:
    """Windows of an item: each run of ``width`` words; a shorter item, if not empty, is one window."""
    words = normalised_words(text)
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(1, len(words) - width + 1))]


class Automaton:
    """All windows of the given (item, text) pairs in one automaton over normalised text."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        import ahocorasick

        self.items = [item for item, _ in items]
        owners: dict[bytes, set[int]] = {}
        for k, (_, text) in enumerate(items):
            for window in windows(text, width):
                owners.setdefault(window, set()).add(k)
        self.machine = ahocorasick.Automaton()
        for window, ks in owners.items():
            self.machine.add_word(window.decode("latin-1"), (len(window), tuple(ks)))
        if owners:
            self.machine.make_automaton()
        self.empty = not owners

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, tuple[int, ...]]]]:
        """The number of words, and each occurrence as (first word, last word + 1, items)."""
        words = normalised_words(text)
        if not words or self.empty:
            return len(words), []
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        found = list(self.machine.iter(line))
        if not found:
            return len(words), []
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
        ends = np.searchsorted(spaces, [end for end, _ in found])
        starts = np.searchsorted(spaces, [end - length + 1 for end, (length, _) in found])
        return len(words), [(int(a), int(b), ks) for a, b, (_, (_, ks)) in zip(starts, ends, found, strict=True)]


def _in_order(item: str | None) -> tuple[bool, str]:
    return item is not None, item or ""


def _report(automaton: Automaton, text: str | None, before: list[dict]) -> dict:
    """Words, hit words, items and character spans, with those of earlier automata merged in."""
    n, found = automaton.scan(text)
    spans = {(s["start"], s["end"], s["item"]) for s in before}
    if found:
        at = [m.span() for m in WORD.finditer(text)]
        spans |= {(at[a][0], at[b - 1][1], automaton.items[k]) for a, b, ks in found for k in ks}
    hit = 0
    if spans:
        covered, marks = [m.span() for m in WORD.finditer(text)], sorted((a, b) for a, b, _ in spans)
        k, reach = 0, -1
        for a, b in covered:
            while k < len(marks) and marks[k][0] <= a:
                reach = max(reach, marks[k][1])
                k += 1
            hit += b <= reach
    return {"n_words": n, "n_hit": hit, "items": sorted({i for _, _, i in spans}, key=_in_order),
            "spans": [{"start": a, "end": b, "item": i} for a, b, i in sorted(spans, key=lambda s: (*s[:2], _in_order(s[2])))]}


def _shards(benchmark: DataFrame, item_col: str, text_col: str, width: int, shard_bytes: int) -> list[DataFrame]:
    """The benchmark in parts that are small enough to collect; a single part in the usual case."""

    def deal(batches):
        for batch in batches:
            items, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normalised_words(text)
                step = max(PART_WORDS, 2 * width) - width + 1
                starts = [0] if len(words) <= step + width - 1 else range(0, len(words) - width + 1, step)
                for s in starts:
                    items.append(item)
                    texts.append(b" ".join(words[s : s + step + width - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string())], names=["item", "text"])

    # repeated rows count once, here and in the sum: what is collected is what was summed
    items = materialise(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
                        .mapInArrow(deal, "item string, text string").distinct())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    if n == 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def _scanned(docs: DataFrame, benchmark: DataFrame, width: int, text_col: str, item_col: str, shard_bytes: int, keep: list[str]) -> DataFrame:
    """(row, found): the columns ``keep`` of each row as a struct, and what find_contamination says."""
    names = list(dict.fromkeys([*keep, text_col]))
    out = packed_rows(docs, names).withColumn("found", F.lit(None).cast(f"struct<{_STATE.replace(' long', ':bigint').replace(' array', ':array')}>"))
    kind, at = out.schema, names.index(text_col)
    shards = _shards(benchmark, item_col, "text", width, shard_bytes)
    for part in shards:
        items = [(r["item"], r["text"]) for r in part.collect()]
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            automaton = Automaton(sent.value, width)
            for batch in batches:
                texts, before = batch.column(0).field(at), batch.column(1)
                found = [_report(automaton, t.as_py(), (b.as_py() or {}).get("spans") or []) for t, b in zip(texts, before, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, batch.schema[1].type)], schema=batch.schema)

        before, out = out, out.mapInArrow(run, kind)
        if len(shards) > 1:
            out = materialise(out)
            drop_table(before)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", shard_bytes: int = AUTOMATON_BYTES,
                       keep: list[str] | None = None) -> DataFrame:
    """Scan every whole text once for every window of the benchmark.

    Returns the columns ``keep`` (the id alone by default) and a struct ``found`` of n_words, n_hit,
    items (sorted item ids as strings) and spans (start and end in code points of the original text,
    and the item). Only the benchmark is sent to the tasks, and only after its size was summed: one of up
    to ``shard_bytes`` is one automaton; a larger one is dealt into several, which scan one after
    another, each adding to what the ones before found, with the state written between them.

    A null or empty text has no words and no hits; a long one is scanned whole. A null item id is an item
    of its own, which stands first and is null in the lists. Repeated items count once, windows of several items count for each, repeated documents each get their
    row, and an empty benchmark hits nothing. An empty table has no rows; other columns are not read. ``keep`` may
    hold any names; one called "found" stands beside the struct.
    """
    keep = list(keep or [id_col])
    return _scanned(docs, benchmark, width, text_col, item_col, shard_bytes, keep).select(*[F.col(f"row.{quoted(c)}").alias(c) for c in keep], "found")


def contamination_digest(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 (of the comma-joined sorted items), contaminated.
    An item without an id counts, but has no part in the hash.

    Nulls, long texts, ties, repeated rows and empty tables: see find_contamination. Without items the hash is that of an
    empty string. Other columns of the documents are not returned.
    """
    found = find_contamination(docs, benchmark, width)
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents without any hit, all their columns as they were, whatever their names.

    Nulls, long texts, repeated rows and empty tables: see find_contamination.
    """
    scanned = _scanned(docs, benchmark, width, "text", "item_id", AUTOMATON_BYTES, docs.columns)
    return unpacked_rows(scanned.where(F.col("found.n_hit") == 0), docs.columns)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
