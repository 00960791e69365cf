"""URL filter: rules first, then the ratio of two character language models."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise
from .urls import host_of, path_of

#: (host, path, verdict)
Rule = tuple[str, str, str]
#: Longest context in bytes, four at most in a key; weight of the shorter context's estimate.
ORDER, SMOOTHING = 4, 2.0
#: Scores are calibrated in so many bins for each unit, up to this bound either way.
BINS, BOUND = 256, 8
_START, _END = 2, 3
#: URLs of a block, as a power of two: a block's distinct contexts and grams are looked up together.
BLOCK_BITS = 12


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The text and verdict of the longest rule that fits, else null."""
    text = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def _contexts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte of each text, and each text's end: the text's number and the 64-bit keys [order, byte] of its
    contexts and of the contexts with the byte."""
    coded = [bytes([_START] * ORDER) + t.encode() + bytes([_END]) for t in texts]
    line = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    sizes = np.array([len(c) for c in coded], np.int64)
    text = np.repeat(np.arange(len(coded)), sizes)
    inside = np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(inside >= ORDER)
    contexts, grams = np.empty((ORDER + 1, len(at)), np.int64), np.empty((ORDER + 1, len(at)), np.int64)
    packed = np.zeros(len(at), np.uint64)
    for k in range(ORDER + 1):
        if k:  # a byte of the context each; what is packed is exact, no two contexts share a key
            packed |= line[at - k] << np.uint64(8 * (k - 1))
        own = packed | np.uint64(2 * k << 40)
        contexts[k] = own.view(np.int64)
        grams[k] = (own | np.uint64(1 << 40) | line[at] << np.uint64(32)).view(np.int64)
    return text[at], contexts, grams


#: The sorted keys of contexts and grams, and their counts [class, key].
Model = tuple[np.ndarray, np.ndarray]


def _counts_of(model: Model, keys: np.ndarray) -> np.ndarray:
    """Counts [class, key]; 0 for keys that the model has not seen."""
    known, counts = model
    if not len(known):
        return np.zeros((2, len(keys)))
    distinct, inverse = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
    return np.where(known[at] == distinct, counts[:, at], 0)[:, inverse]


def count_table(labelled: DataFrame) -> DataFrame:
    """(key, r, a): exact counts of the contexts and grams of all rows of ``labelled`` (text, cls 0 or 1).

    Each task counts its batches, so that what is shuffled is a row for each distinct key of a batch. The table has a row
    for each distinct context or gram, and stays on Spark however many there are.
    """

    def run(batches):
        for batch in batches:
            classes, texts = np.array(batch.column(1).to_pylist(), np.int64), batch.column(0).to_pylist()
            if not texts:
                continue
            text, contexts, grams = _contexts(texts)
            keys, inverse = np.unique(np.concatenate([contexts, grams]), return_inverse=True)
            accepted = np.tile(classes[text], 2 * (ORDER + 1))
            both = np.bincount(inverse.ravel(), minlength=len(keys))
            a = np.bincount(inverse.ravel()[accepted == 1], minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(both - a), pa.array(a)], names=["key", "r", "a"])

    return labelled.select("text", "cls").mapInArrow(run, "key long, r long, a long").groupBy("key").agg(F.sum("r").alias("r"), F.sum("a").alias("a"))


def _model_of(found: pa.Table) -> Model:
    keys = found["key"].to_numpy()
    order = np.argsort(keys)
    return keys[order], np.stack([found[c].to_numpy()[order].astype(np.float64) for c in "ra"])


def count_model(labelled: DataFrame) -> Model:
    """The counts of count_table in one place: for few URLs, to look at or to score single ones by log_ratio."""
    return _model_of(count_table(labelled).toArrow())


def log_ratio(texts: list[str], model: Model) -> np.ndarray:
    """Mean over each text's bytes and its end of ln p(accepted) - ln p(rejected)."""
    if not texts:
        return np.empty(0)
    text, contexts, grams = _contexts(texts)
    p = np.full((2, len(text)), 1 / 256)
    for k in range(ORDER + 1):
        p = (_counts_of(model, grams[k]) + SMOOTHING * p) / (_counts_of(model, contexts[k]) + SMOOTHING)
    logs = np.log(p)
    return np.bincount(text, logs[1] - logs[0], len(texts)) / np.bincount(text, minlength=len(texts))


def _scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` (block, text, ...), as they were written, with the column ``score``.

    The distinct contexts and grams of each block are joined with their counts, and each block is scored with those
    that it needs: no task holds more than a block and its keys, and nothing is sent to all tasks.
    """

    def needed(batches):
        for batch in batches:
            blocks, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for block in np.unique(blocks):
                _, contexts, grams = _contexts([t for t, x in zip(texts, blocks, strict=True) if x == block])
                keys = np.unique(np.concatenate([contexts, grams]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(keys)], names=["block", "key"])

    def score(own: pa.Table, known: pa.Table) -> pa.Table:
        return own.append_column("score", pa.array(log_ratio(own["text"].to_pylist(), _model_of(known)), pa.float64()))

    keys = rows.select("block", "text").mapInArrow(needed, "block long, key long").distinct().join(counts, "key")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy("block").cogroup(keys.groupBy("block")).applyInArrow(score, f"{kinds}, score double")


def calibrate(bins: dict[int, tuple[int, int]]) -> float:
    """The threshold with the best mean of both classes' hit rates. ``bins``: bin -> (rejected, accepted);
    among equally good ones the middle; 0 if a class is missing."""
    rejected, accepted = sum(b[0] for b in bins.values()), sum(b[1] for b in bins.values())
    if not rejected or not accepted:
        return 0.0
    below_r = below_a = 0
    best, found = -1.0, [0.0]
    for k in range(-BINS * BOUND, BINS * BOUND + 1):
        rate = below_r / rejected + 1 - below_a / accepted
        if rate > best + 1e-12:
            best, found = rate, []
        if rate > best - 1e-12:
            found.append(k / BINS)
        r, a = bins.get(k, (0, 0))
        below_r, below_a = below_r + r, below_a + a
    return found[len(found) // 2]


def judge_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row (page_id, host, path, rule, verdict, score) for each page.

    The longest fitting rule decides. URLs that a rule allows or blocks are also what the models of accepted
    and rejected URLs are counted from, all of them but a fifth, on which the threshold of the mean log-likelihood
    difference is calibrated; a URL without a rule is allowed at that threshold or above. Without examples of
    either class the score is 0 for all and allows. Only the bins, of a fixed number, reach the driver.

    A null url or one without ``://`` has an empty host and path and no rule. A URL is judged whole, however long. URLs
    with equal host and path get equal scores. Null and repeated ids and repeated rows each get their row; an empty
    table has none; other columns are not read.
    """
    known = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    known = known.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.concat("host", "path").alias("text"))
    rows = materialise(known.select("*", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block")))
    held = F.crc32(F.col("text").cast("binary")) % 5 == 0
    counts = materialise(count_table(rows.where("ruled is not null").where(~held).select("text", (F.col("ruled") == "allow").cast("int").alias("cls"))))
    seen = counts.where("key = 0").first()  # the key of the empty context
    out, threshold = rows.withColumn("score", F.lit(0.0)), 0.0
    if seen and seen["r"] and seen["a"]:
        out = materialise(_scored(rows, counts))
        at = F.greatest(F.lit(-BINS * BOUND), F.least(F.lit(BINS * BOUND), F.floor(F.col("score") * BINS))).cast("int")
        bins = out.where("ruled is not null").where(held).groupBy(at.alias("bin")).agg(
            F.count_if(F.col("ruled") == "block").alias("r"), F.count_if(F.col("ruled") == "allow").alias("a")).collect()
        threshold = calibrate({x["bin"]: (x["r"], x["a"]) for x in bins})
        drop_table(rows)
    drop_table(counts)
    judged = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "score")


def allowed(host: str, path: str, rules: list[Rule]) -> Rule | None:
    """The rule that decides, in plain Python; for tests and single URLs."""
    fitting = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return reduce(lambda a, b: b if len(b[0] + b[1]) > len(a[0] + a[1]) else a, fitting) if fitting else None
