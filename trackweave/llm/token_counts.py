"""Token counts without ids: pieces counted once per distinct pre-token, then joined and summed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary

#: Texts whose distinct pre-tokens are counted together, in characters.
BLOCK_CHARS = 8_000_000


def count_tokens(docs: DataFrame, limit: int = 1024, vocabulary_file: str = vocabulary.DEFAULT_FILE,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_bytes, n_tokens, over_limit) for each input row.

    Blocks of texts are taken from each partition as they come; the distinct pre-tokens of a block are
    counted once and joined to its texts inside the task, so nothing is shuffled. Only the two named
    columns are read, whatever the others are named. A null text counts as empty (0 bytes, 0 tokens); a text is counted
    whole, and one longer than a block is a block of its own. A count that equals ``limit`` is not over it. Null and
    repeated ids and repeated rows are kept as they are; an empty table gives an empty result.
    """

    def blocks(batch: pa.RecordBatch):
        begin = chars = 0
        texts: list[str] = []
        for i, text in enumerate(batch.column(1)):
            texts.append(text.as_py() or "")
            chars += len(texts[-1])
            if chars >= BLOCK_CHARS:
                yield begin, texts
                begin, chars, texts = i + 1, 0, []
        if texts:
            yield begin, texts

    def run(batches):
        counter = vocabulary.load(vocabulary_file)
        for batch in batches:
            for begin, texts in blocks(batch):
                tokens = counter.count_batch(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)),
                     pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array(tokens, pa.int64()),
                     pa.array([n > limit for n in tokens], pa.bool_())],
                    names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
