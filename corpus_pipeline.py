"""A corpus pipeline in five stages, each of which takes and returns documents; the last packs them.

Every stage works on all rows that its predecessor kept. Null, empty and repeated rows are handled as each
operator's docstring says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trackweave.llm import decontaminate, line_dedup, ngram_join, packing, quality
from trackweave.llm.common import delete_folder, ensure_importable, read_table, scratch_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    A null text is scored as an empty one, a text of any length by all of it; rows with equal texts share a score and so
    their fate; a score of just the threshold stays. Without usable labels all stay. An empty table stays empty; all columns stay as they are.
    """
    ensure_importable(spark)
    return quality.drop_low_quality(docs, read_table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that repeat an earlier one.

    Null and empty texts stay as they are; texts and lines are taken whole, however long. Earlier means a smaller
    id, null ids last, and among equal ids the order of a hash of the text; rows that repeat id and text fare alike. A document of which
    nothing is left goes. An empty table stays empty; of other columns only ``n_chars`` follows the text.
    """
    ensure_importable(spark)
    return line_dedup.dedup_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by a Jaccard similarity of 0.8 on five-word shingles.

    The one with the smallest id stays. Texts without words are linked with nothing and stay, nulls too; a text of fewer
    words is one shingle; long ones are taken whole. Null ids and repeated rows: see ngram_join.drop_near_duplicates. An empty table
    stays empty; all columns stay as they are.
    """
    ensure_importable(spark)
    return ngram_join.drop_near_duplicates(docs, width=5, num=4, den=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark.

    Null and empty texts hold none; texts of any length are scanned whole; repeated rows each have their own fate. An empty
    benchmark drops nothing, an empty table stays empty; all columns stay as they are.
    """
    ensure_importable(spark)
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack into sequences of 2048 ids; one row for each piece.

    A null or empty text is its end id alone; a long one fills sequences and leaves a rest. Null and repeated ids and repeated rows are packed
    each for itself; pieces of equal length are dealt out in the order of tasks and rows. An empty table has no pieces; other columns are not read.
    """
    ensure_importable(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A boosted classifier and a tokenizer are part of it; tested against the stages' brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each one's result is written to the shared folder and read back.

    A stage's table is deleted when the next one is written; the last one's stays, as the result reads it.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
