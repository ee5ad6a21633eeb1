"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, mix.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
written as Parquet and read again as the next one's docs.  All but the last return the columns of
documents; the last adds to each document left what the mix takes of it.

``ORACLE_SQL`` is None: the first, third and fourth stage have no SQL form; ``tests/llm/test_pipeline.py`` holds all against brute force.

Text moves little: the first stage decides row by row, the others drop rows by id, and ids are broadcast while they are few
(``llm.common.MOST_IDS``); beyond, or where ids repeat, the texts are joined by shuffle.

Edge cases: a null text counts as empty throughout; all empty texts are one group of equal ones, of which one row stays; without labels of
both kinds the first stage keeps every row; rows with a null doc_id stay, but for equal texts (one stays, a row with an id
before one without); of repeated rows one stays; rows that share an id with different texts are judged by their own text in the first two stages and
stand and go together in the next two; an empty table, benchmark or label table is no error; further columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import decontaminate, exact_dedup, mixing, near_copies, quality
from pointloom.llm.common import materialise, read


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the quality classifier predicts as label 0 go."""
    return quality.kept_documents(docs, read(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of equal texts the one of smallest doc_id stays."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2 on five-word shingles, then prefix filtering, both verified at Jaccard 0.8: of each class the document of smallest doc_id stays."""
    return near_copies.kept_documents(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark item within its error budget go."""
    return decontaminate.kept_documents(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: doc_id, source, size, source_size, target, rate, copies and taken of every document left."""
    return mixing.mix(docs)


STAGES = [
    ("quality", reject_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply ``STAGES`` to documents; each stage's result is written in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
