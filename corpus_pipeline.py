"""From raw documents to packed training sequences: each stage is one operator of lodestone.llm.

Defined cases, of every stage: a null text counts as empty (quality rules reject it; the other stages would keep the first such row); of rows that
tie the one with the least doc_id stays, nulls last, then the one read first; repeated rows are copies; rows that share a doc_id but not their text are
different rows; an empty table stays empty; further columns, whatever their names, are carried along by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import exact_dedup, packing, quality_rules, simhash, substring_dedup
from lodestone.llm.common import documents, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents the first stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays."""
    return simhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences in repeated spans are removed from all but the first text that holds them."""
    return substring_dedup.remove_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, each with its sequence and offset."""
    return packing.pack(docs, packing.word_tokenizer())


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("substring_dedup", substrings),
    ("best_fit_packing", packed),
]

#: The near-dedup and packing stages cannot be told in SQL; tests/llm compares run() with all stages in plain Python, at sf 0.001 with odd rows added.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each stage's result written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
