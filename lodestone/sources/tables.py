"""The driver's Parquet tables as views, and the one runner of SQL queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.functions.dialect import DUCKDB, SPARK, Dialect

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of stored files that one task takes where texts are taken apart.
TASK_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, or over a task for each TASK_BYTES of the files it reads, if its files make fewer tasks than that: what one task holds does
    not grow with the table."""
    plan = df._jdf.queryExecution()
    leaves = plan.optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    stored = sum(n for n in sizes if n < 1 << 62)  # rows that are in no file have no known size
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-stored // TASK_BYTES))
    return df.repartition(tasks) if plan.toRdd().getNumPartitions() < tasks else df


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs a query over the tables that it names; Catalyst prunes columns and pushes filters to their scans.

    Where texts are taken apart, which costs far more than reading them, a small documents table is spread first.
    """
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            df = table(spark, sf_dir, name)
            (spread(df) if name == "documents" and "regexp_extract_all" in text else df).createOrReplaceTempView(name)
    if re.search(r"\bstored_log\b", text):
        from lodestone.sources.eventlog import stored

        stored(spark, sf_dir).createOrReplaceTempView("stored_log")
    return spark.sql(text)


class Catalogue:
    """Queries by name. A query is told once, as a function of the dialect, or has a Spark form and an oracle."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def sql(self, build: Callable[[Dialect], str]) -> Callable:
        name = build.__name__
        self.queries[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, build(SPARK))
        self.oracle[name] = build(DUCKDB)
        return build

    def spark(self, oracle: str | None = None) -> Callable:
        def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
            self.queries[build.__name__] = build
            if oracle:
                self.oracle[build.__name__] = oracle
            return build

        return add
