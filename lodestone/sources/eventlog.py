"""The event log as a stored table: sequences are given when events are appended and never worked out again.

A log is a folder with events (epoch, sequence, event_id, ts, kind, user_id, value, props; partitioned by epoch) and epochs (epoch, last, vouched: how
far a closed epoch is vouched for, null while it is open).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import kept, scratch
from lodestone.sources.tables import table

EVENT = "sequence long, event_id long, ts timestamp_ntz, kind string, user_id long, value double, props string, epoch long"
EPOCH_START, EPOCH_SECONDS, UNVOUCHED = 1704067200, 604800, 5
LOW_BITS = (1 << 33) - 1


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `number`, from 1, in order: range-sorted, numbered within each partition, and each partition moved by the rows before it. No task
    holds more than a range; what is summed up is one row for each partition."""
    spark = rows.sparkSession
    path = scratch(spark, "numbered")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.schema(f"{rows._jdf.schema().toDDL()}, id bigint").parquet(path).withColumn("part", F.shiftright("id", 33))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "part").select(*rows.columns, (F.col("before") + F.col("id").bitwiseAND(F.lit(LOW_BITS)) + 1).alias("number"))


def append(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Appends events (epoch, event_id, ts, kind, user_id, value, props): in each epoch sequences go on from the greatest there is."""
    new = numbered(rows, "epoch", "ts", "event_id")
    first = new.groupBy("epoch").agg(F.min("number").alias("first"))
    last = heads(spark, path).select("epoch", F.col("last").alias("had"))
    placed = new.join(F.broadcast(first), "epoch").join(F.broadcast(last), "epoch", "left")
    placed = placed.withColumn("sequence", F.col("number") - F.col("first") + 1 + F.coalesce("had", F.lit(0)))
    fields = [f.split()[0] for f in EVENT.split(", ")]
    placed.select(*fields).repartitionByRange("epoch", "sequence").sortWithinPartitions("epoch", "sequence").write.mode("append").partitionBy("epoch").parquet(f"{path}/events")


def events(spark: SparkSession, path: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/events")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], EVENT)
    return spark.read.schema(EVENT).parquet(f"{path}/events")


def heads(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, first, last) of what the log holds; the sequences stand in the footers of its files."""
    return events(spark, path).groupBy("epoch").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"))


def from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as events to append: an epoch is a week."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    epoch = (F.floor((seconds - EPOCH_START) / EPOCH_SECONDS) + 1).cast("long")
    return table(spark, sf_dir, "events").select(epoch.alias("epoch"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("kind"), "user_id", "value", "props")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of the events table, written at first use in a session."""
    return events(spark, kept(spark, ("log", sf_dir), lambda path: append(spark, path, from_table(spark, sf_dir))))
