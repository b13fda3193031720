"""Streaming twins of batch queries over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import scratch
from lodestone.sources.tables import Catalogue, table

C = Catalogue()


def deliver(spark: SparkSession, sf_dir: str, out: str, per_trigger: int = 1) -> None:
    """Keeps each subject's revision count and last event as a stream over the log; changed keys are appended for each batch.

    The checkpoint is the cursor: the stream goes on from it after a restart. A repeated batch replaces its own rows.
    """
    schema = table(spark, sf_dir, "events").schema
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{sf_dir}/[e]vents.parquet")
    state = log.groupBy("event_type", "user_id").agg(F.count("*").alias("revision"), F.max("event_id").alias("last_event"))
    query = (
        state.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")).start()
    )
    query.awaitTermination()


@C.spark("select event_type, user_id, count(*) as revision, max(event_id) as last_event from events group by event_type, user_id")
def events_stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "stream")
    deliver(spark, sf_dir, out)
    rows = spark.read.parquet(f"{out}/rows")
    return rows.groupBy("event_type", "user_id").agg(F.max("revision").alias("revision"), F.max("last_event").alias("last_event"))


HOLD_SECONDS = 12 * 3600
EXPIRED = f"""with o as (select user_id, date_trunc('second', ts) as ts from events),
m as (select *, case when epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts)) < {HOLD_SECONDS} then 0 else 1 end as opens from o),
g as (select *, sum(opens) over (partition by user_id order by ts rows between unbounded preceding and current row) as hold from m),
h as (select user_id, min(epoch(ts))::bigint as opened, max(epoch(ts))::bigint + {HOLD_SECONDS} as expired, count(*) as renewals from g group by user_id, hold)
select * from h where expired <= (select max(epoch(ts))::bigint from o)"""


@C.spark(EXPIRED)
def events_stateful_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holds that each event of a user opens or renews; one expires, and only then is emitted, once the watermark has passed its end.

    The state of a hold is dropped with it. Time is in whole seconds. A hold's last instant is no longer part of it: an event just then opens another. Spark
    joins sessions that touch, so a session ends a millisecond before its hold.
    """
    out = scratch(spark, "timers")
    schema = table(spark, sf_dir, "events").schema
    log = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")
    log = log.select("user_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts")).withWatermark("ts", "0 seconds")
    holds = log.groupBy("user_id", F.session_window("ts", f"{HOLD_SECONDS - 1} seconds 999 milliseconds").alias("hold")).agg(F.count("*").alias("renewals"))
    rows = holds.select("user_id", F.unix_timestamp("hold.start").alias("opened"), (F.unix_timestamp("hold.end") + 1).alias("expired"), "renewals")
    query = rows.writeStream.outputMode("append").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{out}/rows").start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")
