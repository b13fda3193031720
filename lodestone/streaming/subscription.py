"""A subscription to the event log: delivered as a stream, authorised again before each delivery, nothing skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.eventlog import EVENT


def subscribe(spark: SparkSession, log: str, out: str, grants: Callable[[], DataFrame], principal: str, item_bytes: int = 1 << 20, batch_bytes: int = 1 << 26, files_per_trigger: int = 1) -> str | None:
    """Delivers what has been appended to the log since the last call, and returns why the subscription ended, or None while it goes on.

    grants: principal, kind, read again before every delivery. Each micro-batch is written under its number (a repeated one replaces itself): delivered
    events, and events that the principal may not see now. Those are withheld, not skipped: they are offered again with each later delivery and come
    once they may be seen. The subscription ends when the principal holds no grant (authorization_lost), when an event alone is
    too large (item_too_large), or when a delivery would be more than the reader takes (backpressure); the checkpoint is its cursor.
    """
    ended: list[str] = []
    fields = [f.split()[0] for f in EVENT.split(", ")]
    plain = ", ".join(f for f in EVENT.split(", "))

    def stored(name: str, upto: int) -> DataFrame:
        paths = [f"{out}/{name}/batch={k}" for k in range(upto)]
        return spark.read.schema(plain).parquet(*paths) if paths else spark.createDataFrame([], plain)

    def deliver(batch: DataFrame, number: int) -> None:
        mine = grants().filter(F.col("principal") == principal).select("kind").distinct()
        held = stored("withheld", number).unionByName(batch.select(*fields))
        if number:
            held = held.join(stored("delivered", number).select("epoch", "sequence"), ["epoch", "sequence"], "left_anti")
        held = held.dropDuplicates(["epoch", "sequence"])
        seen = held.join(mine, "kind", "left_semi").select(*fields)
        size = seen.agg(F.coalesce(F.max(F.octet_length("props")), F.lit(0)), F.coalesce(F.sum(F.octet_length("props")), F.lit(0))).first()
        why = "authorization_lost" if mine.isEmpty() else "item_too_large" if size[0] > item_bytes else "backpressure" if size[1] > batch_bytes else None
        if why:
            ended.append(why)
            raise RuntimeError(why)  # nothing of this batch counts as delivered, and the cursor stays before it
        seen.write.mode("overwrite").parquet(f"{out}/delivered/batch={number}")
        held.join(mine, "kind", "left_anti").select(*fields).write.mode("overwrite").parquet(f"{out}/withheld/batch={number}")

    reader = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger)
    query = reader.parquet(f"{log}/events").writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(deliver).start()
    try:
        query.awaitTermination()
    except Exception:
        if not ended:
            raise
    return ended[0] if ended else None


def delivered(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(EVENT).parquet(f"{out}/delivered/batch=*")
