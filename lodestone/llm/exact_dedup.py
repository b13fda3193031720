"""Exact dedup as a stateful stream: keyed state on disk, without expiry.

Every row's digest arrives on a stream. The state holds for each digest the least row seen (stable identifier
and content locator) and the number of rows; it lives in RocksDB, is never dropped, and a restarted stream
goes on from its checkpoint. A hit (a second row of a digest) is then checked on its full bytes: the hit and
the row that the state names are read again through their locators and compared. Rows whose bytes differ
although their digests agree are grouped by their bytes instead.

Two texts are equal when identical after each run of ASCII white space is replaced by one space.

Defined cases: a null text counts as empty and equals it; of equal texts the row with the least doc_id stays,
among repeated rows of one doc_id the one whose locator is least; an empty table gives an empty result;
further columns are carried by keep_first() and otherwise not read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import WHITE, documents, scratch, whole_text, written

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # a store is closed when its task has committed: an executor holds those of its running tasks, not of all partitions
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # many small stores: without this each holds megabytes of preallocated log files
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Copies compared with their kept row in one task, at most about so many: larger groups are salted.
COPIES_PER_SALT = 256


def normalised() -> Column:
    return F.regexp_replace(whole_text(), f"{WHITE}+", " ")


def located(docs: DataFrame) -> DataFrame:
    """docs with a locator column `at` (file, row in it): the place where a row's bytes can be read again.

    A frame that is not a plain file scan is written to the shared folder first.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    if not _plain_scan(docs):
        return written(docs.select(row), "contents").select("row", place.alias("at"))
    return docs.select(row, place.alias("at"))


def _plain_scan(docs: DataFrame) -> bool:
    """Whether docs still offers the file source's metadata column: asked for by itself, in a plan that is never run."""
    try:
        return "file_path" in docs.select("_metadata.*").columns and "_metadata" not in docs.columns
    except AnalysisException:
        return False


def arrivals(rows: DataFrame) -> DataFrame:
    """What the stream carries: doc_id, digest and locator, never the text."""
    sight = rows.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "at")
    return sight.select("doc_id", F.sha2(normalised(), 256).alias("digest"), "at")


def stream_first_seen(spark: SparkSession, path: str, schema, checkpoint: str, out: str, per_trigger: str | None = None):
    """Runs the stream over the arrivals in path until it has caught up; run again later, it continues.

    Each micro-batch appends the changed keys of the state to `out`: digest, first (doc_id, at), n.
    per_trigger: maxBytesPerTrigger of the file source; None: all that is there.
    """
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxBytesPerTrigger", per_trigger)
    state = (
        reader.parquet(path)
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n"))
    )

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")  # a repeated batch replaces itself

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(append)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def classes(docs: DataFrame, per_trigger: str | None = None, digest: Column | None = None) -> DataFrame:
    """Per row of docs: at, doc_id, digest, keep_id, keep_at, group_size.

    digest: another key for the stream's state, for tests of the check on full bytes.
    """
    spark = docs.sparkSession
    rows = located(docs)
    seen = arrivals(rows)
    if digest is not None:
        seen = rows.select(F.col("row.doc_id").alias("doc_id"), digest.alias("digest"), "at")
    base = scratch(spark, "dedup")
    seen.write.option("compression", "zstd").parquet(f"{base}/arrivals")
    schema = seen.schema
    stream_first_seen(spark, f"{base}/arrivals", schema, f"{base}/checkpoint", f"{base}/state", per_trigger)
    seen = spark.read.schema(schema).parquet(f"{base}/arrivals")
    changed = spark.createDataFrame([], "digest string, first struct<doc_id: long, at: struct<file: string, row: long>>, n long")
    if not seen.isEmpty():
        changed = spark.read.parquet(f"{base}/state")
    # the state of a key only falls (first) and grows (n), so its last version needs no order of batches
    # written, so that the join is between two plain shuffles, where a digest that very many rows share is split
    state = written(changed.groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n")), "last_state")
    named = written(seen.join(state, "digest"), "named")

    # full bytes of every hit against the row its state names
    hits = named.filter("n > 1")
    salts = F.ceil(F.col("n") / COPIES_PER_SALT).cast("int")
    text = rows.select("at", F.col("row.text").alias("text")).select("at", normalised().alias("bytes"))
    members = hits.join(text, "at").withColumn("salt", F.pmod(F.xxhash64("at"), salts).cast("int"))
    keepers = (
        hits.filter(F.col("at") == F.col("first.at"))
        .join(text, "at")
        .select(F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "digest", F.col("bytes").alias("kept_bytes"))
    )
    checked = members.join(keepers, ["digest", "salt"]).select(
        "digest", "at", "doc_id", F.when(F.col("bytes") != F.col("kept_bytes"), F.sha2(F.concat("bytes", F.lit("\0"), "digest"), 512)).alias("other"),
        F.when(F.col("bytes") != F.col("kept_bytes"), F.col("bytes")).alias("other_bytes"),
    )
    checked = written(checked.filter("other is not null"), "unequal")
    if checked.isEmpty():
        return named.select("at", "doc_id", "digest", F.col("first.doc_id").alias("keep_id"), F.col("first.at").alias("keep_at"), F.col("n").alias("group_size"))
    # digests that agree on different bytes: such rows leave the class and are grouped by the bytes themselves
    own = checked.groupBy("digest", "other", "other_bytes").agg(F.min(F.struct("doc_id", "at")).alias("first2"), F.count("*").alias("n2"))
    moved = checked.select("at", "digest", "other", "other_bytes").join(own, ["digest", "other", "other_bytes"]).select("at", "first2", "n2")
    lost = checked.groupBy("digest").agg(F.count("*").alias("gone"))
    return (
        named.join(moved, "at", "left")
        .join(lost, "digest", "left")
        .select(
            "at", "doc_id", "digest",
            F.coalesce("first2", "first")["doc_id"].alias("keep_id"),
            F.coalesce("first2", "first")["at"].alias("keep_at"),
            F.coalesce("n2", F.col("n") - F.coalesce("gone", F.lit(0))).alias("group_size"),
        )
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    stay = classes(docs).filter(F.col("at") == F.col("keep_at")).select(F.col("at").alias("stays"))
    rows = located(docs)
    return rows.join(stay, rows["at"] == stay["stays"], "left_semi").select("row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("at") == F.col("keep_at")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""
