"""Evidence: a log of operations folded into artifacts, their bytes, holds and objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An operation on an artifact. size and digest are what prepare declares; offset and content what append brings; hold names a hold; releases the
#: holds that a purge lets go.
OPERATION = "artifact string, seq long, op string, size long, digest string, offset long, content binary, hold string, until string, at string, releases array<string>"
STATE = "struct<state: string, size: bigint, digest: string, received: bigint, chunks: array<struct<seq: bigint, content: binary>>, holds: array<struct<hold: string, until: string>>, purged_at: string>"


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often it is named there."""
    return F.transform(F.array(value), body)[0]


def fold(operations: DataFrame) -> DataFrame:
    """(artifact, seq, op, outcome, and state, size, digest, received, holds, purged_at after it) for every operation, in order of seq.

    Outcomes: ok; already_sealed for a seal repeated; else a refusal that changes nothing: exists, absent, not_staged, upload_offset_mismatch,
    upload_size_exceeded, size_mismatch, content_digest_mismatch, not_sealed, hold_unknown, hold_active, not_purging. A hold is active up to its
    instant, which is no longer part of it. An artifact's operations are bounded by its size and its holds: they are folded as one array.
    """
    ops = operations.select("artifact", F.struct("seq", "op", "size", "digest", "offset", "content", "hold", "until", "at", "releases").alias("x"))
    held = ops.groupBy("artifact").agg(F.array_sort(F.collect_list("x"), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)).alias("ops"))
    row = "struct<seq: bigint, op: string, outcome: string, state: string, size: bigint, digest: string, received: bigint, holds: array<string>, purged_at: string>"
    zero = F.struct(F.expr(f"cast(null as {STATE})").alias("s"), F.expr(f"cast(array() as array<{row}>)").alias("out"))

    def state(s: Column, **over: Column) -> Column:
        fields = ("state", "size", "digest", "received", "chunks", "holds", "purged_at")
        return F.struct(*[over.get(f, s[f]).alias(f) for f in fields])

    def step(acc: Column, x: Column) -> Column:
        s, op = acc["s"], x["op"]
        length = F.octet_length(x["content"]).cast("long")
        active = F.filter(s["holds"], lambda h: h["until"].isNull() | (x["at"] < h["until"]))
        kept = F.filter(active, lambda h: ~F.coalesce(F.array_contains(x["releases"], h["hold"]), F.lit(False)))
        bytes_ = F.aggregate(s["chunks"], F.lit("").cast("binary"), lambda a, c: F.concat(a, c["content"]))
        refusal = (
            F.when(op == "prepare", F.when(s.isNotNull(), "exists"))
            .when(s.isNull(), "absent")
            .when(op == "append", F.when(s["state"] != "staged", "not_staged").when(x["offset"] != s["received"], "upload_offset_mismatch").when(s["received"] + length > s["size"], "upload_size_exceeded"))
            .when(op == "seal", F.when(s["state"] == "sealed", "already_sealed").when(s["state"] != "staged", "not_staged").when(s["received"] != s["size"], "size_mismatch").when(F.sha2(bytes_, 256) != s["digest"], "content_digest_mismatch"))
            .when(op == "abandon", F.when(s["state"] != "staged", "not_staged"))
            .when(op == "hold", F.when(s["state"] != "sealed", "not_sealed"))
            .when(op == "release", F.when(~F.exists(active, lambda h: h["hold"] == x["hold"]), "hold_unknown"))
            .when(op == "purge", F.when((s["state"] != "sealed") | s["purged_at"].isNotNull(), "not_sealed").when(F.size(kept) > 0, "hold_active"))
            .when(op == "confirm", F.when(s["state"] != "purge_pending", "not_purging"))
            .otherwise("unknown_operation")
        )
        none = F.expr("cast(array() as array<struct<seq: bigint, content: binary>>)")
        no_holds = F.expr("cast(array() as array<struct<hold: string, until: string>>)")
        fresh = F.struct(
            F.lit("staged").alias("state"), x["size"].alias("size"), x["digest"].alias("digest"), F.lit(0).cast("long").alias("received"), none.alias("chunks"), no_holds.alias("holds"), F.lit(None).cast("string").alias("purged_at")
        )
        chunk, hold = F.array(F.struct(x["seq"].alias("seq"), x["content"].alias("content"))), F.array(F.struct(x["hold"].alias("hold"), x["until"].alias("until")))

        def after(r: Column) -> Column:
            return (
                F.when(r.isNotNull(), s)
                .when(op == "prepare", fresh)
                .when(op == "append", state(s, received=s["received"] + length, chunks=F.concat(s["chunks"], chunk)))
                .when(op == "seal", state(s, state=F.lit("sealed"), chunks=none))
                .when(op == "abandon", state(s, state=F.lit("abandoned"), chunks=none))
                .when(op == "hold", state(s, holds=F.concat(F.filter(active, lambda h: h["hold"] != x["hold"]), hold)))
                .when(op == "release", state(s, holds=F.filter(active, lambda h: h["hold"] != x["hold"])))
                .when(op == "purge", state(s, state=F.lit("purge_pending"), holds=kept))
                .when(op == "confirm", state(s, state=F.lit("purged"), purged_at=x["at"]))
            )

        def line(r: Column, n: Column) -> Column:
            return F.struct(
                x["seq"].alias("seq"), op.alias("op"), F.coalesce(r, F.lit("ok")).alias("outcome"), n["state"].alias("state"), n["size"].alias("size"), n["digest"].alias("digest"), n["received"].alias("received"),
                F.transform(n["holds"], lambda h: h["hold"]).alias("holds"), n["purged_at"].alias("purged_at"),
            )

        # the refusal, and the state that follows from it, are worked out once for each operation
        return _let(refusal, lambda r: _let(after(r), lambda n: F.struct(n.alias("s"), F.concat(acc["out"], F.array(line(r, n))).alias("out"))))

    return held.select("artifact", F.inline(F.aggregate("ops", zero, step, lambda a: a["out"])))


def latest(folded: DataFrame) -> DataFrame:
    """The last state of each artifact."""
    return folded.groupBy("artifact").agg(F.max_by(F.struct("state", "size", "digest", "received", "holds", "purged_at"), "seq").alias("l")).select("artifact", "l.*")


def contents(operations: DataFrame, folded: DataFrame) -> DataFrame:
    """(digest, content) of every sealed artifact, once for each digest: the chunks that were accepted, joined in order."""
    taken = folded.filter("op = 'append' and outcome = 'ok'").select("artifact", "seq")
    sealed = latest(folded).filter("state in ('sealed', 'purge_pending')").select("artifact", "digest")
    chunks = operations.select("artifact", "seq", F.hex("content").alias("content")).join(taken, ["artifact", "seq"]).join(sealed, "artifact")
    whole = chunks.groupBy("artifact", "digest").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("c"))
    return whole.select("digest", F.unhex(F.array_join(F.transform("c", lambda x: x["content"]), "")).alias("content")).dropDuplicates(["digest"])


def availability(artifacts: DataFrame, objects: DataFrame, out_of_store: Column | None = None) -> DataFrame:
    """artifacts: as latest() gives. objects: digest, content. Adds availability and reason; an object is read again and its digest compared."""
    away = F.lit(False) if out_of_store is None else out_of_store
    facts = artifacts.join(objects.select("digest", (F.sha2("content", 256) == F.col("digest")).alias("intact")), "digest", "left")
    state = F.col("state")
    word = (
        F.when(state == "abandoned", "unavailable").when(state == "purged", "purged").when(state == "purge_pending", "purge_pending").when(state == "staged", "available")
        .when(away | ~F.coalesce("intact", F.lit(False)), "unavailable").otherwise("available")
    )
    why = F.when(state == "abandoned", "abandoned_by_producer").when(state != "sealed", None).when(away, "store_unavailable").when(~F.coalesce("intact", F.lit(False)), "integrity_failed")
    return facts.select("artifact", "digest", "state", word.alias("availability"), why.alias("reason"))


def fetched(artifacts: DataFrame, objects: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges: artifact, digest, offset, length. Each with content and next_offset (null at the end), or a refusal: not_sealed, artifact_digest_mismatch,
    offset_out_of_range."""
    facts = ranges.withColumnRenamed("digest", "asked").join(artifacts.select("artifact", "state", "digest", "size"), "artifact", "left").join(objects, "digest", "left")
    refusal = F.when(~F.col("state").eqNullSafe(F.lit("sealed")), "not_sealed").when(F.col("asked") != F.col("digest"), "artifact_digest_mismatch").when((F.col("offset") < 0) | (F.col("offset") > F.col("size")), "offset_out_of_range")
    end = F.least(F.col("offset") + F.col("length"), F.col("size"))
    piece = F.substring("content", (F.col("offset") + 1).cast("int"), (end - F.col("offset")).cast("int"))
    ok = refusal.isNull()
    return facts.select("artifact", "offset", "length", F.when(ok, piece).alias("content"), F.when(ok & (end < F.col("size")), end).alias("next_offset"), refusal.alias("refusal"))


def write_objects(objects: DataFrame, path: str) -> None:
    """Objects by digest, in folders by its first and second two digits; an object that is there already is not written again."""
    spark = objects.sparkSession
    new = objects.withColumn("a", F.substring("digest", 1, 2))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        new = new.join(read_objects(spark, path).select("digest"), "digest", "left_anti")
    new.repartition("a").sortWithinPartitions("digest").write.mode("append").partitionBy("a").parquet(path)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest string, content binary, a string").parquet(path).drop("a")


def unreferenced(objects: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Digests of objects that no artifact holds that is staged, sealed or waiting for its purge."""
    roots = artifacts.filter("state in ('staged', 'sealed', 'purge_pending')").select("digest").distinct()
    return objects.select("digest").distinct().join(roots, "digest", "left_anti")
