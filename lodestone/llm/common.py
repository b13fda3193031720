"""What the operators of this subpackage share: scratch tables, whole texts, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class and as plain characters.
WHITE = r"[\x20\x09-\x0D]"
WHITE_CHARS = " \t\n\x0b\f\r"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, the folder that all executors share.

    Only a local session, where the setting may be unset, gets a temporary folder of its own. What was made for a
    session is taken away by clear_scratch().
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_lodestone_scratch", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = spark._lodestone_scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    spark.__dict__.setdefault("_lodestone_paths", []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Deletes all that scratch() named for this session and returns how many paths it took away.

    To be called when the results that read them have been written elsewhere; frames made before cannot be read then.
    """
    paths = spark.__dict__.pop("_lodestone_paths", [])
    conf = spark._jsc.hadoopConfiguration()
    gone = 0
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(at.getFileSystem(conf).delete(at, True))
    return gone


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph of long ids: (node, root), root the least id reachable.

    Alternates large-star and small-star steps until the edge set no longer changes. Each step takes the
    least neighbour by an aggregate (combined before the shuffle) and joins it back; both sides of that join are
    written tables, so that a hub's rows are split over tasks, and lost executors cost one step only.
    """

    def summary(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first())

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """pairs: (u, v) with v a neighbour of u; the least of u and its neighbours becomes the hub."""
        hub = written(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "hubs")
        linked = pairs.join(hub, "u").select(F.col("v").alias("x"), "m", "u")
        if large:
            new = linked.filter("x > u").select(F.col("x").alias("u"), F.col("m").alias("v"))
        else:
            new = linked.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(
                hub.select("u", F.col("m").alias("v"))
            )
        return new.filter("u <> v").distinct()

    e = written(
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .filter("u <> v")
        .distinct(),
        "edges",
    )
    before = summary(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = written(star(written(star(both, large=True), "stars"), large=False), "edges")
        now = summary(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
