"""Incremental evaluation over a dependency table: results are kept, and recomputed only where what they read has changed.

Frames: inputs (key, value, changed_at, durability), nodes (key, function, argument, deps: array in the order they are read, untracked), memo (key, value,
changed_at, verified_at, durability) and stamps (durability, changed_at: the last revision at which an input of that durability or above
changed). A function is a Column of the array of its dependencies' values and of its argument; the registry names them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.authority import descendants
from lodestone.sources.scratch import scratch

LOW, MEDIUM, HIGH = 0, 1, 2
INPUT = "key string, value long, changed_at long, durability int"
NODE = "key string, function string, argument long, deps array<string>, untracked boolean"
MEMO = "key string, value long, changed_at long, verified_at long, durability int"
STAMP = "durability int, changed_at long"
#: What a node can be: a function of the values it reads and of its argument.
FUNCTIONS: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda values, argument: F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x) % argument,
    "choice": lambda values, argument: F.get(values, (F.get(values, F.lit(0)) % F.size(values)).cast("int")) % argument,
}


class CycleError(ValueError):
    """Nodes wait for each other."""


def set_inputs(inputs: DataFrame, stamps: DataFrame, changes: DataFrame, revision: int) -> tuple[DataFrame, DataFrame]:
    """changes: key, value, durability, each key once. New inputs and stamps; an input set to what it already is changes nothing. A change is announced to
    every durability up to the greater of the input's old and new one: results that read it recorded the old one."""
    new = changes.select("key", F.col("value").alias("new_value"), F.col("durability").alias("new_durability"))
    both = inputs.join(new, "key", "full")
    set_ = F.col("new_value").isNotNull()
    moved = set_ & ~(F.col("value").eqNullSafe(F.col("new_value")) & F.col("durability").eqNullSafe(F.col("new_durability")))
    both = both.withColumn("moved", moved)
    out = both.select(
        "key", F.coalesce("new_value", "value").alias("value"), F.when(F.col("moved"), F.lit(revision)).otherwise(F.col("changed_at")).cast("long").alias("changed_at"),
        F.coalesce("new_durability", "durability").cast("int").alias("durability"),
    )
    reach = both.filter("moved").agg(F.max(F.greatest(F.coalesce("durability", F.lit(LOW)), "new_durability")).alias("upto"))
    announced = F.when(F.col("durability") <= F.coalesce("upto", F.lit(-1)), F.lit(revision)).otherwise(F.col("changed_at")).cast("long")
    return out, stamps.join(F.broadcast(reach)).select("durability", announced.alias("changed_at"))


def dependents(nodes: DataFrame, key: str, transitive: bool = False) -> DataFrame:
    """(node): what reads a key directly, or through others too."""
    edges = nodes.select(F.col("key").alias("child"), F.explode("deps").alias("parent")).distinct()
    if transitive:
        return descendants(edges, edges.sparkSession.createDataFrame([(key,)], "node string")).select("node")
    return edges.filter(F.col("parent") == key).select(F.col("child").alias("node"))


def demanded(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """The nodes that have to be current for keys (node) to be: themselves and what they read, however far down."""
    edges = nodes.select(F.explode("deps").alias("child"), F.col("key").alias("parent")).distinct()
    below = descendants(edges, keys).select("node").unionByName(keys.select("node")).distinct()
    return nodes.join(below, nodes["key"] == below["node"], "left_semi")


def evaluate(inputs: DataFrame, nodes: DataFrame, memo: DataFrame, stamps: DataFrame, revision: int, functions=FUNCTIONS, max_levels: int = 1000) -> DataFrame:
    """The memo of all nodes brought up to `revision`, with `executed`: whether a node was computed again.

    Level by level, each written: a level is every node whose dependencies are settled. A node keeps its result if no input of its durability or above
    changed since it was verified, or else if nothing that it read did; one that read something untracked is always computed again. A result
    that comes out the same keeps its old changed_at, so that nothing behind it is computed again, unless it has become less durable.
    """
    spark = inputs.sparkSession
    base = scratch(spark, "memo")
    settled_ddl = f"{MEMO}, executed boolean"
    known = memo.select("key", *[F.col(c).alias(f"m_{c}") for c in ("value", "changed_at", "verified_at", "durability")])
    waiting = nodes.join(known, "key", "left").join(F.broadcast(stamps.select(F.col("durability").alias("m_durability"), F.col("changed_at").alias("stamp"))), "m_durability", "left")
    given = inputs.select("key", "value", "changed_at", "durability")
    n = nodes.count()
    done = 0
    for level in range(max_levels):
        if done == n:
            break
        settled = spark.read.schema(settled_ddl).parquet(*[f"{base}/level={k}" for k in range(level)]) if level else spark.createDataFrame([], settled_ddl)
        ready = given.unionByName(settled.select("key", "value", "changed_at", "durability"))
        left = waiting.join(settled.select("key"), "key", "left_anti")
        reads = left.select("key", F.posexplode_outer("deps").alias("at", "dep")).join(ready.select(F.col("key").alias("dep"), "value", "changed_at", "durability"), "dep", "left")
        facts = reads.groupBy("key").agg(
            F.array_sort(F.collect_list(F.struct("at", "value"))).alias("read"), F.max("changed_at").alias("latest"), F.min("durability").alias("least"),
            F.count_if(F.col("dep").isNotNull() & F.col("durability").isNull()).alias("missing"),
        ).filter("missing = 0")
        now = left.join(facts, "key")
        values = F.transform("read", lambda x: x["value"])
        computed = F.lit(None).cast("long")
        for name, function in functions.items():
            computed = F.when(F.col("function") == name, function(values, F.col("argument"))).otherwise(computed)
        shallow = F.coalesce(F.col("stamp"), F.lit(0)) <= F.col("m_verified_at")
        keep = F.col("m_value").isNotNull() & ~F.col("untracked") & (shallow | (F.coalesce("latest", F.lit(0)) <= F.col("m_verified_at")))
        durability = F.when(F.col("untracked"), LOW).otherwise(F.coalesce("least", F.lit(HIGH))).cast("int")
        same = F.col("m_value").eqNullSafe(computed) & (durability >= F.col("m_durability"))
        rows = now.select(
            "key", F.when(keep, F.col("m_value")).otherwise(computed).alias("value"),
            F.when(keep | F.coalesce(same, F.lit(False)), F.col("m_changed_at")).otherwise(F.lit(revision)).cast("long").alias("changed_at"), F.lit(revision).cast("long").alias("verified_at"),
            F.when(keep, F.col("m_durability")).otherwise(durability).alias("durability"), (~keep).alias("executed"),
        )
        rows.write.parquet(f"{base}/level={level}")
        more = spark.read.schema(settled_ddl).parquet(f"{base}/level={level}").count()
        if not more:
            raise CycleError(f"{n - done} nodes wait for each other or for a key that is not there")
        done += more
    else:
        raise RuntimeError("more levels than allowed")
    if not n:
        return spark.createDataFrame([], settled_ddl)
    return spark.read.schema(settled_ddl).parquet(*[f"{base}/level={k}" for k in range(level)])
