"""Grants as relations: cover, denials in order, delegation, cascade, admission of commands.

A grant frame has grant_id, holder, rights (array), resources (array of kind, id, id_prefix), expires_at (an instant as text;
null: never), scope and epoch (null: not bound), delegable, max_depth, parent, revoked, constraints (array of text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import scratch

RESOURCE = "struct<kind: string, id: string, id_prefix: string>"
GRANT = (
    f"grant_id string, holder string, rights array<string>, resources array<{RESOURCE}>, expires_at string, scope string, epoch long, "
    "delegable boolean, max_depth int, parent string, revoked boolean, constraints array<string>"
)


def covers(resource: Column, kind: Column, id_: Column) -> Column:
    """Whether a resource covers a subject: of its kind, with its id, or else beginning with its prefix, or else any."""
    named = F.when(resource["id"].isNotNull(), resource["id"] == id_).when(resource["id_prefix"].isNotNull(), F.startswith(id_, resource["id_prefix"])).otherwise(True)
    return F.coalesce((resource["kind"] == kind) & named, F.lit(False))


def covers_resource(wide: Column, narrow: Column) -> Column:
    """Whether a resource is at least as wide as another: one without a name covers all of its kind, one with an id only the
    same id, one with a prefix the ids and prefixes that begin with it."""
    by_prefix = F.coalesce(F.startswith(F.coalesce(narrow["id"], narrow["id_prefix"]), wide["id_prefix"]), F.lit(False))
    named = F.when(wide["id"].isNotNull(), F.coalesce(narrow["id"] == wide["id"], F.lit(False))).when(wide["id_prefix"].isNotNull(), by_prefix).otherwise(True)
    return F.coalesce((wide["kind"] == narrow["kind"]) & named, F.lit(False))


def unusable(at: Column) -> Column:
    """Why a grant cannot be used at an instant, whatever it is used for; null if it can. `current` is its scope's epoch now."""
    return (
        F.when(F.col("revoked"), "revoked")
        .when(F.col("expires_at").isNotNull() & (at >= F.col("expires_at")), "expired")
        .when(F.col("scope").isNotNull() & ~F.col("epoch").eqNullSafe(F.col("current")), "authority_epoch_stale")
    )


def denials(requests: DataFrame, grants: DataFrame, epochs: DataFrame) -> DataFrame:
    """requests: request, principal, grant_id, right, kind, id, work, at. epochs: scope, current. Adds denial: the first reason
    that applies, null where the request is permitted. The right comes before the scope, and both before a work binding."""
    held = grants.withColumnRenamed("holder", "of")
    facts = requests.join(held, "grant_id", "left").join(epochs, "scope", "left")
    scope = F.exists("resources", lambda r: covers(r, F.col("kind"), F.col("id")))
    bound = (F.size("constraints") > 0) & ~F.coalesce(F.array_contains("constraints", F.col("work")), F.lit(False))
    reason = (
        F.when(F.col("grant_id").isNull(), "grant_required")
        .when(F.col("of").isNull() | (F.col("of") != F.col("principal")), "grant_not_found")
        .otherwise(F.coalesce(
            unusable(F.col("at")),
            F.when(~F.array_contains("rights", F.col("right")), "right_missing").when(F.col("id").isNotNull() & ~scope, "out_of_scope").when(bound, "binding_violation"),
        ))
    )
    return facts.select(*[F.col(c) for c in requests.columns], reason.alias("denial"))


def delegation_breaches(grants: DataFrame) -> DataFrame:
    """Children that exceed their parent: grant_id, parent, breach (the first rule broken): delegable, rights, resources,
    expiry, depth, constraints, binding."""
    p = grants.select(F.col("grant_id").alias("parent"), *[F.col(c).alias(f"p_{c}") for c in grants.columns if c not in ("grant_id", "parent")])
    pairs = grants.join(p, "parent")
    outside = F.exists("resources", lambda n: ~F.exists("p_resources", lambda w: covers_resource(w, n)))
    breach = (
        F.when(~F.col("p_delegable") | (F.col("p_max_depth") < 1), "delegable")
        .when(F.size(F.array_except("rights", "p_rights")) > 0, "rights")
        .when(outside, "resources")
        .when(F.col("p_expires_at").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > F.col("p_expires_at"))), "expiry")
        .when(F.col("max_depth") > F.col("p_max_depth") - 1, "depth")
        .when(F.size(F.array_except("p_constraints", "constraints")) > 0, "constraints")
        .when(F.col("p_scope").isNotNull() & ~(F.col("scope").eqNullSafe(F.col("p_scope")) & F.col("epoch").eqNullSafe(F.col("p_epoch"))), "binding")
    )
    return pairs.select("grant_id", "parent", breach.alias("breach")).filter("breach is not null")


def descendants(edges: DataFrame, roots: DataFrame, max_levels: int = 1000) -> DataFrame:
    """edges: child, parent. roots: node. (node, depth) of everything below, each once, at its least depth.

    Level by level, each level written before the next: neither the number of rows nor a cycle stops it.
    """
    spark = edges.sparkSession
    base = scratch(spark, "levels")
    schema = "node string, depth long"
    level = roots.select(F.col("node").cast("string").alias("node"), F.lit(0).cast("long").alias("depth")).distinct()
    for depth in range(max_levels):
        level.write.parquet(f"{base}/level={depth}")
        level = spark.read.schema(schema).parquet(f"{base}/level={depth}")
        if level.isEmpty():
            break
        seen = spark.read.schema(schema).parquet(*[f"{base}/level={k}" for k in range(depth + 1)])
        below = edges.join(level, edges["parent"] == level["node"]).select(edges["child"].alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        level = below.join(seen.select("node"), "node", "left_anti")
    else:
        raise RuntimeError("more levels than allowed")
    return spark.read.schema(schema).parquet(*[f"{base}/level={k}" for k in range(depth + 1)]).filter("depth > 0")


def revoked_with(grants: DataFrame, roots: DataFrame) -> DataFrame:
    """Grants that the revocation of roots (node) takes down: active ones below, also below grants that are revoked already."""
    below = descendants(grants.select(F.col("grant_id").alias("child"), "parent"), roots)
    return grants.join(below, grants["grant_id"] == below["node"]).filter(~F.col("revoked")).select("grant_id", "depth")


#: What is checked of a command, in order.
ADMISSION = ("invalid", "replayed", "command_conflict", "denied", "capability_missing", "epoch_stale", "precondition_failed", "admitted")


def admitted(commands: DataFrame) -> DataFrame:
    """commands: principal, command_id, at (their order), digest (null: malformed), denial, capable, epoch, current_epoch, expected, revision.
    Adds outcome and applied_by: the first command of its principal and id decides; a later one with its digest replays it,
    with another digest conflicts."""
    key = ["principal", "command_id"]
    valid = commands.filter("digest is not null")
    first = valid.groupBy(*key).agg(F.min(F.struct("at", "digest")).alias("first"))
    facts = commands.join(first, key, "left")
    again = F.col("at") != F.col("first.at")
    outcome = (
        F.when(F.col("digest").isNull(), "invalid")
        .when(again & (F.col("digest") == F.col("first.digest")), "replayed")
        .when(again, "command_conflict")
        .when(F.col("denial").isNotNull(), "denied")
        .when(~F.col("capable"), "capability_missing")
        .when(~F.col("epoch").eqNullSafe(F.col("current_epoch")), "epoch_stale")
        .when(F.col("expected").isNotNull() & (F.col("expected") != F.coalesce("revision", F.lit(0))), "precondition_failed")
        .otherwise("admitted")
    )
    return facts.select(*[F.col(c) for c in commands.columns], outcome.alias("outcome"), F.col("first.at").alias("applied_by"))
