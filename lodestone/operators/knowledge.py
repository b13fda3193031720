"""Claims: support, conflicts, applicability, reliance, what changed since a packet was made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRY = "struct<support_id: string, roots: array<struct<id: string, digest: string>>, completeness: string>"


def support_class(entries: Column) -> Column:
    """The class of a claim's support, from an array of ENTRY.

    Two entries are shared if they have a root in common; disjoint if both are complete and no digest of a root is in both;
    else it cannot be told. The first that applies: unsupported (no entry), undetermined (some ancestry unknown and no disjoint
    pair), single_lineage (a root in every entry), multiple_lineages (a disjoint pair), overlapping_lineages (all pairs shared).
    """
    digests = lambda e: F.filter(F.transform(e["roots"], lambda r: r["digest"]), lambda d: d.isNotNull())
    shared = lambda a, b: F.arrays_overlap(a["roots"], b["roots"])
    complete = lambda a, b: (a["completeness"] == "complete") & (b["completeness"] == "complete")
    disjoint = lambda a, b: ~shared(a, b) & complete(a, b) & ~F.coalesce(F.arrays_overlap(digests(a), digests(b)), F.lit(False))

    def any_pair(test) -> Column:
        return F.exists(F.transform(entries, lambda a, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda b: test(a, b))), lambda x: x)

    unknown = F.exists(entries, lambda e: F.coalesce(e["completeness"], F.lit("unknown")) == "unknown")
    common = F.exists(F.get(entries, F.lit(0))["roots"], lambda r: F.forall(entries, lambda e: F.array_contains(e["roots"], r)))
    return (
        F.when(F.size(entries) == 0, "unsupported")
        .when(unknown & ~any_pair(disjoint), "undetermined")
        .when(common, "single_lineage")
        .when(any_pair(disjoint), "multiple_lineages")
        .when((F.size(entries) >= 2) & ~any_pair(lambda a, b: ~shared(a, b)), "overlapping_lineages")
        .otherwise("undetermined")
    )


def unknown_ancestry(entries: Column) -> Column:
    """support_id of the entries whose ancestry is unknown, in order."""
    return F.transform(F.filter(entries, lambda e: F.coalesce(e["completeness"], F.lit("unknown")) == "unknown"), lambda e: e["support_id"])


def availability(states: Column) -> Column:
    """One word for an array of states of artifacts: available, unavailable, purged, unknown."""
    n = F.size(states)
    count = lambda s: F.size(F.filter(states, lambda x: x == s))
    return (
        F.when(n == 0, "unknown").when(count("available") == n, "complete").when(count("available") > 0, "partial")
        .when(count("unknown") > 0, "unknown").when(count("purged") == n, "purged").otherwise("unavailable")
    )


CLAIM = (
    "claim string, subject string, predicate string, scope string, qualifiers map<string, string>, trees map<string, string>, environment string, build string, "
    "completeness string, valid_from string, valid_until string, cardinality string, value string, plane string"
)


def compared(pairs: DataFrame) -> DataFrame:
    """pairs: columns of CLAIM as a_* and b_*. Adds refusal (the first check that tells the two apart, or null), kind, status and
    uncertain: what could not be settled. Without uncertainty a conflict is demonstrated, else potential."""
    a, b = (lambda c, s=s: F.col(f"{s}_{c}") for s in "ab")

    def same(c: str) -> Column:
        return a(c).eqNullSafe(b(c))

    def clash(c: str) -> Column:
        """A key that both maps hold with different values."""
        both = F.array_intersect(F.map_keys(a(c)), F.map_keys(b(c)))
        return F.coalesce(F.exists(both, lambda k: F.element_at(a(c), k) != F.element_at(b(c), k)), F.lit(False))

    def equal_maps(c: str) -> Column:
        entries = [F.array_sort(F.map_entries(x(c))) for x in (a, b)]
        return entries[0].eqNullSafe(entries[1])

    def differ(c: str) -> Column:
        return F.coalesce(a(c) != b(c), F.lit(False))

    known = a("trees").isNotNull() & b("trees").isNotNull()
    basis_apart = known & (clash("trees") | differ("environment") | differ("build"))
    certain = known & equal_maps("trees") & same("environment") & same("build") & (a("completeness") == "complete") & (b("completeness") == "complete")
    dated = a("valid_from").isNotNull() & a("valid_until").isNotNull() & b("valid_from").isNotNull() & b("valid_until").isNotNull()
    overlap = (a("valid_from") < b("valid_until")) & (b("valid_from") < a("valid_until"))
    multiple = (a("cardinality") == "multiple") | (b("cardinality") == "multiple")
    refusal = (
        F.when(~same("subject"), "subject_differs").when(~same("predicate"), "predicate_differs").when(~same("scope"), "scope_differs")
        .when(clash("qualifiers"), "qualifiers_disjoint").when(basis_apart, "basis_disjoint").when(dated & ~overlap, "validity_disjoint")
        .when(F.coalesce(multiple, F.lit(False)), "multiple_values_permitted").when(same("value"), "values_equal")
    )
    drift = F.concat_ws(">", a("plane"), b("plane")).isin("normative>observed", "observed>normative")
    single = F.coalesce((a("cardinality") == "single") & (b("cardinality") == "single"), F.lit(False))
    doubts = [
        ("qualifiers", ~equal_maps("qualifiers")), ("basis", ~F.coalesce(certain, F.lit(False))), ("validity", ~dated), ("cardinality", ~single),
        ("plane", ~drift & ~same("plane")),
    ]
    uncertain = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in doubts]))
    found = refusal.isNull()
    return pairs.withColumns({
        "refusal": refusal, "kind": F.when(found, F.when(drift, "drift").otherwise("conflict")),
        "status": F.when(found, F.when(F.size(uncertain) == 0, "demonstrated").otherwise("potential")), "uncertain": F.when(found, uncertain),
    })


def conflicts(claims: DataFrame) -> DataFrame:
    """Pairs of claims that conflict: a_claim < b_claim, kind, status, uncertain.

    Claims with all members alike but their name are represented by the least of them, since equal values never conflict; so a
    statement with very many copies makes no pairs of its own, and pairs are made between different texts only.
    """
    members = [c for c in claims.columns if c != "claim"]
    keys = [F.to_json(F.array_sort(F.map_entries(c))) if c in ("qualifiers", "trees") else F.col(c) for c in members]
    digest = F.sha2(F.to_json(F.struct(*[k.alias(c) for k, c in zip(keys, members)])), 256)
    first = claims.withColumn("like", digest).groupBy("like").agg(F.min_by(F.struct(*claims.columns), "claim").alias("c")).select("c.*")
    a, b = (first.select(*[F.col(c).alias(f"{s}_{c}") for c in first.columns]) for s in "ab")
    same = [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in ("subject", "predicate", "scope")]
    pairs = a.join(b, same[0] & same[1] & same[2] & (F.col("a_claim") < F.col("b_claim")) & ~F.col("a_value").eqNullSafe(F.col("b_value")))
    return compared(pairs).filter("refusal is null").select("a_claim", "b_claim", "kind", "status", "uncertain")


def findings(conditions: DataFrame, targets: DataFrame, kinds: tuple[str, ...] = ("repository_tree", "dirty_snapshot", "environment_digest")) -> DataFrame:
    """conditions: claim, condition_id, kind, repository, expected. targets: repository, tree, dirty, environment, a row for each repository of
    the target. Adds finding: unsupported, missing_anchor, match or mismatch."""
    environment = targets.agg(F.max("environment").alias("environment_now"))
    facts = conditions.join(targets.select("repository", "tree", "dirty"), "repository", "left").join(F.broadcast(environment))
    seen = F.when(F.col("kind") == "repository_tree", F.col("tree")).when(F.col("kind") == "dirty_snapshot", F.col("dirty")).when(F.col("kind") == "environment_digest", F.col("environment_now"))
    finding = F.when(~F.col("kind").isin(*kinds), "unsupported").when(seen.isNull(), "missing_anchor").when(seen == F.col("expected"), "match").otherwise("mismatch")
    return facts.select("claim", "condition_id", "kind", finding.alias("finding"))


def result_of(found: Column) -> Column:
    """The result of an evaluation from its findings, the first rule that applies; no findings say nothing."""
    some = lambda *names: F.exists(found, lambda f: f.isin(*names))
    return (
        F.when(some("mismatch"), "invalid_for_target").when(some("missing_anchor", "unsupported"), "unknown").when(some("unchecked"), "needs_check")
        .when(F.size(found) == 0, "unknown").otherwise("applicable")
    )


#: What a use is worth.
RELIANCE = {"binding": 4, "evidence": 3, "hypothesis": 2, "reference": 1}


def _rank(use: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in RELIANCE.items() for x in p]), use), F.lit(0))


def shortfall(wanted: Column, state: Column, permitted: Column, result: Column) -> Column:
    """Why a claim does not satisfy an item that relies on it as `wanted`; null if it does."""
    strict = F.when((state != "accepted_for_use") | (_rank(permitted) < _rank(wanted)), "not_accepted").when(result == "invalid_for_target", "invalid_for_target").when(result != "applicable", "applicability_not_established")
    return F.when(wanted.isin("binding", "evidence"), strict).when(state == "rejected", "not_accepted")


SNAPSHOT = "claim string, revision long, state string, permitted string, result string, conflicts array<string>"


def attached(sections: DataFrame, reads: DataFrame) -> DataFrame:
    """sections: section, label, claim, revision, digest. reads: claim, revision, digest, recomputed, state, permitted, result: the claim
    as it is read. Adds claim_error, and label and historical as the claim makes them: only a claim that is accepted for binding use
    stays binding, and one invalid for the target makes its section historical and stale. A digest that does not come out is never carried."""
    r = reads.select(F.col("claim"), *[F.col(c).alias(f"r_{c}") for c in reads.columns if c != "claim"])
    facts = sections.join(r, "claim", "left")
    same = (F.col("revision") == F.col("r_revision")) & (F.col("digest") == F.col("r_digest")) & (F.col("digest") == F.col("r_recomputed"))
    error = F.when(F.col("claim").isNull(), None).when(F.col("r_digest").isNull(), "knowledge_unavailable").when(~same, "claim_digest_mismatch")
    read = F.col("claim").isNotNull() & error.isNull()
    stale = read & (F.col("r_result") == "invalid_for_target")
    weak = read & (F.col("label") == "binding") & ~((F.col("r_state") == "accepted_for_use") & F.col("r_permitted").eqNullSafe(F.lit("binding")))
    label = F.when(stale, "stale").when(weak, "hypothesis").otherwise(F.col("label"))
    return facts.select(*[F.col(c) for c in sections.columns if c != "label"], label.alias("label"), stale.alias("historical"), error.alias("claim_error"))


def read_time_changes(carried: DataFrame, now: DataFrame) -> DataFrame:
    """carried and now: SNAPSHOT, as a packet holds it and as it is read again (with current_revision); carried has wanted (the reliance of
    a required item that the claim satisfied, or null). A row for each claim: changes (array, in order), invalidated, unverified (reasons)."""
    n = now.select("claim", *[F.col(c).alias(f"n_{c}") for c in now.columns if c != "claim"])
    facts = carried.join(n, "claim", "left")
    gone = F.col("n_state").isNull()
    opened = F.size(F.array_except("n_conflicts", "conflicts")) > 0
    kinds = [
        ("unavailable", gone), ("reliance_changed", ~(F.col("state").eqNullSafe(F.col("n_state")) & F.col("permitted").eqNullSafe(F.col("n_permitted")))),
        ("applicability_changed", ~F.col("result").eqNullSafe(F.col("n_result"))), ("conflict_opened", opened), ("lineage_revised", F.col("n_current_revision") > F.col("revision")),
    ]
    changes = F.array_compact(F.array(*[F.when(test if k == "unavailable" else ~gone & test, F.lit(k)) for k, test in kinds]))
    short = F.coalesce(shortfall(F.col("wanted"), F.col("n_state"), F.col("n_permitted"), F.col("n_result")), F.when(F.col("n_result") == "invalid_for_target", "invalid_for_target"))
    needed = F.col("wanted").isNotNull()
    invalidated = F.when(needed & ~gone, F.when(short == "not_accepted", "permitted_use_lost").when(short == "invalid_for_target", short))
    unverified = F.when(needed, F.when(gone, "knowledge_unavailable").when(short == "applicability_not_established", short))
    return facts.select("claim", changes.alias("changes"), invalidated.alias("invalidated"), unverified.alias("unverified"))


def dependency_reasons(dependencies: DataFrame, revisions: DataFrame, evaluations: DataFrame, here: str) -> DataFrame:
    """dependencies: claim, provider, on_claim, on_revision. revisions: claim, revision. evaluations: claim, result. Adds the first reason
    that a dependency does not hold: remote_dependency, self_reference, unresolved, not_evaluated, not_established; null if it holds."""
    r = revisions.select(F.col("claim").alias("on_claim"), F.col("revision").alias("on_revision"), F.lit(True).alias("resolved"))
    e = evaluations.select(F.col("claim").alias("on_claim"), F.col("result").alias("on_result"))
    facts = dependencies.join(r, ["on_claim", "on_revision"], "left").join(e, "on_claim", "left")
    reason = (
        F.when(F.col("provider") != here, "remote_dependency").when(F.col("on_claim") == F.col("claim"), "self_reference").when(F.col("resolved").isNull(), "unresolved")
        .when(F.col("on_result").isNull(), "not_evaluated").when(F.col("on_result") != "applicable", "not_established")
    )
    return facts.select(*dependencies.columns, reason.alias("reason"))


def decisions_checked(decisions: DataFrame, authorities: DataFrame) -> DataFrame:
    """decisions: claim, seq, principal, supersedes (the seq of the decision it replaces, or null). authorities: claim, principal (the bound one).
    Adds refusal: not_authority, or stale_decision where it does not supersede the latest one accepted before it."""
    held = authorities.select("claim", F.col("principal").alias("bound"))
    known = decisions.join(held, "claim", "left")
    ours = F.col("principal").eqNullSafe(F.col("bound"))
    # every decision names the one it replaces, so the accepted ones form a chain: a fold over the few decisions of a claim
    rows = known.groupBy("claim").agg(F.array_sort(F.collect_list(F.struct("seq", "principal", "supersedes", ours.alias("ours")))).alias("d"))
    zero = F.struct(F.lit(None).cast("long").alias("last"), F.expr("cast(array() as array<struct<seq: bigint, refusal: string>>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        refusal = F.when(~x["ours"], "not_authority").when(~x["supersedes"].eqNullSafe(s["last"]), "stale_decision")
        return F.struct(F.when(refusal.isNull(), x["seq"]).otherwise(s["last"]).alias("last"), F.concat(s["out"], F.array(F.struct(x["seq"].alias("seq"), refusal.alias("refusal")))).alias("out"))

    return rows.select("claim", F.inline(F.aggregate("d", zero, step, lambda s: s["out"])))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, with first_seen, the least place of the key."""
    agg = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("last"), F.min(order).alias("first_seen"))
    return agg.select(*keys, "last.*", "first_seen")


def history(revisions: DataFrame, events: DataFrame) -> DataFrame:
    """revisions: claim, revision. events: claim, revision, epoch, sequence. Each revision with its place in its claim and its first event."""
    first = events.groupBy("claim", "revision").agg(F.min(F.struct("epoch", "sequence")).alias("position"))
    w = Window.partitionBy("claim").orderBy("revision")
    return revisions.withColumn("place", F.row_number().over(w)).join(first, ["claim", "revision"], "left")
