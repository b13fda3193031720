"""Packets: ranking claims, ordering sections, what fits, what each item and request comes to.

Frames: items (request, item, obligation required or advisory, check_kind, wanted, check_repository, check_path, check_digest, check_claim, unmet,
corrected, authority_revision) and sections (request, section, item, place, content, claim_error, historical, and what a check looks at:
repository, path, via, digests, claim, shortfall, authority_revision). A request's sections are few by its own limits: they are folded as one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.constants import CLAIMS

#: What is dropped last to first, by kind.
DROP_RANK = ("binding_claim", "current_claim", "span", "anchor", "historical")


def drop_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in DROP_RANK]), kind) - 1


def ordered(sections: DataFrame) -> DataFrame:
    """sections: request, kind, order, key. Adds place: by what is dropped last, then its own order, then its key."""
    w = Window.partitionBy("request").orderBy(drop_rank(F.col("kind")), "order", "key")
    return sections.withColumn("place", F.row_number().over(w))


def ranked_claims(claims: DataFrame, asked: Column, most: int = CLAIMS) -> DataFrame:
    """claims: request, claim, terms (of its text and what it cites), named (whether a condition names a repository of the basis), binding.

    Eligible is what is named or shares a term; the score counts the question's terms, repeats included, that it has. Adds score, place
    and fate: carried (the first `most`, and binding ones in any case) or applicability, the reason it is left out for.
    """
    score = F.size(F.filter(asked, lambda t: F.array_contains(F.col("terms"), t)))
    w = Window.partitionBy("request").orderBy(F.col("score").desc(), "claim")
    some = claims.withColumn("score", score).filter("named or score > 0").withColumn("place", F.row_number().over(w))
    return some.withColumn("fate", F.when((F.col("place") <= most) | F.col("binding"), "carried").otherwise("applicability")).drop("terms")


def mandatory(sections: DataFrame, items: DataFrame) -> DataFrame:
    """sections with mandatory: whether they serve a required item."""
    must = items.filter("obligation = 'required'").select("request", "item", F.lit(True).alias("must")).distinct()
    return sections.join(must, ["request", "item"], "left").withColumn("mandatory", F.coalesce("must", F.lit(False))).drop("must")


def mandatory_size(sections: DataFrame, items: DataFrame) -> DataFrame:
    return mandatory(sections, items).filter("mandatory").groupBy("request").agg(F.sum(F.octet_length("content")).alias("bytes"), F.count("*").alias("n"))


def inclusion(sections: DataFrame, items: DataFrame, capacity: DataFrame) -> DataFrame:
    """capacity: request, amount. (request, section, included, reason): the bytes of required items' sections are reserved first and these
    are always in; others fill what remains in order of place, a later smaller one after a larger that did not fit. A section whose
    claim could not be read is never in."""
    rows = mandatory(sections, items).select("request", "place", "section", "mandatory", F.octet_length("content").cast("long").alias("size"), F.col("claim_error").isNotNull().alias("failed"))
    held = rows.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("place", "section", "mandatory", "size", "failed"))).alias("s"), F.coalesce(F.sum(F.when(F.col("mandatory") & ~F.col("failed"), F.col("size"))), F.lit(0)).alias("reserved"))
    held = held.join(capacity, "request").withColumn("room", F.col("amount") - F.col("reserved"))
    zero = F.struct(F.col("room").cast("long").alias("room"), F.expr("cast(array() as array<struct<section: string, included: boolean, reason: string>>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        optional = ~x["failed"] & ~x["mandatory"]
        fits = optional & (x["size"] <= a["room"])
        included = ~x["failed"] & (x["mandatory"] | fits)
        reason = F.when(x["failed"], "unavailable").when(~included, "output_capacity")
        row = F.struct(x["section"].cast("string").alias("section"), included.alias("included"), reason.alias("reason"))
        return F.struct(F.when(fits, a["room"] - x["size"]).otherwise(a["room"]).alias("room"), F.concat(a["out"], F.array(row)).alias("out"))

    return held.select("request", F.inline(F.aggregate("s", zero, step, lambda a: a["out"])))


def passes() -> Column:
    """Whether a section (its own columns) meets the check of its item (check_*)."""
    path = (F.col("path") == F.col("check_path")) | (F.col("via") == F.col("check_path"))
    source = F.coalesce((F.col("repository") == F.col("check_repository")) & path, F.lit(False))
    kind = F.col("check_kind")
    return (
        F.when(kind == "source_included", source)
        .when(kind == "evidence_included", F.coalesce(F.array_contains("digests", F.col("check_digest")), F.lit(False)))
        .when(kind == "claim_included", F.coalesce(F.col("claim") == F.col("check_claim"), F.lit(False)) & F.col("shortfall").isNull())
        .when(kind == "authority_content_included", F.col("authority_revision").eqNullSafe(F.coalesce("corrected", "supplied")) & F.col("supplied").isNotNull())
        .otherwise(False)
    )


def item_results(items: DataFrame, sections: DataFrame, included: DataFrame, finishing: bool = True, ended: str | None = None) -> DataFrame:
    """(request, item, obligation, result, reason): satisfied if a current, included section passes; else unmet for its own stated reason, pending
    while preparing, and at the end unmet or degraded with the first reason that applies."""
    s = sections.withColumn("section", F.col("section").cast("string")).join(included.select("request", "section", "included"), ["request", "section"])
    facts = items.join(s.withColumn("has", F.lit(True)), ["request", "item"], "left")
    current = F.col("has") & ~F.coalesce("historical", F.lit(False))
    claimed = (F.col("check_kind") == "claim_included") & (F.col("claim").isNotNull() | F.col("claim_error").isNotNull())
    error = F.when(F.col("claim_error") == "claim_digest_mismatch", F.col("claim_error")).when(F.col("claim_error").isNotNull(), "knowledge_unavailable")
    why = F.coalesce(error, F.when(F.col("claim") != F.col("check_claim"), "unavailable"), F.col("shortfall"), F.when(F.col("historical"), "invalid_for_target"))
    keys = ["request", "item", "obligation"]
    agg = facts.groupBy(*keys).agg(
        F.coalesce(F.bool_or(current & F.col("included") & passes()), F.lit(False)).alias("satisfied"),
        F.coalesce(F.bool_or(current & ~F.col("included")), F.lit(False)).alias("omitted"),
        F.first("unmet").alias("unmet"), F.first("corrected").alias("corrected"), F.min_by(F.when(claimed, F.struct(why.alias("why"))), F.when(claimed, F.col("place"))).alias("claim_reason"),
    )
    cause = F.coalesce(F.col("claim_reason.why"), F.when(F.col("omitted"), "output_capacity"), F.when(F.col("corrected").isNotNull(), "corrected_during_preparation"), F.lit(ended or "unavailable"))
    result = (
        F.when(F.col("satisfied"), "satisfied").when(F.col("unmet").isNotNull(), "unmet").when(F.lit(not finishing), "pending")
        .when(F.col("obligation") == "required", "unmet").otherwise("degraded")
    )
    reason = F.when(F.col("satisfied"), None).when(F.col("unmet").isNotNull(), F.col("unmet")).when(F.lit(not finishing), None).otherwise(cause)
    return agg.select(*keys, result.alias("result"), reason.alias("reason"))


def states(results: DataFrame) -> DataFrame:
    """(request, state): unmet if any item is, partial if any is degraded, else ready."""
    return results.groupBy("request").agg(F.when(F.bool_or(F.col("result") == "unmet"), "unmet").when(F.bool_or(F.col("result") == "degraded"), "partial").otherwise("ready").alias("state"))


def corrected_since(authority: DataFrame, corrections: DataFrame) -> DataFrame:
    """authority: packet, item, authority_revision, as a packet holds it. corrections: item, corrected. What has been corrected to a later revision since."""
    return authority.join(corrections, "item").filter(F.col("corrected") > F.col("authority_revision")).select("packet", "item", F.col("corrected").alias("authority_revision"))


def answers_checked(answers: DataFrame, offered: DataFrame) -> DataFrame:
    """answers: question, ids (array, as given). offered: question, id, place. (question, chosen, refused): chosen in the order offered, each once;
    refused are ids that were not offered, each once, in the order given."""
    given = answers.select("question", F.posexplode(F.array_distinct("ids")).alias("given", "id"))
    facts = given.join(offered, ["question", "id"], "left")

    def gathered(keep: Column, order: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(order, "id")))), lambda x: x["id"])

    found = facts.groupBy("question").agg(gathered(F.col("place").isNotNull(), "place").alias("chosen"), gathered(F.col("place").isNull(), "given").alias("refused"))
    none = F.expr("cast(array() as array<string>)")
    return answers.select("question").distinct().join(found, "question", "left").select("question", F.coalesce("chosen", none).alias("chosen"), F.coalesce("refused", none).alias("refused"))


def tallied(rows: DataFrame, by: list[str], kind: str, most: int) -> DataFrame:
    """Counts of each kind within `by`, the most frequent first, ties by name, at most `most` kinds."""
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), kind)
    return rows.groupBy(*by, kind).agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= most)
