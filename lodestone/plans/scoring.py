"""Scoring of projections and runs: rubric, judges, surveys, differences between trees, recorded answers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import carried_bytes

#: Least mean of a band, best first.
BANDS = ((3.5, "strong"), (2.5, "adequate"), (1.5, "weak"))


def band(mean: Column) -> Column:
    out = F.lit("failing")
    for least, name in reversed(BANDS):
        out = F.when(mean >= least, name).otherwise(out)
    return F.when(mean.isNotNull(), out)


def rubric(marks: DataFrame, weights: DataFrame) -> DataFrame:
    """marks: run, criterion, mark. weights: criterion, weight. (run, mean, band): the weighted mean of a run's marks; a criterion without a mark counts as 0."""
    runs = marks.select("run").distinct()
    given = marks.groupBy("run", "criterion").agg(F.avg("mark").alias("mark"))
    wanted = runs.join(F.broadcast(weights)).join(given, ["run", "criterion"], "left")
    out = wanted.groupBy("run").agg((F.sum(F.coalesce("mark", F.lit(0)) * F.col("weight")) / F.sum("weight")).alias("mean"))
    return out.withColumn("band", band(F.col("mean")))


def unblinded(scores: DataFrame, sides: DataFrame, apart: float = 1.0) -> DataFrame:
    """scores: pair, side, judge, score. sides: pair, side, arm, run. (run, arm, score, judges, attention): scores averaged over judges and over pairs that show the
    same run; attention where the judges of some pair are further apart than `apart`."""
    named = scores.join(sides, ["pair", "side"])
    each = named.groupBy("run", "arm", "pair").agg(F.avg("score").alias("score"), F.count("*").alias("judges"), (F.max("score") - F.min("score")).alias("spread"))
    return each.groupBy("run", "arm").agg(F.avg("score").alias("score"), F.sum("judges").alias("judges"), F.bool_or(F.col("spread") > apart).alias("attention"))


def verdicts(runs: DataFrame) -> DataFrame:
    """runs: run, judge, score, criticals, gates (array of booleans). (run, score, verdict): the median of the judges; USEFUL from 75 on with two criticals found, PARTIAL from 50 on, else NOT;
    a failed gate is NOT."""
    each = runs.groupBy("run").agg(F.median("score").alias("score"), F.max("criticals").alias("criticals"), F.bool_and(F.forall("gates", lambda g: g)).alias("gates"))
    verdict = F.when(~F.col("gates"), "NOT").when((F.col("score") >= 75) & (F.col("criticals") >= 2), "USEFUL").when(F.col("score") >= 50, "PARTIAL").otherwise("NOT")
    return each.select("run", "score", verdict.alias("verdict"))


def compared(a: Column, b: Column, margin: float = 5) -> Column:
    """How b does against a."""
    return F.when(b - a >= margin, "BETTER").when(a - b >= margin, "WORSE").otherwise("EQUAL")


def cost_return(points: Column, tokens: Column) -> Column:
    """Points for each 10,000 tokens; null where none were spent."""
    return F.try_divide(points * 10_000, tokens)


def survey(chunks: DataFrame, bounds: tuple[int, int, int] = (2048, 4096, 8192)) -> DataFrame:
    """chunks: path, start_byte, text. (path, most, at, over_0, over_1, over_2): the greatest number of bytes that a chunk takes as JSON, the first chunk that takes
    it, and how many are over each bound."""
    rows = chunks.withColumn("carried", carried_bytes(F.col("text")))
    return rows.groupBy("path").agg(
        F.max("carried").alias("most"), F.max_by("start_byte", F.struct("carried", -F.col("start_byte"))).alias("at"), *[F.count_if(F.col("carried") > b).alias(f"over_{k}") for k, b in enumerate(bounds)]
    )


def _leaves(value, path: str, out: list) -> list:
    if isinstance(value, dict) and value:
        for k, v in value.items():
            _leaves(v, f"{path}.{k}", out)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            _leaves(v, f"{path}[{i}]", out)
    else:
        out.append({"path": path, "value": json.dumps(value, sort_keys=True)})
    return out


def leaves(body: Column) -> Column:
    """(path, value) of every leaf of a JSON text; an empty container is one. SQL functions do not reach a depth that is not known before."""
    return F.pandas_udf(lambda s: s.map(lambda x: _leaves(json.loads(x), "$", []), na_action="ignore"), "array<struct<path: string, value: string>>")(body)


def differences(pairs: DataFrame, most: int = 32) -> DataFrame:
    """pairs: pair, a, b (JSON texts). (pair, place, path, a, b): leaves that differ, by path, the first `most`; null where a side lacks it."""
    sides = [pairs.select("pair", F.inline(leaves(F.col(s)))).withColumnRenamed("value", s) for s in "ab"]
    rows = sides[0].join(sides[1], ["pair", "path"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    w = Window.partitionBy("pair").orderBy("path")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("pair", "place", "path", "a", "b")


def replayed(questions: DataFrame, records: DataFrame) -> DataFrame:
    """questions: question, digest. records: digest, at, answer. (question, answer, reason): the recorded answer; not_recorded, or model_answer_ambiguous where
    records of one question disagree."""
    known = records.groupBy("digest").agg(F.min_by("answer", "at").alias("answer"), (F.min("answer") != F.max("answer")).alias("differ"))
    facts = questions.join(known, "digest", "left")
    reason = F.when(F.col("answer").isNull(), "not_recorded").when(F.col("differ"), "model_answer_ambiguous")
    return facts.select("question", F.when(reason.isNull(), F.col("answer")).alias("answer"), reason.alias("reason"))


def gate(outcomes: DataFrame, expected: DataFrame) -> DataFrame:
    """outcomes and expected: name, outcome. What one has and the other has not, as often as it is more: (name, outcome, side)."""
    more, less = outcomes.select("name", "outcome").exceptAll(expected.select("name", "outcome")), expected.select("name", "outcome").exceptAll(outcomes.select("name", "outcome"))
    return more.withColumn("side", F.lit("unexpected")).unionByName(less.withColumn("side", F.lit("missing")))


def page_of(rows: DataFrame, filters: dict[str, str | None], visible: Column, after: str | None, limit: int = 100) -> tuple[list, str | None, bool]:
    """A page of evidence by id: rows that may be seen and meet every filter given (None passes all), after an id; the id to go on from, or None at the end; and
    whether anything was hidden, decided before the filters. rows: id and the filters' columns. One row more than the page comes to the driver."""
    limit = max(1, min(limit, 1000))
    hidden = not rows.filter(~visible).isEmpty()
    wanted = rows.filter(visible)
    for name, value in filters.items():
        wanted = wanted.filter(F.coalesce(F.col(name) == F.lit(value), F.lit(False))) if value is not None else wanted
    if after is not None:
        wanted = wanted.filter(F.col("id") > after)
    found = wanted.orderBy("id").limit(limit + 1).collect()
    return found[:limit], (found[limit - 1]["id"] if len(found) > limit else None), hidden


def obligations(effects: DataFrame, observations: DataFrame, now: str) -> DataFrame:
    """effects: effect, deadline. observations: effect, at, what (satisfied or aborted). (effect, state): the first observation decides; without one
    it is overdue from its deadline on, else pending."""
    first = observations.groupBy("effect").agg(F.min_by("what", "at").alias("what"))
    return effects.join(first, "effect", "left").select("effect", F.coalesce("what", F.when(F.col("deadline") <= now, "overdue").otherwise("pending")).alias("state"))


def shared_jobs(requests: DataFrame) -> DataFrame:
    """requests: request, at, principal, basis, items, view, claims, evidence (arrays: what it may read), ends (when its job would end). (request, job): a request joins the first
    earlier job that is still running and has the same principal, basis, items and the same three sets, in any order of their members."""
    sets = [F.array_join(F.array_sort(c), "\x1f") for c in ("view", "claims", "evidence")]
    key = F.sha2(F.concat_ws("\x1e", "principal", "basis", "items", *sets), 256)
    held = requests.withColumn("key", key).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "request", "ends"))).alias("r"))
    zero = F.struct(F.lit(None).cast("string").alias("job"), F.lit(None).cast("string").alias("ends"), F.expr("cast(array() as array<struct<request: string, job: string>>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        joins = F.coalesce(x["at"] < s["ends"], F.lit(False))
        job = F.when(joins, s["job"]).otherwise(x["request"])
        return F.struct(job.alias("job"), F.when(joins, s["ends"]).otherwise(x["ends"]).alias("ends"), F.concat(s["out"], F.array(F.struct(x["request"].alias("request"), job.alias("job")))).alias("out"))

    return held.select(F.inline(F.aggregate("r", zero, step, lambda s: s["out"])))
