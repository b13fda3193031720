"""Scores, differences, recorded answers, sets, and a subscription that loses and regains its right."""

import datetime

from pyspark.sql import functions as F

from lodestone.functions import sets as S
from lodestone.plans import scoring as P
from lodestone.sources import eventlog
from lodestone.streaming import subscription


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def arr(*x):
    return F.array(*[F.lit(v) for v in x]).cast("array<string>")


def test_sets(spark):
    assert list(one(spark, S.subset(arr("a"), arr("a", "b")), S.subset(arr("c"), arr("a")), S.subset(arr(), arr()))) == [True, False, True]
    assert list(one(spark, S.common(F.array(arr("a", "b"), arr("b", "c"))), S.common(F.array().cast("array<array<string>>")))) == [["b"], []]
    assert list(one(spark, S.same_members(arr("a", "b"), arr("b", "a")), S.same_members(arr("a", "a"), arr("a")))) == [True, False]
    assert list(one(spark, S.worth_asking(arr("a")), S.worth_asking(arr("a", "b")), S.worth_choosing(arr(*"abcdefgh"), arr(*"abcde")))) == [False, True, True]


def test_rubric_and_judges(spark):
    marks = spark.createDataFrame([(1, "x", 4.0), (1, "y", 2.0), (2, "x", 4.0)], "run int, criterion string, mark double")
    weights = spark.createDataFrame([("x", 3), ("y", 1)], "criterion string, weight int")
    assert {r.run: (r.mean, r.band) for r in P.rubric(marks, weights).collect()} == {1: (3.5, "strong"), 2: (3.0, "adequate")}
    scores = spark.createDataFrame([(1, "l", "j", 4.0), (1, "l", "k", 2.0), (2, "r", "j", 3.0), (1, "r", "j", 1.0)], "pair int, side string, judge string, score double")
    sides = spark.createDataFrame([(1, "l", "new", 7), (1, "r", "old", 8), (2, "r", "new", 7)], "pair int, side string, arm string, run int")
    assert {r.run: (r.arm, r.score, r.judges, r.attention) for r in P.unblinded(scores, sides).collect()} == {7: ("new", 3.0, 3, True), 8: ("old", 1.0, 1, False)}
    runs = [(1, "j", 80, 2, [True]), (1, "k", 74, 1, [True]), (2, "j", 90, 1, [True]), (3, "j", 99, 9, [True, False]), (4, "j", 10, 0, [])]
    got = P.verdicts(spark.createDataFrame(runs, "run int, judge string, score int, criticals int, gates array<boolean>")).collect()
    assert {r.run: (r.score, r.verdict) for r in got} == {1: (77.0, "USEFUL"), 2: (90.0, "PARTIAL"), 3: (99.0, "NOT"), 4: (10.0, "NOT")}
    s = F.lit
    assert list(one(spark, P.compared(s(50), s(55)), P.compared(s(55), s(51)), P.compared(s(60), s(55)), P.cost_return(s(5), s(20_000)), P.cost_return(s(5), s(0)))) == ["BETTER", "EQUAL", "WORSE", 2.5, None]


def test_survey_differences_replay_gate(spark):
    chunks = spark.createDataFrame([("p", 0, "ab"), ("p", 2, '""'), ("p", 4, "\n\n"), ("q", 0, "")], "path string, start_byte int, text string")
    assert {r.path: (r.most, r.at, r.over_0, r.over_1) for r in P.survey(chunks, (1, 3, 9)).collect()} == {"p": (4, 2, 3, 2), "q": (0, 0, 0, 0)}
    pairs = spark.createDataFrame([(1, '{"a": [1, {"b": 2}], "c": {}}', '{"a": [1, {"b": 3}, 4]}'), (2, "1", "1")], "pair int, a string, b string")
    assert [(r.pair, r.path, r.a, r.b) for r in P.differences(pairs).orderBy("path").collect()] == [(1, "$.a[1].b", "2", "3"), (1, "$.a[2]", None, "4"), (1, "$.c", "{}", None)]
    questions = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "question int, digest string")
    records = spark.createDataFrame([("x", 1, "a"), ("x", 2, "a"), ("y", 1, "a"), ("y", 2, "b")], "digest string, at int, answer string")
    assert {r.question: (r.answer, r.reason) for r in P.replayed(questions, records).collect()} == {1: ("a", None), 2: (None, "model_answer_ambiguous"), 3: (None, "not_recorded")}
    fields = "name string, outcome string"
    got = P.gate(spark.createDataFrame([("t", "ok"), ("t", "ok"), ("u", "failed")], fields), spark.createDataFrame([("t", "ok"), ("v", "ok")], fields)).collect()
    assert sorted(map(tuple, got)) == [("t", "ok", "unexpected"), ("u", "failed", "unexpected"), ("v", "ok", "missing")]


def test_pages_of_evidence(spark):
    rows = spark.createDataFrame([(f"a{i}", "s1" if i % 2 else "s2", None if i == 3 else "text") for i in range(10)], "id string, scope string, media string")
    found, after, hidden = P.page_of(rows, {"scope": "s1", "media": None}, F.col("id") != "a9", None, 2)
    assert [r.id for r in found] == ["a1", "a3"] and after == "a3" and hidden
    found, after, hidden = P.page_of(rows, {"scope": "s1", "media": "text"}, F.lit(True), "a3", 9)
    assert [r.id for r in found] == ["a5", "a7", "a9"] and after is None and not hidden


def test_obligations_and_shared_jobs(spark):
    effects = spark.createDataFrame([("a", "2024"), ("b", "2025"), ("c", "2023"), ("d", "2024")], "effect string, deadline string")
    seen = spark.createDataFrame([("a", 2, "aborted"), ("a", 1, "satisfied"), ("c", 1, "aborted")], "effect string, at int, what string")
    assert {r.effect: r.state for r in P.obligations(effects, seen, "2024").collect()} == {"a": "satisfied", "b": "pending", "c": "aborted", "d": "overdue"}
    row = lambda r, at, view, ends="5": (r, at, "u", "b", "i", view, [], ["e"], ends)
    requests = [row("r1", "1", ["x", "y"]), row("r2", "2", ["y", "x"]), row("r3", "3", ["x"]), row("r4", "6", ["x", "y"], "9"), row("r5", "7", ["x", "y"])]
    df = spark.createDataFrame(requests, "request string, at string, principal string, basis string, items string, view array<string>, claims array<string>, evidence array<string>, ends string")
    assert {r.request: r.job for r in P.shared_jobs(df).collect()} == {"r1": "r1", "r2": "r1", "r3": "r3", "r4": "r4", "r5": "r4"}


def test_subscription(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    fields = "epoch long, event_id long, ts timestamp_ntz, kind string, user_id long, value double, props string"

    def append(*ids):
        eventlog.append(spark, log, spark.createDataFrame([(1, i, datetime.datetime(2024, 1, 1, 0, i), "ab"[i % 2], 1, 1.0, "x" * (100 if i == 50 else 1)) for i in ids], fields).coalesce(1))

    kinds = ["a"]
    grants = lambda: spark.createDataFrame([("u", k) for k in kinds] + [("other", "b")], "principal string, kind string")

    def ids():
        return sorted(r.event_id for r in subscription.delivered(spark, out).collect())

    append(1, 2, 3, 4)
    assert subscription.subscribe(spark, log, out, grants, "u") is None and ids() == [2, 4]
    append(5, 6)
    kinds.append("b")
    assert subscription.subscribe(spark, log, out, grants, "u") is None and ids() == [1, 2, 3, 4, 5, 6]
    append(7, 8)
    held, kinds[:] = kinds[:], []
    assert subscription.subscribe(spark, log, out, grants, "u") == "authorization_lost" and ids() == [1, 2, 3, 4, 5, 6]
    kinds[:] = held
    assert subscription.subscribe(spark, log, out, grants, "u") is None and ids() == list(range(1, 9))
    append(50)
    assert subscription.subscribe(spark, log, out, grants, "u", item_bytes=10) == "item_too_large"
    assert subscription.subscribe(spark, log, out, grants, "u", batch_bytes=10) == "backpressure" and 50 not in ids()
    assert subscription.subscribe(spark, log, out, grants, "u") is None and 50 in ids()
