"""Payloads that keep to their shape, and one fault at a time."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import validation as V

D = "sha256:" + "0a" * 32
SUBJECT = {"kind": "evidence.artifact", "id": "a1"}
EVIDENCE = {"provider": "p", "artifact": SUBJECT, "digest": D}
DESCRIPTOR = {
    "digest": D, "size": 3, "media_type": "text/plain", "producer": {"producer_id": "x"}, "source": {"kind": "file", "id": "f"}, "scope": "s", "capture": {"captured_at": "2024-01-01T00:00:00Z"},
    "coverage": {"completeness": "complete"}, "retention_class": "short", "locator": "https://h/p?page=1",
}
CLAIM = {
    "plane": "observed", "statement": {"subject": SUBJECT, "predicate": "holds", "value": {"a": [1]}, "cardinality": "single"}, "scope": {"id": "s", "qualifiers": {"os": "linux"}},
    "support": [{"support_id": "s1", "evidence": EVIDENCE, "ancestry": {"completeness": "complete", "roots": [{"x": 1}]}}], "derivation": {"kind": "human", "inputs": [EVIDENCE]},
    "validity": {"from": "2024-01-01T00:00:00Z", "until": "2025-01-01T00:00:00Z"}, "health": "passing",
}
ITEM = {"item_id": "i1", "selector": {"kind": "path", "value": "a"}, "obligation": "required", "reliance": "evidence", "selected_by": "u", "check": {"kind": "source_included", "repository": "r", "path": "p"}}
SUBMIT = {
    "consumer": {"task": "t", "principal": "u"}, "basis": {"repositories": [{"id": "r", "tree": "t"}], "completeness": "complete"}, "items": [ITEM],
    "limits": {"deadline": "2024-01-01T00:00:00Z", "output_capacity": {"unit": "bytes", "amount": 1}},
}


def faults(spark, base, cases, check):
    """cases: path to set, value (DROP: taken out), and the path at fault."""
    rows = [json.dumps(base)]
    for path, value, _ in cases:
        body = copy.deepcopy(base)
        at = body
        for key in path[:-1]:
            at = at[key]
        if value is DROP:
            del at[path[-1]]
        else:
            at[path[-1]] = value
        rows.append(json.dumps(body))
    df = spark.createDataFrame(list(enumerate([*rows, "{no json", "[]"])), "k int, body string").select("k", check(F.col("body")).alias("f")).orderBy("k")
    assert [r.f for r in df.collect()] == [None, *(f"/payload{want}" for *_, want in cases), "/payload", "/payload"]


DROP = object()


def test_descriptors(spark):
    cases = [
        (["extra"], 1, "/extra"), (["scope"], DROP, "/scope"), (["digest"], "sha256:00", "/digest"), (["size"], -1, "/size"), (["size"], "3", "/size"), (["producer", "principal"], "other", "/producer/principal"),
        (["source", "kind"], "terminal_output", "/coverage/completeness"), (["capture", "captured_at"], "2024-01-01", "/capture/captured_at"), (["coverage", "completeness"], "all", "/coverage/completeness"),
        (["capture", "uncertainty"], {"not_before": "2024-02-01T00:00:00Z", "not_after": "2024-01-01T00:00:00Z"}, "/capture/uncertainty"), (["locator"], "https://me@h/p", "/locator"), (["locator"], "https://h/p?a=1&Api_Key=2", "/locator"),
        (["work"], {"kind": "job"}, "/work/id"),
    ]
    faults(spark, DESCRIPTOR, cases, lambda b: V.descriptor_fault(b, F.lit("me")))


def test_claims(spark):
    cases = [
        (["plane"], "wishful", "/plane"), (["statement", "subject", "kind"], "Evidence", "/statement/subject/kind"), (["statement", "predicate"], "x" * 129, "/statement/predicate"), (["scope", "qualifiers", "k"], "", "/scope/qualifiers/k"),
        (["support", 0, "ancestry", "roots"], [], "/support/0/ancestry/roots"), (["support"], CLAIM["support"] * 2, "/support"), (["support", 0, "evidence", "digest"], D.upper(), "/support/0/evidence/digest"),
        (["validity", "until"], "2024-01-01T00:00:00Z", "/validity"), (["derivation", "inputs"], [EVIDENCE, {}], "/derivation/inputs/1/provider"), (["plane"], "normative", "/health"), (["supersedes"], {}, "/supersedes"),
    ]
    faults(spark, CLAIM, cases, V.claim_fault)


def test_submits(spark):
    cases = [
        (["items"], [], "/items"), (["items", 0, "check", "kind"], "vibes", "/items/0/check/kind"), (["items", 0, "transition"], "merge", "/items/0/transition"), (["items", 0, "obligation"], "required_before_transition", "/items/0/transition"),
        (["items", 0, "check", "path"], DROP, "/items/0/check/path"), (["items"], [ITEM, ITEM], "/items"), (["limits", "output_capacity", "amount"], 0, "/limits/output_capacity/amount"), (["consumer", "executor"], "-x", "/consumer/executor"),
        (["fallback"], "panic", "/fallback"), (["origin"], {"initiator": SUBJECT, "depth": 0}, "/origin/call_budget"), (["basis", "repositories"], [{"id": "r"}], "/basis/repositories/0/tree"),
    ]
    faults(spark, SUBMIT, cases, V.submit_fault)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_limits_and_intents(spark):
    s = F.lit
    bodies = ['{"a":[[[1]]]}', '{"a":[1,2,3]}', '{"a":"xxxxxxxx"}', '{"payload":{"k":"xx","l":"yy"}}', '{"a":[[[[1,2,3,4]]]],"b":"xxxxxxxxx"}', '{"a":1}']
    got = [one(spark, V.limit_broken(s(b), 3, 2, 7, 12))[0] for b in bodies]
    assert got == ["max_depth", "max_array_items", "max_string_bytes", "max_payload_bytes", "max_depth", None]
    command = {"operation": "o", "subject": 1, "preconditions": [], "requires": ["f", "x/y"], "payload": {"b": 1, "a": 2}, "extensions": {"x/y": 3, "x/z": 4}, "command_id": "c"}
    same = dict(reversed(command.items())) | {"command_id": "d"}
    a, b, c, d = one(spark, *[V.command_intent(s(json.dumps(x))) for x in (command, same, command | {"requires": ["x/q"]}, command | {"requires": ["f", "f"]})])
    assert a == b == '{"extensions":{"x/y":3},"operation":"o","payload":{"a":2,"b":1},"preconditions":[],"requires":["f","x/y"],"subject":1}' and c is None and d is None


def test_small_grammars(spark):
    s = F.lit
    assert list(one(spark, *[V.is_instant(s(x)) for x in ("2024-01-01T00:00:00Z", "2024-01-01 00:00:00Z", "2024-01-01T00:00:00.0Z")])) == [True, False, False]
    assert one(spark, V.ids_outside_grammar(F.array(*[s(x) for x in ("ok", "-no", "twice", "twice", "a/b")])))[0] == ["-no", "a/b", "twice"]
    assert list(one(spark, V.chunk_limit(s(10_000), s(8_000), s(5_000)), V.chunk_limit(s(10), s(8_000), s(5_000)))) == [3750, 0]
    good = '{"format": "facts/1", "facts": [{"name": "os", "class": "environment", "value": "linux"}]}'
    assert [tuple(x) for x in one(spark, V.facts(s(good)))[0]] == [("os", "environment", "linux")] and one(spark, V.facts(s(good.replace("environment", "weather"))))[0] is None
    assert [one(spark, V.revision_refusals(*[s(x) for x in row]))[0] for row in ((2, "d", 2, "d"), (2, "d", 1, "d"), (2, "d", 2, "e"))] == [None, "stale_revision", "stale_revision"]


@pytest.mark.parametrize("text, good", [("a.b", True), ("a.b_c.d-e", True), ("a", False), ("A.b", False), ("a..b", False), ("a.b/c", False)])
def test_dotted_names(spark, text, good):
    body = copy.deepcopy(CLAIM)
    body["statement"]["subject"]["kind"] = text
    assert (one(spark, V.claim_fault(F.lit(json.dumps(body))))[0] is None) == good
