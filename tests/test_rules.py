"""Rules of authority, knowledge, compiling and spending on small frames, case by case."""

from collections import defaultdict

import pytest
from oracle import SF
from pyspark.sql import functions as F

from lodestone.operators import authority as A
from lodestone.operators import knowledge as K
from lodestone.operators import spending as S
from lodestone.plans import compiling as P
from lodestone.plans import rules


def grant(id_, **over):
    base = dict(
        grant_id=id_, holder="h", rights=["read"], resources=[("part", None, None)], expires_at=None, scope=None, epoch=None, delegable=True, max_depth=3, parent=None, revoked=False, constraints=[]
    )
    return tuple((base | over).values())


def test_covers_resource(spark):
    cases = [
        (("a", None, None), ("a", "x", None), True), (("a", None, None), ("b", "x", None), False), (("a", "x", None), ("a", "x", None), True), (("a", "x", None), ("a", None, "x"), False),
        (("a", None, "x"), ("a", "xy", None), True), (("a", None, "x"), ("a", None, "xy"), True), (("a", None, "xy"), ("a", None, "x"), False), (("a", None, "x"), ("a", None, None), False),
    ]
    df = spark.createDataFrame([(w, n) for w, n, _ in cases], f"w {A.RESOURCE}, n {A.RESOURCE}")
    assert [r[0] for r in df.select(A.covers_resource(F.col("w"), F.col("n"))).collect()] == [c for *_, c in cases]


def test_denials_in_order(spark):
    grants = spark.createDataFrame(
        [grant("ok"), grant("gone", revoked=True, expires_at="2020"), grant("old", expires_at="2024", rights=[]), grant("stale", scope="s", epoch=1, rights=[]), grant("narrow", resources=[("part", None, "x")], constraints=["w1"])], A.GRANT
    )
    epochs = spark.createDataFrame([("s", 2)], "scope string, current long")
    ask = [
        ("none", "h", None, "read", "part", "x1", None), ("unknown", "h", "zz", "read", "part", "x1", None), ("other", "you", "ok", "read", "part", "x1", None), ("revoked", "h", "gone", "read", "part", "x1", None),
        ("at", "h", "old", "read", "part", "x1", None), ("epoch", "h", "stale", "read", "part", "x1", None), ("right", "h", "narrow", "write", "part", "q", None), ("scope", "h", "narrow", "read", "part", "q", None),
        ("bound", "h", "narrow", "read", "part", "x1", "w2"), ("fine", "h", "narrow", "read", "part", "x1", "w1"), ("whole", "h", "ok", "read", "part", None, None),
    ]
    requests = spark.createDataFrame([(*a, "2024") for a in ask], "request string, principal string, grant_id string, right string, kind string, id string, work string, at string")
    got = {r.request: r.denial for r in A.denials(requests, grants, epochs).collect()}
    assert got == {
        "none": "grant_required", "unknown": "grant_not_found", "other": "grant_not_found", "revoked": "revoked", "at": "expired", "epoch": "authority_epoch_stale", "right": "right_missing",
        "scope": "out_of_scope", "bound": "binding_violation", "fine": None, "whole": None,
    }


def test_delegation(spark):
    top = dict(rights=["read", "write"], resources=[("part", None, "x")], expires_at="2025", scope="s", epoch=1, max_depth=2, constraints=["w1"])
    child = top | dict(parent="p", max_depth=1)
    rows = [
        grant("p", **top), grant("fine", **child), grant("rights", **child | dict(rights=["admin"])), grant("resources", **child | dict(resources=[("part", None, None)])), grant("expiry", **child | dict(expires_at=None)),
        grant("depth", **child | dict(max_depth=2)), grant("constraints", **child | dict(constraints=["w2"])), grant("binding", **child | dict(epoch=2)), grant("q", delegable=False), grant("delegable", parent="q"),
    ]
    got = {r.grant_id: r.breach for r in A.delegation_breaches(spark.createDataFrame(rows, A.GRANT)).collect()}
    assert got == {x: x for x in ("rights", "resources", "expiry", "depth", "constraints", "binding", "delegable")}


def test_descendants_of_a_cycle_and_a_long_chain(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "b")], "child string, parent string")
    got = {(r.node, r.depth) for r in A.descendants(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("b", 1), ("c", 2), ("d", 2)}


def claim(name, **over):
    base = dict(
        claim=name, subject="s", predicate="p", scope="x", qualifiers={"q": "1"}, trees={"r": "t"}, environment=None, build=None, completeness="complete", valid_from="2020", valid_until="2030", cardinality="single", value=name,
        plane="observed",
    )
    return tuple((base | over).values())


@pytest.mark.parametrize(
    "over, want",
    [
        ({}, ("conflict", "demonstrated", [])), ({"subject": "t"}, None), ({"qualifiers": {"q": "2"}}, None), ({"qualifiers": {"z": "2"}}, ("conflict", "potential", ["qualifiers"])), ({"trees": {"r": "u"}}, None),
        ({"trees": {"r2": "u"}}, ("conflict", "potential", ["basis"])), ({"environment": "e"}, ("conflict", "potential", ["basis"])), ({"valid_from": "2030", "valid_until": "2031"}, None),
        ({"valid_until": None}, ("conflict", "potential", ["validity"])), ({"cardinality": "multiple"}, None), ({"cardinality": None}, ("conflict", "potential", ["cardinality"])), ({"value": "a"}, None),
        ({"plane": "normative"}, ("drift", "demonstrated", [])), ({"plane": "procedural"}, ("conflict", "potential", ["plane"])),
    ],
)
def test_conflicts(spark, over, want):
    got = K.conflicts(spark.createDataFrame([claim("a"), claim("b", **over)], K.CLAIM)).collect()
    assert [(r.kind, r.status, r.uncertain) for r in got] == ([want] if want else [])


def test_copies_of_a_claim_make_no_pairs(spark):
    got = K.conflicts(spark.createDataFrame([claim(f"a{i}", value="1") for i in range(50)] + [claim(f"b{i}", value="2") for i in range(50)], K.CLAIM)).collect()
    assert [(r.a_claim, r.b_claim) for r in got] == [("a0", "b0")]


def test_support_classes(spark):
    r, q = [("r", "d")], [("q", "e")]
    cases = [
        ([], "unsupported"), ([("1", r, "unknown")], "undetermined"), ([("1", r, "complete")], "single_lineage"), ([("1", r, "complete"), ("2", q, "complete")], "multiple_lineages"),
        ([("1", r, "complete"), ("2", q, "unknown")], "undetermined"), ([("1", r, "complete"), ("2", [("x", "d")], "complete")], "undetermined"), ([("1", r + q, "complete"), ("2", q + [("z", "f")], "complete"), ("3", r + [("z", "f")], "complete")], "overlapping_lineages"),
        ([("1", r, "complete"), ("2", q, "complete"), ("3", r, "unknown")], "multiple_lineages"), ([("1", [], "complete")], "undetermined"),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], f"e array<{K.ENTRY}>")
    assert [x[0] for x in df.select(K.support_class(F.col("e"))).collect()] == [w for _, w in cases]


def test_results_and_shortfalls(spark):
    cases = [([], "unknown"), (["match"], "applicable"), (["match", "unchecked"], "needs_check"), (["unchecked", "unsupported"], "unknown"), (["missing_anchor", "mismatch"], "invalid_for_target")]
    df = spark.createDataFrame([(c,) for c, _ in cases], "f array<string>")
    assert [x[0] for x in df.select(K.result_of(F.col("f"))).collect()] == [w for _, w in cases]
    rows = [
        ("binding", "accepted_for_use", "binding", "applicable", None), ("binding", "accepted_for_use", "evidence", "applicable", "not_accepted"), ("evidence", "accepted_for_use", "binding", "unknown", "applicability_not_established"),
        ("evidence", "accepted_for_use", "evidence", "invalid_for_target", "invalid_for_target"), ("reference", "rejected", None, "unknown", "not_accepted"), ("hypothesis", "superseded", None, "invalid_for_target", None),
    ]
    df = spark.createDataFrame(rows, "w string, s string, p string, r string, want string")
    assert all(x[0] == x[1] for x in df.select(K.shortfall(*[F.col(c) for c in "wspr"]), "want").collect())


def test_claims_attached(spark):
    sections = spark.createDataFrame([(i, "binding", c, 1, "d") for i, c in enumerate(["ok", "weak", "stale", "forged", "gone", None])], "section int, label string, claim string, revision int, digest string")
    reads = [("ok", 1, "d", "d", "accepted_for_use", "binding", "applicable"), ("weak", 1, "d", "d", "accepted_for_use", "evidence", "applicable"), ("stale", 1, "d", "d", "accepted_for_use", "binding", "invalid_for_target"), ("forged", 1, "d", "e", "accepted_for_use", "binding", "applicable")]
    got = K.attached(sections, spark.createDataFrame(reads, "claim string, revision int, digest string, recomputed string, state string, permitted string, result string")).orderBy("section").collect()
    assert [(r.label, r.historical, r.claim_error) for r in got] == [("binding", False, None), ("hypothesis", False, None), ("stale", True, None), ("binding", False, "claim_digest_mismatch"), ("binding", False, "knowledge_unavailable"), ("binding", False, None)]


def test_decisions_supersede_the_latest(spark):
    rows = [("c", 1, "a", None), ("c", 2, "b", 1), ("c", 3, "a", None), ("c", 4, "a", 1), ("c", 5, "a", 1), ("c", 6, "a", 4)]
    got = K.decisions_checked(spark.createDataFrame(rows, "claim string, seq long, principal string, supersedes long"), spark.createDataFrame([("c", "a")], "claim string, principal string")).orderBy("seq").collect()
    assert [r.refusal for r in got] == [None, "not_authority", "stale_decision", None, "stale_decision", None]


def test_items_and_their_checks(spark):
    item = "request int, item int, obligation string, check_kind string, check_repository string, check_path string, check_digest string, check_claim string, unmet string, corrected long, supplied long"
    section = "request int, section string, item int, place int, content string, claim_error string, historical boolean, repository string, path string, via string, digests array<string>, claim string, shortfall string, authority_revision long"
    def it(i, kind, obligation="required", **k):
        base = dict(request=1, item=i, obligation=obligation, check_kind=kind, check_repository="r", check_path="p", check_digest="d", check_claim="c", unmet=None, corrected=None, supplied=None)
        return tuple((base | k).values())
    def se(i, **k):
        base = dict(request=1, section=f"s{i}", item=i, place=i, content="xx", claim_error=None, historical=False, repository=None, path=None, via=None, digests=[], claim=None, shortfall=None, authority_revision=None)
        return tuple((base | k).values())
    items = [
        it(1, "source_included"), it(2, "evidence_included"), it(3, "claim_included"), it(4, "authority_content_included", supplied=2, corrected=3), it(5, "claim_included"), it(6, "claim_included"), it(7, "source_included", "advisory"),
        it(8, "source_included", unmet="no_reader"), it(9, "authority_content_included", supplied=2, corrected=3), it(10, "claim_included"),
    ]
    sections = [
        se(1, repository="r", via="p"), se(2, digests=["d"]), se(3, claim="c"), se(4, authority_revision=3), se(5, claim="c", shortfall="not_accepted"), se(6, claim_error="claim_digest_mismatch"), se(7, content="x" * 99, repository="r", path="p"),
        se(8), se(9, authority_revision=2), se(10, claim="other"),
    ]
    items, sections = spark.createDataFrame(items, item), spark.createDataFrame(sections, section)
    fits = P.inclusion(sections, items, spark.createDataFrame([(1, 50)], "request int, amount int"))
    assert {r.section: r.reason for r in fits.collect() if not r.included} == {"s6": "unavailable", "s7": "output_capacity"}
    results = P.item_results(items, sections, fits)
    assert [(r.result, r.reason) for r in results.orderBy("item").collect()] == [
        *[("satisfied", None)] * 4, ("unmet", "not_accepted"), ("unmet", "claim_digest_mismatch"), ("degraded", "output_capacity"), ("unmet", "no_reader"), ("unmet", "corrected_during_preparation"), ("unmet", "unavailable"),
    ]
    assert P.states(results).first().state == "unmet"
    assert [r.result for r in P.item_results(items, sections, fits, finishing=False).orderBy("item").collect()].count("pending") == 5


def test_answers_and_corrections(spark):
    answers = spark.createDataFrame([(1, ["b", "z", "a", "b"]), (2, [])], "question int, ids array<string>")
    offered = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "question int, id string, place int")
    assert {r.question: (r.chosen, r.refused) for r in P.answers_checked(answers, offered).collect()} == {1: (["a", "b"], ["z"]), 2: ([], [])}
    held = spark.createDataFrame([("p", "i", 2), ("p", "j", 3)], "packet string, item string, authority_revision long")
    later = spark.createDataFrame([("i", 3), ("j", 3)], "item string, corrected long")
    assert [tuple(r) for r in P.corrected_since(held, later).collect()] == [("p", "i", 3)]


def test_admissions_brute_force(spark):
    """The same rows, folded one by one with sums over all that came before."""
    rows = rules.calls(spark, SF).orderBy("store", "seconds", "id").collect()
    c = S.Ceilings(request=25_000, job=40_000, window=30_000, month=900_000, run=1_000_000)
    held, want = defaultdict(list), {}
    for r in rows:
        past = held[r.store]
        total = lambda test: sum(e for j, s, m, e in past if test(j, s, m)) + r.estimate  # noqa: B023, E731
        over = [("per_request", r.estimate > c.request), ("per_job", total(lambda j, s, m: j == r.job) > c.job), ("window_exhausted", total(lambda j, s, m: s > r.seconds - 18000) > c.window), ("month_exhausted", total(lambda j, s, m: m == r.month) > c.month), ("run_ceiling", total(lambda *_: True) > c.run)]  # noqa: B023
        want[r.id] = r.stop or next((name for name, hit in over if hit), "reservation")
        if want[r.id] == "reservation":
            past.append((r.job, r.seconds, r.month, r.estimate))
    got = {r.id: (r.outcome, r.spent) for r in S.admissions(rules.calls(spark, SF), c).collect()}
    assert {k: v[0] for k, v in got.items()} == want and len(set(want.values())) >= 5
    assert all((v[1] > 0) == (v[0] == "reservation") for v in got.values())


def test_counted_admission(spark):
    rows = [("low", 100, 1, 10, None), ("saved", 9000, 1, 10, 2000), ("loose", 9000, 1, 10, 500), ("silent", 9000, 1, 10, None)]
    got = S.counted_admission(spark.createDataFrame(rows, "call string, body_bytes int, messages int, generation int, count int"), 3000).collect()
    assert {r.call: (r.bound, r.believed, r.outcome) for r in got} == {"low": (1142, 1142, "admitted"), "saved": (10042, 2010, "admitted_by_count"), "loose": (10042, 10042, "refused"), "silent": (10042, 10042, "refused")}
