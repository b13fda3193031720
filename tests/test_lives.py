"""The event log and its pages, artifacts through their operations, and kept results against computing from scratch."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluator as E
from lodestone.operators import lifecycle as L
from lodestone.operators import reading as R
from lodestone.sources import eventlog


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Three epochs of 30 events, appended in two goes."""
    path = str(tmp_path_factory.mktemp("log"))
    fields = "epoch long, event_id long, ts timestamp_ntz, kind string, user_id long, value double, props string"
    rows = [(e, 100 * e + i, datetime.datetime(2024, e, 1, 0, 0, i % 20), "ab"[i % 2], i % 3, 1.0, "x" * 10) for e in (1, 2, 3) for i in range(30)]
    for part in (rows[:45], rows[45:]):
        eventlog.append(spark, path, spark.createDataFrame(part, fields).repartition(3))
    return eventlog.events(spark, path)


def test_sequences_go_on(log):
    got = {r.epoch: sorted(x[0] for x in log.filter(F.col("epoch") == r.epoch).select("sequence").collect()) for r in log.select("epoch").distinct().collect()}
    assert got == {e: list(range(1, 31)) for e in (1, 2, 3)}
    first = log.filter("epoch = 1").orderBy("sequence").collect()
    assert [(r.ts, r.event_id) for r in first] == sorted((r.ts, r.event_id) for r in first)


def test_pages_join(log):
    at, ids, pages = R.Position(1, 1), [], 0
    while True:
        page = R.read(log, at, visible=F.col("user_id") != 2, limit=17, vouched={1: 25, 2: 30})
        ids += [i["event_id"] for i in page.items if i["item"] == "event"]
        pages += 1
        assert len(page.items) <= 17
        if page.next == at:
            break
        at = R.Position.parse(page.next.cursor("s.1"), "s.1")
    want = [r.event_id for r in log.filter("user_id <> 2 and (epoch > 1 or sequence <= 25)").orderBy("epoch", "sequence").collect()]
    assert ids == want and pages > 3 and at == R.Position(3, 31)


def test_gap_change_budget_and_cursors(log):
    kept, gone = R.retained(log, 50)
    mark = R.Position(*gone.first())
    assert kept.count() == 50 and mark == R.Position(2, 10)
    page = R.read(kept, R.Position(1, 5), visible=F.col("user_id") != 2, watermark=mark)
    assert [i["item"] for i in page.items] == ["gap"] and page.next == R.Position(3, 31) and page.filtered
    assert R.snapshot(kept, F.col("user_id") != 2).count() == 4
    page = R.read(log, R.Position(1, 28), vouched={1: 25, 2: 30}, limit=3)
    assert [(i["item"], i["epoch"], i["sequence"]) for i in page.items] == [("epoch_change", 1, 25), ("event", 2, 1), ("event", 2, 2)] and page.next == R.Position(2, 3)
    page = R.read(log, R.Position(3, 1), byte_budget=25)
    assert len(page.items) == 2 and page.next == R.Position(3, 3) and not page.filtered and not page.too_large
    assert R.read(log, R.Position(3, 1), byte_budget=5).too_large
    page = R.read(log, R.Position(3, 1), kinds=("b",))
    assert page.filtered and {i["kind"] for i in page.items} == {"b"}
    assert R.Position.parse("c1.other.1.2", "s") is None and R.Position.parse("c1.s.1", "s") is None and R.Position.parse("c2.s.1.2", "s") is None


def ops(spark, rows):
    names = [f.split()[0] for f in L.OPERATION.split(", ")]
    return spark.createDataFrame([tuple({"at": "2024", "artifact": "a", "seq": i, "releases": None, **r}.get(n) for n in names) for i, r in enumerate(rows)], L.OPERATION)


def test_lifecycle(spark, tmp_path):
    body = b"hello world"
    digest = hashlib.sha256(body).hexdigest()
    up = [dict(op="prepare", size=11, digest=digest), dict(op="append", offset=0, content=body[:6]), dict(op="append", offset=6, content=body[6:])]
    rows = [
        dict(op="append", offset=0, content=b"x"), *up[:2], dict(op="prepare", size=1), dict(op="append", offset=5, content=b"x"), dict(op="append", offset=6, content=b"too long"), dict(op="seal"), up[2], dict(op="hold", hold="h"),
        dict(op="seal"), dict(op="seal"), dict(op="abandon"), dict(op="hold", hold="h"), dict(op="hold", hold="k", until="2025"), dict(op="purge"), dict(op="release", hold="z"), dict(op="release", hold="h"),
        dict(op="purge", at="2024"), dict(op="confirm"), dict(op="purge", at="2025"), dict(op="confirm", at="2026"), dict(op="append", offset=0, content=b"x"),
    ]
    got = [r.outcome for r in L.fold(ops(spark, rows)).orderBy("seq").collect()]
    assert got == [
        "absent", "ok", "ok", "exists", "upload_offset_mismatch", "upload_size_exceeded", "size_mismatch", "ok", "not_sealed", "ok", "already_sealed", "not_staged", "ok", "ok", "hold_active", "hold_unknown", "ok",
        "hold_active", "not_purging", "ok", "ok", "not_staged",
    ]
    more = [dict(r, artifact=a, seq=i) for a in "bc" for i, r in enumerate([*up, dict(op="seal")])]
    more += [dict(op="prepare", size=1, digest=digest, artifact="d", seq=0), dict(op="append", offset=0, content=b"x", artifact="d", seq=1), dict(op="seal", artifact="d", seq=2), dict(op="abandon", artifact="d", seq=3)]
    o = ops(spark, more)
    folded = L.fold(o)
    assert {(r.artifact, r.outcome) for r in folded.filter("op = 'seal'").collect()} == {("b", "ok"), ("c", "ok"), ("d", "content_digest_mismatch")}
    last, objects, path = L.latest(folded), L.contents(o, folded), str(tmp_path / "objects")
    assert [bytes(r.content) for r in objects.collect()] == [body]
    L.write_objects(objects, path)
    L.write_objects(objects.unionByName(spark.createDataFrame([("00ff", b"orphan")], "digest string, content binary")), path)
    stored = L.read_objects(spark, path)
    assert stored.count() == 2 and [r.digest for r in L.unreferenced(stored, last).collect()] == ["00ff"]
    assert {(r.artifact, r.availability, r.reason) for r in L.availability(last, stored).collect()} == {("b", "available", None), ("c", "available", None), ("d", "unavailable", "abandoned_by_producer")}
    bad = stored.withColumn("content", F.lit(b"other"))
    assert {r.reason for r in L.availability(last, bad).collect()} == {"integrity_failed", "abandoned_by_producer"}
    ask = spark.createDataFrame([("b", digest, 6, 3), ("b", digest, 6, 99), ("b", "00", 0, 1), ("b", digest, 12, 1), ("d", digest, 0, 1)], "artifact string, digest string, offset long, length long")
    got = {(r.artifact, r.offset, r.length): (r.content and bytes(r.content), r.next_offset, r.refusal) for r in L.fetched(last, stored, ask).collect()}
    assert got == {
        ("b", 6, 3): (b"wor", 9, None), ("b", 6, 99): (b"world", None, None), ("b", 0, 1): (None, None, "artifact_digest_mismatch"), ("b", 12, 1): (None, None, "offset_out_of_range"), ("d", 0, 1): (None, None, "not_sealed"),
    }


def scratch_values(inputs, nodes):
    """Every node from scratch, in plain Python."""
    values = dict(inputs)
    while len(values) < len(inputs) + len(nodes):
        for key, function, argument, deps, _ in nodes:
            if key not in values and all(d in values for d in deps):
                v = [values[d] for d in deps]
                values[key] = (sum(v) if function == "sum" else v[v[0] % len(v)]) % argument
    return {n[0]: values[n[0]] for n in nodes}


@pytest.mark.parametrize("seed", range(2))
def test_evaluator_random_programs(spark, seed):
    """Programs of random nodes over inputs that change: always the values of computing from scratch, and no more work than reads have changed."""
    rng = random.Random(seed)
    inputs = {f"i{k}": (rng.randint(0, 15), rng.randint(0, 2)) for k in range(4)}
    nodes = []
    for k in range(10):
        known = [*inputs, *(n[0] for n in nodes)]
        nodes.append((f"n{k}", rng.choice(["sum", "choice"]), rng.randint(1, 4), rng.sample(known, rng.randint(1, min(3, len(known)))), rng.random() < 0.1))
    program = spark.createDataFrame(nodes, E.NODE)
    given = spark.createDataFrame([(k, v, 1, d) for k, (v, d) in inputs.items()], E.INPUT)
    stamps, memo = spark.createDataFrame([(k, 1) for k in range(3)], E.STAMP), spark.createDataFrame([], E.MEMO)
    for revision in range(1, 4):
        if revision > 1:
            changed = {k: (rng.randint(0, 15), rng.randint(0, 2)) for k in rng.sample(sorted(inputs), rng.randint(0, 2))}
            inputs |= changed
            given, stamps = E.set_inputs(given, stamps, spark.createDataFrame([(k, v, d) for k, (v, d) in changed.items()], "key string, value long, durability int"), revision)
            given, stamps = (spark.createDataFrame(x.collect(), x.schema) for x in (given, stamps))
        rows = E.evaluate(given, program, memo, stamps, revision).collect()
        assert {r.key: r.value for r in rows} == scratch_values({k: v for k, (v, _) in inputs.items()}, nodes)
        if revision > 1 and not changed:
            assert not any(r.executed for r in rows if not dict((n[0], n[4]) for n in nodes)[r.key])
        memo = spark.createDataFrame([tuple(r)[:5] for r in rows], E.MEMO)


def test_evaluator_cycles_and_graph(spark):
    nodes = spark.createDataFrame([("a", "sum", 9, ["b", "i"], False), ("b", "sum", 9, ["a"], False), ("c", "sum", 9, ["i"], False), ("d", "sum", 9, ["c", "i"], False)], E.NODE)
    inputs, stamps, memo = spark.createDataFrame([("i", 4, 1, 2)], E.INPUT), spark.createDataFrame([(k, 1) for k in range(3)], E.STAMP), spark.createDataFrame([], E.MEMO)
    with pytest.raises(E.CycleError):
        E.evaluate(inputs, nodes, memo, stamps, 1)
    need = E.demanded(nodes, spark.createDataFrame([("d",)], "node string"))
    assert {r.key for r in need.collect()} == {"c", "d"}
    assert {r.key: (r.value, r.durability) for r in E.evaluate(inputs, need, memo, stamps, 1).collect()} == {"c": (4, 2), "d": (8, 2)}
    assert {r.node for r in E.dependents(nodes, "i").collect()} == {"a", "c", "d"} and {r.node for r in E.dependents(nodes, "c", True).collect()} == {"d"}
    same, after = E.set_inputs(inputs, stamps, spark.createDataFrame([("i", 4, 2)], "key string, value long, durability int"), 2)
    assert same.first().changed_at == 1 and {r.changed_at for r in after.collect()} == {1}
    _, lower = E.set_inputs(inputs, stamps, spark.createDataFrame([("i", 4, 0)], "key string, value long, durability int"), 2)
    assert {r.durability: r.changed_at for r in lower.collect()} == {0: 2, 1: 2, 2: 2}


def test_hold_ends_at_its_last_instant(spark, tmp_path):
    """An event just as a hold ends opens another; a second before, it renews it."""
    from lodestone.streaming import log as S

    at = datetime.datetime(2024, 1, 1)
    rows = [(1, 0), (1, S.HOLD_SECONDS), (2, 0), (2, S.HOLD_SECONDS - 1), (3, 2 * S.HOLD_SECONDS), (4, S.HOLD_SECONDS), (5, S.HOLD_SECONDS + 1)]
    made = [(k, at + datetime.timedelta(seconds=n), u, "view", 1.0, "{}") for k, (u, n) in enumerate(rows)]
    spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.user_id, r.expired - r.opened, r.renewals) for r in S.events_stateful_timers(spark, str(tmp_path)).collect()}
    assert got == {(1, S.HOLD_SECONDS, 1), (2, 2 * S.HOLD_SECONDS - 1, 2), (4, S.HOLD_SECONDS, 1)}
