"""Projections: formats, units that tile, parts, the floor and the ledger."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.plans import projecting as P

LOG = "   Compiling x\n" * 30 + "     Running unittests\n\nrunning 3 tests\ntest a ... ok\ntest b ... FAILED\n\nfailures:\n\n---- b stdout ----\n" + "panicked at\n" * 300 + "\nfailures:\n    b\n\ntest result: FAILED. 1 passed\n\nerror: test failed, to rerun\n"
RECORDS = [{"fixture": f"f{i}", "outcome": "pass" if i % 7 else "failed", "log": "é" * 400} for i in range(40)]
DOCUMENT = {"tool": "x", "limits": [], "results": RECORDS, "summary": {"n": 40}}
ARTIFACTS = [
    ("log", LOG.encode()), ("json", json.dumps(DOCUMENT, indent=1, ensure_ascii=False).encode()), ("lines", b"".join(json.dumps(r).encode() + b"\n\n" for r in RECORDS) + b'{"reason": "build-finished"}\n'), ("plain", ("word " * 20 + "\n").encode() * 300),
    ("long", "漢".encode() * 3000), ("small", b"one\ntwo"), ("empty", b""), ("binary", b"\xff\x00" * 10), ("huge", b"x" * (P.INPUT_BYTES + 1)),
]


@pytest.fixture(scope="module")
def artifacts(spark):
    return spark.createDataFrame(ARTIFACTS, "artifact string, content binary")


@pytest.fixture(scope="module")
def units(artifacts):
    return P.units(artifacts).collect()


def test_formats(artifacts):
    assert {r.artifact: r.format for r in P.sniffed(artifacts).collect()} == {
        "log": "libtest", "json": "json", "lines": "json_lines", "plain": "lines", "long": "lines", "small": "lines", "empty": "lines", "binary": "binary", "huge": "too_large",
    }


def test_units_tile(units):
    for name, body in ARTIFACTS[:6]:
        own = sorted((r for r in units if r.artifact == name), key=lambda r: r.unit)
        assert own[0].start == 0 and own[-1].end == len(body) and all(a.end == b.start for a, b in zip(own, own[1:]))
        assert all(r.end - r.start <= P.UNIT_BYTES for r in own) and all(body[r.start : r.end].decode() for r in own)


def test_kinds(units):
    def of(name, kind):
        body = dict(ARTIFACTS)[name]
        return [body[r.start : r.end].decode() for r in units if r.artifact == name and r.kind == kind]

    assert [x.split("\n")[0].strip() for x in of("log", "identity")] == ["Running unittests", "running 3 tests", "test result: FAILED. 1 passed"]
    failures = "".join(of("log", "failure"))
    assert failures.count("panicked") == 300 and "test b ... FAILED" in failures and "error: test failed" in failures and "Compiling" not in failures
    failed = [r for r in RECORDS if r["outcome"] == "failed"]
    for name in ("json", "lines"):
        text = "".join(of(name, "failure"))
        assert all(f'"{r["fixture"]}"' in text for r in failed) and text.count('"failed"') == len(failed) and '"pass"' not in text
    assert '"tool"' in "".join(of("json", "identity")) and '"summary"' in "".join(of("json", "identity")) and "build-finished" in of("lines", "identity")[0]
    assert {r.label for r in units if r.artifact == "json" and r.kind == "failure"} >= {'$."results"[0]', '$."results"[7]'}


def test_parts(artifacts):
    rows = P.parts(P.units(artifacts)).collect()
    for name in ("log", "json", "plain"):
        own = [r for r in rows if r.artifact == name]
        assert all((r.part is None) == (r.kind == "identity") for r in own)
        for part in {r.part for r in own} - {None}:
            held = [r for r in own if r.part == part]
            assert sum(r.end - r.start for r in held) <= P.PART_BYTES and len(held) <= P.PART_UNITS
        places = [r.part for r in sorted(own, key=lambda r: r.unit) if r.part is not None]
        assert places == sorted(places)
        for group in {r.group for r in own if r.part is not None}:
            if sum(r.end - r.start for r in own if r.group == group) <= P.PART_BYTES:
                assert len({r.part for r in own if r.group == group}) == 1


def plain_floor(own):
    """Units kept one by one, the whole weighed each time."""
    def fits(kept):
        runs = sum(k - 1 not in kept for k in kept)
        return P.HEADER + sum(size[k] for k in kept) + P.EXCERPT_OVERHEAD * runs <= P.SHOWN_BYTES and runs <= P.EXCERPTS

    size = {r.unit: r.end - r.start for r in own}
    if fits(set(size)):
        return set(size)
    kept = set()
    for kind in ("failure", "identity"):
        for r in sorted(own, key=lambda r: r.unit):
            if r.kind == kind and fits(kept | {r.unit}):
                kept.add(r.unit)
    return kept


def test_floor_and_ledger(artifacts, units):
    rows = P.floor(P.units(artifacts)).collect()
    for name in {r.artifact for r in units}:
        assert {r.unit for r in rows if r.artifact == name and r.carried} == plain_floor([r for r in units if r.artifact == name])
    extents = P.ledger(artifacts).collect()
    for name, body in ARTIFACTS:
        own = sorted((r for r in extents if r.artifact == name), key=lambda r: r.extent)
        at = 0
        for r in own:
            assert r.start == at
            at = r.end
        assert at == len(body) and all(a.disposition != b.disposition for a, b in zip(own, own[1:]))
    assert {r.artifact: r.disposition for r in extents if r.artifact in ("binary", "huge", "small")} == {"binary": "not_text", "huge": "insufficient_capacity", "small": "carried"}
    text = {r.artifact: r.content for r in P.shown(artifacts).collect()}
    assert text["small"] == "artifact small, 7 bytes, lines\n[0-7]\none\ntwo" and "omitted: not_selected" in text["plain"] and all(len(t.encode()) <= P.SHOWN_BYTES + 4096 for t in text.values())


def test_named_failures(artifacts):
    got = {r.artifact: (r.tests, r.errors) for r in P.named_failures(artifacts).collect()}
    assert got == {"log": (1, 1), "lines": (6, 0)}
