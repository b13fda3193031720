"""Rules of canonical JSON and redaction, and what must hold for ledgers and ids."""

import pytest
from oracle import SF

from lodestone.catalogue import QUERIES
from lodestone.functions.encoding import UNSETTLED, canonical_json, redact


@pytest.mark.parametrize("text, want", [
    ('{"b": 1, "a": [true, null, "x"]}', '{"a":[true,null,"x"],"b":1}'), ('{"\\ufb33": 1, "\\ud83d\\ude00": 2}', '{"\U0001f600":2,"דּ":1}'),
    ('"\\u0001\\n\\u007f\\u00e9/"', '"\\u0001\\n\x7fé/"'), ('{"a": 1, "a": 2}', None), ("1.5", None), ("1e3", None), ("NaN", None), ("9007199254740992", None), ("-7", "-7"),
    ("", None), ("{", None), ('"\\ud800"', None),
])
def test_canonical_json(text, want):
    assert canonical_json(text) == want


SECRET = "s3cr3tvalue0123456789"


@pytest.mark.parametrize("text", [
    f"https://a.example/x?X-Signature={SECRET}&y=1&token={SECRET}", f"Authorization: Bearer {SECRET}", f'{{"api_key": "{SECRET}"}}', f"see ghp_{SECRET} here",
    f'{{"link": "https:\\/\\/a.example\\/x?a=1\\u0026sig={SECRET}"}}', f'{{"u": "https%3A%2F%2Fa.example%2F%3Fpassword%3D{SECRET}"}}', f"password = x password: '{SECRET}'", f"eyJhbGci.{SECRET}.abc",
])
def test_redaction_takes_out_credentials(text):
    assert SECRET not in redact(text) and "[redacted" in redact(text)


def test_redaction_leaves_ordinary_text():
    for text in ("The key idea: a token of thanks, said at sunrise.", "", "12:30 http://a.example/b?page=2", "sk-short"):
        assert redact(text) == text
    deep = "https://a.example/?x=" + "%25252525252525252541"
    assert redact(f'["{deep}"]') == f'["{UNSETTLED}"]'


def test_ledgers_and_ids(spark):
    assert QUERIES["projection_ledger"](spark, SF).filter("not tiles").count() == 0
    assert QUERIES["id_encode_bounded"](spark, SF).filter("length(id) > 128 or not id rlike '^[A-Za-z][A-Za-z0-9._:~-]*$'").count() == 0
    assert QUERIES["memo_recompute_agrees"](spark, SF).filter("not agrees").count() == 0
    assert QUERIES["redact_full"](spark, SF).filter("leaks").count() == 0


def test_long_texts_are_worked_on_a_few_at_a_time(spark, monkeypatch, tmp_path):
    """Pages are dealt over tasks by their size, a worker holds few of them at a time, and nulls and refusals stay null."""
    from lodestone.plans import ledgers
    from lodestone.sources import tables

    rows = [(i, None if i % 7 == 0 else "1.5" if i % 5 == 0 else '{"b": %d, "a": 1}' % i) for i in range(300)]
    got = ledgers.mapped(spark.createDataFrame(rows, "id long, body string").coalesce(1), "body", canonical_json).collect()
    assert {r.id: r.body for r in got} == {i: None if i % 7 == 0 or i % 5 == 0 else '{"a":1,"b":%d}' % i for i in range(300)}
    monkeypatch.setattr(tables, "TASK_BYTES", 1 << 10)
    for name in ("canonical_json_digest", "redact_full"):
        assert QUERIES[name](spark, SF).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
