"""The index and its search: odd files, replacing a repository, paging, bounds, publication."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import retrieval as R

FIELDS = "repository string, tree string, path string, blob string, mode string, content binary"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.fixture(scope="module")
def blobs(spark):
    rows = [("7", "t1", f"src/f{i}.py", f"b{i}", "100644", f"def getUserName{i % 3}():\n    return café\n".encode() * (i + 1)) for i in range(12)]
    rows += [
        ("7", "t1", "bin", "x1", "100644", b"\xff\xfe\x00"), ("7", "t1", "link", "x2", "120000", b"src/f1.py"), ("7", "t1", "big.txt", "x3", "100755", b"a" * (R.MAX_BLOB + 1)),
        ("7", "t1", "empty.rs", "x4", "100644", b""), ("other", "t1", "notes.md", "n1", "100644", b"user name\n" * 30),
    ]
    return spark.createDataFrame(rows, FIELDS)


@pytest.fixture(scope="module")
def index(spark, blobs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    R.index_tree(blobs, path)
    return path


@pytest.fixture(scope="module")
def view(spark):
    return spark.createDataFrame([("7", "t1"), ("other", "t1")], "repository string, basis string")


def test_coverage(blobs):
    got = {r.repository: r.asDict() for r in R.coverage(blobs).collect()}
    assert got["7"] == {"repository": "7", "blobs": 15, "indexed": 13, "anchored": 13, "binary": 1, "too_large": 1, "unanchored_language": 0}
    assert got["other"]["unanchored_language"] == 1


def test_pages_join_to_the_whole(index, blobs, view):
    whole = R.search(index, blobs, view, "user", bounds=R.Bounds(rows=1000, batch_bytes=1 << 30)).found
    pages, cursor = [], None
    while True:
        page = R.search(index, blobs, view, "user", bounds=R.Bounds(rows=4, cursor=cursor))
        pages += page.found
        if page.cursor is None:
            assert page.truncated is None
            break
        assert page.truncated == "rows"
        cursor = R.Cursor.decode(page.cursor.encode())
    assert pages == whole and len(whole) > 8 and [tuple(r[k] for k in R.ORDER) for r in whole] == sorted(tuple(r[k] for k in R.ORDER) for r in whole)


def test_identifiers_and_accents(index, blobs, view):
    assert len(R.search(index, blobs, view, "getusername0", True).found) == 0  # a question's words are taken as they part: letters, digit
    assert {r["repository"] for r in R.search(index, blobs, view, "getUserName", True).found} == {"7"}
    assert {r["repository"] for r in R.search(index, blobs, view, "CAFE", True).found} == {"7"}


def test_states_reasons_and_replacing(spark, index, blobs, view, tmp_path):
    behind = spark.createDataFrame([("7", "t2"), ("nowhere", "t1"), ("other", "t1")], "repository string, basis string")
    page = R.search(index, blobs, behind, "user name", True)
    assert {s["repository"]: s["state"] for s in page.sources} == {"7": "lagging", "nowhere": "unavailable", "other": "complete"}
    assert page.declares_its_gaps() and {r["origin"] for r in page.found if r["repository"] == "7"} == {"canonical"}
    assert [s["reason"] is None for s in page.sources] == [True, False, True]
    path = str(tmp_path / "i")
    R.index_tree(blobs, path)
    R.index_tree(blobs.filter("repository = '7' and path = 'src/f1.py'"), path)
    assert {r["path"] for r in R.search(path, blobs, view, "user").found} == {"src/f1.py", "notes.md"}
    manifest = {r.repository: r.index_digest for r in R.read(spark, path, "manifest").collect()}
    before = {r.repository: r.index_digest for r in R.read(spark, index, "manifest").collect()}
    assert manifest["other"] == before["other"] and manifest["7"] != before["7"]


def test_a_page_without_room_declares_its_gaps(spark, index, blobs):
    """Rows read from texts come after all ranked ones: a page that is full before them says so."""
    behind = spark.createDataFrame([("7", "t1"), ("other", "t2")], "repository string, basis string")
    page = R.search(index, blobs, behind, "user", bounds=R.Bounds(rows=3))
    assert page.declares_its_gaps() and {r["repository"] for r in page.found} == {"7"}
    assert [s["reason"] for s in page.sources] == [None, "lagging: its rows stand behind this page"]
    last = R.search(index, blobs, behind, "user", bounds=R.Bounds(rows=100, batch_bytes=1 << 30))
    assert [s["reason"] for s in last.sources] == [None, None] and last.declares_its_gaps()


def test_budget_of_direct_reading(blobs):
    rows, stopped = R.canonical_rows(blobs, ["user"], True, budget=500)
    assert {r.repository: r.stopped for r in stopped.collect()} == {"7": True, "other": False}
    assert 0 < rows.filter("repository = '7'").count() < 12


def test_direct_reading_is_as_told_blob_by_blob(spark):
    """Parts that are cut by themselves change nothing: the blobs read, and whether the budget ended it, as a plain walk in order of path tells."""
    rows = [(r, "t1", f"f{i:03}.txt", f"b{i}", "100644", b"user name\n" * (i * 7 % 23)) for r in ("a", "b", "c") for i in range({"a": 200, "b": 9, "c": 1}[r])]
    made = spark.createDataFrame(rows, FIELDS)
    for budget in (0, 1, 500, 1090, 3000, 10**6):
        found, stopped = R.canonical_rows(made, ["user"], True, budget=budget)
        want, ended = set(), {}
        for repository in "abc":
            used, ended[repository] = 0, False
            for r, _, path, _, _, content in sorted(rows):
                if r == repository:
                    if used >= budget:
                        ended[r] = True
                    elif content:
                        want.add((r, path))
                    used += len(content)
        assert {(r.repository, r.path) for r in found.collect()} == want and {r.repository: r.stopped for r in stopped.collect()} == ended
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert all("content" not in line for line in plan.splitlines() if line.strip(" :+-|").startswith("Window"))


def test_terms_are_counted_in_their_text(spark):
    got = one(spark, R.term_counts(T.tokens(F.lit("b a getA b B c"))), R.term_counts(F.array().cast("array<string>")))
    assert [tuple(x) for x in got[0]] == [("a", 2), ("b", 3), ("c", 1), ("get", 1), ("geta", 1)] and got[1] == []


def test_index_is_dealt_by_size(spark, blobs, tmp_path, monkeypatch):
    """No task indexes more than its share of the texts, and each segment of the postings is in order of term."""
    monkeypatch.setattr(R, "TASK_TEXT", 200)
    path = str(tmp_path / "i")
    R.index_tree(blobs.filter("repository = '7' and path like 'src/%'"), path)
    rows = R.read(spark, path, "postings").select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("k"), "term", "start_byte", "tf").orderBy("file", "k").collect()
    files = {r.file for r in rows}
    assert len(files) > 4
    for f in files:
        terms = [r.term for r in rows if r.file == f]
        assert terms == sorted(terms)


def test_cursor_refuses_what_is_none():
    assert R.Cursor.decode("1.5\x1fa\x1fb\x1f7") == R.Cursor(1.5, "a", "b", 7)
    for text in ("", "1.5\x1fa\x1fb", "1.5\x1fa\x1fb\x1f7\x1fc", "x\x1fa\x1fb\x1f7", "1.5\x1fa\x1fb\x1fx"):
        assert R.Cursor.decode(text) is None


def test_bounds():
    rows = [{"score": 0.0, "repository": "r", "path": "p", "start_byte": i * 100, "end_byte": i * 100 + 90, "origin": "index"} for i in range(5)]
    page = R.bounded(rows, [], R.Bounds(rows=5, span_bytes=50, batch_bytes=120))
    assert [r["end_byte"] - r["start_byte"] for r in page.found] == [50, 50] and page.truncated == "bytes" and page.found[0]["clipped"]
    assert len(R.bounded(rows, [], R.Bounds(batch_bytes=1)).found) == 1
    assert R.bounded(rows, [], R.Bounds()).cursor is None


def test_published_spans():
    spans = [dict(path=p, blob=b, from_byte=s, to_byte=s + 10) for p, b, s in (("p", "b", 0), ("p", "b", 5), ("p", "b", 20), ("p", "c", 0), ("q", "d", 0))]
    assert [(s["path"], s["blob"], s["from_byte"]) for s in R.published(spans)] == [("p", "b", 0), ("p", "b", 20), ("q", "d", 0)]
    assert len(R.published(spans, taken=[spans[0]])) == 3 and len(R.published(spans, most=1)) == 1


def test_united_lists(spark):
    fields = "question int, rank int, path string, blob string, start_byte long"
    first = spark.createDataFrame([(1, 1, "p", "b", 0), (1, 2, "q", "d", 0)], fields)
    second = spark.createDataFrame([(1, 1, "p", "b", 0), (1, 2, "p", "b", 9), (1, 3, "p", "b", 20)], fields)
    assert sorted((r["of"], r.path, r.start_byte) for r in R.united(first, second).collect()) == [(1, "p", 0), (1, "q", 0), (2, "p", 9)]


def test_text_rules(spark):
    s = F.lit
    assert one(spark, T.tokens(s("getUserName HTTPServer2 naïve_x")))[0] == ["getusername", "get", "user", "name", "httpserver2", "http", "server", "2", "naive", "x"]
    assert one(spark, T.query_terms(s("getUserName get")))[0] == ["get", "user", "name", "get"]
    assert list(one(spark, *[T.file_kind(s(p)) for p in ("a/b.rs", ".git", "a/Makefile", "a.b/c", "x.tar.gz")])) == [".rs", "no extension", "no extension", "no extension", ".gz"]
    assert list(one(spark, *[T.language_for_path(s(p)) for p in ("a.py", "b.tsx", "c.md", "d")])) == ["python", "typescript", None, None]
    assert list(one(spark, *[T.within(s("aé漢b"), n) for n in range(8)])) == ["", "a", "a", "aé", "aé", "aé", "aé漢", "aé漢b"]
    assert one(spark, T.clipped(s("abcdefghij"), 8))[0] == "abc[cut]" and one(spark, T.clipped(s("abc"), 8))[0] == "abc"
    assert one(spark, T.one_line(s("a\nb\tc\x01\\")))[0] == "a\\nb\\tc\\u0001\\\\"
    assert one(spark, T.carried_bytes(s('a"\\\n\x01é')))[0] == 1 + 2 + 2 + 2 + 6 + 2
    cases = [("a/b", "../c", "a/c"), ("a", "../../c", None), ("", "./x//y/.", "x/y"), ("a", "/etc", None), ("a/b", "../..", "")]
    assert [one(spark, T.join_in_tree(s(a), s(b)))[0] for a, b, _ in cases] == [c for *_, c in cases]
    terms = F.array(*[s(t) for t in ("a b", "", "x" * 49, "get_user", "path/*.rs", "Ünï", "k:v", "more", "last")])
    assert one(spark, T.permitted_terms(terms))[0] == ["get_user", "path/*.rs", "Ünï", "k:v"]
    assert one(spark, T.proposed_query(terms))[0] == ["get", "user", "path", "rs", "uni", "k", "v"]
    got = one(spark, T.symbols(s("fix getUser in a.loader_x now, The End."), F.array(s("src/Main.rs is"))))[0]
    assert got == ["Main", "Main.rs", "a.loader_x", "getUser", "loader_x", "src"]
    assert one(spark, T.hits(F.array(s("ab"), s("x"), s("ab")), s("xABy")))[0] == 3
    assert [one(spark, T.lines_of(s("a\nb\nc"), s(v)))[0] for v in ("2-3", "1-1", "3-2", "0-1", "x", "2-9")] == ["b\nc", "a\n", "a\nb\nc", "a\nb\nc", "a\nb\nc", "b\nc"]
    long = "é" * 3000 + " needle " + "é" * 3000
    cut = one(spark, T.excerpt(s(long), s(0).cast("long"), s(len(long.encode())).cast("long"), F.array(s("needle"))))[0]
    assert "needle" in cut and 2040 <= len(cut.encode()) <= 2050 and one(spark, T.excerpt(s("abc"), s(1).cast("long"), s(3).cast("long"), F.array(s("c"))))[0] == "bc"
