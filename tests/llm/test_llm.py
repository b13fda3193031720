"""The ten operators and the pipeline: oracles, brute force, round trips, and the defined odd cases."""

import random
import sys
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import SF, duck, rows  # noqa: E402

P = pytest.importorskip("public_tokenizers")

from lodestone.llm import byte_bpe, exact_dedup, language_id, licenses, packing, quality_rules, registry, simhash, substring_dedup, suffix_dedup, token_store  # noqa: E402
from lodestone.llm.tokens import Encoder  # noqa: E402

PASSAGE = " ".join(f"word{i}" + ("." if i % 9 == 8 else "") for i in range(72))
ODD = [
    (1, None, "en", 5), (2, "", "en", 5), (3, " \n\t ", None, 5), (4, "Same  text\nhere.", "en", 5), (5, "Same text here.", "en", 5),
    (5, "Same text here.", "en", 5), (6, "x" * 50_000, "fr", 5), (7, "Head one. " + PASSAGE + " tail.", "en", 5), (8, "Other head. " + PASSAGE + " Another tail.", "en", 5),
    (9, "the " * 300, "en", 5), (10, "Und die 漢字 é́ ist nicht der Σ. İ.\r\n\0 ende", "de", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names the operators use themselves."""
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, n_chars long").withColumns(
        {c: F.lit("extra") for c in ("at", "row", "gone", "stays", "digest", "fp", "t", "w", "m", "part", "key", "_metadata")}
    )


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("doc_id < 0")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck(registry.ORACLE_SQL[name]))


def test_exact_dedup_odd(odd, none):
    got = sorted((r.doc_id, r.keep_id, r.group_size, r["at"] == r.keep_at) for r in exact_dedup.classes(odd).collect())
    assert [g[:3] for g in got if g[0] in (1, 2, 4, 5)] == [(1, 1, 2), (2, 1, 2), (4, 4, 3), (5, 4, 3), (5, 4, 3)]
    assert sum(g[3] for g in got) == len({" ".join((t or "").split(" ")) if t else "" for _, t, _, _ in ODD}) - 1
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and exact_dedup.keep_first(none).count() == 0


def test_exact_dedup_checks_full_bytes(odd):
    """With a key that is the same for all, classes still hold equal bytes only."""
    got = exact_dedup.classes(odd, digest=F.lit("same")).select("doc_id", "keep_id", "group_size").collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} >= {(1, 1, 2), (2, 1, 2), (5, 4, 3), (7, 7, 1)}


def test_exact_dedup_stream_continues(spark, tmp_path):
    schema = exact_dedup.arrivals(exact_dedup.located(spark.createDataFrame([(1, "a")], "doc_id long, text string"))).schema
    args = (spark, str(tmp_path / "in"), schema, str(tmp_path / "c"), str(tmp_path / "out"))
    for ids in ([5, 6], [3]):
        spark.createDataFrame([(i, "d", ("f", i)) for i in ids], schema).write.mode("append").parquet(str(tmp_path / "in"))
        exact_dedup.stream_first_seen(*args)
    r = spark.read.parquet(str(tmp_path / "out")).agg(F.min("first").alias("f"), F.max("n").alias("n")).first()
    assert (r.f.doc_id, r.n) == (3, 3)


def plain_fingerprint(text, words=4):
    """The majority of each bit over the XXH64 hashes of all shingles, bit by bit."""
    import re

    from xxhash import xxh64

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)] * bool(w)
    h = [xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fp):
    """fp: id -> fingerprint. The least id that links of at most RADIUS bits reach from each id."""
    ids = sorted(fp)
    f = np.array([fp[i] for i in ids], dtype=np.uint64)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= simhash.RADIUS)):
        a, b = find(ids[i]), find(ids[j])
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_brute_force(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.classes(docs).collect()}
    want = {r.doc_id: plain_fingerprint(r.text or "") for r in docs.collect()}
    assert {k: v[0] for k, v in got.items()} == want and {k: v[1] for k, v in got.items()} == plain_components(want)
    assert got[10_001][0] == 0 and simhash.classes(none).count() == 0


def test_simhash_blocks(spark):
    """Blocks so small that crowded counts are dealt over several: no link is lost."""
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(150)]
    fp = {i: b for i, b in enumerate(dict.fromkeys(base + [b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(1, 4))) for b in base * 3]))}
    rows_ = spark.createDataFrame([(i, x - (x >> 63 << 64)) for i, x in fp.items()], "node long, fp long")
    from lodestone.llm.common import components

    roots = {r.node: r.root for r in components(simhash.links(rows_, block=20)).collect()}
    assert {i: roots.get(i, i) for i in fp} == plain_components(fp)
    found = simhash.blocks_of({10: 5, 11: 5, 30: 100, 31: 3, 33: 4}, 20)
    assert found == [(10, 11, 1), (30, 30, 7), (31, 33, 1)]


def test_simhash_keep_one_odd(odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and simhash.keep_one(none).count() == 0
    want = plain_components({i: plain_fingerprint(t or "") for i, t, *_ in ODD})
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(want.values()))


def test_simhash_keeps_rows_without_an_id_of_their_own(spark):
    """A null doc_id or a shared one loses a row only where the row has a near copy that stays."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(200)) for x in "abcd")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (None, c), (None, d), (None, d + " end"), (3, c)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text[0]) for r in simhash.keep_one(docs).collect())
    assert got == [(0, "d"), (1, "a"), (2, "b"), (3, "c")]
    assert {(r.doc_id, r.component_id) for r in simhash.classes(docs).collect()} == {(1, 1), (2, 1), (2, 2), (None, 3), (None, None), (3, 3)}


def test_components_of_a_long_path(spark):
    from lodestone.llm.common import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(201)} | {(500, 500), (501, 500)}


def test_quality_odd(spark, odd, none):
    got = {r.doc_id: r for r in quality_rules.verdicts(odd).collect()}
    assert not got[1].kept and got[1].n_words == 0 and got[9].n_repeat_words == 300 and not got[9].kept
    assert quality_rules.keep_good(odd).columns == odd.columns and quality_rules.verdicts(none).count() == 0
    polish = (
        "Wiatr od morza przyszedł nad ranem i do południa nie ustał, a ludzie na rynku mówili, że to dobry znak i że w tym roku na polach nie zabraknie wody. "
        "Potem przyszli inni z miasta, a z nimi dzieci i psy, i nie było już na placu cicho. "
        "Kto chciał kupić chleb, ten stał w kolejce do wieczora, bo w piekarni nie było mąki, a w sklepie na rogu nie było nikogo."
    )
    rng = random.Random(4)
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(120))
    docs = spark.createDataFrame([(1, polish), (2, noise)], "doc_id long, text string")
    assert [(r.kept, r.failed_rules) for r in quality_rules.verdicts(docs).orderBy("doc_id").collect()] == [(True, ""), (False, "stop_word_ratio")]


def test_licenses(spark, odd, none):
    known = licenses.known_licenses(spark)
    wrapped = licenses._BSD2.replace("retain the above copyright", "retain the above\ncopyright")
    docs = [
        (1, "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + licenses._MIT.replace("sublicense", "sublicence").upper(), "MIT", None),
        (2, "Prose.\nReleased under the MIT Licence.", None, "MIT"),
        (2, "The same doc_id, but plain prose.", None, None),
        (3, None, None, None),
        (4, "The MIT License\n\nCopyright (c) Example Corporation.\nAll rights reserved.\n\n" + licenses._MIT, "MIT", None),
        (5, "Copyright Jane Doe 2020\n" + wrapped + "\n" + licenses._BSD_END, "BSD-2-Clause", None),
        (6, "(c) The Authors\n" + licenses._ISC, "ISC", None),
        (7, licenses._ZLIB + " And more.", None, None),
        (8, "/* " + licenses._GNU_NOTICE.format(it="program", name="Affero General Public License", n="3").replace("\n", "\n * ") + " */", "AGPL-3.0-or-later", None),
    ]
    got = licenses.scan(spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string"), known).collect()
    assert sorted((r.doc_id, r.licence or "", r.notices or "") for r in got) == sorted((a, c or "", d or "") for a, _, c, d in docs)
    assert licenses.scan(none, known).count() == 0 and licenses.scan(odd, known).count() == len(ODD)
    assert known.count() == known.select("digest").distinct().count() and known.select("licence").distinct().count() >= 30


@pytest.mark.skipif(not Path("/usr/share/common-licenses").is_dir(), reason="no published texts here")
def test_license_digests_are_of_the_published_texts(spark):
    names = {"Artistic-1.0-Perl": "Artistic", "BSD-3-Clause": "BSD"}
    digests = dict(licenses.KNOWN_DIGESTS)
    texts = [(k, Path("/usr/share/common-licenses", names.get(k, k.removesuffix(".0") if k in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-3.0") else k)).read_text()) for k in digests]
    found = spark.createDataFrame(texts, "k string, text string").select("k", F.sha2(licenses.canonical(F.col("text")), 256).alias("d")).collect()
    assert {r.k: r.d for r in found} == digests


def test_substring_dedup_removes_the_second_copy(odd, none):
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(odd).collect()}
    assert out[7].text == ODD[7][1] and "word30" not in out[8].text and "Other head." in out[8].text and "Another tail." in out[8].text
    assert out[8].n_chars == len(out[8].text) and out[1].text is None and substring_dedup.remove_repeats(none).count() == 0


def plain_removal(docs):
    """docs: (doc_id, text) in order. doc_id -> text without every sentence of a span of 16 words or more with an earlier copy."""
    import re

    first, cuts = {}, {}
    for doc, text in docs:
        cut = [p for p in re.findall(r"(?s)(.*?(?:[.!?][\x20\x09-\x0D]+|\n|\Z))", text or "") if p]
        s = [(i, " ".join(w)) for i, p in enumerate(cut) if (w := [x for x in re.split(r"[\x20\x09-\x0D]+", p) if x])]
        cuts[doc] = cut, s
    out = {}
    for doc, _ in docs:
        cut, s = cuts[doc]
        gone = set()
        for k in range(len(s)):
            n, body = 0, []
            for m in range(k, min(len(s), k + 48)):
                n += s[m][1].count(" ") + 1
                body.append(s[m][1])
                if n >= 16 and first.setdefault("\n".join(body), (doc, k)) != (doc, k):
                    gone |= {s[j][0] for j in range(k, m + 1)}
        out[doc] = "".join(p for i, p in enumerate(cut) if i not in gone)
    return out


def test_substring_dedup_removes_whole_spans(spark):
    long = " ".join(f"w{i}" for i in range(20)) + ". "
    docs = spark.createDataFrame(
        [(1, long + "Short tail here. Own end."), (2, "Own start. " + long + "Short tail here. Other end."), (3, "Alone. " + long + "Third end.")], "doc_id long, text string"
    )
    out = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect()}
    assert out[2] == "Own start. Other end." and out[3] == "Alone. Third end." and out[1].startswith("w0 ")


def test_substring_dedup_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = plain_removal(sorted((r.doc_id, r.text) for r in docs.filter("text is not null").collect()))
    got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).filter("text is not null").collect()}
    assert got == want


def test_substring_dedup_query_removes(spark, tmp_path, monkeypatch):
    """The query removes as well: whole spans go from the texts, and its rows are read off the table that holds what is left."""
    tables = {}
    plain = substring_dedup.written
    monkeypatch.setattr(substring_dedup, "written", lambda df, name, *a: tables.setdefault(name, plain(df, name, *a)))
    long = " ".join(f"w{i}" for i in range(10)) + ". " + " ".join(f"v{i}" for i in range(10)) + ". "
    docs = [(1, long + "Short tail here. Own end."), (2, "Own start. " + long + "Short tail here. Other end."), (3, None), (4, "Nothing. Repeated.")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in registry.QUERIES["op1_substring_dedup"](spark, str(tmp_path)).collect()]
    assert got == [(2, 1, 1, 1, 2, 1)]
    assert {r.doc_id: r.text for r in tables["left"].collect()} == {1: docs[0][1], 2: "Own start. Other end.", 3: None, 4: docs[3][1]}


def test_substring_dedup_rows_that_share_an_id(spark):
    """Of rows with one doc_id, or none, each loses its own repeats only; a row without doc_id is never the first copy before others."""
    long = " ".join(f"w{i}" for i in range(20)) + ". "
    docs = spark.createDataFrame([(None, "Zero. " + long + "x."), (1, "One. " + long), (2, "Two. " + long + "y."), (2, "Three. Other words. z."), (None, "Four. Free.")], "doc_id long, text string")
    assert sorted(r.text for r in substring_dedup.remove_repeats(docs).collect()) == sorted(["Zero. x.", "One. " + long, "Two. y.", "Three. Other words. z.", "Four. Free."])


def test_suffix_dedup_finds_repeats(spark, odd, none):
    got = [(r.doc_id, r.other_doc_id, r.n_words) for r in suffix_dedup.matches(odd).collect()]
    assert any({a, b} == {7, 8} and n >= 50 for a, b, n in got) and suffix_dedup.matches(none).count() == 0
    docs = {r.doc_id: (r.text or "").split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    places = defaultdict(set)
    for k, w in docs.items():
        for i in range(len(w) - 49):
            places[" ".join(w[i : i + 50])].add((k, i))
    want = {k for v in places.values() if len(v) > 1 for k, _ in v}
    found = set()
    for r in registry.QUERIES["op9_suffix_dedup"](spark, SF).collect():
        assert docs[r.doc_id][r.start : r.start + r.n_words] == docs[r.other_doc_id][r.other_start : r.other_start + r.n_words]
        found |= {r.doc_id, r.other_doc_id}
    assert found == want


def uncovered(docs, found, n=50):
    """Words in windows of n words with an earlier copy that no row of their own doc_id covers. docs: doc_id -> words, in order."""
    seen, want = set(), set()
    for k, w in docs.items():
        for i in range(len(w) - n + 1):
            h = hash(tuple(w[i : i + n]))
            if h in seen:
                want |= {(k, i + j) for j in range(n)}
            seen.add(h)
    return want - {(r.doc_id, r.start + j) for r in found for j in range(r.n_words)}


def suffix_matches(spark, docs):
    found = suffix_dedup.matches(spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")).collect()
    for r in found:
        assert docs[r.doc_id][r.start : r.start + r.n_words] == docs[r.other_doc_id][r.other_start : r.other_start + r.n_words]
        assert (r.other_doc_id, r.other_start) < (r.doc_id, r.start)
    return found


def test_suffix_dedup_text_sorts_between(spark):
    """Each pair of four texts shares 40 to 60 words around one common block, to the left of it and to the right by turns."""
    rng = random.Random(5)
    docs, n = {}, 0
    for g in range(60):
        left, mid, right = ([f"{x}{g}_{i}" for i in range(40)] for x in "lmr")
        for _ in range(4):
            a, b = rng.randint(0, 40), rng.randint(0, 40)
            docs[n] = [f"h{n}_{i}" for i in range(60)] + left[40 - a :] + mid + right[:b] + [f"t{n}_{i}" for i in range(60)]
            n += 1
    assert not uncovered(docs, suffix_matches(spark, docs))


def test_suffix_dedup_names_every_copy(spark):
    """Passages of 51 to 80 words in 50 texts each, among texts that share only 16 words of them: every copy but the first has its own rows."""
    rng, docs = random.Random(6), {}
    for size in (51, 55, 60, 70, 80):
        passage = [f"p{size}_{i}" for i in range(size)]
        for k in range(100):
            n = len(docs)
            at = rng.randint(0, size - 16)
            docs[n] = [f"h{n}_{i}" for i in range(rng.randint(0, 80))] + (passage if k % 2 else passage[at : at + 16]) + [f"t{n}_{i}" for i in range(rng.randint(0, 80))]
    docs = {k: docs[i] for k, i in enumerate(rng.sample(range(len(docs)), len(docs)))}
    assert not uncovered(docs, suffix_matches(spark, docs))


def test_suffix_dedup_rows_without_an_id_of_their_own(spark):
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    rows_ = [(1, a), (1, b), (None, a), (None, ["c", *b]), (2, ["d"])]
    found = suffix_dedup.matches(spark.createDataFrame([(k, " ".join(w)) for k, w in rows_], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.other_doc_id, r.other_start, r.n_words) for r in found) == [(None, 0, 1, 0, 60), (None, 1, 1, 0, 60)]


def test_suffix_dedup_covers_every_word(spark):
    large = SF.replace("sf0.001", "sf0.1")
    docs = {r.doc_id: (r.text or "").split() for r in spark.read.parquet(f"{large}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()}
    assert not uncovered(docs, registry.QUERIES["op9_suffix_dedup"](spark, large).collect())


def test_language_id_held_out(spark, odd, none):
    got = registry.QUERIES["op8_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95
    model = language_id.fit(odd)
    out = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert out[1].lang_pred == out[2].lang_pred == "und" and language_id.predict(none, model).count() == 0
    assert language_id.predict(odd, language_id.fit(none)).filter("lang_pred <> 'und'").count() == 0


def test_language_id_brute_force(spark):
    """Every prediction and score again in plain Python, from word and n-gram counts of all rows that are learned from (the sample holds them all here)."""
    import math
    from collections import Counter

    import regex

    find = regex.compile(language_id.WORD).findall
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = {d for d, *_ in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for d, text, lang in docs:
        if d not in held and text is not None and lang is not None:
            for w in find(text.lower()):
                words[w][lang] += 1
                padded = f"<{w}>"
                for k in language_id.LENGTHS:
                    for i in range(len(padded) - k + 1):
                        grams[padded[i : i + k]][lang] += 1
    langs = sorted({k for c in words.values() for k in c})

    def logs(table, size):
        table = {w: c for w, c in table.items() if c.total() >= language_id.MIN_COUNT}
        total, kinds = defaultdict(Counter), Counter(size(w) for w in table)
        for w, c in table.items():
            total[size(w)].update(c)
        out = {}
        for w, c in table.items():
            t = total[size(w)]
            unseen = language_id.SMOOTH / (sum(t.values()) / len(langs))
            out[w] = [math.log((c[k] / max(t[k], 1) + unseen) / (1 + unseen * kinds[size(w)])) for k in langs]
        return out

    known, parts = logs(words, lambda w: 0), logs(grams, len)

    def of(word):
        if word in known:
            return known[word]
        padded = f"<{word}>"
        for k in language_id.LENGTHS:
            found = [parts[g] for i in range(len(padded) - k + 1) if (g := padded[i : i + k]) in parts]
            if found:
                return [sum(x) / len(found) for x in zip(*found)]
        return [0.0] * len(langs)

    got = {r.doc_id: r for r in registry.QUERIES["op8_language_id"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, text, _ in docs:
        found = find((text or "").lower())
        sums = [sum(x) for x in zip(*map(of, found))] if found else []
        share = [math.exp(x - max(sums)) for x in sums]
        want = (langs[sums.index(max(sums))], max(share) / sum(share)) if found else ("und", 0.0)
        assert got[d].held_out == (d in held) and got[d].lang_pred == want[0] and abs(got[d].score - want[1]) < 1e-2


def test_language_id_keeps_a_rare_language(spark):
    """One text in 3,000 is in the rare language; none of the sample's bound goes to it by its share alone."""
    rows_ = [(i, "the cat and the dog sat on the mat with a bird", "en") for i in range(6_000)]
    rows_ += [(10_000 + i, "zwei kleine hunde liefen schnell durch den garten", "de") for i in range(2)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    model = language_id.fit(docs, fit_texts=20)
    out = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).filter("doc_id >= 10000 or doc_id < 10").collect()}
    assert model["langs"] == ["de", "en"] and out[10_000] == out[10_001] == "de" and out[0] == "en"


LETTERS = "ab aA\n\t  é漢́'s12.,!x\r\0İΣ<|endoftext|>"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memoised_encoding_equals_the_library(name):
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(P.path(name)), random.Random(1)
    plain.encode_special_tokens = True
    mine = Encoder(P.path(name))
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    texts += ["".join(rng.choice("ab.,é×ñİ \n") for _ in range(rng.randint(0, 60))) for _ in range(1500)]  # words before full stops and commas
    for text, ids in zip(texts, mine.encode(texts)):
        assert np.frombuffer(ids, mine.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_byte_bpe_equals_tiktoken(spark, odd, none):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine, rng = byte_bpe.Bpe(path, P.PATTERN), random.Random(2)
    for text in ["abcabcd" * 5000, *("".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 200))) for _ in range(500))]:
        ids = np.frombuffer(mine.encode(text), mine.dtype)
        assert ids.tolist() == theirs.encode_ordinary(text) and mine.decode(ids) == text.encode()
    both = byte_bpe.decode(byte_bpe.encode(odd, path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in both) == sorted((t or "").encode() for _, t, _, _ in ODD)
    assert byte_bpe.encode(none, path, P.PATTERN).count() == 0


def test_byte_bpe_ranks_in_any_order(tmp_path):
    """Matches that share a queue, with vocabularies whose merges make pairs of lesser rank."""
    import base64

    import tiktoken

    rng = random.Random(5)
    for seed in range(20):
        longer = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))).encode() for _ in range(60)})
        rng.shuffle(longer)
        ranks = {t: i for i, t in enumerate([bytes([b]) for b in range(256)] + longer)}
        (path := tmp_path / f"{seed}.tiktoken").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in ranks.items()))
        theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        mine = byte_bpe.Bpe(str(path), P.PATTERN)
        texts = [" ".join("".join(rng.choice("aabc") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 9))) for _ in range(60)]
        assert [np.frombuffer(x, mine.dtype).tolist() for x in mine.encode_all(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_byte_bpe_bounds_what_a_worker_holds(monkeypatch):
    """A batch of 20 MB is worked on by the slice, and words that never come back do not pile up."""
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(byte_bpe, "MEMO", 1000)
    mine, rng = byte_bpe.Bpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), random.Random(6)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(7)) for _ in range(100_000)]
    texts = [" ".join(words[i * 20 : i * 20 + 20] * 26) for i in range(5000)]
    batch = pa.record_batch([pa.array(range(5000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    total, rows = 0, 0
    tracemalloc.start()
    for part in byte_bpe._encode_batches(iter([batch, batch.slice(0, 0)]), mine):
        rows, total = rows + part.num_rows, total + sum(part.column(1).to_pylist())
        assert len(mine.memo) + len(mine.older) < 15_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 5000 and total > 0 and peak < 30e6
    assert [i for x in byte_bpe._slices(batch, 1) for i in x.column(0).to_pylist()] == list(range(5000))


@pytest.mark.parametrize("ids", [np.random.default_rng(0).zipf(1.3, 100_000).clip(0, 50_000), np.arange(100_000) % 7, np.zeros(70_000), np.arange(3), np.zeros(0)])
def test_re_pair_round_trip(ids):
    ids = ids.astype("u4")
    rules, lengths, seq = token_store.compress(ids, 50_257)
    shard = token_store.Shard(seq, rules, lengths, 50_257)
    assert (shard.ids() == ids).all() and len(shard.ids()) == len(ids)
    pairs = np.unique(seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:], return_counts=True)[1] if len(seq) > 1 else np.zeros(1)
    assert pairs.max() < token_store.LEAST_PAIRS
    for a, b in ((0, 10), (5, 6), (1000, 5000), (99_990, 100_000), (7, 7), (0, 1 << 20)):
        assert (shard.ids(a, b) == ids[a:b]).all()


def test_token_store_brute_force(spark):
    """The query's starts, lengths and checksums against the library, and single documents and ranges read by themselves."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in registry.QUERIES["op2_token_store"](spark, SF).collect()}
    path, start, want = token_store.scratch(spark, "store"), 0, {}
    token_store.write(docs, P.path("byte_bpe_50k.json"), path)
    for doc, text in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert got[doc].asDict() == {"doc_id": doc, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        start, want[doc] = start + len(ids), ids
    some = sorted(want)[3::40]
    for lo, hi in ((0, None), (2, 5), (1, 400)):
        part = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in token_store.read(spark, path, some, lo, hi).collect()}
        assert part == {d: want[d][lo:hi].tolist() for d in some}


def test_token_store(spark, odd, none, tmp_path):
    token_store.write(odd, P.path("byte_bpe_50k.json"), str(tmp_path / "t"))
    got = sorted(token_store.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, *_ in ODD) and got[0].n_tokens == 1
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    token_store.write(none, P.path("byte_bpe_50k.json"), str(tmp_path / "n"))
    assert token_store.read(spark, str(tmp_path / "n")).count() == 0


def test_packing(spark, odd, none):
    table = packing.written(packing.pieces(odd, packing.word_tokenizer()), "pieces")
    placed = packing.place(table.drop("ids")).collect()
    held = defaultdict(list)
    for r in placed:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(placed) == table.count() and packing.pack(none, packing.word_tokenizer()).count() == 0


def best_fit(lengths, capacity=2048):
    """The number of sequences that best-fit in descending order needs, piece by piece."""
    gaps = []
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        insort(gaps, gap - length)
    return len(gaps)


@pytest.mark.parametrize("seed", range(3))
def test_packing_rounds(spark, seed):
    """Every rank has one place, sequences are gapless and not overfull, and hardly more than one-by-one best-fit needs."""
    rng = random.Random(seed)
    counts = {rng.randint(1, (2048, 300, 2048)[seed]): rng.randint(1, 50) for _ in range(300)}
    if seed == 2:
        counts = {k: n for k, n in counts.items() if k > 600}
    seen, fill = defaultdict(list), defaultdict(list)
    for r in packing.slots(spark.createDataFrame(list(counts.items()), "length long, n long")).collect():
        seen[r["size"]] += range(r.lo, r.lo + r.n)
        for k in range(r.n):
            fill[r["first"] + k].append((r.offset, r["size"]))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert all(sum(n for _, n in v) == max(o + n for o, n in v) <= 2048 for v in fill.values())
    assert len(fill) <= 1.01 * best_fit([k for k, n in counts.items() for _ in range(n)]) + 1


def test_packing_brute_force(spark):
    """The query's pieces and checksums against the library, text by text, and the number of its sequences."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.word_tokenizer())
    plain.encode_special_tokens = True
    got = {(r.doc_id, r.piece): r for r in registry.QUERIES["op4_best_fit_packing"](spark, SF).collect()}
    lengths = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k, start in enumerate(range(0, len(ids), 2048)):
            own, x = ids[start : start + 2048], got.pop((r.doc_id, k))
            assert (x.start, x.length, x.ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
            lengths.append((x.sequence_id, x.offset, x.length))
    assert not got
    ends = {}
    for sequence, offset, length in sorted(lengths):
        assert ends.get(sequence, 0) == offset
        ends[sequence] = offset + length
    assert max(ends.values()) <= 2048 and len(ends) <= 1.01 * best_fit([n for *_, n in lengths])


def plain_quality(text):
    """Whether a text passes, from the rules' wording."""
    import re

    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    again = {i + j for v in places.values() if len(v) > 1 for i in v for j in range(3)}
    n = max(1, len(words))
    few_stops = sum(w.lower() in quality_rules.STOP_WORDS for w in words) / n < 0.02 and (len(words) - len(set(words))) / n < 0.10
    bad = len(words) < 50 or 100 * len(again) > 50 * len(words) or few_stops
    bad = bad or not 2 <= sum(map(len, words)) / n <= 14 or sum(c in "#*$%&|<>" for c in text) / n > 0.10
    return not (bad or (len(lines) - len(set(lines))) / max(1, len(lines)) > 0.5)


def test_pipeline_brute_force(spark, tmp_path, odd):
    """run() against all five stages in plain Python: which rows stay, what text is left, and gapless sequences."""
    import re

    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = odd.select(F.col("doc_id") + 10_000, "text", "lang", F.lit("odd"), "n_chars").toDF("doc_id", "text", "lang", "source", "n_chars")
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    rows_ = sorted(((r.doc_id, r.text) for r in docs.unionByName(more).collect()), key=lambda x: x[0])
    left, seen = {}, set()
    for doc, text in rows_:
        normal = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        if plain_quality(text) and normal not in seen:
            seen.add(normal)
            left[doc] = text
    roots = plain_components({k: plain_fingerprint(t) for k, t in left.items()})
    left = plain_removal([(k, t) for k, t in left.items() if roots[k] == k])
    plain = Tokenizer.from_file(packing.word_tokenizer())
    plain.encode_special_tokens = True
    want = {}
    for doc, text in left.items():
        ids = plain.encode(text, add_special_tokens=False).ids + [0]
        for k, start in enumerate(range(0, len(ids), 2048)):
            want[doc, k] = (start, zlib.crc32(np.array(ids[start : start + 2048], "<u4").tobytes()))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.ids_crc32) for r in out} == want and len(out) == len(want)
    ends = {}
    for sequence, offset, length in sorted((r.sequence_id, r.offset, r.length) for r in out):
        assert ends.get(sequence, 0) == offset
        ends[sequence] = offset + length
    assert max(ends.values()) <= 2048


def test_pipeline_stages_odd(spark, odd, none):
    """Every stage takes nulls, ties, clashing names and an empty table, and keeps the columns."""
    import corpus_pipeline

    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
