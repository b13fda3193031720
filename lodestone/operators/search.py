"""Queries over chunks: tokens, chunking, ranked search over a written index, paging, publication, anchors and coverage."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.constants import BATCH_BYTES, BM25_B, BM25_K1, CHUNK_BYTES, CHUNK_LINES, INDEX_VERSION, PAGE_ROWS, PER_PATH, SPAN_BYTES, SPANS
from lodestone.functions import text as T
from lodestone.functions.dialect import DUCKDB as D
from lodestone.operators import retrieval as R
from lodestone.sources.scratch import kept
from lodestone.sources.tables import Catalogue, spread, table

C = Catalogue()


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of repositories: a source is a repository, a language a folder."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(
        F.col("source").alias("repository"), F.lit("t1").alias("tree"), path.alias("path"), F.col("doc_id").cast("string").alias("blob"),
        F.lit("100644").alias("mode"), F.col("text").cast("binary").alias("content"),
    )


#: Sources whose index is behind or absent, so that all three states occur: by the last character of their name.
BEHIND, ABSENT = "7", "9"


def index(spark: SparkSession, sf_dir: str) -> str:
    """The folder with the index over all documents, written at first use in a session."""
    return kept(spark, ("index", sf_dir), lambda path: R.index_tree(blobs(spark, sf_dir), path))


def view(spark: SparkSession, sf_dir: str, all_complete: bool = True) -> DataFrame:
    """Every repository with the tree asked about. Else those of some names ask for a tree that the index does not hold."""
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("repository")).distinct()
    basis = F.lit("t1") if all_complete else F.when(F.substring("repository", -1, 1) == BEHIND, "t2").otherwise(F.lit("t1"))
    return names.withColumn("basis", basis)


def asked(spark: SparkSession, sf_dir: str, words: int = 6, item: int = 0) -> str:
    """The first words of a benchmark question."""
    row = table(spark, sf_dir, "benchmark").filter(F.col("item_id") == item).select("text").first()
    return " ".join(row[0].split()[:words])


def find(spark: SparkSession, sf_dir: str, words: int = 6, item: int = 0, **how) -> R.Page:
    return R.search(index(spark, sf_dir), blobs(spark, sf_dir), view(spark, sf_dir), asked(spark, sf_dir, words, item), **how)


# the oracles' own chunks, tokens and ranking

CHUNK_LINES_DUCK = r"regexp_extract_all(text, '[^\n]*(?:\n|\z)')"


def chunk_duck(bounded: bool, docs: str = "documents") -> str:
    full = f"n >= {CHUNK_LINES}" + (f" or e - b >= {CHUNK_BYTES}" if bounded else "")
    return f"""lines as (select doc_id, row_number() over (partition by doc_id order by k) as k, line, strlen(line) as size from (
  select doc_id, unnest({CHUNK_LINES_DUCK}) as line, generate_subscripts({CHUNK_LINES_DUCK}, 1) as k from {docs}) z where line <> ''),
walk as (
  select doc_id, k, 0::bigint as b, size::bigint as e, 1::bigint as l, 1::bigint as n from lines where k = 1
  union all
  select w.doc_id, x.k, case when {full} then e else b end, e + x.size, case when {full} then l + n else l end, case when {full} then 1 else n + 1 end
  from walk w join lines x on w.doc_id = x.doc_id and x.k = w.k + 1),
chunks as (select w.doc_id, b as start_byte, max(e) as end_byte, l as start_line, l + max(n) - 1 as end_line, string_agg(x.line, '' order by x.k) as text
  from walk w join lines x on w.doc_id = x.doc_id and w.k = x.k group by w.doc_id, b, l)"""


def marked_duck(x: str) -> str:
    for pattern in (r"(\p{Ll})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
        x = D.replace(x, pattern, r"\1" + T.MARK + r"\2")
    return rf"regexp_extract_all(lower(strip_accents({x})), '[\p{{L}}\p{{N}}{T.MARK}]+')"


def tokens_duck(x: str) -> str:
    return f"flatten(list_transform({marked_duck(x)}, lambda w: case when contains(w, '{T.MARK}') then list_prepend(replace(w, '{T.MARK}', ''), string_split(w, '{T.MARK}')) else [w] end))"


def terms_duck(x: str) -> str:
    return f"flatten(list_transform({marked_duck(x)}, lambda w: string_split(w, '{T.MARK}')))"


def scored_duck(words: int = 6, item: int = 0, having: str = "", extra: str = "") -> str:
    question = f"array_to_string((string_split_regex(trim(text), '\\s+'))[1:{words}], ' ')"
    return f"""with recursive {chunk_duck(True)},
toks as (select *, {tokens_duck('text')} as tokens from chunks),
stats as (select count(*) as n, sum(len(tokens))::double / count(*) as avglen from toks),
q as (select term, count(*) as qtf from (select unnest({terms_duck('(' + question + ')')}) as term from benchmark where item_id = {item}) z group by term),
tf as (select doc_id, start_byte, end_byte, start_line, end_line, len(tokens) as len, q.term, qtf, len(list_filter(tokens, lambda x: x = q.term)) as tf from toks, q where list_contains(tokens, q.term)),
df as (select term, count(*) as n from tf group by term),
hits as (select doc_id, start_byte, end_byte, start_line, end_line, count(*) as matched, round(-sum(qtf * greatest(ln((s.n - df.n + 0.5) / (df.n + 0.5)), 1e-6)
  * tf * {BM25_K1 + 1} / (tf + {BM25_K1} * ({1 - BM25_B} + {BM25_B} * len / s.avglen))), 6) as score from tf join df using (term), stats s group by all {having}),
r as (select h.score, d.source as repository, d.lang || '/' || d.doc_id || '.txt' as path, start_byte, end_byte, start_line, end_line, h.doc_id from hits h join documents d using (doc_id)){extra}"""


ALL_DUCK = "having count(*) = (select count(*) from q)"
PAGE_DUCK = f"select score, repository, path, start_byte, least(end_byte, start_byte + {SPAN_BYTES}) as end_byte, start_line, end_line, 'index' as origin, end_byte - start_byte > {SPAN_BYTES} as clipped from r"
FIRST_DUCK = f"order by score, repository, path, start_byte limit {PAGE_ROWS}"


@C.spark(f"{scored_duck()} {PAGE_DUCK} {FIRST_DUCK}")
def search_topk_any(spark, sf_dir):
    return find(spark, sf_dir).rows(spark)


@C.spark(f"{scored_duck(3, having=ALL_DUCK)} {PAGE_DUCK} {FIRST_DUCK}")
def search_topk_all(spark, sf_dir):
    return find(spark, sf_dir, words=3, match_all=True).rows(spark)


@C.spark(f"{scored_duck()} {PAGE_DUCK} where path = 'en/1.txt' {FIRST_DUCK}")
def search_within_path(spark, sf_dir):
    return find(spark, sf_dir, within="en/1.txt").rows(spark)


@C.spark(f"{scored_duck(40, 1)} {PAGE_DUCK} {FIRST_DUCK}")
def search_duplicate_terms(spark, sf_dir):
    return find(spark, sf_dir, words=40, item=1).rows(spark)


@C.spark("select 0.0::double as score, '' as repository, '' as path, 0::bigint as start_byte, 0::bigint as end_byte, 0::bigint as start_line, 0::bigint as end_line, '' as origin, false as clipped where false")
def search_empty_question(spark, sf_dir):
    """A question without terms finds nothing, and declares no gap."""
    page = R.search(index(spark, sf_dir), blobs(spark, sf_dir), view(spark, sf_dir), " ?! ")
    assert page.declares_its_gaps()
    return page.rows(spark)


@C.spark(f"{scored_duck()} {PAGE_DUCK} order by score, repository, path, start_byte limit {PAGE_ROWS} offset {PAGE_ROWS}")
def search_keyset_page2(spark, sf_dir):
    """The second page, from the first one's cursor as a client would hand it back."""
    first = find(spark, sf_dir, bounds=R.Bounds(batch_bytes=1 << 30))
    return find(spark, sf_dir, bounds=R.Bounds(batch_bytes=1 << 30, cursor=R.Cursor.decode(first.cursor.encode()))).rows(spark)


@C.spark(f"""{scored_duck(extra=f''', page as (select *, least(end_byte - start_byte, 300) as span from r order by score, repository, path, start_byte limit 13),
total as (select *, row_number() over w as k, sum(span) over w as bytes from page window w as (order by score, repository, path, start_byte))''')}
select k::bigint as k, path, start_byte, span::bigint as span, case when (select count(*) from total where k = 1 or bytes <= 2000) >= 12 then 'rows' else 'bytes' end as truncated from total where k <= 12 and (k = 1 or bytes <= 2000)""")
def search_three_bounds(spark, sf_dir):
    """Rows, bytes of a span and bytes of all spans at once, and which of them ended the page."""
    page = find(spark, sf_dir, bounds=R.Bounds(rows=12, span_bytes=300, batch_bytes=2000))
    rows = [(k, r["path"], r["start_byte"], r["end_byte"] - r["start_byte"], page.truncated) for k, r in enumerate(page.found, 1)]
    return spark.createDataFrame(rows, "k long, path string, start_byte long, span long, truncated string")


@C.spark(f"{scored_duck()} select repository, path, start_byte, score, k::bigint as k from (select *, row_number() over (partition by path order by score, repository, start_byte) as k from r) z where k <= {PER_PATH}")
def search_per_path_cap(spark, sf_dir):
    """At most two spans of a path, in order of rank, over all hits."""
    path = index(spark, sf_dir)
    hits = R.scored(spark, path, R.terms_of(spark, asked(spark, sf_dir)))
    w = Window.partitionBy("path").orderBy("score", "repository", "start_byte")
    return hits.withColumn("k", F.row_number().over(w).cast("long")).filter(F.col("k") <= PER_PATH).select("repository", "path", "start_byte", "score", "k")


_STATES_DUCK = f"""select repository, case when ends_with(repository, '{ABSENT}') then 'unavailable' when ends_with(repository, '{BEHIND}') then 'lagging' else 'complete' end as state
from (select distinct source as repository from documents) z"""


def partial_index(spark: SparkSession, sf_dir: str) -> str:
    """An index that lacks some repositories."""
    return kept(spark, ("partial", sf_dir), lambda path: R.index_tree(blobs(spark, sf_dir).filter(F.substring("repository", -1, 1) != ABSENT), path))


@C.spark(_STATES_DUCK)
def manifest_states(spark, sf_dir):
    return R.source_states(spark, partial_index(spark, sf_dir), view(spark, sf_dir, False)).select("repository", "state")


@C.spark(f"""with recursive docs as (select *, source as repository, lang || '/' || doc_id || '.txt' as path from documents where ends_with(source, '{ABSENT}') or ends_with(source, '{BEHIND}')),
small as (select *, coalesce(sum(strlen(text)) over (partition by repository order by path rows between unbounded preceding and 1 preceding), 0) as before from docs where strlen(text) <= 1048576),
read as (select * from small where before < 8388608), {chunk_duck(False, 'read')}
select d.repository, d.path, start_byte, end_byte from chunks c join docs d using (doc_id)
where len(list_intersect({tokens_duck('c.text')}, list_distinct({terms_duck("'that on'")}))) > 0""")
def canonical_fallback(spark, sf_dir):
    """Every chunk that a direct reading finds in the sources that are not complete: unranked, within the budget of bytes."""
    states = R.source_states(spark, partial_index(spark, sf_dir), view(spark, sf_dir, False)).filter("state <> 'complete'").select("repository")
    rows, _ = R.canonical_rows(blobs(spark, sf_dir).join(states, "repository", "left_semi"), ["that", "on"], False)
    return rows.select("repository", "path", "start_byte", "end_byte")


@C.spark()
def search_merged_sources(spark, sf_dir):
    """One page over complete, lagging and absent sources; the tests compare it with the parts it is made of."""
    page = R.search(partial_index(spark, sf_dir), blobs(spark, sf_dir), view(spark, sf_dir, False), asked(spark, sf_dir))
    return page.rows(spark)


@C.spark(f"{_STATES_DUCK} where false")
def gap_declared_invariant(spark, sf_dir):
    """Sources that neither are complete nor give a reason nor a row: none, whatever the question."""
    path, gone = partial_index(spark, sf_dir), []
    for question in ("that", "zqxv", ""):
        page = R.search(path, blobs(spark, sf_dir), view(spark, sf_dir, False), question, bounds=R.Bounds(rows=10_000, batch_bytes=1 << 40))
        canonical = {r["repository"] for r in page.found if r["origin"] == "canonical"}
        gone += [(s["repository"], s["state"]) for s in page.sources if s["state"] != "complete" and not s["reason"] and s["repository"] not in canonical]
    return spark.createDataFrame(gone, "repository string, state string")


# tokens, chunks, files


@C.spark(f"with recursive {chunk_duck(True)} select term, count(*) as df, sum(tf)::bigint as cf from (select doc_id, start_byte, term, count(*) as tf from (select doc_id, start_byte, unnest({tokens_duck('text')}) as term from chunks) a group by all) b group by term")
def term_document_frequency(spark, sf_dir):
    postings = R.read(spark, index(spark, sf_dir), "postings")
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@C.spark(f"select doc_id, len({tokens_duck('text')})::bigint as n_tokens, len({terms_duck('text')})::bigint as n_parts, sha256(array_to_string({tokens_duck('text')}, ' ')) as digest from documents")
def tokens_normalised(spark, sf_dir):
    both = spread(table(spark, sf_dir, "documents")).select("doc_id", T.tokens(F.col("text")).alias("t"), T.query_terms(F.col("text")).alias("p"))
    return both.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size("p").cast("long").alias("n_parts"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


def cut(spark: SparkSession, sf_dir: str, size: int | None) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.inline(T.chunks(F.col("text"), CHUNK_LINES, size)))


COLUMNS = ("doc_id", "start_byte", "end_byte", "start_line", "end_line")
_SPANS = f"select {', '.join(COLUMNS)}, sha256(text) as digest from chunks"


@C.spark(f"with recursive {chunk_duck(False)} {_SPANS}")
def chunk_lines(spark, sf_dir):
    return cut(spark, sf_dir, None).select(*COLUMNS, F.sha2("text", 256).alias("digest"))


@C.spark(f"with recursive {chunk_duck(True)} {_SPANS}")
def chunk_bytes_bounded(spark, sf_dir):
    return cut(spark, sf_dir, CHUNK_BYTES).select(*COLUMNS, F.sha2("text", 256).alias("digest"))


@C.spark(f"""with recursive {chunk_duck(True)} select doc_id, start_byte, lag(start_byte) over w as before_start, lead(end_byte) over w as after_end,
  coalesce(lag(end_byte) over w, 0) = start_byte as tiles from chunks window w as (partition by doc_id order by start_byte)""")
def chunk_neighbours(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("start_byte")
    return cut(spark, sf_dir, CHUNK_BYTES).select(
        "doc_id", "start_byte", F.lag("start_byte").over(w).alias("before_start"), F.lead("end_byte").over(w).alias("after_end"),
        (F.coalesce(F.lag("end_byte").over(w), F.lit(0)) == F.col("start_byte")).alias("tiles"),
    )


@C.spark(f"""with recursive {chunk_duck(False)}, n as (select *, end_byte - start_byte as own, lag(end_byte - start_byte) over w as bs, lead(end_byte - start_byte) over w as asz,
  lag(start_byte) over w as b0, lead(end_byte) over w as a1, lag(text) over w as bt, lead(text) over w as txt from chunks window w as (partition by doc_id order by start_byte)),
m as (select *, len(list_filter(['the', 'on', 'que'], lambda t: contains(lower(bt), t))) as bh, len(list_filter(['the', 'on', 'que'], lambda t: contains(lower(txt), t))) as ah,
  own + coalesce(bs, 0) + coalesce(asz, 0) <= {CHUNK_BYTES} as both_fit, coalesce(own + bs <= {CHUNK_BYTES}, false) as bf, coalesce(own + asz <= {CHUNK_BYTES}, false) as af from n),
s as (select *, case when both_fit then 'both' when bf and af then case when bh > ah then 'b' else 'a' end when bf then 'b' when af then 'a' else '' end as side from m)
select doc_id, start_byte, case when side in ('both', 'b') then coalesce(b0, start_byte) else start_byte end as from_byte, case when side in ('both', 'a') then coalesce(a1, end_byte) else end_byte end as to_byte from s""")
def widen_span(spark, sf_dir):
    chunks = cut(spark, sf_dir, None).select(F.lit("").alias("repository"), F.col("doc_id").cast("string").alias("path"), "doc_id", "start_byte", "end_byte", "text")
    return R.widened(chunks.select("repository", "path", "doc_id", "start_byte"), chunks.drop("doc_id"), ["the", "on", "que"]).select("doc_id", "start_byte", "from_byte", "to_byte")


@C.spark()
def spans_published(spark, sf_dir):
    """The spans that a question's packet gets: ranked, widened, capped, without overlap; checked by the tests' brute force."""
    path = index(spark, sf_dir)
    page = find(spark, sf_dir, bounds=R.Bounds(rows=SPANS * 4, batch_bytes=1 << 30))
    chunks = R.read(spark, path, "chunks")
    hits = page.rows(spark).join(chunks.select("repository", "path", "blob").distinct(), ["repository", "path"])
    wide = R.widened(hits, chunks, R.terms_of(spark, asked(spark, sf_dir))).orderBy(*R.ORDER).collect()  # a page
    kept_ = R.published([r.asDict() for r in wide])
    return spark.createDataFrame([(k, r["repository"], r["path"], r["from_byte"], r["to_byte"]) for k, r in enumerate(kept_, 1)], "k long, repository string, path string, from_byte long, to_byte long")


@C.spark(f"""with q as (select item_id, list_distinct({terms_duck('text')}[1:3]) as terms from benchmark),
d as (select doc_id, list_distinct({tokens_duck('text')}) as tokens from documents),
m as (select item_id, doc_id, len(list_intersect(terms, tokens)) as n, len(terms) as wanted from q, d)
select item_id, coalesce(min(doc_id) filter (n = wanted), min(doc_id) filter (n > 0), min(doc_id)) as doc_id,
  case when count(*) filter (n = wanted) > 0 then 'all' when count(*) filter (n > 0) > 0 then 'any' else 'first' end as rung from m group by item_id""")
def source_ladder(spark, sf_dir):
    """For each question: the first text with all of its first three terms, else with any, else the first text. Only terms
    that are asked for leave a text."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.slice(T.query_terms(F.col("text")), 1, 3)).alias("terms"))
    docs = spread(table(spark, sf_dir, "documents"))
    found = docs.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    asked_ = q.select("item_id", F.size("terms").alias("wanted"), F.explode("terms").alias("term"))
    hits = found.join(asked_, "term").groupBy("item_id", "wanted", "doc_id").agg(F.count("*").alias("n"))
    best = hits.groupBy("item_id").agg(F.min(F.when(F.col("n") == F.col("wanted"), F.col("doc_id"))).alias("whole"), F.min("doc_id").alias("part"))
    first = docs.agg(F.min("doc_id")).first()[0]
    rung = F.when(F.col("whole").isNotNull(), "all").when(F.col("part").isNotNull(), "any").otherwise("first")
    return q.select("item_id").join(best, "item_id", "left").select("item_id", F.coalesce("whole", "part", F.lit(first)).alias("doc_id"), rung.alias("rung"))


@C.spark(r"select doc_id, strlen(x)::bigint as n_bytes, sha256(x) as digest, starts_with(text, x) as is_start from (select doc_id, text, substring(text, 1, list_max(list_filter(range(0, least(length(text), 600) + 1), lambda k: strlen(substring(text, 1, k)) <= 600))) as x from documents)")
def clipped_within(spark, sf_dir):
    """The longest start of a text within 600 bytes that ends at a character."""
    x = table(spark, sf_dir, "documents").select("doc_id", "text", T.within(F.col("text"), 600).alias("x"))
    return x.select("doc_id", F.octet_length("x").cast("long").alias("n_bytes"), F.sha2("x", 256).alias("digest"), F.startswith("text", F.col("x")).alias("is_start"))


@C.spark("select page_id, strlen(to_json(html))::bigint - 2 as carried from pages")
def carried_bytes(spark, sf_dir):
    """Bytes of a text as a JSON string, without its quotes."""
    return table(spark, sf_dir, "pages").select("page_id", T.carried_bytes(F.col("html")).alias("carried"))


def anchors(d) -> str:
    return f"""with a as (select doc_id, lang, {d.extract_all('text', r'[A-Z][a-z]{5,}')} as w from documents),
seen as (select lang, doc_id, t.name, count(*) as uses from a, {d.each('w', 't', 'name')} group by lang, doc_id, t.name)"""


@C.sql
def anchor_resolve_ambiguous(d):
    return f"""{anchors(d)} select lang, name, count(*) as candidates, count(*) > 1 as ambiguous, min(doc_id) as first_doc from seen group by lang, name"""


@C.sql
def anchor_references_top16(d):
    return f"""{anchors(d)} select * from (select lang, name, doc_id, uses, cast(row_number() over (partition by lang, name order by doc_id) as bigint) as k from seen) z where k <= 16"""


@C.spark("""select source as repository, count(*) as blobs, count(*) filter (strlen(text) <= 1048576) as indexed, 0::bigint as anchored, 0::bigint as binary, count(*) filter (strlen(text) > 1048576) as too_large,
count(*) filter (strlen(text) <= 1048576) as unanchored_language from documents group by source""")
def coverage_counts(spark, sf_dir):
    return R.coverage(blobs(spark, sf_dir))


@C.sql
def coverage_by_kind(d):
    return f"""with k as (select case when {d.extract("path", r"[^/](\.[^./]+)$")} = '' then 'no extension' else {d.extract("path", r"[^/](\.[^./]+)$")} end as kind from (
  select {d.replace("url", r"[?#].*$", "")} as path from pages) z) select kind, count(*) as n from k group by kind"""
