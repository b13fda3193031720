"""A written index of chunks and one search over it: state of each source, ranking, canonical fallback, bounds and cursor.

A blob table has repository, tree, path, blob, mode and content (bytes). An index is a folder with three tables, each
partitioned by repository: chunks, postings (in segments of a bounded size of text, each sorted by term, so that a
search reads the pages of its terms only) and manifest. Indexing a repository again replaces its partitions. Ranking
uses document frequency and average length over the whole index; filters come after.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.constants import BATCH_BYTES, BM25_B, BM25_K1, CHUNK_BYTES, CHUNK_LINES, INDEX_VERSION, PAGE_ROWS, PER_PATH, SPAN_BYTES, SPANS
from lodestone.functions import text as T

MAX_BLOB, CANONICAL_READ = 1 << 20, 8 << 20
REGULAR = ("100644", "100755")
ORDER = ("score", "repository", "path", "start_byte")
SEPARATOR = "\x1f"
#: Bytes of text that one task indexes: its postings take some 60 times as much memory while they are sorted.
TASK_TEXT = 4 << 20
#: Parts of a repository whose blobs are put in order apart before direct reading.
PARTS = 64
PLACE = ("start_byte", "end_byte", "start_line", "end_line")


TABLES = {
    "chunks": "tree string, path string, blob string, start_byte long, end_byte long, start_line long, end_line long, text string, chunk long, repository string",
    "postings": "tree string, path string, start_byte long, end_byte long, start_line long, end_line long, chunk long, len int, term string, tf long, repository string",
    "manifest": "blobs long, indexed long, anchored long, binary long, too_large long, unanchored_language long, frontier string, chunks long, total_len long, index_digest string, compiler string, repository string",
}


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of an index; the schema is given, so that a repository's name stays a string whatever it looks like."""
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")


# indexing


def classified(blobs: DataFrame) -> DataFrame:
    """blobs with `fate`: indexed, too_large, binary, or skipped (no regular file). Bytes are looked at only in what is small enough."""
    fate = (
        F.when(~F.col("mode").isin(*REGULAR), "skipped").when(F.octet_length("content") > MAX_BLOB, "too_large")
        .when(~F.is_valid_utf8(F.col("content").cast("string")), "binary").otherwise("indexed")
    )
    return blobs.withColumn("fate", fate)


def coverage(blobs: DataFrame) -> DataFrame:
    """Per repository: how many blobs there are, were indexed or not, and are of a language whose anchors are known."""
    language = T.language_for_path(F.col("path"))

    def count(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    done = F.col("fate") == "indexed"
    return classified(blobs).filter("fate <> 'skipped'").groupBy("repository").agg(
        F.count("*").alias("blobs"), count(done, "indexed"), count(done & language.isNotNull(), "anchored"), count(F.col("fate") == "binary", "binary"),
        count(F.col("fate") == "too_large", "too_large"), count(done & language.isNull(), "unanchored_language"),
    )


def chunk_rows(blobs: DataFrame, lines: int = CHUNK_LINES, size: int | None = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of each indexed blob: repository, tree, path, blob, start_byte, end_byte, start_line, end_line, text."""
    text = classified(blobs).filter("fate = 'indexed'").select("repository", "tree", "path", "blob", F.col("content").cast("string").alias("text"))
    return text.select("repository", "tree", "path", "blob", F.inline(T.chunks(F.col("text"), lines, size)))


def term_counts(tokens: Column) -> Column:
    """An array of (term, tf) of the distinct tokens, in order: runs of the sorted tokens, so in proportion to their number and without a shuffle."""

    def runs(t: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(t)), lambda i: (i == 0) | (i == F.size(t)) | (F.get(t, i) != F.get(t, i - 1)))
        return F.transform(F.array(at), lambda b: F.transform(F.slice(b, 1, F.size(b) - 1), lambda i, k: F.struct(F.get(t, i).alias("term"), (F.get(b, k + 1) - i).cast("long").alias("tf"))))[0]

    return F.transform(F.array(F.sort_array(tokens)), runs)[0]


def index_tree(blobs: DataFrame, path: str) -> None:
    """Writes or replaces the index of every repository in blobs, and its manifest row: frontier, compiler, digest, coverage.

    chunk ids are given when chunks are written, and postings are made from the written chunks. Both are dealt by repository and path over as many tasks
    as the texts' size calls for: a task's memory does not grow with the corpus and its files are of few repositories. Postings are not
    shuffled: they stand with their texts, many times smaller, until they are written.
    """
    spark = blobs.sparkSession
    size = blobs.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_TEXT))
    chunks = chunk_rows(blobs.repartitionByRange(tasks, "repository", "path")).withColumn("chunk", F.monotonically_increasing_id())

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").partitionBy("repository").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")

    def stored(name: str) -> DataFrame:
        return read(spark, path, name).join(here, "repository", "left_semi")

    write(chunks, "chunks")
    here = F.broadcast(blobs.select("repository").distinct())
    # a text's tokens are counted before they leave it: each distinct term of a chunk is one row
    # and carries its chunk's place, so that a search ranks without reading the chunks
    of = ("repository", "tree", "path", *PLACE, "chunk")
    texts = stored("chunks").select(*of, "text")
    held = texts.repartitionByRange(tasks, "repository", "path", "start_byte").select(*of, T.tokens(F.col("text")).alias("tokens"))
    counted = held.select(*of, F.size("tokens").alias("len"), F.inline(term_counts(F.col("tokens"))))
    write(counted.sortWithinPartitions("repository", "term", "chunk"), "postings")
    row = F.concat_ws(SEPARATOR, "path", "start_byte", "end_byte", "blob")
    # a digest of the digests of blobs: no single string holds a whole repository
    digests = stored("chunks").groupBy("repository", "path", "blob").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("d"))
    digests = digests.groupBy("repository", F.substring("d", 1, 2).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("d"))
    digests = digests.groupBy("repository").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("index_digest"))
    sums = stored("chunks").groupBy("repository").agg(F.count("*").alias("chunks"))
    sums = sums.join(stored("postings").groupBy("repository").agg(F.sum("tf").alias("total_len")), "repository", "left")
    manifest = coverage(blobs).join(blobs.groupBy("repository").agg(F.max("tree").alias("frontier")), "repository").join(sums, "repository", "left").join(digests, "repository", "left")
    write(manifest.withColumn("compiler", F.lit(INDEX_VERSION)), "manifest")


# searching


@dataclass(frozen=True)
class Cursor:
    """A place in the merged order of a search."""

    score: float
    repository: str
    path: str
    start_byte: int

    def encode(self) -> str:
        return SEPARATOR.join((repr(self.score), self.repository, self.path, str(self.start_byte)))

    @staticmethod
    def decode(text: str) -> Cursor | None:
        """None where the text is no cursor: too few or too many parts, or numbers that are none."""
        parts = text.split(SEPARATOR)
        if len(parts) != 4:
            return None
        try:
            return Cursor(float(parts[0]), parts[1], parts[2], int(parts[3]))
        except ValueError:
            return None


@dataclass(frozen=True)
class Bounds:
    """Rows of a page, bytes of one span, bytes of all spans; cursor: where the page before ended."""

    rows: int = PAGE_ROWS
    span_bytes: int = SPAN_BYTES
    batch_bytes: int = BATCH_BYTES
    cursor: Cursor | None = None


@dataclass
class Page:
    """found: at most `rows` rows in order. sources: repository, frontier, state, reason. truncated: `rows`, `bytes` or None."""

    found: list[dict]
    sources: list[dict]
    cursor: Cursor | None = None
    truncated: str | None = None
    fields: str = field(default="score double, repository string, path string, start_byte long, end_byte long, start_line long, end_line long, origin string, clipped boolean", repr=False)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r[f.split()[0]] for f in self.fields.split(", ")) for r in self.found], self.fields)

    def declares_its_gaps(self) -> bool:
        """Every source that is not complete gives a reason or a row read from its texts."""
        canonical = {r["repository"] for r in self.found if r["origin"] == "canonical"}
        return all(s["state"] == "complete" or s["reason"] or s["repository"] in canonical for s in self.sources)


def source_states(spark: SparkSession, path: str, view: DataFrame) -> DataFrame:
    """view: repository, basis (the tree asked about). Adds state: complete, lagging or unavailable."""
    manifest = read(spark, path, "manifest").select("repository", "frontier", "compiler")
    state = F.when(F.col("frontier").isNull(), "unavailable").when((F.col("frontier") != F.col("basis")) | (F.col("compiler") != INDEX_VERSION), "lagging").otherwise("complete")
    return view.join(manifest, "repository", "left").withColumn("state", state)


def scored(spark: SparkSession, path: str, terms: list[str], match_all: bool = False) -> DataFrame:
    """BM25 of every chunk that holds a term (or all of them): score (smaller is better), matched, repository, tree, path, chunk and its place.

    Only the postings of the terms are read; the number of chunks and their length stand in the manifest.
    """
    asked = {t: terms.count(t) for t in terms}
    n, total = read(spark, path, "manifest").agg(F.coalesce(F.sum("chunks"), F.lit(0)), F.sum("total_len")).first()
    found = read(spark, path, "postings").filter(F.col("term").isin(*asked))
    df = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}  # one row a term asked for
    weight = F.create_map(*[F.lit(x) for t, k in asked.items() for x in (t, k * _idf(n, df.get(t, 0)))])
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.lit(float(total or 0) / max(1, n)))
    part = F.element_at(weight, F.col("term")) * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + norm)
    out = found.groupBy("repository", "tree", "path", "chunk", *PLACE).agg(F.round(-F.sum(part), 6).alias("score"), F.count("*").alias("matched"))
    return out.filter(F.col("matched") == len(asked)) if match_all else out


def _idf(n: int, df: int) -> float:
    import math

    return max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)


def after(cursor: Cursor | None) -> Column:
    """Rows strictly after the cursor in the merged order."""
    if cursor is None:
        return F.lit(True)
    out = F.lit(False)
    for name in reversed(ORDER):
        value = F.lit(getattr(cursor, name))
        out = (F.col(name) > value) | ((F.col(name) == value) & out)
    return out




def canonical_rows(blobs: DataFrame, terms: list[str], match_all: bool, within: str | None = None, budget: int = CANONICAL_READ) -> tuple[DataFrame, DataFrame]:
    """Chunks of texts read directly, unranked, that hold all (or one) of the terms; and per repository whether the budget of
    bytes ended the reading: blobs are read in order of path while the bytes before them are fewer than the budget."""
    small = blobs.filter(F.col("mode").isin(*REGULAR) & (F.octet_length("content") <= MAX_BLOB))
    if within is not None:
        small = small.filter(F.col("path") == within)
    # sizes alone are ordered. A part of a repository that reaches the budget by itself is cut first: what is behind the cut has the budget before it in the
    # whole repository too, so that few rows of each part are left for the order over all
    blob = ["repository", "path", "tree", "blob"]
    sizes = small.groupBy(*blob).agg(F.sum(F.octet_length("content")).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("repository", "part").orderBy(*blob[1:]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within_parts = sizes.withColumn("part", F.pmod(F.hash(*blob), F.lit(PARTS))).withColumn("before", before).filter(F.col("before") < budget)
    whole = within_parts.withColumn("part", F.lit(0)).withColumn("before", before).filter(F.col("before") < budget)
    total = sizes.groupBy("repository").agg(F.sum("size").alias("n"), F.max_by("size", F.struct(*blob[1:])).alias("last"))
    stopped = total.select("repository", (F.col("n") - F.col("last") >= budget).alias("stopped"))
    spans = chunk_rows(small.join(whole.select(*blob), blob, "left_semi"), size=None)
    held = F.filter(F.array(*[F.lit(t) for t in dict.fromkeys(terms)]), lambda t: F.array_contains(F.col("tokens"), t))
    spans = spans.withColumn("tokens", T.tokens(F.col("text"))).withColumn("matched", F.size(held))
    wanted = len(set(terms)) if match_all else 1
    return spans.filter(F.col("matched") >= wanted).withColumn("score", F.lit(0.0)), stopped


def search(path: str, blobs: DataFrame, view: DataFrame, question: str, match_all: bool = False, within: str | None = None, bounds: Bounds = Bounds()) -> Page:
    """One page of a search over the repositories in view (repository, basis), in order of score, repository, path, start_byte.

    Complete sources are answered from the index, the others from blobs. What comes to the driver is one row more than the
    page holds and one row for each source in view.
    """
    spark = view.sparkSession
    terms = terms_of(spark, question)
    states = source_states(spark, path, view).orderBy("repository").collect()
    if not terms:  # matches nothing, which is no gap
        return Page([], [{"repository": s["repository"], "frontier": s["basis"], "state": "complete", "reason": None} for s in states])
    complete = [s["repository"] for s in states if s["state"] == "complete"]
    other = [s for s in states if s["state"] != "complete"]
    parts, stopped, answered = [], {}, set()
    columns = [*ORDER[:3], *PLACE]
    if complete:
        hits = scored(spark, path, terms, match_all).filter(F.col("repository").isin(*complete))
        if within is not None:
            hits = hits.filter(F.col("path") == within)
        if bounds.cursor is not None:
            hits = hits.filter(F.col("score") >= bounds.cursor.score)
        parts.append(hits.select(*columns, F.lit("index").alias("origin")))
    if other:
        names = [s["repository"] for s in other]
        rows, budget = canonical_rows(blobs.filter(F.col("repository").isin(*names)), terms, match_all, within)
        stopped = {r["repository"]: r["stopped"] for r in budget.collect()}
        parts.append(rows.select(*columns, F.lit("canonical").alias("origin")))
        answered = {r[0] for r in rows.filter(after(bounds.cursor)).select("repository").distinct().collect()}
    found: list[dict] = []
    if parts:
        merged = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        found = [r.asDict() for r in merged.filter(after(bounds.cursor)).orderBy(*ORDER).limit(bounds.rows + 1).collect()]
    page = bounded(found, [], bounds)
    shown = {r["repository"] for r in page.found if r["origin"] == "canonical"}
    page.sources = [{"repository": s["repository"], "frontier": s["basis"], "state": s["state"], "reason": _reason(s, stopped, answered, shown)} for s in states]
    return page


def _reason(source, stopped: dict, answered: set, shown: set) -> str | None:
    """answered: repositories with a row read from their texts after the cursor; shown: those with one on this page."""
    if source["state"] == "complete":
        return None
    if stopped.get(source["repository"]):
        return f"{source['state']}: reading stopped at {CANONICAL_READ} bytes"
    if source["repository"] in shown:
        return None
    return f"{source['state']}: {'its rows stand behind this page' if source['repository'] in answered else 'nothing found in its texts'}"


def bounded(candidates: list[dict], sources: list[dict], bounds: Bounds) -> Page:
    """Cuts a page out of ordered candidates: rows, then the clip of each span, then bytes of the batch, whose first row always stays."""
    page, used, why = [], 0, None
    for row in candidates:
        size = min(row["end_byte"] - row["start_byte"], bounds.span_bytes)
        if len(page) == bounds.rows:
            why = "rows"
        elif page and used + size > bounds.batch_bytes:
            why = "bytes"
        if why:
            break
        used += size
        page.append(row | {"clipped": row["end_byte"] - row["start_byte"] > size, "end_byte": row["start_byte"] + size})
    owed = Cursor(*(page[-1][k] for k in ORDER)) if page and len(candidates) > len(page) else None
    return Page(page, sources, owed, why if owed else None)


def terms_of(spark: SparkSession, question: str) -> list[str]:
    return spark.range(1).select(T.query_terms(F.lit(question))).first()[0]


# publishing


def widened(hits: DataFrame, chunks: DataFrame, terms: list[str], size: int = CHUNK_BYTES) -> DataFrame:
    """hits (repository, path, start_byte and more) with from_byte and to_byte: both neighbours are taken if they fit
    `size` bytes together, else of the two that fit alone the one in which more terms occur, the one after on a tie."""
    w = Window.partitionBy("repository", "path").orderBy("start_byte")
    # neighbours are looked for in the texts that were hit alone
    chunks = chunks.join(hits.select("repository", "path").distinct(), ["repository", "path"], "left_semi")
    near = chunks.select("repository", "path", "start_byte", "end_byte", *[f(c).over(w).alias(f"{n}_{c}") for n, f in (("b", F.lag), ("a", F.lead)) for c in ("start_byte", "end_byte", "text")])
    near = near.join(hits.select("repository", "path", "start_byte").distinct(), ["repository", "path", "start_byte"], "left_semi")
    wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    own = F.col("end_byte") - F.col("start_byte")
    before, behind = F.col("b_end_byte") - F.col("b_start_byte"), F.col("a_end_byte") - F.col("a_start_byte")
    both = F.coalesce(before, F.lit(0)) + F.coalesce(behind, F.lit(0)) + own <= size
    fits_b, fits_a = F.coalesce(own + before <= size, F.lit(False)), F.coalesce(own + behind <= size, F.lit(False))
    more_before = T.hits(wanted, F.col("b_text")) > T.hits(wanted, F.col("a_text"))
    take_b = both | (fits_b & (~fits_a | more_before))
    take_a = both | (fits_a & ~take_b)
    spans = near.select(
        "repository", "path", "start_byte", F.when(take_b, F.coalesce("b_start_byte", "start_byte")).otherwise(F.col("start_byte")).alias("from_byte"),
        F.when(take_a, F.coalesce("a_end_byte", "end_byte")).otherwise(F.col("end_byte")).alias("to_byte"),
    )
    return hits.join(spans, ["repository", "path", "start_byte"])


def published(spans: list[dict], taken: list[dict] = (), most: int = SPANS, per_path: int = PER_PATH) -> list[dict]:
    """Of ranked, widened spans those that are published: at most `most`, `per_path` of a path whatever its repository, and none
    that overlaps what is already taken from its blob; a span dropped for its overlap uses up nothing. A page's rows only."""
    out: list[dict] = []
    for s in spans:
        if len(out) == most:
            break
        if sum(o["path"] == s["path"] for o in out) >= per_path:
            continue
        if any(o["blob"] == s["blob"] and o["from_byte"] < s["to_byte"] and s["from_byte"] < o["to_byte"] for o in [*taken, *out]):
            continue
        out.append(s)
    return out


def united(first: DataFrame, second: DataFrame, per_path: int = PER_PATH) -> DataFrame:
    """Two ranked lists (question, rank, path, blob, start_byte) as one: the second after the first, a span once, and
    at most per_path spans of a path counted through both."""
    both = first.withColumn("of", F.lit(1)).unionByName(second.withColumn("of", F.lit(2)))
    once = Window.partitionBy("question", "blob", "start_byte").orderBy("of", "rank")
    capped = Window.partitionBy("question", "path").orderBy("of", "rank", "start_byte")
    both = both.withColumn("k", F.row_number().over(once)).filter("k = 1").withColumn("k", F.row_number().over(capped)).filter(F.col("k") <= per_path)
    return both.drop("k")
