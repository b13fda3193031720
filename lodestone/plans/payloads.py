"""Queries over payloads, projections, scores and records, by the functions of validation, projecting, scoring and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import sets as X
from lodestone.operators import search, validation
from lodestone.plans import projecting as P
from lodestone.plans import scoring as S
from lodestone.sources.tables import Catalogue, spread, table

C = Catalogue()


@C.spark("""select doc_id, case when lang = 'fr' then '/payload/digest' when source = 'src3' then '/payload/size' when source = 'src4' then '/payload/scope' when n_chars > 9000 then '/payload/capture/captured_at'
  when lang = 'es' and n_chars > 3000 then '/payload/coverage/completeness' when source = 'src5' then '/payload/locator' end as fault from documents""")
def descriptor_faults(spark, sf_dir):
    """Upload descriptors of all documents, some with a fault that their columns call for: the first path at fault."""
    d = table(spark, sf_dir, "documents")
    digest = F.sha2("text", 256)
    body = F.to_json(F.struct(
        F.concat(F.lit("sha256:"), F.when(F.col("lang") == "fr", F.upper(F.concat(F.lit("a"), F.substring(digest, 2, 63)))).otherwise(digest)).alias("digest"),
        F.when(F.col("source") == "src3", -1).otherwise(F.col("n_chars")).alias("size"), F.lit("text/plain").alias("media_type"), F.struct(F.lit("p1").alias("producer_id")).alias("producer"),
        F.struct(F.when(F.col("lang") == "es", "terminal_output").otherwise(F.lit("file")).alias("kind"), F.col("source").alias("id")).alias("source"),
        F.when(F.col("source") == "src4", F.lit("")).otherwise(F.col("source")).alias("scope"), F.struct(F.when(F.col("n_chars") > 9000, "2024-01-01").otherwise(F.lit("2024-01-01T00:00:00Z")).alias("captured_at")).alias("capture"),
        F.struct(F.when(F.col("n_chars") > 3000, "complete").otherwise(F.lit("partial")).alias("completeness")).alias("coverage"), F.lit("short").alias("retention_class"),
        F.when(F.col("source") == "src5", "https://h/p?a=1&token=2").otherwise(F.lit("https://h/p?a=1")).alias("locator"),
    ))
    return d.select("doc_id", validation.descriptor_fault(body, F.lit("p")).alias("fault"))


@C.spark("""select event_id, (event_type in ('view', 'click')) as well_formed from events""")
def instant_grammar(spark, sf_dir):
    """Instants as text in five spellings, of which two are the grammar's."""
    kind = F.col("event_type")
    made = (
        F.when(kind.isin("view", "click"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == "error", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(kind == "signup", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .otherwise(F.date_format("ts", "yyyy-M-d'T'HH:mm:ss'Z'"))
    )
    return table(spark, sf_dir, "events").select("event_id", validation.is_instant(made).alias("well_formed"))


@C.spark("select p_partkey, cast(floor(greatest(0, least(p_size * 200 - 2048, 8000 - 2048, cast(floor(p_retailprice * 5) as bigint))) / 4) * 3 as bigint) as bytes from part")
def chunk_limits(spark, sf_dir):
    string = F.floor(F.col("p_retailprice") * 5)
    return table(spark, sf_dir, "part").select("p_partkey", validation.chunk_limit(F.col("p_size") * 200, F.lit(8000), string).cast("long").alias("bytes"))


@C.spark("""select l_orderkey, bool_and(s_nationkey < 12) as readable, len(list_distinct(list(l_suppkey))) as roots, count(distinct l_returnflag) = 1 as one_flag from lineitem join supplier on l_suppkey = s_suppkey group by l_orderkey""")
def derivation_readable(spark, sf_dir):
    """Whether all that an order's lines read is among what a reader may read: sets held as arrays, of one order each."""
    may = table(spark, sf_dir, "supplier").groupBy("s_suppkey").agg(F.bool_and(F.col("s_nationkey") < 12).alias("may"))  # suppliers of some nations
    line = table(spark, sf_dir, "lineitem").join(may, F.col("l_suppkey") == F.col("s_suppkey"))
    root = F.col("l_suppkey").cast("string")
    read = line.groupBy("l_orderkey").agg(F.collect_set(root).alias("read"), F.collect_set(F.when(F.col("may"), root)).alias("may"), F.collect_set(F.array("l_returnflag")).alias("flags"))
    return read.select("l_orderkey", X.subset(F.col("read"), F.col("may")).alias("readable"), F.size("read").cast("long").alias("roots"), (F.size(X.common(F.col("flags"))) > 0).alias("one_flag"))


# projections: a user's events as a test run, pages as text, an event's props as records


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test runs: for each user and day the lines that its events stand for."""
    kind, name = F.col("event_type"), F.col("event_id").cast("string")
    line = (
        F.when(kind == "error", F.concat(F.lit("test t"), name, F.lit(" ... FAILED"))).when(kind == "signup", F.concat(F.lit("running "), name, F.lit(" tests"))).when(kind == "view", "")
        .when(kind == "click", F.concat(F.lit("test t"), name, F.lit(" ... ok"))).otherwise(F.concat(F.lit("error: "), name))
    )
    rows = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", line.alias("line"))
    held = rows.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("x"))
    return held.select(F.concat_ws("/", F.col("user_id").cast("string"), "day").alias("artifact"), F.concat(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit("\n")).cast("binary").alias("content"))


@C.spark(r"""with e as (select user_id || '/' || strftime(ts, '%Y-%m-%d') as artifact, event_id, event_type in ('error', 'signup', 'click') as telling, event_type as k from events)
select artifact, case when bool_or(telling) then 'libtest' else 'lines' end as format, count(*) filter (k = 'error') as failed, count(*) filter (k = 'purchase') as diagnostics from e group by artifact""")
def projection_formats(spark, sf_dir):
    """The format of each run, and its failed tests and diagnostics counted apart (none where it is no test run)."""
    made = runs(spark, sf_dir)
    named = P.named_failures(made)
    out = P.sniffed(made).join(named, "artifact", "left").select("artifact", "format", F.coalesce("tests", F.lit(0)).alias("failed"), F.coalesce("errors", F.lit(0)).alias("diagnostics"))
    other = F.regexp_count(F.col("text"), F.lit(r"(?m)^error: "))
    lines = made.select("artifact", F.col("content").cast("string").alias("text")).select("artifact", other.cast("long").alias("n"))
    return out.join(lines, "artifact").select("artifact", "format", "failed", F.when(F.col("format") == "lines", F.col("n")).otherwise(F.col("diagnostics")).alias("diagnostics"))


@C.spark("""with l as (select user_id || '/' || strftime(ts, '%Y-%m-%d') as artifact, case event_type when 'error' then 'test t' || event_id || ' ... FAILED' when 'signup' then 'running ' || event_id || ' tests' when 'view' then ''
  when 'click' then 'test t' || event_id || ' ... ok' else 'error: ' || event_id end as line from events) select artifact, 0::bigint as start, sum(strlen(line) + 1)::bigint as end from l group by artifact""")
def projection_tiles(spark, sf_dir):
    """The extents of every projection put together: from its first byte to its last, without a gap."""
    rows = P.ledger(runs(spark, sf_dir))
    whole = rows.groupBy("artifact").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.col("end") - F.col("start")).alias("n"))
    return whole.filter("n = end - start").select("artifact", "start", "end")


@C.spark()
def projection_pages(spark, sf_dir):
    """Pages as projections: header, carried excerpts, and what is left out with its reason."""
    return P.shown(table(spark, sf_dir, "pages").select(F.col("page_id").alias("artifact"), F.col("html").cast("binary").alias("content")))


# scores


@C.spark("""with m as (select l_orderkey as run, l_returnflag as criterion, avg(l_quantity / 12.5) as mark from lineitem group by all), w as (select * from (values ('A', 1), ('N', 3), ('R', 2)) t(criterion, weight)), r as (select distinct run from m),
s as (select r.run, round(sum(coalesce(mark, 0) * weight) / sum(weight), 6) as mean from r cross join w left join m on m.run = r.run and m.criterion = w.criterion group by r.run)
select run, mean, case when mean >= 3.5 then 'strong' when mean >= 2.5 then 'adequate' when mean >= 1.5 then 'weak' else 'failing' end as band from s""")
def rubric_scores(spark, sf_dir):
    marks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_returnflag").alias("criterion"), (F.col("l_quantity") / 12.5).alias("mark"))
    out = S.rubric(marks, spark.createDataFrame([("A", 1), ("N", 3), ("R", 2)], "criterion string, weight int"))
    return out.select("run", F.round("mean", 6).alias("mean"), S.band(F.round("mean", 6)).alias("band"))


@C.spark("""with p as (select l_partkey as run, l_linestatus as arm, l_orderkey as pair, avg(l_quantity) as score, count(*) as judges, max(l_quantity) - min(l_quantity) as spread from lineitem group by all)
select run, arm, round(avg(score), 6) as score, sum(judges)::bigint as judges, bool_or(spread > 10) as attention from p group by run, arm""")
def judges_unblinded(spark, sf_dir):
    """Lines as judgements: a pair is an order, its sides are parts and states, a judge a line."""
    line = table(spark, sf_dir, "lineitem")
    side = F.concat_ws("/", F.col("l_partkey").cast("string"), "l_linestatus")
    scores = line.select(F.col("l_orderkey").alias("pair"), side.alias("side"), F.col("l_linenumber").alias("judge"), F.col("l_quantity").alias("score"))
    sides = line.select(F.col("l_orderkey").alias("pair"), side.alias("side"), F.col("l_linestatus").alias("arm"), F.col("l_partkey").alias("run")).distinct()
    return S.unblinded(scores, sides, 10.0).withColumn("score", F.round("score", 6))


@C.spark(f"""with recursive {search.chunk_duck(True)}, s as (select doc_id, start_byte, strlen(to_json(text))::bigint - 2 as n from chunks)
select doc_id as path, max(n) as most, arg_min(start_byte, (-n, start_byte)) as at, count(*) filter (n > 1000) as over_0, count(*) filter (n > 2048) as over_1, count(*) filter (n > 4096) as over_2 from s group by doc_id""")
def carried_bytes_survey(spark, sf_dir):
    return S.survey(search.cut(spark, sf_dir, 2048).withColumnRenamed("doc_id", "path"), (1000, 2048, 4096))


@C.spark("""with e as (select event_id, user_id, props->>'k' as k, lag(props->>'k') over (partition by user_id order by event_id) as before from events)
select event_id as pair, 1 as place, '$.k' as path, before as a, k as b from e where before is not null and before <> k""")
def structural_differences(spark, sf_dir):
    """Each event's props against those of the user's event before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    pairs = table(spark, sf_dir, "events").select(F.col("event_id").alias("pair"), F.lag("props").over(w).alias("a"), F.col("props").alias("b")).filter("a is not null")
    return S.differences(spread(pairs))


@C.spark("""with r as (select user_id || props as q, event_id, event_type from events where event_type in ('view', 'click')), k as (select q, arg_min(event_type, event_id) as answer, count(distinct event_type) > 1 as differ from r group by q)
select event_id as question, case when differ then null else answer end as answer, case when answer is null then 'not_recorded' when differ then 'model_answer_ambiguous' end as reason from events left join k on user_id || props = q""")
def replay_lookup(spark, sf_dir):
    """Every event as a question, views and clicks as recorded answers."""
    e = table(spark, sf_dir, "events")
    digest = F.sha2(F.concat(F.col("user_id").cast("string"), "props"), 256).alias("digest")
    records = e.filter("event_type in ('view', 'click')").select(digest, F.col("event_id").alias("at"), F.col("event_type").alias("answer"))
    return S.replayed(e.select(F.col("event_id").alias("question"), digest), records)


@C.spark("""with n as (select max(ts) as now from events), o as (select event_id, user_id, ts from events where event_type = 'signup'),
f as (select o.event_id, arg_min(e.event_type, e.event_id) as what from o join events e on e.user_id = o.user_id and e.event_id > o.event_id and e.event_type in ('purchase', 'error') group by o.event_id)
select o.event_id as effect, case when what = 'purchase' then 'satisfied' when what = 'error' then 'aborted' when o.ts + interval 1 day <= now then 'overdue' else 'pending' end as state from o left join f using (event_id), n""")
def effects_overdue(spark, sf_dir):
    """Obligations of signups: the user's next purchase satisfies, an error before it aborts; without either overdue after a day."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    # the next decisive event stands on each row: no join of a user's signups with all that follows
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    what = F.when(F.col("event_type") == "purchase", "satisfied").when(F.col("event_type") == "error", "aborted")
    next_ = F.first(F.when(what.isNotNull(), F.struct(F.col("event_id").alias("at"), what.alias("what"))), ignorenulls=True).over(w)
    rows = e.withColumn("next", next_).filter("event_type = 'signup'")
    effects = rows.select(F.col("event_id").alias("effect"), F.date_format(F.col("ts") + F.expr("interval 1 day"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("deadline"))
    seen = rows.filter("next is not null").select(F.col("event_id").alias("effect"), "next.at", "next.what")
    now = e.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    return S.obligations(effects, seen, now)


@C.spark("""with a as (select l_orderkey, l_linenumber, min(l_quantity) as q from lineitem where l_returnflag <> 'A' group by all), b as (select l_orderkey, l_linenumber, max(l_quantity) as q from lineitem where l_returnflag <> 'R' group by all)
select coalesce(a.l_orderkey, b.l_orderkey) as tree, count(*) filter (a.q is null) as added, count(*) filter (b.q is null) as deleted, count(*) filter (a.q <> b.q) as changed, count(*) filter (a.q = b.q) as same from a full join b using (l_orderkey, l_linenumber) group by 1""")
def dirty_tallies(spark, sf_dir):
    """Two listings of each order's lines: how many paths were added, deleted, changed or are the same."""
    line = table(spark, sf_dir, "lineitem")
    a = line.filter("l_returnflag <> 'A'").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("a"))
    b = line.filter("l_returnflag <> 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("b"))
    both = a.join(b, ["l_orderkey", "l_linenumber"], "full")
    tests = {"added": F.col("a").isNull(), "deleted": F.col("b").isNull(), "changed": F.col("a") != F.col("b"), "same": F.col("a") == F.col("b")}
    return both.groupBy(F.col("l_orderkey").alias("tree")).agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
