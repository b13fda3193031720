"""Spans without overlap, packets as bytes, tiling ledgers, bounded ids, canonical JSON, redaction, recomputation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodestone.constants import SPANS
from lodestone.functions.encoding import canonical_json, redact
from lodestone.plans.packet import line_class, loglines, sections
from lodestone.sources.tables import Catalogue, run_sql, spread, table

C = Catalogue()
ID_LENGTH, ID_MARK, ID_DIGITS, ID_DOMAIN = 128, "~~", 32, "lodestone-id/1"

SPAN_ROWS = """spans as (select l_orderkey as blob, l_linenumber as rank, l_partkey % 100 as s, l_partkey % 100 + cast(l_quantity as bigint) as e from lineitem)"""
SPANS_SPARK = f"""with {SPAN_ROWS}, g as (select blob, array_sort(collect_list(struct(rank, s, e))) as a from spans group by blob),
f as (select blob, aggregate(a, cast(array() as array<struct<rank: int, s: bigint, e: bigint>>),
  (k, x) -> case when exists(k, y -> x.s < y.e and y.s < x.e) then k else concat(k, array(named_struct('rank', cast(x.rank as int), 's', x.s, 'e', x.e))) end) as kept from g)
select blob, cast(t.x.rank as bigint) as rank, t.x.s as start_at, t.x.e as end_at from f lateral view explode(kept) t as x"""
SPANS_DUCK = f"""with recursive {SPAN_ROWS}, o as (select *, row_number() over (partition by blob order by rank, s, e) as k from spans),
w as (select blob, k, true as taken, rank, s, e, [{{'s': s, 'e': e}}] as kept from o where k = 1
  union all select o.blob, o.k, len(list_filter(w.kept, lambda y: o.s < y.e and y.s < o.e)) = 0, o.rank, o.s, o.e,
    case when len(list_filter(w.kept, lambda y: o.s < y.e and y.s < o.e)) = 0 then list_append(w.kept, {{'s': o.s, 'e': o.e}}) else w.kept end from w join o on w.blob = o.blob and o.k = w.k + 1)
select blob, cast(rank as bigint) as rank, s as start_at, e as end_at from w where taken"""


@C.spark(SPANS_DUCK)
def spans_overlap_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In rank order a span is taken unless it overlaps one already taken: a fold over the few spans of a blob."""
    return run_sql(spark, sf_dir, SPANS_SPARK)


@C.sql
def packet_bytes_digest(d):
    """A packet of its first sections as canonical JSON (names in order, no spaces), its length and digest."""
    item = """concat('{"mandatory":', case when mandatory then 'true' else 'false' end, ',"section":', cast(section as string), ',"size":', cast(size as string), '}')"""
    packet = d.pick(
        "array_join(transform(array_sort(collect_list(struct(place, item))), x -> x.item), ',')", "string_agg(item, ',' order by place)"
    )
    return f"""with {sections(d)}, o as (select request, {item} as item, row_number() over (partition by request order by rank, size, section) as place from sections),
p as (select request, concat('{{"request":"', request, '","sections":[', {packet}, ']}}') as body from o where place <= {SPANS} group by request)
select request, {d.octets('body')} as bytes, concat('sha256:', {d.sha256('body')}) as digest from p"""


@C.sql
def projection_ledger(d):
    """A run's log as units that tile its bytes; failures are carried, what is left out says why."""
    whole = "rows between unbounded preceding and current row"
    return f"""with {loglines(d)}, c as (select run, line, text, {line_class(d)} as kind, {d.octets('text')} + 1 as size from log),
m as (select *, case when lag(kind) over w = kind then 0 else 1 end as starts, sum(size) over (partition by run order by line {whole}) as upto from c window w as (partition by run order by line)),
g as (select *, sum(starts) over (partition by run order by line {whole}) as unit from m),
u as (select run, unit, max(kind) as kind, min(upto - size) as start_byte, max(upto) as end_byte, count(*) as n from g group by run, unit)
select run, cast(unit as bigint) as unit, kind, cast(start_byte as bigint) as start_byte, cast(end_byte as bigint) as end_byte, n, case when kind in ('failed', 'error', 'block') then 'carried' else 'not_selected' end as disposition,
  start_byte = coalesce(lag(end_byte) over (partition by run order by unit), 0) as tiles from u"""


@C.sql
def id_encode_bounded(d):
    """Ids in a narrow grammar, 128 characters at most: a long one keeps a digest and the longest tail that fits,
    from a `:` on if the tail has one, never from inside an escape."""
    char = f"""case when {d.matches('c', '^[A-Za-z0-9._-]$')} then c when c = '/' then ':'
      else {d.replace(d.pick("hex(encode(c, 'UTF-8'))", 'hex(encode(c))'), '(..)', '~' + chr(92) + '1')} end"""
    letters = d.pick("split(raw, '')", "string_split(raw, '')")
    room = f"({ID_LENGTH - len(ID_MARK) - ID_DIGITS} - length(prefix))"
    domain = f"concat('{ID_DOMAIN}', chr(10), rest)"
    inside = "case when substring(rest, length(rest) - room, 1) = '~' then 2 when substring(rest, length(rest) - room - 1, 1) = '~' then 1 else 0 end"
    return f"""with r as (select page_id, 'span-pages:' as prefix, concat(url, case when length(html) % 2 = 0 then concat('#', html) else '' end) as raw from pages),
e as (select page_id, prefix, {d.join(d.transform(letters, 'c', char), '')} as rest from r),
t as (select *, {room} as room, right(rest, {room}) as tail from e),
b as (select *, case when length(prefix) + length(rest) <= {ID_LENGTH} then '' when colon > 0 then substring(tail, colon) else substring(tail, 1 + {inside}) end as ending
  from (select *, instr(tail, ':') as colon from t) z)
select page_id, case when length(prefix) + length(rest) <= {ID_LENGTH} then concat(prefix, rest) else concat(prefix, '{ID_MARK}', substring({d.sha256(domain)}, 1, {ID_DIGITS}), ending) end as id from b"""


@C.sql
def memo_recompute_agrees(d):
    """One input changes: nodes whose dependencies kept their values keep theirs, the others are recomputed, and all must equal a
    computation from scratch. A recomputed node that comes to its old value stops the change there."""
    return """with inputs as (select n_regionkey as id, n_regionkey * 10 as old, case when n_regionkey = 2 then 25 else n_regionkey * 10 end as new from nation group by n_regionkey),
n1 as (select n_nationkey as id, i.old <> i.new as redo, (i.old + n_nationkey) % 5 as old, (i.new + n_nationkey) % 5 as scratch from nation join inputs i on n_regionkey = i.id),
n2 as (select *, case when redo then scratch else old end as now from n1),
s1 as (select s_suppkey as id, n2.now <> n2.old as redo, (n2.old * 3 + s_suppkey) % 4 as old, (n2.scratch * 3 + s_suppkey) % 4 as scratch, (n2.now * 3 + s_suppkey) % 4 as fresh from supplier join n2 on s_nationkey = n2.id),
s2 as (select *, case when redo then fresh else old end as now from s1),
c1 as (select c_custkey as id, n2.now <> n2.old as redo, (n2.old + c_custkey) % 9 as old, (n2.scratch + c_custkey) % 9 as scratch, (n2.now + c_custkey) % 9 as fresh from customer join n2 on c_nationkey = n2.id),
c2 as (select *, case when redo then fresh else old end as now from c1),
nodes as (select 'nation' as level, redo, old, now, scratch from n2 union all select 'supplier', redo, old, now, scratch from s2 union all select 'customer', redo, old, now, scratch from c2)
select level, count(*) as nodes, """ + f"{d.count_if('redo')} as recomputed, {d.count_if('redo and old = now')} as unchanged, bool_and(now = scratch) as agrees from nodes group by level"


#: Rows of long texts that a Python worker holds as objects at a time.
FEW = 64


def mapped(df: DataFrame, column: str, rule: Callable[[str], str | None]) -> DataFrame:
    """df with a string column replaced by rule of it, null staying null. A batch of rows may be a whole partition of long texts: no more than a task's share
    of the table comes in one, and it is worked on and given back a few rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for start in range(0, batch.num_rows, FEW):
                few = batch.slice(start, FEW)
                texts = pa.array([None if t is None else rule(t) for t in few.column(at).to_pylist()], few.schema.field(at).type)
                yield few.set_column(at, few.schema.field(at), texts)

    return df.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in df.schema]))


@C.spark()
def canonical_json_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as JSON, brought to canonical form; the length in bytes and digest of that."""
    page = F.to_json(F.struct("url", F.col("page_id").alias("page"), F.struct(F.col("html").alias("\U0001f600"), F.col("url").alias("דּ")).alias("body")))
    made = mapped(spread(table(spark, sf_dir, "pages")).select("page_id", page.alias("body")), "body", canonical_json)
    return made.select("page_id", F.octet_length("body").cast("long").alias("bytes"), F.concat(F.lit("sha256:"), F.sha2("body", 256)).alias("digest"))


@C.spark()
def redact_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges rendered from pages, JSON and plain, with their credentials taken out."""
    link = F.concat("url", F.lit("&X-Signature="), F.sha2("html", 256))
    plain = F.concat(F.lit("GET "), link, F.lit(" Authorization: Bearer "), F.md5("html"), F.lit("\n"), "html")
    record = F.when(F.col("page_id") % 2 == 0, plain).otherwise(F.to_json(F.struct(link.alias("link"), F.md5("url").alias("api_key"), "html")))
    made = spread(table(spark, sf_dir, "pages")).select("page_id", record.alias("record"), F.sha2("html", 256).alias("held"))
    made = mapped(made, "record", redact).withColumnRenamed("record", "redacted")
    return made.select("page_id", "redacted", F.contains("redacted", "held").alias("leaks"))
