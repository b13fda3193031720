"""Logs and their failures; scoring; encoding; a few checks of the substrate."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.sources.eventlog import numbered
from lodestone.sources.tables import Catalogue, table

C = Catalogue()
SECTIONS = """sections as (select source as request, doc_id as section, lang as item, octet_bytes as size, case when doc_id % 11 = 0 then 0 when doc_id % 5 = 0 then 1 else 2 end as rank, doc_id % 11 = 0 as mandatory
  from (select *, {octets} as octet_bytes from documents) z)"""


def sections(d) -> str:
    return SECTIONS.format(octets=d.octets("text"))


def loglines(d) -> str:
    return """log as (select event_id as line, user_id as run, case event_type when 'error' then concat('test t', cast(event_id as string), ' ... FAILED') when 'signup' then concat('running ', cast(event_id as string), ' tests')
  when 'view' then '' when 'click' then concat('test t', cast(event_id as string), ' ... ok') else concat('---- t', cast(event_id as string), ' stdout ----') end as text from events)"""


def line_class(d) -> str:
    return f"""case when text = '' then 'blank' when {d.matches('text', '^running [0-9]+ tests?$')} then 'identity' when {d.matches('text', r'^test .* \.\.\. FAILED$')} then 'failed'
  when {d.matches('text', '^---- .* stdout ----$')} then 'block' when {d.matches('text', r'^error(\[|:)')} then 'error' else 'other' end"""


@C.sql
def log_line_classify(d):
    return f"with {loglines(d)} select line, {line_class(d)} as kind from log"


@C.sql
def log_failure_blocks(d):
    """Runs of lines of one class become one unit: gaps and islands within a run."""
    return f"""with {loglines(d)}, c as (select run, line, {line_class(d)} as kind from log),
m as (select *, case when lag(kind) over w = kind then 0 else 1 end as starts from c window w as (partition by run order by line)),
g as (select *, sum(starts) over (partition by run order by line rows between unbounded preceding and current row) as island from m)
select run, min(line) as first_line, max(line) as last_line, max(kind) as kind, count(*) as n from g group by run, island"""


@C.sql
def projection_islands(d):
    return f"""with c as (select event_id, user_id, value > 50 as carried from events), m as (select *, case when lag(carried) over (partition by user_id order by event_id) = carried then 0 else 1 end as s from c),
g as (select *, sum(s) over (partition by user_id order by event_id rows between unbounded preceding and current row) as island from m)
select user_id, min(event_id) as start_id, max(event_id) as end_id, count(*) as n from g where carried group by user_id, island"""


@C.sql
def json_failed_records(d):
    return f"select event_id, {d.json('props', 'k')} as name from events where event_type = 'error' and cast({d.json('props', 'k')} as bigint) % 2 = 1"


@C.sql
def redact_regex_core(d):
    x = "concat(url, ' Authorization: Bearer ', html, ' token=s3cr3t')"
    for pattern, by in ((r"Bearer [^\s]+", "Bearer [redacted]"), (r"(token|password|secret)=[^&\s]+", r"\1=[redacted]"), (r"([?&](key|sig))=[^&]*", r"\1=[redacted]")):
        x = d.replace(x, pattern, by)
    return f"select page_id, {x} as redacted from pages"


@C.sql
def digest_content(d):
    return f"select doc_id, concat('sha256:', {d.sha256('text')}) as digest, {d.matches(d.sha256('text'), '^[0-9a-f]{64}$')} as well_formed from documents"


@C.spark("""with t as (select event_id, case event_type when 'view' then to_base64(encode(props)) when 'click' then replace(to_base64(encode(props)), '=', '') when 'error' then props when 'signup' then regexp_replace(to_base64(encode('a' || event_id)), '.=$', 'B=') else lower(to_base64(encode(props))) end as given from events)
select event_id, given, regexp_full_match(given, '([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?') and (not ends_with(given, '=') or case when ends_with(given, '==') then regexp_matches(given, '[AQgw]==$') else regexp_matches(given, '[AEIMQUYcgkosw048]=$') end) as strict from t""")
def base64_strict(spark, sf_dir):
    """Texts given as base64, of which some are none: strict are those that decode and come out the same when encoded again."""
    made = F.base64(F.col("props").cast("binary"))
    other = F.regexp_replace(F.base64(F.concat(F.lit("a"), F.col("event_id").cast("string")).cast("binary")), ".=$", "B=")
    given = F.when(F.col("event_type") == "view", made).when(F.col("event_type") == "click", F.replace(made, F.lit("="), F.lit(""))).when(F.col("event_type") == "error", F.col("props")).when(F.col("event_type") == "signup", other).otherwise(F.lower(made))
    rows = table(spark, sf_dir, "events").select("event_id", given.alias("given"))
    shaped = F.col("given").rlike(r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return rows.select("event_id", "given", F.when(shaped, F.base64(F.unbase64("given")) == F.col("given")).otherwise(False).alias("strict"))


#: What the name of a query parameter that carries a credential contains.
SIGNALS = ("signature", "token", "credential", "secret", "password", "passwd", "sig", "key", "auth", "session")


def carries_credentials(locator):
    """Whether a locator holds user information before its first `/`, `?` or `#`, or a query parameter of a telling name."""
    authority = F.split(F.regexp_replace(locator, r"^.*?://", ""), r"[/?#]")[0]
    query = F.split(F.regexp_extract(locator, r"\?(.*)$", 1), "#")[0]
    names = F.transform(F.split(query, "&"), lambda pair: F.lower(F.split(pair, "=")[0]))
    return F.contains(authority, F.lit("@")) | F.exists(names, lambda n: n.rlike("|".join(SIGNALS)))


@C.spark(rf"""with u as (select page_id, case page_id % 4 when 1 then replace(url, '://', '://me:pw@') when 2 then url || '?X-Amz-Signature=1' when 3 then url || '?page=1&Session_Id=2#key=3' else url || '#token=1' end as url from pages)
select page_id, regexp_matches(url, '^[a-z]+://[^/?#]*@') or len(list_filter(string_split(string_split(case when contains(url, '?') then substring(url, instr(url, '?') + 1) else '' end, '#')[1], '&'),
  lambda p: regexp_matches(lower(string_split(p, '=')[1]), '{'|'.join(SIGNALS)}'))) > 0 as has_credentials, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host from u""")
def identifier_grammar(spark, sf_dir):
    """Locators of pages with user information, a signature, a session or only a fragment added, by turns."""
    k, url = F.col("page_id") % 4, F.col("url")
    made = F.when(k == 1, F.replace(url, F.lit("://"), F.lit("://me:pw@"))).when(k == 2, F.concat(url, F.lit("?X-Amz-Signature=1"))).when(k == 3, F.concat(url, F.lit("?page=1&Session_Id=2#key=3"))).otherwise(F.concat(url, F.lit("#token=1")))
    return table(spark, sf_dir, "pages").select("page_id", carries_credentials(made).alias("has_credentials"), F.regexp_extract(made, r"^[a-z]+://([^/?#]+)", 1).alias("host"))


@C.sql
def score_interval_coverage(d):
    """Overlap of carried ranges with key ranges, within the same order."""
    return f"""with c as (select l_orderkey as k, {d.seconds('l_shipdate')} as f, {d.seconds('l_shipdate')} + 86400 * cast(l_quantity as bigint) as u from lineitem where l_linenumber = 1),
a as (select l_orderkey as k, {d.seconds('l_shipdate')} as f, {d.seconds('l_shipdate')} + 86400 * 20 as u from lineitem where l_linenumber > 1)
select a.k, cast(sum(greatest(0, least(a.u, c.u) - greatest(a.f, c.f))) as bigint) as covered, cast(sum(a.u - a.f) as bigint) as total from a join c on a.k = c.k group by a.k"""


@C.sql
def score_bands(d):
    return """select s_suppkey, case when s_acctbal >= 7500 then 'full' when s_acctbal >= 5000 then 'most' when s_acctbal >= 2500 then 'some' when s_acctbal > 0 then 'little' else 'none' end as band from supplier"""


@C.sql
def score_verdicts(d):
    return """with s as (select l_suppkey, median(l_quantity) as score, bool_and(l_discount < 0.1) as gate, count(case when l_returnflag = 'R' then 1 end) as criticals from lineitem group by l_suppkey)
select l_suppkey, score, case when gate and score >= 27 and criticals >= 2 then 'USEFUL' when score >= 25 then 'PARTIAL' else 'NOT' end as verdict from s"""


@C.sql
def outcome_multiset_gate(d):
    """Outcomes counted against what was expected, differences both ways."""
    return """with got as (select event_type as outcome, count(*) as n from events group by event_type), want as (select event_type as outcome, count(*) as n from events where event_id % 1000 <> 1 group by event_type)
select coalesce(g.outcome, w.outcome) as outcome, coalesce(g.n, 0) as got, coalesce(w.n, 0) as expected, coalesce(g.n, 0) = coalesce(w.n, 0) as pass from got g full outer join want w on g.outcome = w.outcome"""


@C.spark("""with h as (select doc_id, source, sha256('shuffle:' || doc_id) as h from documents)
select doc_id, row_number() over (partition by source order by h, doc_id) as place, case when h[1] in ('0', '2', '4', '6', '8', 'a', 'c', 'e') then 'left' else 'right' end as side from h""")
def hash_ordering(spark, sf_dir):
    """A shuffle that is always the same: documents of a source in order of a digest, and a side by the parity of its first digit. Places come from one
    numbering of all rows, so that no source is a single task."""
    h = F.sha2(F.concat(F.lit("shuffle:"), F.col("doc_id").cast("string")), 256)
    rows = numbered(table(spark, sf_dir, "documents").select("source", h.alias("h"), "doc_id"), "source", "h", "doc_id")
    first = rows.groupBy("source").agg(F.min("number").alias("first"))
    side = F.when(F.conv(F.substring("h", 1, 1), 16, 10).cast("int") % 2 == 0, "left").otherwise("right")
    return rows.join(first, "source").select("doc_id", (F.col("number") - F.col("first") + 1).alias("place"), side.alias("side"))


@C.sql
def substrate_star_join_topn(d):
    return """select n_name, cast(round(sum(l_extendedprice * (1 - l_discount)), 0) as bigint) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name order by revenue desc, n_name limit 5"""


@C.sql
def substrate_rollup(d):
    return "select l_returnflag, l_linestatus, cast(sum(l_quantity) as bigint) as quantity, count(*) as n from lineitem group by rollup(l_returnflag, l_linestatus)"


@C.sql
def substrate_set_ops(d):
    return "select c_custkey from customer where c_nationkey < 10 intersect select o_custkey from orders where o_totalprice > 50000 except select c_custkey from customer where c_mktsegment = 'BUILDING'"
