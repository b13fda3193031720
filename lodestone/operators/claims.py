"""Claims, decisions, evaluations, support, conflicts and dependencies; evidence artifacts; grants."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.authority import descendants
from lodestone.sources.tables import Catalogue, table

C = Catalogue()


def claims(d) -> str:
    """A claim is a text's digest, its revisions the documents with that text; decisions come from labels."""
    return f"""docs as (select doc_id, lang, source, {d.sha256('text')} as digest from documents),
revisions as (select digest as claim, doc_id, lang, source, cast(row_number() over (partition by digest order by doc_id) as bigint) as revision from docs),
decisions as (select r.claim, r.revision, l.doc_id as seq, case when l.toxic = 1 then 'rejected' when l.quality = 1 then 'accepted_for_use' else 'superseded' end as value
  from labels l join revisions r on l.doc_id = r.doc_id)"""


@C.sql
def claim_latest_decision(d):
    return f"""with {claims(d)}, ranked as (select *, row_number() over (partition by claim order by seq desc) as k from decisions)
select r.claim, max(r.revision) as current_revision, max(k.value) as decision from revisions r left join (select * from ranked where k = 1) k on r.claim = k.claim group by r.claim"""


@C.sql
def claim_latest_evaluation(d):
    return f"""with {claims(d)}, e as (select claim, lang as target, {d.pick('max_by', 'arg_max')}(source, doc_id) as evaluator, min(doc_id) as first_seen, count(*) as evaluations from revisions group by claim, lang)
select claim, target, evaluator, first_seen, evaluations from e"""


@C.sql
def claim_history_positions(d):
    return f"""with {claims(d)}, e as (select user_id as doc_id, min(event_id) as position from events where event_type = 'purchase' group by user_id)
select r.claim, r.revision, r.doc_id, e.position from revisions r left join e on r.doc_id = e.doc_id"""


@C.sql
def claim_validity_overlap(d):
    """Half-open validity intervals of a customer's orders that overlap: a range join within the customer."""
    return f"""with v as (select o_custkey as subject, o_orderkey as id, {d.seconds('o_orderdate')} as f, {d.seconds('o_orderdate')} + 86400 * 30 as u from orders)
select a.subject, a.id as a, b.id as b, least(a.u, b.u) - greatest(a.f, b.f) as seconds from v a join v b on a.subject = b.subject and a.id < b.id and a.f < b.u and b.f < a.u"""


@C.sql
def manifest_completeness(d):
    return f"""with c as (select l_orderkey, l_linenumber <= 3 as required, case when p_partkey is null then 'missing' when l_linestatus = 'O' then 'unverified' when p_size > 45 then 'withheld' else 'present' end as state
  from lineitem left join part on l_partkey = p_partkey)
select l_orderkey, case when bool_and(not required or state = 'present') then 'complete' when bool_or(required and state = 'missing') then 'incomplete' else 'undetermined' end as completeness,
  {d.count_if("state = 'present'")} as present, count(*) as children from c group by l_orderkey"""


@C.sql
def proof_loss_dependents(d):
    """What holds or lists a purged artifact: two reverse lookups."""
    return """with purged as (select p_partkey from part where p_size = 50)
select 'manifest' as kind, l_orderkey as dependent, p_partkey as artifact from purged join lineitem on p_partkey = l_partkey where l_linenumber <= 2
union all select 'hold' as kind, l_suppkey as dependent, p_partkey as artifact from purged join (select distinct l_suppkey, l_partkey from lineitem where l_quantity > 45) h on p_partkey = l_partkey"""


@C.sql
def gc_unreferenced(d):
    return "select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 40 and l_linenumber = 1)"


@C.sql
def evidence_query_page(d):
    """A page by id after a cursor; what is hidden is flagged before any filter."""
    return """with visible as (select *, p_size % 5 <> 0 as seen from part)
select p_partkey, p_brand, p_type, (select count_if(not seen) > 0 from visible) as filtered from visible where seen and p_partkey > 57 and p_size < 30 order by p_partkey limit 100"""


@C.sql
def hold_expiry_transition(d):
    as_of = "(select max(ts) from events)"
    return f"""with h as (select event_id, user_id, {d.seconds('ts')} + 86400 * (event_id % 20) as expires from events where event_type = 'signup')
select event_id, case when expires <= (select max({d.seconds('ts')}) from events) then 'expired' else 'active' end as state from h"""


@C.sql
def artifact_reassembly_digest(d):
    """Staged chunks in order of their offset, joined and digested; the size seen against the size declared."""
    whole = d.pick(
        "array_join(transform(array_sort(collect_list(struct(l_linenumber, bytes))), x -> x.bytes), '')",
        "string_agg(bytes, '' order by l_linenumber, bytes)",
    )
    piece = "concat(cast(l_partkey as string), ':', cast(l_suppkey as string), ';')"
    return f"""with c as (select l_orderkey, l_linenumber, {piece} as bytes from lineitem)
select l_orderkey, {d.sha256(whole)} as digest, cast(sum(length(bytes)) as bigint) as size from c group by l_orderkey"""


@C.spark("""select doc_id, sha256(list_reduce(list_transform(range(101, least(strlen(text), 150) + 1), lambda i: hex(encode(text))[2 * i - 1 : 2 * i]), lambda x, y: x || y)) as piece, strlen(text) as size, strlen(text) >= 150 as whole from documents where strlen(text) > 100""")
def artifact_range_read(spark, sf_dir):
    """Bytes 100 to 149 of every text that reaches so far, as the digest of their hexadecimal digits; whole: whether all of the range was there."""
    raw, size = F.col("text").cast("binary"), F.octet_length("text").cast("long")
    docs = table(spark, sf_dir, "documents").filter(size > 100)
    return docs.select("doc_id", F.sha2(F.hex(F.substring(raw, 101, 50)), 256).alias("piece"), size.alias("size"), (size >= 150).alias("whole"))


@C.sql
def dirty_snapshot_digest(d):
    """Paths that differ between two listings, each once, and one digest for each tree over them: a digest of the digests of 256 parts, so that no
    string holds a whole tree."""
    return f"""with a as (select doc_id, lang, n_chars from documents where doc_id % 10 <> 1), b as (select doc_id, lang, n_chars + case when doc_id % 9 = 0 then 1 else 0 end as n_chars from documents where doc_id % 10 <> 2),
x as (select coalesce(a.lang, b.lang) as tree, coalesce(a.doc_id, b.doc_id) as id, case when a.doc_id is null then 'added' when b.doc_id is null then 'deleted' else 'changed' end as status
  from a full outer join b on a.doc_id = b.doc_id where a.n_chars is distinct from b.n_chars),
p as (select tree, substring({d.sha256('cast(id as string)')}, 1, 2) as part, count(*) as n, {d.sha256(d.join_agg("concat(cast(id as string), '=', status)", 'id'))} as digest from x group by tree, substring({d.sha256('cast(id as string)')}, 1, 2))
select tree, cast(sum(n) as bigint) as entries, {d.sha256(d.join_agg('digest', 'part'))} as digest from p group by tree"""


@C.sql
def memo_dependents_direct(d):
    return "select distinct l_suppkey as node, l_partkey as dependency from lineitem"


@C.spark("""with recursive edges as (
  select 'nation' || n_nationkey as node, 'region' || n_regionkey as dep from nation
  union all select 'supplier' || s_suppkey, 'nation' || s_nationkey from supplier
  union all select 'customer' || c_custkey, 'nation' || c_nationkey from customer),
hit as (select node, 1 as depth from edges where dep = 'region2' union all select e.node, h.depth + 1 from edges e join hit h on e.dep = h.node)
select node, min(depth)::bigint as depth from hit group by node""")
def memo_affected_transitive(spark, sf_dir):
    """Nodes whose results a changed region may alter: reverse reachability over recorded edges, level by level."""
    tables = (("nation", "n_nationkey", "region", "n_regionkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"), ("customer", "c_custkey", "nation", "c_nationkey"))
    edges = None
    for name, key, on, dep in tables:
        e = table(spark, sf_dir, name).select(F.concat(F.lit(name), F.col(key).cast("string")).alias("child"), F.concat(F.lit(on), F.col(dep).cast("string")).alias("parent"))
        edges = e if edges is None else edges.unionByName(e)
    return descendants(edges, spark.createDataFrame([("region2",)], "node string"))


@C.sql
def memo_shallow_verify(d):
    """A node is valid if no input of its durability or above changed since it was verified."""
    return """with inputs as (select n_regionkey % 3 as durability, max(n_nationkey) as changed_at from nation group by n_regionkey % 3),
stamps as (select a.durability, max(b.changed_at) as changed_at from inputs a join inputs b on b.durability >= a.durability group by a.durability)
select s_suppkey as node, s.durability, s_nationkey >= s.changed_at as valid from supplier join stamps s on s_suppkey % 3 = s.durability"""
