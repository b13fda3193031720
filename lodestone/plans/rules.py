"""Queries that apply the rules of authority, knowledge, compiling and spending to frames made from the tables.

The frames are fixtures: every member is read off a column (a status, a price, a date), since the tables hold no grants, claims or packets.
The oracles state each rule again, as plain SQL over the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import authority as A
from lodestone.operators import knowledge as K
from lodestone.operators import spending as S
from lodestone.plans import compiling as P
from lodestone.sources.tables import Catalogue, table

C = Catalogue()


def day(column: str, plus: int = 0) -> Column:
    return F.date_format(F.date_add(column, plus), "yyyy-MM-dd")


def text(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# grants: one for each order, delegated from the customer's order before it


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    digit = F.substring("o_orderpriority", 1, 1)
    words = lambda *x: F.array(*[F.lit(w) for w in x])
    none = F.lit(None).cast("string")
    customer = F.col("o_custkey").cast("string")
    id_ = F.when(F.col("o_orderstatus") == "F", customer)
    prefix = F.when(F.col("o_orderstatus") == "O", F.substring(customer, 1, 1))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select(
        text("g", "o_orderkey").alias("grant_id"), text("c", "o_custkey").alias("holder"),
        F.when(digit < "3", words("read", "write", "delegate")).when(digit == "3", words("read", "write")).otherwise(words("read")).alias("rights"),
        F.array(F.struct(F.lit("part").alias("kind"), id_.alias("id"), prefix.alias("id_prefix"))).alias("resources"),
        F.when(F.col("o_orderstatus") != "P", day("o_orderdate", 2000)).alias("expires_at"),
        F.when(digit != "5", digit).alias("scope"), F.when(digit != "5", F.year("o_orderdate")).cast("long").alias("epoch"),
        (F.col("o_totalprice") > 100000).alias("delegable"), digit.cast("int").alias("max_depth"), F.concat(F.lit("g"), before.cast("string")).alias("parent"),
        (F.col("o_totalprice") < 20000).alias("revoked"), F.when(F.col("o_orderstatus") == "F", F.array(F.concat(F.lit("w"), digit))).otherwise(F.array(none).cast("array<string>")).alias("constraints"),
    ).withColumn("constraints", F.array_compact("constraints"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("scope"), F.year("o_orderdate").cast("long").alias("y"))
    return g.groupBy("scope").agg((F.min("y") + 2).alias("current"))


GRANTS_DUCK = """g as (select 'g' || o_orderkey as grant_id, 'c' || o_custkey as holder, o_orderpriority[1] as digit, o_orderstatus as status, o_custkey::varchar as customer, o_totalprice as price,
  strftime(o_orderdate + interval 2000 day, '%Y-%m-%d') as expires, year(o_orderdate) as y, 'g' || lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as parent from orders),
e as (select digit, min(y) + 2 as current from g group by digit)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return line.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("request"),
        F.when(F.col("l_returnflag") == "R", text("c", "l_suppkey")).otherwise(text("c", "o_custkey")).alias("principal"),
        F.when(F.col("l_discount") > 0, text("g", "l_orderkey")).alias("grant_id"), F.when(F.col("l_linestatus") == "O", "write").otherwise(F.lit("read")).alias("right"),
        F.lit("part").alias("kind"), F.when(F.col("l_tax") > 0, F.col("l_partkey").cast("string")).alias("id"), text("w", "l_linenumber").alias("work"), day("l_shipdate").alias("at"),
    )


@C.spark(f"""with {GRANTS_DUCK}, r as (select l.*, o_custkey, 'g' || l_orderkey as grant_id from lineitem l join orders on l_orderkey = o_orderkey)
select l_orderkey || '-' || l_linenumber || '-' || l_partkey as request, case when l_discount <= 0 then 'grant_required'
  when g.holder <> case when l_returnflag = 'R' then 'c' || l_suppkey else 'c' || o_custkey end then 'grant_not_found' when price < 20000 then 'revoked'
  when status <> 'P' and strftime(l_shipdate, '%Y-%m-%d') >= expires then 'expired' when g.digit <> '5' and y <> current then 'authority_epoch_stale'
  when l_linestatus = 'O' and g.digit > '3' then 'right_missing'
  when l_tax > 0 and ((status = 'F' and l_partkey::varchar <> customer) or (status = 'O' and not starts_with(l_partkey::varchar, customer[1]))) then 'out_of_scope'
  when status = 'F' and 'w' || l_linenumber <> 'w' || g.digit then 'binding_violation' end as denial
from r join g using (grant_id) join e on e.digit = g.digit""")
def grant_usable_reason(spark, sf_dir):
    """Why each request under a grant is refused: the first reason in the fixed order, null where it is permitted."""
    return A.denials(requests(spark, sf_dir), grants(spark, sf_dir), epochs(spark, sf_dir)).select("request", "denial")


@C.spark(f"""with {GRANTS_DUCK} select c.grant_id, c.parent, case when p.price <= 100000 or p.digit::int < 1 then 'delegable' when (c.digit < '3' and p.digit >= '3') or (c.digit = '3' and p.digit > '3') then 'rights'
  when not (p.status = 'P' or (p.status = 'F' and c.status = 'F') or (p.status = 'O' and c.status <> 'P')) then 'resources' when p.status <> 'P' and (c.status = 'P' or c.expires > p.expires) then 'expiry'
  when c.digit::int > p.digit::int - 1 then 'depth' when p.status = 'F' and not (c.status = 'F' and c.digit = p.digit) then 'constraints'
  when p.digit <> '5' and (c.digit <> p.digit or c.y <> p.y) then 'binding' end as breach from g c join g p on c.parent = p.grant_id where breach is not null""")
def grant_delegation_violations(spark, sf_dir):
    return A.delegation_breaches(grants(spark, sf_dir))


@C.spark(f"""with recursive {GRANTS_DUCK}, below as (select grant_id, 1::bigint as depth from g where parent in (select grant_id from g where parent is null)
  union all select g.grant_id, depth + 1 from g join below b on g.parent = b.grant_id)
select grant_id, depth from below join g using (grant_id) where price >= 20000""")
def grant_revocation_cascade(spark, sf_dir):
    """What the revocation of every customer's first grant takes down, walking through grants that are revoked already."""
    g = grants(spark, sf_dir)
    return A.revoked_with(g, g.filter("parent is null").select(F.col("grant_id").alias("node")))


@C.spark("""with recursive edges as (select 'n' || n_nationkey as child, 'r' || n_regionkey as parent from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer),
tree as (select child, 1::bigint as depth from edges where parent = 'r1' union all select e.child, t.depth + 1 from edges e join tree t on e.parent = t.child) select child as node, depth from tree""")
def grant_descendants(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(text("n", "n_nationkey").alias("child"), text("r", "n_regionkey").alias("parent"))
    c = table(spark, sf_dir, "customer").select(text("c", "c_custkey").alias("child"), text("n", "c_nationkey").alias("parent"))
    return A.descendants(n.unionByName(c), spark.createDataFrame([("r1",)], "node string"))


@C.spark("""with g as (select o_orderkey, o_orderstatus as status, o_custkey::varchar as customer from orders)
select p_partkey, count(*) as grants from part join g on status = 'P' or (status = 'F' and p_partkey::varchar = customer) or (status = 'O' and starts_with(p_partkey::varchar, customer[1])) group by p_partkey""")
def grant_cover_semi(spark, sf_dir):
    """How many grants cover each part. A cover is an equality on id, or on the prefix at one of the lengths that prefixes have, or unnamed: no
    comparison of all pairs."""
    g = grants(spark, sf_dir).select("grant_id", F.explode("resources").alias("r")).select("grant_id", "r.*")
    g = g.groupBy("kind", "id", "id_prefix").agg(F.count("*").alias("n"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("pid"))
    exact = parts.join(g.filter("id is not null"), F.col("pid") == F.col("id")).select("p_partkey", "n")
    sizes = [r[0] for r in g.filter("id is null and id_prefix is not null").select(F.length("id_prefix")).distinct().collect()]  # lengths of prefixes
    starts = parts.select("p_partkey", F.explode(F.array(*[F.substring("pid", 1, k) for k in sizes]) if sizes else F.array().cast("array<string>")).alias("start"))
    by_prefix = starts.join(g.filter("id is null"), F.col("start") == F.col("id_prefix")).select("p_partkey", "n")
    free = g.filter("id is null and id_prefix is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    unnamed = parts.select("p_partkey").join(F.broadcast(free)).filter("n > 0")
    return exact.unionByName(by_prefix).unionByName(unnamed).groupBy("p_partkey").agg(F.sum("n").alias("grants"))


# commands: one for each event; its id is its content


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    known = e.groupBy("user_id").agg(F.count("*").alias("revision"), F.max("event_type").alias("latest"))
    return e.join(known, "user_id").select(
        "event_id", text("u", "user_id").alias("principal"), F.concat("event_type", k.cast("string")).alias("command_id"), F.col("event_id").alias("at"),
        F.when(F.col("value") >= 1, F.sha2(F.concat("event_type", F.floor(F.col("value") / 100).cast("string")), 256)).alias("digest"),
        F.when(F.col("event_type") == "error", "right_missing").alias("denial"), (F.col("event_type") != "view").alias("capable"),
        F.weekofyear("ts").cast("long").alias("epoch"), F.lit(1).cast("long").alias("current_epoch"), F.when(k < 50, k).alias("expected"), "revision",
    )


@C.spark("""with c as (select event_id, user_id, event_type || (props->>'k')::bigint as command, event_type, value, case when value >= 1 then event_type || floor(value / 100)::bigint end as body, (props->>'k')::bigint as k, weekofyear(ts) as w, count(*) over (partition by user_id) as revision from events),
f as (select user_id, command, min(event_id) as first, arg_min(body, event_id) as first_body from c where body is not null group by all)
select event_id, case when body is null then 'invalid' when event_id <> first and body = first_body then 'replayed' when event_id <> first then 'command_conflict' when event_type = 'error' then 'denied'
  when event_type = 'view' then 'capability_missing' when w <> 1 then 'epoch_stale' when k < 50 and k <> revision then 'precondition_failed' else 'admitted' end as outcome, first as applied_by
from c left join f using (user_id, command)""")
def admission_ordered_reason(spark, sf_dir):
    """What becomes of each command, in the fixed order of checks; the first of its id decides for the later ones."""
    return A.admitted(commands(spark, sf_dir)).select("event_id", "outcome", "applied_by")


# claims: one for each order


def order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, price = table(spark, sf_dir, "orders"), F.col("o_totalprice")
    none = F.lit(None).cast("string")
    return o.select(
        text("o", "o_orderkey").alias("claim"), text("c", "o_custkey").alias("subject"), F.lit("p").alias("predicate"), F.lit("s").alias("scope"),
        F.when(price >= 30000, F.create_map(F.lit("status"), "o_orderstatus")).alias("qualifiers"), F.when(price < 190000, F.create_map(F.lit("r"), F.year("o_orderdate").cast("string"))).alias("trees"),
        F.when(price < 150000, F.col("o_orderstatus")).alias("environment"), none.alias("build"), F.when(price > 60000, "complete").otherwise(F.lit("partial")).alias("completeness"),
        F.when(price >= 40000, day("o_orderdate")).alias("valid_from"), F.when(price >= 40000, day("o_orderdate", 180)).alias("valid_until"),
        F.when(price > 185000, "multiple").when(price > 80000, "single").alias("cardinality"), F.substring("o_orderpriority", 1, 1).alias("value"),
        F.when(F.col("o_orderstatus") == "F", "observed").when(F.col("o_orderstatus") == "O", "normative").otherwise(F.lit("procedural")).alias("plane"),
    )


CLAIMS_DUCK = """k as (select 'o' || o_orderkey as claim, 'c' || o_custkey as subject, case when o_totalprice >= 30000 then o_orderstatus end as q, case when o_totalprice < 190000 then year(o_orderdate) end as tree,
  case when o_totalprice < 150000 then o_orderstatus end as env, o_totalprice > 60000 as whole, case when o_totalprice >= 40000 then o_orderdate end as f, case when o_totalprice >= 40000 then o_orderdate + interval 180 day end as u,
  case when o_totalprice > 185000 then 'multiple' when o_totalprice > 80000 then 'single' end as card, o_orderpriority[1] as v, case o_orderstatus when 'F' then 'observed' when 'O' then 'normative' else 'procedural' end as plane from orders),
c as (select min(claim) as claim, * exclude (claim) from k group by all)"""


@C.spark(f"""with {CLAIMS_DUCK}, p as (select a.claim as a_claim, b.claim as b_claim, (a.plane = 'normative' and b.plane = 'observed') or (a.plane = 'observed' and b.plane = 'normative') as drift, a.plane <> b.plane as planes,
  a.q is distinct from b.q as uq, not coalesce(a.tree = b.tree and a.env is not distinct from b.env and a.whole and b.whole, false) as ub, a.f is null or b.f is null as uv, not coalesce(a.card = 'single' and b.card = 'single', false) as uc
  from c a join c b on a.subject = b.subject and a.claim < b.claim and a.v <> b.v
  where not coalesce(a.q <> b.q, false) and not coalesce(a.tree <> b.tree, false) and not coalesce(a.tree is not null and b.tree is not null and a.env <> b.env, false)
    and (a.f is null or b.f is null or (a.f < b.u and b.f < a.u)) and coalesce(a.card, '') <> 'multiple' and coalesce(b.card, '') <> 'multiple')
select a_claim, b_claim, case when drift then 'drift' else 'conflict' end as kind, case when uq or ub or uv or uc or (planes and not drift) then 'potential' else 'demonstrated' end as status,
  concat_ws(',', case when uq then 'qualifiers' end, case when ub then 'basis' end, case when uv then 'validity' end, case when uc then 'cardinality' end, case when planes and not drift then 'plane' end) as uncertain from p""")
def claim_conflict_pairs(spark, sf_dir):
    """Pairs of claims that eight checks in order do not tell apart, and what of them is uncertain."""
    found = K.conflicts(order_claims(spark, sf_dir))
    return found.withColumn("uncertain", F.array_join("uncertain", ","))


@C.spark("""with e as (select l_orderkey as claim, l_linenumber, l_partkey as root, l_suppkey as digest, case l_returnflag when 'A' then 'unknown' else 'complete' end as comp, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i from lineitem),
p as (select a.claim, bool_or(a.digest <> b.digest and a.comp = 'complete' and b.comp = 'complete') as disjoint, bool_and(a.root = b.root and a.digest = b.digest) as shared from e a join e b on a.claim = b.claim and a.i < b.i group by a.claim),
s as (select claim, count(*) as n, bool_or(comp = 'unknown') as unknown, count(distinct (root, digest)) = 1 as common, coalesce(list(l_linenumber::varchar order by i) filter (comp = 'unknown'), []) as unknowns from e group by claim)
select o_orderkey as claim, case when n is null then 'unsupported' when unknown and not coalesce(disjoint, false) then 'undetermined' when common then 'single_lineage' when disjoint then 'multiple_lineages' when n >= 2 and shared then 'overlapping_lineages' else 'undetermined' end as support_class,
  coalesce(array_to_string(unknowns, ','), '') as unknown from orders left join s on o_orderkey = s.claim left join p on o_orderkey = p.claim""")
def claim_support_class(spark, sf_dir):
    """Orders as claims, their lines as support; an order without a line has none."""
    line = table(spark, sf_dir, "lineitem")
    root = F.array(F.struct(F.col("l_partkey").cast("string").alias("id"), F.col("l_suppkey").cast("string").alias("digest")))
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(F.col("l_linenumber").cast("string").alias("support_id"), root.alias("roots"), F.when(F.col("l_returnflag") == "A", "unknown").otherwise(F.lit("complete")).alias("completeness")).alias("e"))
    held = line.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("entries"))
    all_ = table(spark, sf_dir, "orders").join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    entries = F.coalesce(F.col("entries"), F.expr(f"cast(array() as array<{K.ENTRY}>)"))
    return all_.select(F.col("o_orderkey").alias("claim"), entries.alias("entries")).select("claim", K.support_class(F.col("entries")).alias("support_class"), F.array_join(K.unknown_ancestry(F.col("entries")), ",").alias("unknown"))


@C.spark("""with a as (select l_orderkey, count(*) as n, count(*) filter (l_returnflag = 'N') as ok, count(*) filter (l_returnflag = 'A' and l_linestatus = 'O') as unknown, count(*) filter (l_returnflag = 'R') as purged from lineitem group by l_orderkey)
select o_orderkey, case when n is null then 'unknown' when ok = n then 'complete' when ok > 0 then 'partial' when unknown > 0 then 'unknown' when purged = n then 'purged' else 'unavailable' end as availability from orders left join a on o_orderkey = l_orderkey""")
def claim_availability(spark, sf_dir):
    state = F.when(F.col("l_returnflag") == "N", "available").when(F.col("l_returnflag") == "R", "purged").when(F.col("l_linestatus") == "O", "unknown").otherwise("unavailable")
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(state).alias("states"))
    all_ = table(spark, sf_dir, "orders").join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return all_.select("o_orderkey", K.availability(F.coalesce("states", F.array().cast("array<string>"))).alias("availability"))


@C.spark("""with t as (select source, max(lang) as tree, case when max(n_chars) > 15000 then max(lang) end as dirty from documents group by source), env as (select max(source) as e from documents),
f as (select l_orderkey as claim, case when l_returnflag = 'A' and l_linestatus = 'O' then 'unsupported' when l_returnflag = 'N' then case when tree is null then 'missing_anchor' when tree = 'es' then 'match' else 'mismatch' end
  when l_returnflag = 'R' then case when dirty is null then 'missing_anchor' when dirty = 'es' then 'match' else 'mismatch' end else case when e = 'src9' then 'match' else 'mismatch' end end as finding
  from lineitem left join t on source = 'src' || l_suppkey, env)
select claim, case when bool_or(finding = 'mismatch') then 'invalid_for_target' when bool_or(finding in ('missing_anchor', 'unsupported')) then 'unknown' else 'applicable' end as result, count(*) as conditions from f group by claim""")
def claim_condition_findings(spark, sf_dir):
    """Conditions of three kinds and one that nothing implements, found against a target, and the result for each claim."""
    docs = table(spark, sf_dir, "documents")
    target = docs.groupBy("source").agg(F.max("lang").alias("tree"), F.when(F.max("n_chars") > 15000, F.max("lang")).alias("dirty"), F.max("source").alias("e"))
    target = target.select(F.col("source").alias("repository"), "tree", "dirty", F.col("e").alias("environment"))
    kind = F.when(F.col("l_returnflag") == "N", "repository_tree").when(F.col("l_returnflag") == "R", "dirty_snapshot").when(F.col("l_linestatus") == "O", "host_name").otherwise("environment_digest")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("condition_id"), kind.alias("kind"), text("src", "l_suppkey").alias("repository"))
    rows = rows.withColumn("expected", F.when(F.col("kind") == "environment_digest", "src9").otherwise(F.lit("es")))
    found = K.findings(rows, target).groupBy("claim").agg(F.collect_list("finding").alias("f"))
    return found.select("claim", K.result_of(F.col("f")).alias("result"), F.size("f").cast("long").alias("conditions"))


@C.spark("""with x as (select l.*, p_size, s_acctbal, o_custkey from lineitem l left join part on l_partkey = p_partkey left join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey)
select l_orderkey || '-' || l_linenumber || '-' || l_partkey as dependency, case when l_returnflag = 'R' then 'remote_dependency' when l_partkey = x.o_custkey then 'self_reference' when r.o_custkey is null then 'unresolved' when e.p_size is null then 'not_evaluated' when e.p_size < 25 then 'not_established' end as reason
from x left join (select distinct o_custkey from orders) r on r.o_custkey = x.l_partkey left join part e on e.p_partkey = x.l_partkey and e.p_type <> 'ECONOMY'""")
def claim_dependency_findings(spark, sf_dir):
    """Lines as dependencies of a customer's claim on a part's: resolved if a customer has that number, evaluated if the part is not of one type."""
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    rows = table(spark, sf_dir, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("dependency"),
        F.col("o_custkey").alias("claim"), F.when(F.col("l_returnflag") == "R", "there").otherwise(F.lit("here")).alias("provider"), F.col("l_partkey").alias("on_claim"), F.lit(1).alias("on_revision"),
    )
    revisions = o.select(F.col("o_custkey").alias("claim"), F.lit(1).alias("revision")).distinct()
    evaluations = p.filter("p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("claim"), F.when(F.col("p_size") < 25, "unknown").otherwise(F.lit("applicable")).alias("result"))
    return K.dependency_reasons(rows, revisions, evaluations, "here").select("dependency", "reason")


@C.spark("""with w as (select doc_id, quality, toxic from labels), c as (select d.doc_id, lang, source, n_chars, quality, toxic from documents d join w using (doc_id)), n as (select * from c where lang <> 'es'),
x as (select c.*, n.doc_id as there, case when c.toxic = 1 then 'binding' when c.quality = 1 then 'evidence' end as wanted, c.n_chars > 3000 as longer, c.source = 'src3' as opens, c.lang = 'fr' as revised from c left join n using (doc_id))
select doc_id, concat_ws(',', case when there is null then 'unavailable' end, case when there is not null and longer then 'reliance_changed' end, case when there is not null and quality = 0 then 'applicability_changed' end, case when there is not null and opens then 'conflict_opened' end, case when there is not null and revised then 'lineage_revised' end) as changes,
  case when wanted is not null and there is not null then case when longer then 'permitted_use_lost' when quality = 0 then 'invalid_for_target' end end as invalidated, case when wanted is not null and there is null then 'knowledge_unavailable' end as unverified from x""")
def packet_read_time_changes(spark, sf_dir):
    """Claims that a packet carries against the same claims read again: five kinds of change, and what they do to required items."""
    c = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("claim", F.col("doc_id").cast("string"))
    wanted = F.when(F.col("toxic") == 1, "binding").when(F.col("quality") == 1, "evidence")
    none = F.array().cast("array<string>")
    was = c.select("claim", "doc_id", F.lit(1).alias("revision"), F.lit("accepted_for_use").alias("state"), F.lit("binding").alias("permitted"), F.lit("applicable").alias("result"), none.alias("conflicts"), wanted.alias("wanted"))
    now = c.filter("lang <> 'es'").select(
        "claim", F.when(F.col("n_chars") > 3000, "superseded").otherwise(F.lit("accepted_for_use")).alias("state"), F.lit("binding").alias("permitted"),
        F.when(F.col("quality") == 0, "invalid_for_target").otherwise(F.lit("applicable")).alias("result"), F.when(F.col("source") == "src3", F.array(F.lit("k1"))).otherwise(none).alias("conflicts"),
        F.when(F.col("lang") == "fr", 2).otherwise(1).alias("current_revision"),
    )
    found = K.read_time_changes(was, now)
    return found.select(F.col("claim").cast("long").alias("doc_id"), F.array_join("changes", ",").alias("changes"), "invalidated", "unverified")


# packets: a request is a customer's order, an item a line, its section the part's name


def packet_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    line = line.groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_partkey", "l_quantity", "l_returnflag", "l_linestatus", "l_tax", "p_name", "p_size", "p_brand")])
    key = [F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("item")]
    none = F.lit(None).cast("string")
    items = line.select(
        *key, F.when(F.col("l_returnflag") == "N", "required").otherwise(F.lit("advisory")).alias("obligation"), F.lit("source_included").alias("check_kind"), F.col("p_brand").alias("check_repository"),
        F.when(F.col("l_linestatus") == "O", F.col("p_name")).otherwise(F.lit("elsewhere")).alias("check_path"), none.alias("check_digest"), none.alias("check_claim"),
        F.when(F.col("l_tax") == 0, "no_source").alias("unmet"), F.lit(None).cast("long").alias("corrected"), F.lit(None).cast("long").alias("supplied"),
    )
    sections = line.select(
        *key, F.col("l_linenumber").cast("string").alias("section"), F.col("l_linenumber").alias("place"), F.expr("repeat(p_name, cast(l_quantity as int))").alias("content"),
        F.when(F.col("p_size") == 50, "knowledge_unavailable").alias("claim_error"), (F.col("p_size") == 49).alias("historical"), F.col("p_brand").alias("repository"), F.col("p_name").alias("path"), none.alias("via"),
        F.array().cast("array<string>").alias("digests"), none.alias("claim"), none.alias("shortfall"), F.lit(None).cast("long").alias("authority_revision"),
    )
    return items, sections, items.select("request").distinct().withColumn("amount", F.lit(CAPACITY))


CAPACITY = 1500
PACKETS_DUCK = f"""with recursive line as (select l_orderkey as request, l_linenumber as item, max(l_quantity) as q, max(l_returnflag) as flag, max(l_linestatus) as status, max(l_tax) as tax, max(p_name) as name, max(p_size) as psize, max(p_brand) as brand
  from lineitem join part on l_partkey = p_partkey group by all),
s as (select *, strlen(name) * q::int as size, psize = 50 as failed, flag = 'N' as must, row_number() over (partition by request order by item) as k,
  {CAPACITY} - coalesce(sum(strlen(name) * q::int) filter (flag = 'N' and psize <> 50) over (partition by request), 0) as room from line),
w as (select request, k, case when not failed and not must and size <= room then room - size else room end as room, not failed and (must or size <= room) as included from s where k = 1
  union all select s.request, s.k, case when not failed and not must and s.size <= w.room then w.room - s.size else w.room end, not failed and (must or s.size <= w.room) from w join s on s.request = w.request and s.k = w.k + 1),
p as (select s.*, w.included from s join w using (request, k)),
r as (select request, item, case when must then 'required' else 'advisory' end as obligation, included and psize <> 49 and status = 'O' as satisfied, tax = 0 as stated, not included and psize <> 49 as omitted, must from p),
x as (select *, case when satisfied then 'satisfied' when stated or must then 'unmet' else 'degraded' end as result, case when satisfied then null when stated then 'no_source' when omitted then 'output_capacity' else 'unavailable' end as reason from r)"""


@C.spark(f"{PACKETS_DUCK} select request, item::varchar as section, included, case when failed then 'unavailable' when not included then 'output_capacity' end as reason from p")
def packet_inclusion_greedy(spark, sf_dir):
    """What fits: required items' bytes are reserved first, then whatever still fits in order."""
    items, sections, capacity = packet_frames(spark, sf_dir)
    return P.inclusion(sections, items, capacity)


@C.spark(f"{PACKETS_DUCK} select request, item, result, reason from x")
def packet_item_results(spark, sf_dir):
    items, sections, capacity = packet_frames(spark, sf_dir)
    return P.item_results(items, sections.drop("obligation"), P.inclusion(sections, items, capacity)).select("request", "item", "result", "reason")


@C.spark(f"{PACKETS_DUCK} select request, case when bool_or(result = 'unmet') then 'unmet' when bool_or(result = 'degraded') then 'partial' else 'ready' end as state from x group by request")
def packet_state(spark, sf_dir):
    items, sections, capacity = packet_frames(spark, sf_dir)
    return P.states(P.item_results(items, sections, P.inclusion(sections, items, capacity)))


@C.spark(f"{PACKETS_DUCK} select request, sum(size)::bigint as bytes, count(*) as n from s where must group by request")
def packet_mandatory_size(spark, sf_dir):
    items, sections, _ = packet_frames(spark, sf_dir)
    return P.mandatory_size(sections, items)


@C.spark("""select l_orderkey as request, l_linenumber as key, row_number() over (partition by l_orderkey order by case l_returnflag when 'N' then 0 when 'A' then 2 else 4 end, l_quantity, l_linenumber, l_partkey) as place from lineitem""")
def sections_ordered(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "N", "binding_claim").when(F.col("l_returnflag") == "A", "span").otherwise(F.lit("historical"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), kind.alias("kind"), F.col("l_quantity").alias("order"), F.struct("l_linenumber", "l_partkey").alias("key"))
    return P.ordered(rows).select("request", F.col("key.l_linenumber").alias("key"), F.col("place").cast("long").alias("place"))


_CLAIM_SCORES = r"""with q as (select regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as words from benchmark where item_id = 2), s as (select d.doc_id, source, toxic = 1 as binding, quality = 1 as named,
  len(list_filter(q.words, lambda w: list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), w))) as score from documents d join labels using (doc_id), q),
k as (select *, row_number() over (partition by source order by score desc, doc_id) as place from s where score > 0 or named)"""


def claim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.lit(r"([\p{L}\p{N}]+)")
    asked = table(spark, sf_dir, "benchmark").filter("item_id = 2").select(F.regexp_extract_all(F.lower("text"), word, F.lit(1))).first()[0]
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select(F.col("source").alias("request"), F.col("doc_id").alias("claim"), F.regexp_extract_all(F.lower("text"), word, F.lit(1)).alias("terms"), (F.col("quality") == 1).alias("named"), (F.col("toxic") == 1).alias("binding"))
    return P.ranked_claims(rows, F.array(*[F.lit(w) for w in asked]))


@C.spark(f"{_CLAIM_SCORES} select source as request, doc_id as claim, score, place from k where place <= 4 or binding")
def claims_ranked_carried(spark, sf_dir):
    return claim_scores(spark, sf_dir).filter("fate = 'carried'").select("request", "claim", F.col("score").cast("long").alias("score"), F.col("place").cast("long").alias("place"))


@C.spark(f"{_CLAIM_SCORES} select source as request, doc_id as claim, 'applicability' as reason from k where place > 4 and not binding")
def claims_omitted(spark, sf_dir):
    return claim_scores(spark, sf_dir).filter("fate <> 'carried'").select("request", "claim", F.col("fate").alias("reason"))


@C.spark("""with a as (select l_orderkey as question, l_partkey::varchar as id, min(l_linenumber) as given from lineitem group by all), o as (select p_partkey::varchar as id, p_size as place from part where p_size < 30)
select question, coalesce(string_agg(id, ',' order by place, id) filter (place is not null), '') as chosen, count(*) filter (place is null) as refused from a left join o using (id) group by question""")
def answers_closed_set(spark, sf_dir):
    """Answers name parts; offered were those below a size."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("id")))), lambda x: x["id"])
    answers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("question")).agg(ids.alias("ids"))
    offered = answers.select("question", F.explode(F.array_distinct("ids")).alias("id")).join(table(spark, sf_dir, "part").filter("p_size < 30").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").alias("place")), "id")
    return P.answers_checked(answers, offered).select("question", F.array_join("chosen", ",").alias("chosen"), F.size("refused").cast("long").alias("refused"))


@C.spark("""with k as (select l_suppkey, l_returnflag || l_linestatus || l_linenumber as kind, count(*) as n from lineitem group by all)
select * from (select *, row_number() over (partition by l_suppkey order by n desc, kind) as place from k) z where place <= 8""")
def gaps_by_kind(spark, sf_dir):
    """The eight most frequent kinds for each supplier."""
    kind = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    return P.tallied(table(spark, sf_dir, "lineitem").select("l_suppkey", kind.alias("kind")), ["l_suppkey"], "kind", 8)


# spending: events as calls


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("store"), F.col("event_id").alias("id"), text("j", "user_id").alias("job"), seconds.alias("seconds"), F.date_format("ts", "yyyy-MM").alias("month"),
        F.round(F.col("value") * 100).cast("long").alias("estimate"), F.when(F.col("value") > 290, "unsound_bound").alias("stop"),
    )


@C.spark()
def ledger_admissions(spark, sf_dir):
    """Every call against the ceilings, refusals spending nothing; the tests fold the same rows plainly."""
    return S.admissions(calls(spark, sf_dir), S.Ceilings(request=25_000, job=60_000, window=60_000, month=1_500_000))


@C.spark("""with r as (select event_id as id, 'j' || user_id as job, cast(round(value * 100) as bigint) as estimate from events where event_type in ('view', 'click')),
s as (select event_id + 1 as id, case event_type when 'purchase' then 'usage' when 'error' then 'not_sent' when 'signup' then 'provider_exhausted' else 'unknown' end as how, cast(round(value * 90) as bigint) as tokens from events),
x as (select r.id, job, coalesce(how, 'reservation') as kind, case how when 'usage' then tokens when 'not_sent' then 0 when 'provider_exhausted' then 0 else estimate end as tokens, estimate from r left join s using (id))
select * from x union all select id, job, 'overrun', tokens, estimate from x where kind = 'usage' and tokens > estimate""")
def ledger_settled(spark, sf_dir):
    """Views and clicks reserve, the event before settles: what each reservation became, and overruns."""
    e = table(spark, sf_dir, "events")
    reserved = e.filter("event_type in ('view', 'click')").select(F.col("event_id").alias("id"), text("j", "user_id").alias("job"), F.round(F.col("value") * 100).cast("long").alias("estimate"))
    how = F.when(F.col("event_type") == "purchase", "usage").when(F.col("event_type") == "error", "not_sent").when(F.col("event_type") == "signup", "provider_exhausted").otherwise(F.lit("unknown"))
    return S.settled(reserved, e.select((F.col("event_id") + 1).alias("id"), F.col("event_id").alias("at"), how.alias("how"), F.round(F.col("value") * 90).cast("long").alias("tokens")))


@C.spark("""with l as (select event_type as store, 'j' || user_id as job, cast(round(value * 100) as bigint) as tokens, floor(epoch(ts))::bigint as seconds, strftime(ts, '%Y-%m') as month from events), now as (select floor(epoch(max(ts)))::bigint - 3600 as t, strftime(max(ts), '%Y-%m') as m from events),
s as (select store, coalesce(sum(tokens) filter (seconds > t - 18000), 0)::bigint as window_spent, coalesce(sum(tokens) filter (month = m), 0)::bigint as month_spent, sum(tokens)::bigint as run_spent from l, now group by store)
select store, job, sum(tokens)::bigint as job_spent, any_value(window_spent) as window_spent, any_value(month_spent) as month_spent, any_value(run_spent) as run_spent from l join s using (store) group by all""")
def ledger_spend(spark, sf_dir):
    """Totals an hour before the last row: the window has no upper bound, so the last hour counts too."""
    rows = calls(spark, sf_dir).select("store", "job", F.lit("usage").alias("kind"), F.col("estimate").alias("tokens"), "seconds", "month")
    last = rows.agg(F.max("seconds"), F.max("month")).first()
    return S.spend(rows, last[0] - 3600, last[1])
