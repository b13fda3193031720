"""The event log: ranges, gaps, snapshots, retention; subjects, commands, admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.sources.eventlog import numbered
from lodestone.sources.tables import Catalogue, table

C = Catalogue()


def log(d) -> str:
    """Epoch is the week, sequence the place in it. In Spark the log is stored with its sequences; the oracle works them out."""
    week = f"cast(floor(({d.seconds('ts')} - 1704067200) / 604800) + 1 as bigint)"
    worked_out = f"""select {week} as epoch, cast(row_number() over (partition by {week} order by ts, event_id) as bigint) as sequence,
  event_id, ts, event_type as kind, user_id, value, props from events"""
    return f"log as ({d.pick('select * from stored_log', worked_out)})"


@C.sql
def events_read_range(d):
    return f"with {log(d)} select epoch, sequence, event_id, kind from log where epoch = 2 and sequence > 100 order by sequence limit 100"


@C.sql
def events_kind_filter(d):
    """The cursor moves over rows that the filter hides."""
    return f"""with {log(d)}, page as (select * from log where epoch = 1 and sequence between 1 and 500)
select kind, count(*) as n, max(event_id) as last_id, (select max(sequence) from page) as cursor_at from page where kind in ('click', 'error') group by kind"""


@C.sql
def events_authorised(d):
    return f"""with {log(d)}, grants as (select c_custkey as user_id from customer where c_nationkey < 5)
select epoch, {d.count_if('g.user_id is not null')} as visible, count_if(g.user_id is null) > 0 as filtered, max(case when g.user_id is not null then sequence end) as last_visible
from log l left join grants g on l.user_id = g.user_id group by epoch"""


@C.sql
def events_gap_snapshot(d):
    """Below the retention watermark: a gap, and the latest visible state of every subject."""
    return f"""with {log(d)}, mark as (select max(sequence) as upto from log where epoch = 1 and sequence <= 700)
select user_id, count(*) as revision, max(sequence) as at_sequence, (select upto from mark) as gap_to from log where epoch = 1 and sequence <= (select upto from mark) group by user_id"""


@C.sql
def events_epoch_change(d):
    """A closed epoch's tail beyond what is vouched for is not delivered."""
    return f"""with {log(d)}, epochs as (select epoch, cast(max(sequence) - 5 as bigint) as vouched, epoch < (select max(epoch) from log) as closed from log group by epoch)
select l.epoch, count(*) as delivered, max(l.sequence) as last_sequence from log l join epochs e on l.epoch = e.epoch where not e.closed or l.sequence <= e.vouched group by l.epoch"""


@C.sql
def events_retain_last_n(d):
    """The last 1,000 across epochs; the highest of the others is the watermark."""
    return f"""with {log(d)}, ends as (select epoch, max(sequence) as n from log group by epoch),
after as (select epoch, n, cast(coalesce(sum(n) over (order by epoch desc rows between unbounded preceding and 1 preceding), 0) as bigint) as later from ends),
cut as (select epoch, greatest(0, n - greatest(0, 1000 - later)) as upto from after)
select l.epoch, count(*) as kept, min(l.sequence) as first_kept, max(c.upto) as watermark from log l join cut c on l.epoch = c.epoch where l.sequence > c.upto group by l.epoch"""


@C.sql
def events_gaps(d):
    return f"""with {log(d)}, kept as (select * from log where event_id % 97 <> 3)
select epoch, sequence as before_gap, next_sequence from (select epoch, sequence, lead(sequence) over (partition by epoch order by sequence) as next_sequence from kept) z where next_sequence - sequence > 1"""


@C.sql
def subject_snapshot_asof(d):
    return f"""with {log(d)}, s as (select kind, user_id, cast(max(event_id) as bigint) as last_id, count(*) as revision from log where epoch <= 2 group by kind, user_id)
select s.kind, s.user_id, s.revision, l.props from s join log l on s.last_id = l.event_id"""


@C.sql
def subject_latest_revision(d):
    return f"""select event_type as kind, user_id, count(*) as revision, {d.pick('max_by', 'arg_max')}(props, event_id) as value from events group by event_type, user_id"""


@C.sql
def command_dedupe_replay(d):
    """The first of a principal's equal commands in a day applies; the others replay its result."""
    key = f"user_id, concat(event_type, ':', props), {d.day('ts')}"
    return f"""select event_id, first_value(event_id) over w as applied_by, row_number() over w > 1 as replay from events
window w as (partition by {key} order by event_id rows between unbounded preceding and current row)"""


@C.sql
def precondition_failures(d):
    """A command names the revision it expects; it fails unless that is the subject's revision just before."""
    return f"""with r as (select event_id, user_id, cast(row_number() over (partition by user_id order by event_id) - 1 as bigint) as revision, cast({d.json('props', 'k')} as bigint) as k from events)
select event_id, revision, revision - k % 3 as expected from r where k % 3 <> 0"""


@C.spark("""select event_type, count(*) as seen, count(*) filter (before is null or before <> props) as revisions from (
  select event_type, props, lag(props) over (partition by event_type order by event_id) as before from events) z group by event_type""")
def capability_reconcile(spark, sf_dir):
    """A revision is added whenever a capability's value differs from the one before. There are few capabilities: rows are numbered in order over all
    tasks, and each is joined with the one before it."""
    rows = numbered(table(spark, sf_dir, "events").select("event_type", "event_id", "props"), "event_type", "event_id")
    before = rows.select("event_type", (F.col("number") + 1).alias("number"), F.col("props").alias("before"))
    moved = ~F.col("props").eqNullSafe(F.col("before"))
    return rows.join(before, ["event_type", "number"], "left").groupBy("event_type").agg(F.count("*").alias("seen"), F.count_if(moved).alias("revisions"))


def ledger(d) -> str:
    return f"""ledger as (select event_id as id, user_id as job, cast(round(value * 100) as bigint) as tokens, {d.seconds('ts')} as seconds, ts,
  case event_type when 'purchase' then 'usage' when 'click' then 'reservation' when 'view' then 'unknown' when 'error' then 'not_sent' else 'note' end as kind from events)"""


SPENT = "kind in ('reservation', 'usage', 'unknown', 'provider_exhausted', 'not_sent')"


@C.sql
def ledger_rolling_5h(d):
    return f"""with {ledger(d)} select id, job, cast(sum(case when {SPENT} then tokens else 0 end) over (partition by job order by seconds range between 17999 preceding and current row) as bigint) as spent from ledger"""


@C.sql
def ledger_month(d):
    return f"with {ledger(d)} select {d.month('ts')} as month, cast(sum(tokens) as bigint) as spent from ledger where {SPENT} group by {d.month('ts')}"


@C.sql
def ledger_job_run(d):
    return f"with {ledger(d)} select job, cast(sum(tokens) as bigint) as spent, count(*) as calls from ledger where {SPENT} group by job"


@C.sql
def ledger_reconcile_join(d):
    return f"""with {ledger(d)}, calls as (select event_id as reservation, value from events where value >= 50)
select l.id, l.tokens, cast(round(c.value * 90) as bigint) as billed, greatest(0, cast(round(c.value * 90) as bigint) - l.tokens) as overrun from ledger l join calls c on l.id = c.reservation where l.kind = 'reservation'"""


@C.sql
def ledger_input_charged(d):
    """Null unless every attempt of the job reported."""
    return f"""with {ledger(d)} select job, case when bool_and(kind <> 'unknown') then cast(sum(tokens) as bigint) end as input_charged, cast(sum(tokens) as bigint) as charged from ledger where {SPENT} group by job"""


@C.sql
def investigation_budget(d):
    """Distinct questions up to three a job, in order of first sight; a repeated one is free."""
    return f"""with firsts as (select user_id, props, min(event_id) as first_id from events where event_type = 'view' group by user_id, props),
k as (select *, row_number() over (partition by user_id order by first_id) as nth from firsts)
select e.event_id, k.nth <= 3 as asked, e.event_id <> k.first_id as repeated from events e join k on e.user_id = k.user_id and e.props = k.props where e.event_type = 'view'"""


@C.sql
def record_ambiguity(d):
    return f"""select {d.sha256('props')} as question, count(*) as records, count(distinct event_type) as answers, count(distinct event_type) > 1 as ambiguous from events group by props"""


@C.sql
def answer_classify(d):
    k = f"cast({d.json('props', 'k')} as bigint)"
    return f"""select outcome, count(*) as n from (select case when event_type = 'error' and {k} % 2 = 0 then 'quota' when event_type = 'error' then 'failed' when {k} is null then 'unusable'
  when {k} < 10 then 'truncated' when {k} % 10 = 0 then 'repairable' else 'answer' end as outcome from events) z group by outcome"""


@C.sql
def count_admission(d):
    """A local bound first; a count is asked for only where a tighter figure could admit."""
    return f"""with b as (select doc_id, {d.octets('text')} + 8 + 1024 as bound, {d.octets('text')} as bytes, n_chars from documents),
c as (select *, case when n_chars < bytes / 8 then bound else least(n_chars, bound) end as believed from b)
select doc_id, bound, case when bound <= 3000 then 'admitted' when believed <= 3000 then 'admitted_by_count' else 'refused' end as verdict from c"""


@C.sql
def instants(d):
    plus = d.pick("timestampadd(second, 3600, ts)", "ts + interval 3600 second")
    return f"select event_id, {d.instant('ts')} as at_instant, {d.instant(plus)} as later, {d.seconds('ts')} as seconds, {d.month('ts')} as month from events"


@C.sql
def shared_job_coalescing(d):
    """Requests with the same principal, basis and items join one job: the first."""
    return f"""select {d.sha256("concat_ws('|', cast(user_id as string), event_type, props)")} as job_key, min(event_id) as job, count(*) as requests from events group by user_id, event_type, props"""
