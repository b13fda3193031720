"""A ledger of spending: admission under ceilings, settlement, and totals.

Admission is a fold: a refusal spends nothing, so whether a request is admitted depends on those before it. It runs store by store, each
in order, streaming over sorted partitions; a store's rows never stand in memory together, only the spends of its window and totals by job.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.constants import ROLLING_SECONDS


@dataclass(frozen=True)
class Ceilings:
    request: int = 9_500
    job: int = 200_000
    window: int = 20_000
    month: int = 2_000_000
    run: int | None = None


def admissions(requests: DataFrame, ceilings: Ceilings = Ceilings()) -> DataFrame:
    """requests: store, id (their order in the store), job, seconds, month, estimate, stop (a reason that the store is stopped for, or null).
    (store, id, outcome, spent): the stop, then ceilings in the order request, job, window, month, run; outcome reservation if none applies."""
    c, window_seconds = ceilings, ROLLING_SECONDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, started = None, False
        for batch in batches:
            out: list[tuple] = []
            for name, id_, job, seconds, month, estimate, stop in zip(*(x.to_pylist() for x in batch.columns)):
                if not started or name != store:
                    store, started = name, True
                    jobs: dict = defaultdict(int)
                    months: dict = defaultdict(int)
                    recent: deque = deque()
                    in_window = total = 0
                # the window has no upper bound: rows leave it by age only
                while recent and recent[0][0] <= seconds - window_seconds:
                    in_window -= recent.popleft()[1]
                if stop is not None:
                    outcome = stop
                elif estimate > c.request:
                    outcome = "per_request"
                elif jobs[job] + estimate > c.job:
                    outcome = "per_job"
                elif in_window + estimate > c.window:
                    outcome = "window_exhausted"
                elif months[month] + estimate > c.month:
                    outcome = "month_exhausted"
                elif c.run is not None and total + estimate > c.run:
                    outcome = "run_ceiling"
                else:
                    outcome = "reservation"
                    jobs[job] += estimate
                    months[month] += estimate
                    recent.append((seconds, estimate))
                    in_window += estimate
                    total += estimate
                out.append((name, id_, outcome, estimate if outcome == "reservation" else 0))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["store", "id", "outcome", "spent"])

    rows = requests.select(F.col("store").cast("string"), F.col("id").cast("long"), F.col("job").cast("string"), F.col("seconds").cast("long"), "month", F.col("estimate").cast("long"), "stop")
    return rows.repartition("store").sortWithinPartitions("store", "seconds", "id").mapInArrow(run, "store string, id long, outcome string, spent long")


def settled(reservations: DataFrame, settlements: DataFrame) -> DataFrame:
    """reservations: id, job, estimate. settlements: id, at, how (usage, unknown, not_sent, provider_exhausted), tokens. Each reservation becomes its first
    settlement, later ones change nothing; a usage above the estimate adds an overrun row. (id, job, kind, tokens, estimate)"""
    first = settlements.groupBy("id").agg(F.min_by(F.struct("how", "tokens"), "at").alias("s"))
    rows = reservations.join(first, "id", "left")
    kind = F.coalesce("s.how", F.lit("reservation"))
    tokens = F.when(kind == "usage", F.col("s.tokens")).when(kind.isin("not_sent", "provider_exhausted"), 0).otherwise(F.col("estimate"))
    out = rows.select("id", "job", kind.alias("kind"), tokens.alias("tokens"), "estimate")
    over = out.filter("kind = 'usage' and tokens > estimate").withColumn("kind", F.lit("overrun"))
    return out.unionByName(over)


SPENT = ("reservation", "usage", "unknown", "provider_exhausted", "not_sent")


def spend(ledger: DataFrame, now: int, month: str) -> DataFrame:
    """ledger: store, job, kind, tokens, seconds, month. Per store and job what counts against each ceiling at an instant: job_spent, and of the whole store
    window_spent (no upper bound), month_spent and run_spent."""
    spent = ledger.filter(F.col("kind").isin(*SPENT))
    jobs = spent.groupBy("store", "job").agg(F.sum("tokens").alias("job_spent"))
    store = spent.groupBy("store").agg(
        F.coalesce(F.sum(F.when(F.col("seconds") > now - ROLLING_SECONDS, F.col("tokens"))), F.lit(0)).alias("window_spent"),
        F.coalesce(F.sum(F.when(F.col("month") == month, F.col("tokens"))), F.lit(0)).alias("month_spent"), F.sum("tokens").alias("run_spent"),
    )
    return jobs.join(store, "store")


def counted_admission(calls: DataFrame, ceiling: int) -> DataFrame:
    """calls: call, body_bytes, messages, generation, count (a provider's figure, or null). The local bound first; a count is asked for only where it was
    refused, and believed unless below an eighth of the body, when the bound stands. Adds bound, believed, outcome."""
    bound = F.col("body_bytes") + 8 * F.col("messages") + F.col("generation") + 1024
    believed = F.when(F.col("count").isNull() | (F.col("count") < F.col("body_bytes") / 8), bound).otherwise(F.least(F.col("count") + F.col("generation"), bound))
    outcome = F.when(bound <= ceiling, "admitted").when(F.col("count").isNotNull() & (believed <= ceiling), "admitted_by_count").otherwise("refused")
    return calls.select("call", bound.alias("bound"), believed.alias("believed"), outcome.alias("outcome"))
