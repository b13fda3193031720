"""Reading the event log: one page with gaps, epoch changes, what may be seen, and a cursor to go on from."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.eventlog import stored

__all__ = ["Page", "Position", "read", "retained", "snapshot", "stored"]
MOST, DEFAULT = 1000, 100


@dataclass(frozen=True, order=True)
class Position:
    """The next place to be read: an epoch and a sequence in it."""

    epoch: int
    sequence: int

    def cursor(self, stream: str) -> str:
        return f"c1.{stream}.{self.epoch}.{self.sequence}"

    @staticmethod
    def parse(cursor: str, stream: str) -> Position | None:
        """None for text that is no cursor, or that of another stream."""
        m = re.fullmatch(r"c1\.(.+)\.([0-9]{1,15})\.([0-9]{1,15})", cursor)
        return Position(int(m[2]), int(m[3])) if m and m[1] == stream else None


@dataclass
class Page:
    """items: events, gaps and epoch changes, in order. filtered: whether something was hidden. too_large: the first item alone is over the budget."""

    items: list[dict]
    next: Position
    filtered: bool = False
    too_large: bool = False
    fields: str = field(default="epoch long, sequence long, item string, event_id long, kind string", repr=False)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(i.get(f.split()[0]) for f in self.fields.split(", ")) for i in self.items], self.fields)


def retained(log: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The last n events across epochs, and the watermark: the greatest place among the others (no row if there are none)."""
    counts = log.groupBy("epoch").agg(F.count("*").alias("n"), F.max("sequence").alias("last")).orderBy(F.col("epoch").desc()).collect()  # one row an epoch
    left, cut = n, []
    for r in counts:
        keep = min(left, r["n"])
        cut.append((r["epoch"], r["last"] - keep))
        left -= keep
    spark = log.sparkSession
    bounds = spark.createDataFrame(cut, "epoch long, upto long")
    kept_ = log.join(F.broadcast(bounds), "epoch").filter(F.col("sequence") > F.col("upto")).drop("upto")
    gone = bounds.filter("upto > 0").orderBy(F.col("epoch").desc()).limit(1).select("epoch", F.col("upto").alias("sequence"))
    return kept_, gone


def snapshot(log: DataFrame, visible: Column) -> DataFrame:
    """Every subject that may be seen as it is now: kind, user_id, revision, last (its last place)."""
    return log.filter(visible).groupBy("kind", "user_id").agg(F.count("*").alias("revision"), F.max(F.struct("epoch", "sequence")).alias("last"))


def read(log: DataFrame, start: Position, visible: Column | None = None, kinds: tuple[str, ...] = (), limit: int = DEFAULT, byte_budget: int = 1 << 20, vouched: dict[int, int] | None = None, watermark: Position | None = None) -> Page:
    """One page from `start` on. vouched: closed epochs, how far each is vouched for. watermark: the greatest place that was discarded.

    Where events of an epoch are missing because they were discarded, a gap up to the head stands for them, and snapshot() for what it hides. A closed epoch
    ends in an epoch change; what lies beyond its vouched end is never delivered. Hidden events and kinds not asked for are passed over, which `filtered`
    tells; the cursor moves over them. An event that no longer fits the budget is left for the next page. At most `limit` + 1 rows come to the driver
    for each epoch that the page touches.
    """
    limit, vouched = max(1, min(limit, MOST)), vouched or {}
    ends = {r["epoch"]: (r["first"], r["last"]) for r in log.groupBy("epoch").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last")).collect()}
    if not ends:
        return Page([], start)
    current = max(ends)
    head = Position(current, ends[current][1])
    seen = F.lit(True) if visible is None else visible
    wanted = seen & F.col("kind").isin(*kinds) if kinds else seen
    page, at, used = Page([], start), start, 0

    def add(item: dict, size: int) -> bool:
        nonlocal used
        if used + size > byte_budget:
            return False
        used += size
        page.items.append(item)
        return True

    while at.epoch <= current and len(page.items) < limit:
        upto = vouched.get(at.epoch)
        closed = upto is not None and at.epoch < current
        change = {"epoch": at.epoch, "sequence": upto, "item": "epoch_change"}
        if closed and at.sequence > upto:
            if not add(change, 64):
                break
            at = Position(at.epoch + 1, 1)
            continue
        first, last = ends.get(at.epoch, (None, 0))
        if watermark is not None and (first is None or at.sequence < first) and at <= watermark:
            if visible is not None and not log.filter(~seen).isEmpty():
                page.filtered = True  # a subject that the snapshot leaves out
            if not add({"epoch": at.epoch, "sequence": at.sequence, "item": "gap"}, 64):
                break
            at = Position(head.epoch, head.sequence + 1)
            continue
        end = last if upto is None else min(last, upto)
        span = log.filter((F.col("epoch") == at.epoch) & (F.col("sequence") >= at.sequence) & (F.col("sequence") <= end))
        room = limit - len(page.items)
        rows = span.filter(wanted).select("epoch", "sequence", "event_id", "kind", F.octet_length("props").alias("size")).orderBy("sequence").limit(room + 1).collect()
        stop = None
        for k, r in enumerate(rows):
            if k == room:
                stop = Position(at.epoch, rows[k - 1]["sequence"] + 1)
                break
            if not add({"epoch": r["epoch"], "sequence": r["sequence"], "item": "event", "event_id": r["event_id"], "kind": r["kind"]}, r["size"]):
                page.too_large = not page.items
                stop = Position(at.epoch, r["sequence"])
                break
        reached = stop.sequence if stop else end + 1
        if not page.filtered and not span.filter((F.col("sequence") < reached) & ~wanted).isEmpty():
            page.filtered = True
        at = stop or Position(at.epoch, max(at.sequence, end + 1))
        if stop or not closed or len(page.items) >= limit:
            break
        if not add(change, 64):
            break
        at = Position(at.epoch + 1, 1)
    page.next = at
    return page
