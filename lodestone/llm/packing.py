"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Documents are encoded and cut into pieces of at most CAPACITY ids. Pieces of one length are interchangeable, and
so are sequences with the same gap that were filled alike: both are held as runs (size, first rank or sequence, number), which
is what makes a round small, however many documents there are. A round range-sorts runs of pieces and of gaps together
by size, matches each run of pieces with its successor among the gaps by descending sweeps over the ranges, resolves
conflicts by rank (the longest first, then the lower rank), and writes the matches, the updated gaps and what is
left, from which the next round starts. Ranking all pieces within their length and handing each its sequence and
offset are joins over the pieces themselves. The number of rounds depends on the lengths, not on the documents:
about a dozen.

Defined cases: a null or empty text is its end id alone; equal lengths are ranked by task and place within it;
repeated rows are packed each; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import documents, whole_text, written
from lodestone.llm.tokens import TEXTS, encoder

CAPACITY, END_ID = 2048, 0
#: Ranges of a round; lengths of a band down to this part of its longest; rows of slots that are broadcast, at most.
RANGES, BAND, MOST_BROADCAST = 8, 4, 200_000
#: Kinds of runs, in the order that a sweep takes them at equal size.
GAP, PIECE, SLOT = 0, 1, 2
RUNS_DDL = "kind int, size long, lo long, n long, first long, offset long"
RUNS = pa.schema([("kind", pa.int32())] + [(c, pa.int64()) for c in ("size", "lo", "n", "first", "offset")])
PIECES = "part int, doc_id long, piece int, start long, length long, local_rank long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids (little-endian 32-bit), and its place: part, local_rank.

    local_rank counts the pieces of its length in the same task, so (part, local_rank) ranks them without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        seen = [0] * (capacity + 1)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                rows: list[list] = [[] for _ in range(6)]
                for doc, ids in zip(batch.column(0).to_pylist(), encode.encode(batch.column(1))):
                    ids = np.append(np.frombuffer(ids, encode.dtype).astype("<u4"), np.uint32(END_ID))
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        for column, value in zip(rows, (doc, k, start, len(own), seen[len(own)], own.tobytes())):
                            column.append(value)
                        seen[len(own)] += 1
                n = len(rows[0])
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch(
                    [pa.array([part] * n, pa.int32()), *(pa.array(v, t) for v, t in zip(rows, types))],
                    names=["part", "doc_id", "piece", "start", "length", "local_rank", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, PIECES)


def sweep(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """One descending sweep over a range of runs in order of size, a gap before pieces of its size.

    Gaps passed so far lie on a stack, the smallest on top, so each run of pieces meets its successor first: the
    smallest gap that holds it. Runs that want the same gap are served in order, longer pieces first, then by rank;
    a sequence takes as many pieces of the run as fit. Gaps that a match leaves are used from the next round on.
    """
    stack: list[list[int]] = []
    for batch in batches:
        out = []
        for kind, size, lo, n, first, offset in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == GAP:
                stack.append([size, lo, n])
            elif kind == SLOT:
                out.append((kind, size, lo, n, first, offset))
            if kind != PIECE:
                continue
            while n and stack:
                gap, sequence, free = stack[-1]
                layers = min(n, gap // size)
                m = min(free, n // layers)
                at = capacity - gap
                out += [(SLOT, size, lo + j * m, m, sequence, at + j * size) for j in range(layers)]
                if gap > layers * size:
                    out.append((GAP, gap - layers * size, sequence, m, None, None))
                lo, n = lo + layers * m, n - layers * m
                stack[-1][1:] = [sequence + m, free - m]
                if free == m:
                    stack.pop()
            if n:
                out.append((PIECE, size, lo, n, None, None))
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 6, RUNS)], schema=RUNS)
    out = [(GAP, size, lo, n, None, None) for size, lo, n in stack]
    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 6, RUNS)], schema=RUNS)


def matched(runs: DataFrame, capacity: int = CAPACITY, ranges: int = RANGES) -> DataFrame:
    """One round: the runs are range-sorted by size and each range is swept by itself; what finds no partner within its
    range meets the rest in a second sweep. A range's gaps are too small for the pieces of the ranges above it, so
    the two sweeps match as one over everything would; the second one has at most two runs for each size left."""

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sweep(batches, capacity)

    order = [F.col("size").desc(), F.col("kind"), F.col("lo")]
    near = runs.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(swept, RUNS_DDL)
    return near.repartition(1).sortWithinPartitions(*order).mapInArrow(swept, RUNS_DDL)


def slots(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """counts: (length, n), a row for each length. (size, lo, n, first, offset): the pieces of that length
    ranked lo to lo + n - 1 go to the sequences from `first` on, one each, at that offset.

    Each round is written and read again. Lengths come in bands, the longest first, so that short pieces are left for
    the gaps that long ones leave. Sequences are opened, as many as the waiting pieces need by themselves, when
    a band begins with too little room or a round matches nothing.
    """
    spark = counts.sparkSession
    none = F.lit(None).cast("long")
    total = counts.agg(F.coalesce(F.sum(F.col("length") * F.col("n")), F.lit(0))).first()[0]
    pieces_ = counts.select(F.lit(PIECE).alias("kind"), F.col("length").alias("size"), F.lit(0).cast("long").alias("lo"), "n", none.alias("first"), none.alias("offset"))

    def opened(first: int, tokens: int) -> tuple[DataFrame, int]:
        n = -(-tokens // capacity)
        return spark.createDataFrame([(GAP, capacity, first, n, None, None)], RUNS_DDL), first + n

    gaps, sequences_ = opened(0, total)
    done = spark.createDataFrame([], RUNS_DDL)
    top = capacity + 1
    while top > 1:
        low = -(-top // BAND) if top > BAND else 1
        runs = gaps.unionByName(pieces_.filter((F.col("size") < top) & (F.col("size") >= low)))
        while True:
            runs = written(matched(runs, capacity), "round")
            waiting = F.when(F.col("kind") == PIECE, F.col("size") * F.col("n"))
            left, hits = runs.agg(F.coalesce(F.sum(waiting), F.lit(0)), F.count_if(F.col("kind") == SLOT)).first()
            done = done.unionByName(runs.filter(F.col("kind") == SLOT))
            runs = runs.filter(F.col("kind") != SLOT)
            if not left:
                break
            if not hits:
                more, sequences_ = opened(sequences_, left)
                runs = runs.unionByName(more)
        gaps, top = runs, low
    return done.select("size", "lo", "n", "first", "offset")


def place(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """table: rows of pieces(), without ids, written once (its order must not change). Adds sequence_id and offset."""
    here = written(table.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    before = here.select(
        F.col("part").alias("part_"), F.col("length").alias("length_"),
        (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"),
    )
    places = written(slots(here.groupBy("length").agg(F.sum("n").alias("n")), capacity), "slots")
    if places.count() <= MOST_BROADCAST:  # a few for each of at most `capacity` lengths; else the join is by length
        places = F.broadcast(places)
    ranked = table.join(before, (table["part"] == before["part_"]) & (table["length"] == before["length_"])).withColumn("rank", F.col("local_rank") + F.col("before"))
    own = F.col("rank") - places["lo"]
    placed = ranked.join(places, (ranked["length"] == places["size"]) & (own >= 0) & (own < places["n"]))
    kept = [F.col(c) for c in table.columns if c not in ("part", "local_rank")]
    return placed.select(*kept, (places["first"] + own).alias("sequence_id"), places["offset"])


def sequences(table: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids. A group is one sequence, `capacity` ids at most."""
    rows = table.select("doc_id", "piece", "ids").join(placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    order = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return rows.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(order, lambda x: x["ids"]), "")).alias("ids"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece with its place and the checksum of its ids, read back from the written pieces."""
    table = written(pieces(docs, tokenizer, capacity), "pieces")
    light = table.select("part", "doc_id", "piece", "start", "length", "local_rank", F.crc32("ids").alias("ids_crc32"))
    return place(light, capacity)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), word_tokenizer())
