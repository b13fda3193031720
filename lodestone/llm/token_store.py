"""Token ids in Re-Pair grammar shards.

Documents in ascending doc_id order are encoded, an end id is put after each, and the ids are cut into shards.
In a shard, frequent pairs of adjacent ids are replaced by new symbols (nonterminals), again and again, until no
pair occurs LEAST_PAIRS times: Re-Pair, a round replacing all pairs that occur at least a quarter as often as the commonest.
A shard is one row: its documents and their lengths, the rules (a left and right symbol each), the length that
each rule expands to, and the remaining sequence. The expansion lengths tell where each symbol's ids stand, so any
range of ids is decoded without the rest (`Shard.ids`; `read` takes documents and ranges).

Defined cases: a null or empty text is its end id alone; rows that share a doc_id follow each other in order of
their text; a text longer than a shard makes one shard; an empty table makes no shard; only doc_id and text
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import documents, scratch, whole_text
from lodestone.llm.tokens import TEXTS, encoder

END_ID = 0
#: Ids of a shard, about; least number of times that a replaced pair occurs in it.
SHARD_IDS, LEAST_PAIRS = 1 << 18, 48
#: A round replaces all pairs that occur at least 1 / STEP as often as the commonest.
STEP = 4
#: Bits of the hash that counts pairs, and its odd multipliers for left and right, used by turns.
SLOT_BITS, ODD = 16, ((0x9E3779B1, 0x85EBCA77), (0xC2B2AE3D, 0x27D4EB2F), (0x165667B1, 0x9E3779B9))
FIELDS = [
    ("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("terminals", pa.int32()),
    ("rules", pa.binary()), ("lengths", pa.binary()), ("sequence", pa.binary()),
]
DDL = "part int, shard int, start long, n_ids long, doc_ids array<long>, doc_lens array<long>, terminals int, rules binary, lengths binary, sequence binary"


def _frequent(seq: np.ndarray, least: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a frequent pair begins, their pairs' numbers, and the pairs (as left << 32 | right), commonest first.

    Pairs are counted by a hash of SLOT_BITS bits, and one pair stands for each slot; those it hides are met in a
    later round, which hashes otherwise. Only when no pair that stands for its slot is frequent are the others sorted.
    """
    left, right = ODD[salt % len(ODD)]
    slot = ((seq[:-1] * np.uint32(left) ^ seq[1:] * np.uint32(right)) >> np.uint32(32 - SLOT_BITS)).astype(np.intp)
    places = np.nonzero((np.bincount(slot, minlength=1 << SLOT_BITS) >= least)[slot])[0]
    slot, pairs = slot[places], seq[places].astype(np.uint64) << np.uint64(32) | seq[places + 1]
    holder = np.zeros(1 << SLOT_BITS, np.uint64)
    holder[slot] = pairs
    own = holder[slot] == pairs
    count = np.bincount(slot[own], minlength=1 << SLOT_BITS)
    if count.max() >= least:
        places, number = places[own], slot[own]
    else:
        holder, number, count = np.unique(pairs, return_inverse=True, return_counts=True)
        if not len(count) or count.max() < least:
            return places[:0], places[:0], pairs[:0]
    chosen = np.nonzero(count >= max(least, count.max() // STEP))[0]
    chosen = chosen[np.argsort(-count[chosen], kind="stable")]
    rank = np.full(len(count), -1)
    rank[chosen] = np.arange(len(chosen))
    rank = rank[number]
    keep = rank >= 0
    return places[keep], rank[keep], holder[chosen]


def compress(ids: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules as rows of left and right, expansion lengths of the rules, sequence)."""
    seq, rules, lengths = ids.astype(np.uint32), [], np.ones(terminals, np.int64)
    round_ = 0
    while len(seq) > 1:
        places, number, pairs = _frequent(seq, LEAST_PAIRS, round_)
        if not len(pairs):
            break
        # of places in a row, which would overlap, every second one
        first = np.concatenate([[True], np.diff(places) > 1])
        at = np.arange(len(places))
        even = (at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0
        places, number = places[even], number[even]
        left, right = (pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        seq[places] = len(lengths) + number
        stay = np.ones(len(seq), bool)
        stay[places + 1] = False
        seq = seq[stay]
        rules.append(np.stack([left, right], axis=1))
        lengths = np.concatenate([lengths, lengths[left] + lengths[right]])
        round_ += 1
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), lengths[terminals:], seq


def _dealt(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places starts[i] to starts[i] + lens[i] - 1 of each i, one after the other."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())


class Shard:
    """A shard's sequence, of which any range of ids can be decoded."""

    def __init__(self, seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, terminals: int):
        self.seq, self.terminals, self.lengths = seq, terminals, lengths.astype(np.int64)
        self.size = np.ones(len(seq), np.int64)
        long = seq >= terminals
        self.size[long] = self.lengths[seq[long] - terminals]
        self.end = np.cumsum(self.size)
        # every rule written out, by those before it
        self.at = np.cumsum(self.lengths) - self.lengths
        self.whole = np.zeros(int(self.lengths.sum()), np.uint32)
        spans = list(zip(self.at.tolist(), (self.at + self.lengths).tolist()))
        for (lo, hi), (left, right) in zip(spans, rules.tolist()):
            mid = lo + 1
            if left < terminals:
                self.whole[lo] = left
            else:
                s, e = spans[left - terminals]
                mid = lo + e - s
                self.whole[lo:mid] = self.whole[s:e]
            if right < terminals:
                self.whole[mid] = right
            else:
                s, e = spans[right - terminals]
                self.whole[mid:hi] = self.whole[s:e]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """ids[start:stop] of the shard: the lengths tell which symbols reach into the range, and only they are expanded."""
        n = int(self.end[-1]) if len(self.end) else 0
        stop = n if stop is None else min(stop, n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(self.end, start, "right"), np.searchsorted(self.end, stop, "left") + 1
        seq, size = self.seq[i:j], self.size[i:j]
        base = int(self.end[i] - self.size[i])
        to = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint32)
        long = seq >= self.terminals
        out[to[~long]] = seq[~long]
        out[_dealt(to[long], size[long])] = self.whole[_dealt(self.at[seq[long] - self.terminals], size[long])]
        return out[start - base : stop - base]


def shard_of(row: dict) -> Shard:
    return Shard(np.frombuffer(row["sequence"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4"), row["terminals"])


def shards(docs: DataFrame, tokenizer: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """One row for each shard; (part, shard) is the order of doc_id. tokenizer: path of a file of the tokenizers library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        terminals = encode.tokenizer.get_vocab_size()
        end = np.array([END_ID], dtype=encode.dtype).tobytes()
        shard, start, have = 0, 0, 0
        docs_, lens, held = [], [], []

        def row() -> pa.RecordBatch:
            rules, lengths, seq = compress(np.frombuffer(b"".join(held), dtype=encode.dtype), terminals)
            values = [part, shard, start, have, docs_, lens, terminals, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), seq.astype("<u4").tobytes()]
            return pa.record_batch([pa.array([v], t) for v, (_, t) in zip(values, FIELDS)], names=[k for k, _ in FIELDS])

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                for doc, ids in zip(some.column(0).to_pylist(), encode.encode(some.column(1))):
                    n = len(ids) // np.dtype(encode.dtype).itemsize + 1
                    docs_.append(doc), lens.append(n), held.append(ids + end)
                    have += n
                    if have >= shard_ids:
                        yield row()
                        shard, start, have = shard + 1, start + have, 0
                        docs_, lens, held = [], [], []
        if docs_:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, DDL)


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    # rules and sequences are little-endian 32-bit ids: zstd takes out the zero bytes
    shards(docs, tokenizer).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None, start: int = 0, stop: int | None = None) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit).

    doc_ids: only these documents, from shards that hold one of them. start, stop: of each document's ids only this
    range, which alone is decoded.
    """
    wanted = None if doc_ids is None else np.array(sorted(set(doc_ids)), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard, docs = shard_of(r), pa.array(r["doc_ids"], pa.int64())
                lens = np.array(r["doc_lens"], dtype=np.int64)
                ends = np.cumsum(lens)
                starts = ends - lens
                if wanted is None and not start and stop is None:
                    ids = shard.ids().astype("<u4").tobytes()
                    cut = [ids[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist())]
                else:
                    mine = np.arange(len(lens)) if wanted is None else np.nonzero(np.isin(docs.fill_null(-1), wanted) & np.asarray(docs.is_valid()))[0]
                    docs, lens, starts, ends = docs.take(pa.array(mine)), lens[mine], starts[mine], ends[mine]
                    cut = [shard.ids(s + start, e if stop is None else min(e, s + stop)).astype("<u4").tobytes() for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.record_batch(
                    [pa.array([r["part"]] * len(cut), pa.int32()), docs, pa.array(r["start"] + starts), pa.array(lens), pa.array(cut, pa.binary())],
                    names=["part", "doc_id", "start", "n_tokens", "ids"],
                )

    table = spark.read.schema(DDL).parquet(path)
    # one row for each task that wrote, however many documents: their running total gives every shard its place
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    if wanted is not None:
        table = table.filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(x)) for x in wanted])))
    rows = table.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids binary")
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
