"""Byte-level BPE by a hierarchical-bitmap rank queue.

Each match of the pattern is encoded by itself. A match that is a token is that token; else its bytes form a
linked list and every adjacent pair that is a token waits in the bucket of that token's rank. Three levels of
64-bit words mark the buckets in use: find-first-set, level by level, picks the least rank, whose places are merged
from the left. A merge changes the pairs on both sides; what they leave in other buckets is stale and skipped
when met, and if it makes a pair of lesser rank, the rest of the bucket goes back. The matches of a slice of texts
that are not known yet share one queue, so that a bucket is found once for all of them.

Defined cases: a null text is empty and has no ids; bytes that are no token of one byte cannot occur (a vocabulary
holds all 256); repeated rows give equal rows; an empty table gives an empty result; only doc_id and text are
read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents, whole_text

#: Stretches in a memo before the next one is begun, of which two are kept; bytes of text, or of ids, that a worker has as Python objects at a time.
MEMO, SLICE = 350_000, 1 << 20
NONE = -1


class RankQueue:
    """Buckets of places by rank; take() gives the least rank in use and its bucket."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int] | None] = [None] * ranks
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0

    def put(self, rank: int, places: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = places
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def take(self) -> tuple[int, list[int]]:
        """Of a queue whose top is not zero. The bucket leaves the queue."""
        top = self.top
        i = (top & -top).bit_length() - 1
        mid = self.mid[i]
        j = i << 6 | (mid & -mid).bit_length() - 1
        low = self.low[j]
        rank = j << 6 | (low & -low).bit_length() - 1
        low = self.low[j] = low & (low - 1)
        if not low:
            mid = self.mid[i] = mid & (mid - 1)
            if not mid:
                self.top = top & (top - 1)
        bucket, self.buckets[rank] = self.buckets[rank], None
        return rank, bucket


class Bpe:
    """Ids of many texts at a time, with a bounded memo of the stretches between single spaces.

    For patterns that find a match again, whole, when it stands alone, as those of the GPT-2 family do.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        self.pairs = np.full(1 << 16, NONE, np.int32)  # ranks of the tokens of two bytes
        self.bytes = np.zeros(1 << 8, np.int32)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
            elif len(token) == 1:
                self.bytes[token[0]] = rank
        self.queue = RankQueue(len(self.tokens))
        self.find = regex.compile(pattern).findall
        self.odd = re.compile(r"\s\s|\0").search
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the memo before it; what is met again moves on
        self.dtype = "<u2" if len(self.tokens) <= 1 << 16 else "<u4"

    def merge(self, matches: list[bytes]) -> list[bytes]:
        """Ids of each match, none of them empty. The matches lie end to end and share one queue; no pair reaches over an edge."""
        data = b"".join(matches)
        n, sizes = len(data), np.fromiter(map(len, matches), np.int64, len(matches))
        starts = np.cumsum(sizes) - sizes
        raw = np.frombuffer(data, np.uint8).astype(np.int32)
        edges = np.zeros(n + 1, np.uint8)
        edges[starts] = edges[n] = 1
        first = np.full(n, NONE, np.int32)
        first[:-1] = self.pairs[raw[:-1] << 8 | raw[1:]]
        first[edges[1:] == 1] = NONE
        edge, waits, ids = edges.tobytes(), first.tolist(), self.bytes[raw].tolist()  # waits: rank of the pair that begins at a place, NONE if none or gone
        places = list(range(n + 1))
        after, before = places[1:], [NONE, *places[:-1]]  # of a place, the next one and the one before

        queue, get, buckets = self.queue, self.ranks.get, self.queue.buckets
        put, take = queue.put, queue.take
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        kinds, at = np.unique(first[order], return_index=True)
        for rank, bucket in zip(kinds.tolist(), np.split(order, at[1:])):
            put(rank, bucket.tolist())
        while queue.top:
            rank, bucket = take()
            bucket.sort()
            for at, i in enumerate(bucket):
                if waits[i] != rank:
                    continue  # stale
                j = after[i]
                k = after[i] = after[j]
                waits[j] = waits[i] = ids[j] = NONE
                ids[i] = least = rank
                if not edge[k]:
                    before[k] = i
                    if (new := get(data[i : after[k]])) is not None:
                        waits[i] = new
                        if (there := buckets[new]) is None:
                            put(new, [i])
                        else:
                            there.append(i)
                        if new < least:
                            least = new
                if not edge[i]:
                    h = before[i]
                    waits[h] = NONE
                    if (new := get(data[h:k])) is not None:
                        waits[h] = new
                        if (there := buckets[new]) is None:
                            put(new, [h])
                        else:
                            there.append(h)
                        if new < least:
                            least = new
                if least < rank:  # comes before the rest of this bucket
                    if rest := bucket[at + 1 :]:
                        put(rank, rest)
                    break
        left = np.array(ids, np.int32)
        ends = np.cumsum(left >= 0)[starts + sizes - 1] * np.dtype(self.dtype).itemsize
        out = left[left >= 0].astype(self.dtype).tobytes()
        return [out[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _learn(self, stretches: set[str]) -> None:
        found = {s: self.find(s) for s in stretches}
        ranks, memo, older, known, rest = self.ranks, self.memo, self.older, {}, []
        width = np.dtype(self.dtype).itemsize
        for m in set().union(*found.values()):
            if (ids := memo.get(m) or older.get(m)) is not None:
                known[m] = ids
            elif (rank := ranks.get(match := m.encode())) is not None:
                known[m] = rank.to_bytes(width, "little")
            else:
                rest.append((m, match))
        if rest:
            known.update(zip([m for m, _ in rest], self.merge([match for _, match in rest])))
        memo.update((s, known[f[0]] if len(f) == 1 else b"".join([known[m] for m in f])) for s, f in found.items())

    def _cut(self, text: str) -> list[str]:
        if self.odd(text):  # cuts at single spaces and newlines hold only where white space stands alone
            return [text]
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of self.dtype."""
        if len(self.memo) > MEMO:
            self.older, self.memo = self.memo, {}
        memo, older, cuts = self.memo, self.older, list(map(self._cut, texts))
        new = set().union(*cuts) - memo.keys()
        again = new & older.keys()
        memo.update((s, older[s]) for s in again)
        new -= again
        if new:
            self._learn(new)
        out = [b"".join(map(memo.__getitem__, cut)) for cut in cuts]
        for s in new:
            if len(s) >= 64:
                del memo[s]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, about SLICE bytes of a column or one row at a time."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), len(ends)]
    for a, b in zip(at, at[1:]):
        if a < b:
            yield batch.slice(a, b - a)


_loaded: dict[tuple[str, str], Bpe] = {}


def _bpe(path: str, pattern: str) -> Bpe:
    """One for each Python worker: its memo outlives a task."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe(path, pattern)
    return _loaded[path, pattern]


def _encode_batches(batches: Iterator[pa.RecordBatch], bpe: Bpe) -> Iterator[pa.RecordBatch]:
    for part in (x for batch in batches for x in _slices(batch, 1)):
        ids = [np.frombuffer(x, bpe.dtype) for x in bpe.encode_all(part.column(1).to_pylist())]
        yield pa.record_batch(
            [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
            names=["doc_id", "n_tokens", "ids"],
        )


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids (little-endian 32-bit). ranks: path of a tiktoken file, on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encode_batches(batches, _bpe(ranks, pattern))

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Adds `decoded`, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks, pattern)
        for part in (x for batch in batches for x in _slices(batch, 2)):
            out = [bpe.decode(np.frombuffer(x, "<u4")) for x in part.column(2).to_pylist()]
            yield pa.record_batch([*part.columns, pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    both = decode(encode(documents(spark, sf_dir), ranks, P.PATTERN), ranks, P.PATTERN)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
