"""Suffix-array dedup with sparse suffix arrays.

Only suffixes at content-selected places are kept: a word position whose K-word hash is the least of some
window of WINDOW consecutive positions. Any passage of K + WINDOW - 1 words that two texts share has such a place
in common, at the same offset. Suffixes are ordered by the hashes of their first, second and third block of
K words, then by doc_id and place; equal passages are neighbours there. Each suffix is compared with the one
before it, and texts that are neighbours somewhere are read once per pair and their matches extended word by word
to the left and the right. A suffix has one predecessor, so a passage in n texts makes n - 1 pairs.

The order looks to the right only. Where a first block occurs three times or more and is not followed by the
same words each time, a text can sort between two others whose common passage lies to its left, and copies do not
follow each other by doc_id. The places of such blocks, or the windows of MIN_WORDS words through them where these
differ, are therefore ordered once more by doc_id alone (see `windows`). So every occurrence of a repeated window
that is not the first one is compared with one of a lesser doc_id, and every word of it is in a row of its own doc_id.

The order is kept within each first block: groups are split by ranges, a hot block included, because the
neighbour across a range's edge is carried over from the range before (see `neighbours`).

A row says that n_words words from word `start` of doc_id stand from word `other_start` of other_doc_id on too; the
other text is the one with the lesser doc_id, and among rows that share a doc_id the one read first.

Defined cases: a null text is empty; texts of fewer than K words have no suffix; a match within one text
counts (never with itself at the same place); rows are texts of their own even if they share a doc_id; a null doc_id
comes after all others and is null in the result; an empty table gives an empty result; only doc_id and text are
read. Words are runs of other than ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import documents, whole_text, written

K, WINDOW = 16, 34
#: Shortest match that is reported, in words: at least K + WINDOW - 1 = 49, so that each holds a retained place.
MIN_WORDS = 50
BASE = np.uint64(0x9E3779B97F4A7C15)
#: What stands for a null doc_id inside: it sorts after all others.
NO_ID = (1 << 63) - 1


def _word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _block_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of the K words from each position on, by doubling (K is a power of two)."""
    with np.errstate(over="ignore"):
        power, size = BASE, 1
        while size < K:
            h = h[:-size] * power + h[size:]
            power, size = power * power, 2 * size
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _window_min(h: np.ndarray, size: int) -> np.ndarray:
    """Least of each `size` consecutive values."""
    out, have = h, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def minimiser_places(h: np.ndarray) -> np.ndarray:
    """Positions that are the least of some window; of a text shorter than a window, the least position."""
    if len(h) <= WINDOW:
        return np.nonzero(h == h.min())[0]
    least = _window_min(h, WINDOW)
    pad = np.full(WINDOW - 1, np.uint64(0))
    # position i lies in the windows that start at i - WINDOW + 1 to i: it is selected if one of them has its value as least
    most = ~_window_min(~np.concatenate([pad, least, pad]), WINDOW)
    return np.nonzero(h == most[: len(h)])[0]


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of each row of hashes."""
    with np.errstate(over="ignore"):
        h = parts[0]
        for x in parts[1:]:
            h = (h ^ (h >> np.uint64(31))) * BASE + x
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _window_hashes(h: np.ndarray, min_words: int) -> np.ndarray:
    """Hash of the min_words words from each position on, by the block hashes h that cover them."""
    n = max(0, len(h) + K - min_words)
    return _mixed([h[i : i + n] for i in [*range(0, min_words - K, K), min_words - K]])


def texts(docs: DataFrame) -> DataFrame:
    """docs as written once: key (one for each row), doc_id (a null one as NO_ID, after all others), text as bytes."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    return written(docs.select(F.monotonically_increasing_id().alias("key"), doc_id, whole_text().cast("binary").alias("text")), "texts")


def suffixes(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """rows: as texts() gives them. A row for each retained suffix: doc_id, key, p (its first word), b1, b2, b3 (hashes of
    its blocks; past the end 0), around (hash of all windows of min_words words through its first block; null where
    the text ends before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, places, blocks, whole = [], [], [], [], []
            for key, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = text.as_py().split()
                if len(words) < K:
                    continue
                h = _block_hashes(_word_hashes(words))
                p = minimiser_places(h)
                far = np.concatenate([h, np.zeros(2 * K, dtype=np.uint64)])
                w, left = _window_hashes(h, min_words), p - (min_words - K)
                inside = (left >= 0) & (p < len(w))
                around = np.zeros(len(p), dtype=np.uint64)
                around[inside] = _mixed([w[left[inside]], w[p[inside]]])
                ids.append(np.full(len(p), doc, dtype=np.int64))
                keys.append(np.full(len(p), key, dtype=np.int64))
                places.append(p.astype(np.int32))
                blocks.append(np.stack([far[p], far[p + K], far[p + 2 * K], around]))
                whole.append(inside)
            if ids:
                *b, around = np.concatenate(blocks, axis=1).view(np.int64)
                around = pa.array(around, mask=~np.concatenate(whole))
                yield pa.record_batch(
                    [np.concatenate(ids), np.concatenate(keys), np.concatenate(places), *b, around], names=["doc_id", "key", "p", "b1", "b2", "b3", "around"]
                )

    return rows.select("key", "doc_id", "text").mapInArrow(run, "doc_id long, key long, p int, b1 long, b2 long, b3 long, around long")


def windows(rows: DataFrame, places: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(b1, doc_id, key, p) for blocks whose order may keep like places apart, those that occur three times or more and
    not with the same words to the right. Where the windows of min_words words around a block are the same
    each time, its own places, under its own hash, are enough; else b1 is the hash of a window whose least block
    it is and p the place of that least block, the first if there are several."""
    blocks = places.groupBy("b1").agg(
        F.count("*").alias("n"), F.min("around").alias("least"), F.max("around").alias("most"), F.count("around").alias("whole"),
        F.min("b2").alias("least2"), F.max("b2").alias("most2"), F.min("b3").alias("least3"), F.max("b3").alias("most3"),
    )
    alike = (F.col("whole") == F.col("n")) & (F.col("least") == F.col("most"))
    mixed = (F.col("least2") != F.col("most2")) | (F.col("least3") != F.col("most3"))
    # written, so that the join below is between two plain shuffles and a block held by very many texts is split
    apart = written(blocks.filter(F.col("n") > 2).select("b1", F.coalesce(alike, F.lit(False)).alias("alike"), mixed.alias("mixed")).filter("not alike or mixed"), "apart")
    held = written(places.select("doc_id", "key", "p", "b1").join(apart.select("b1", "alike"), "b1"), "held")
    of = held.filter("not alike").groupBy("key").agg(F.collect_set("b1").alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, doc, text, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                words = text.as_py().split()
                if len(words) < min_words:
                    continue
                h = _block_hashes(_word_hashes(words))
                w, size = _window_hashes(h, min_words), min_words - K + 1
                least = _window_min(h, size)
                wanted = np.nonzero(np.isin(least, blocks.values.to_numpy().view(np.uint64)))[0]
                if not len(wanted):
                    continue
                # the first position of the window's least value: the next position at or after its start that has it
                order = np.lexsort((np.arange(len(h)), h))
                sorted_h = h[order]
                lo = np.searchsorted(sorted_h, least[wanted], "left")
                hi = np.searchsorted(sorted_h, least[wanted], "right")
                at = order[lo]
                for i in np.nonzero((hi - lo > 1) & (at < wanted))[0]:
                    same = order[lo[i] : hi[i]]
                    at[i] = same[np.searchsorted(same, wanted[i])]
                n = len(wanted)
                out.append((w[wanted].view(np.int64), np.full(n, doc, dtype=np.int64), np.full(n, key, dtype=np.int64), at.astype(np.int32)))
            if out:
                yield pa.record_batch([np.concatenate(x) for x in zip(*out)], names=["b1", "doc_id", "key", "p"])

    hashed = rows.join(of, "key").select("key", "doc_id", "text", "blocks").mapInArrow(run, "b1 long, doc_id long, key long, p int")
    return hashed.unionByName(held.filter("alike").select("b1", "doc_id", "key", "p"))


def window_links(rows: DataFrame, places: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Links of neighbours(): places in the same window of two texts that come one after the other, by doc_id, among all
    that hold it."""
    found = written(windows(rows, places, min_words), "windows")
    order = ["b1", "doc_id", "key", "p"]
    return neighbours(found.repartitionByRange(*order).sortWithinPartitions(*order)).distinct()


ORDER = ["b1", "b2", "b3", "doc_id", "key", "p"]
#: Columns of a link: the places (doc_id, key, p) and (doc_id, key, p) of two suffixes.
LINK = ["a_id", "a", "p", "b_id", "b", "q"]


def neighbours(sorted_rows: DataFrame) -> DataFrame:
    """A link for each two suffixes that come one right after the other and share their first block.

    The rows are range-partitioned by the whole order, so equal blocks of any number spread over partitions;
    within a partition the row before is at hand, and each partition's last row is handed to the next one.
    """
    schema = pa.schema([("part", pa.int32()), ("edge", pa.int32()), ("b1", pa.int64())] + [(c, pa.int32() if c in "pq" else pa.int64()) for c in LINK])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, none = TaskContext.get().partitionId(), None, [[None]] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            *here, b1 = (batch.column(i).to_numpy() for i in range(4))
            if last is None:  # the partition's first row: its predecessor is in a partition before
                yield pa.record_batch([[part], [0], b1[:1], *none, *(x[:1] for x in here)], schema=schema)
                last = (*(x[:1] for x in here), b1[:1])
                here, b1 = [x[1:] for x in here], b1[1:]
            *rows, k = (np.concatenate([x, y]) for x, y in zip(last, (*here, b1)))
            same = np.nonzero(k[1:] == k[:-1])[0]
            n = len(same)
            yield pa.record_batch([np.full(n, part, np.int32), np.full(n, 2, np.int32), k[same], *(x[same] for x in rows), *(x[same + 1] for x in rows)], schema=schema)
            last = (*(x[-1:] for x in rows), k[-1:])
        if last is not None:
            yield pa.record_batch([[part], [1], last[3], *last[:3], *none], schema=schema)

    ddl = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'long'}" for f in schema)
    found = written(sorted_rows.select("doc_id", "key", "p", "b1").mapInArrow(inside, ddl), "neighbours")
    # two rows for each partition that has any: the last row of the nearest partition before goes with its first
    edges, before = found.filter("edge < 2"), Window.orderBy("part", "edge")
    crossed = edges.select(
        "edge", *[F.lag(c).over(before).alias(c) for c in LINK[:3]], *LINK[3:], (F.lag("b1").over(before) == F.col("b1")).alias("same")
    ).filter("edge = 0 and same")
    return found.filter("edge = 2").select(*LINK).unionByName(crossed.select(*LINK))


def _extend(a: list, b: list, places: list[tuple[int, int]], min_words: int) -> list[tuple[int, int, int]]:
    """Maximal matches (start in a, start in b, words) through the places, each once."""
    found: dict[int, list[tuple[int, int]]] = {}
    out = []
    for p, q in places:
        shift = q - p
        if any(s <= p < e for s, e in found.get(shift, ())):
            continue
        s, e = p, p
        while s > 0 and s + shift > 0 and a[s - 1] == b[s + shift - 1]:
            s -= 1
        while e < len(a) and e + shift < len(b) and a[e] == b[e + shift]:
            e += 1
        found.setdefault(shift, []).append((s, e))
        if e - s >= min_words:
            out.append((s, s + shift, e - s))
    return out


def matches(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each extended match of neighbours: doc_id, start, other_doc_id, other_start, n_words (places in words)."""
    if min_words < K + WINDOW - 1:
        raise ValueError(f"shorter matches than {K + WINDOW - 1} words can be missed")
    rows = texts(docs)
    places = written(suffixes(rows, min_words), "suffixes")
    pairs = neighbours(places.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)).unionByName(window_links(rows, places, min_words))
    # one row for each pair of texts: the one of the lesser doc_id first
    flip = F.struct("a_id", "a") <= F.struct("b_id", "b")
    at = F.struct(F.when(flip, F.col("p")).otherwise(F.col("q")).alias("p"), F.when(flip, F.col("q")).otherwise(F.col("p")).alias("q"))
    a, b = (F.when(flip, F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
    pairs = written(pairs.select(a.alias("a"), b.alias("b"), at.alias("at")).groupBy("a", "b").agg(F.array_sort(F.collect_set("at")).alias("at")), "pairs")
    left, right = (rows.select(F.col("key").alias(x), F.col("doc_id").alias(f"{x}_id"), F.col("text").alias(f"t{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, (a, b) = [], ([None if x == NO_ID else x for x in batch.column(i).to_pylist()] for i in range(2))
            for i in range(batch.num_rows):
                at, ta, tb = (batch.column(c)[i].as_py() for c in ("at", "ta", "tb"))
                found = _extend(ta.split(), tb.split(), [(x["p"], x["q"]) for x in at], min_words)
                out += [(b[i], t, a[i], s, n) for s, t, n in found]
            columns = zip(*out) if out else [[]] * 5
            yield pa.record_batch([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "start", "other_doc_id", "other_start", "n_words"])

    return both.select("a_id", "b_id", "at", "ta", "tb").mapInArrow(run, "doc_id long, start long, other_doc_id long, other_start long, n_words long").distinct()


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir))
