"""SimHash near-dedup by tiled exact comparison.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of a text's word shingles.
Distinct fingerprints are dealt into blocks by their population counts, a crowded count by hash too; every pair of blocks
whose counts are within the radius is one group, and within it tiles sorted by population counts are compared by
exclusive-or and bit count. Tiles use the counts of each 16-bit quarter: the distance of two fingerprints
is at least the sum of the quarters' differences, so a pair of tiles whose quarter ranges are further apart than
the radius is skipped without loss. A group returns
a spanning forest of its links (fewer rows than fingerprints, however large a family of near copies is); the
forests' connected components are found by distributed star contraction.

The comparison is exact and quadratic in the number of distinct fingerprints: blocks bound a task's memory,
and the skipped share of tile pairs grows with the block. See README for figures.

Defined cases: a null text is empty; a text without words has fingerprint zero and is linked like any other;
a text with fewer words than a shingle is one shingle; copies share a fingerprint and thus a class of their
own; repeated rows get equal results; an empty table gives an empty result; only doc_id and text are read.
The graph's nodes are fingerprints, so rows that share a doc_id but not their text are different nodes, and a null
doc_id links like any other: a component's id is its least doc_id that is not null, null where it has none.
keep_one() keeps one row of a component, that of the least doc_id, nulls last, then of the least locator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import components, documents, whole_text, written
from lodestone.llm.exact_dedup import located

SHINGLE, SEED, RADIUS = 4, 42, 4
TILE = 512
#: Fingerprints of a block at most, and the fewest blocks: two blocks are what one task holds.
BLOCK, LEAST_BLOCKS = 1 << 18, 8


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """bytes.lower() and bytes.split() know ASCII only: A-Z, and white space \\x20 \\x09-\\x0D."""
    from itertools import repeat

    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter(map(xxh64_intdigest, runs, repeat(SEED)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp), and at where docs has a locator: fp is the fingerprint's 64 bits as a signed long."""
    at = [c for c in docs.columns if c == "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype="<u8")
            yield pa.record_batch([b.column(0), pa.array(found.view("<i8")), *b.columns[2:]], names=["doc_id", "fp", *at])

    return docs.select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text"), *at).mapInArrow(
        run, "doc_id long, fp long" + ", at struct<file: string, row: long>" * len(at)
    )


class Forest:
    """Least-index labels of the nodes 0 to n - 1 under the links added so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[u], label[v]
            new = a != b
            if not new.any():
                return
            u, v, a, b = u[new], v[new], a[new], b[new]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (up := label[label]).tobytes() != label.tobytes():
                label[:] = up


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((fp >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (0, 16, 32, 48)], axis=1).astype(np.int16)


def _tiles(fp: np.ndarray) -> tuple:
    """Order by quarter counts; each tile's start, end and least and greatest count of each quarter."""
    q = _quarters(fp)
    order = np.lexsort(q.T[::-1])
    starts = np.arange(0, len(fp), TILE)
    q = q[order]
    return order, starts, np.minimum.reduceat(q, starts), np.maximum.reduceat(q, starts)


def linked(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> np.ndarray:
    """Labels of left (and right after it) once all pairs within the radius are linked; right None: left with itself."""
    forest = Forest(len(left) + (0 if right is None else len(right)))
    oa, sa, lo_a, hi_a = _tiles(left)
    ob, sb, lo_b, hi_b = (oa, sa, lo_a, hi_a) if right is None else _tiles(right)
    base = 0 if right is None else len(left)
    a = left[oa]
    b = a if right is None else right[ob]
    for i, s in enumerate(sa):
        gap = np.maximum(0, np.maximum(lo_a[i] - hi_b, lo_b - hi_a[i])).sum(axis=1)
        for j in np.nonzero(gap <= radius)[0]:
            if right is None and j < i:
                continue
            t = sb[j]
            near = np.bitwise_count(a[s : s + TILE, None] ^ b[None, t : t + TILE]) <= radius
            if (right is not None or j != i) and not near.any():
                continue
            u, v = np.nonzero(near)
            forest.add(oa[s + u], base + ob[t + v])
    return forest.label


def blocks_of(counts: dict[int, int], block: int = BLOCK) -> list[tuple[int, int, int]]:
    """counts: number of fingerprints of each population count. Blocks (least count, greatest count, parts): neighbouring
    counts that fit one block together, or a single count that is dealt by hash over its parts."""
    size = max(1, min(block, -(-sum(counts.values()) // LEAST_BLOCKS)))
    out, held = [], 0
    for ones, n in sorted(counts.items()):
        if out and held + n <= size:
            out[-1], held = (out[-1][0], ones, 1), held + n
        else:
            out.append((ones, ones, -(-n // size)))
            held = n
    return out


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """distinct: (node, fp), a row for each fingerprint. Returns (a, b): links that connect what is within the radius.

    Blocks are ranges of population counts. Two blocks whose counts are further apart than the radius hold no link
    and never meet: a fingerprint is sent to the others only.
    """
    ones = F.bit_count("fp").cast("int")
    counts = {r[0]: r[1] for r in distinct.groupBy(ones).count().collect()}  # 65 rows at most
    found = blocks_of(counts, block)
    first, total = [], 0
    for *_, parts in found:
        first.append(total)
        total += parts
    table = []
    for (lo, hi, parts), at in zip(found, first):
        others = [o + k for (l, h, n), o in zip(found, first) if l - hi <= radius and lo - h <= radius for k in range(n)]
        table += [(one, parts, at, others) for one in range(lo, hi + 1)]
    where = distinct.sparkSession.createDataFrame(table, "ones int, parts int, first int, others array<int>")  # 65 rows at most
    dealt = distinct.select("node", "fp", ones.alias("ones")).join(F.broadcast(where), "ones")
    mine = (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).cast("int")
    dealt = dealt.select("node", "fp", mine.alias("mine"), F.explode("others").alias("other"))
    dealt = dealt.select("node", "fp", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        sides = [group] if i == j else [group[group["mine"] == i], group[group["mine"] == j]]
        if not all(len(s) for s in sides):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        fps = [s["fp"].to_numpy(np.int64).view(np.uint64) for s in sides]
        nodes = np.concatenate([s["node"].to_numpy(np.int64) for s in sides])
        label = linked(fps[0], fps[1] if len(fps) > 1 else None, radius)
        own = np.nonzero(label != np.arange(len(label)))[0]
        return pd.DataFrame({"a": nodes[own], "b": nodes[label[own]]})

    return dealt.groupBy("i", "j").applyInPandas(compare, "a long, b long")


def rooted(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, doc_id, root): each distinct fingerprint, its least doc_id, and the least fingerprint that links reach."""
    same = written(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    roots = components(links(same.select(F.col("fp").alias("node"), "fp"), radius))
    return same.join(roots, same["fp"] == roots["node"], "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row of docs: doc_id, fp, component_id (the least doc_id that links reach)."""
    fps = written(fingerprints(docs.select("doc_id", "text"), shingle), "fingerprints")
    named = written(rooted(fps, radius), "rooted")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return fps.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, with all its columns."""
    rows = located(docs)
    fps = written(fingerprints(rows.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "at")), "fingerprints")
    # the first row of each fingerprint, then of each component: both aggregates are combined before the shuffle
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "at")
    first = fps.groupBy("fp").agg(F.min(order).alias("first"))
    stay = first.join(rooted(fps).select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first"))
    stay = stay.select(F.col("first.at").alias("stays"))
    return rows.join(stay, rows["at"] == stay["stays"], "left_semi").select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
