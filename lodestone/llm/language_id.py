"""Language identification with word-first backoff.

A word known from labelled texts scores by its log frequency in each language. An unseen word falls back to its
character n-grams, the longest length of which any n-gram is known, and scores by their mean log frequency.
A text gets the language of the greatest sum, and as its score that language's share of the posterior.

The model is fitted on a bounded sample of the labelled texts: of each language about an equal part of FIT_TEXTS,
and about LEAST_TEXTS at least, or all that it has, chosen by a hash of doc_id with a rate worked out from the
language's own number of texts. So no language is left out because others have more texts. The sample bounds the
model, which alone goes to the executors as a broadcast. Every text is scored, whole.

Smoothing is by share: a word or n-gram not seen in a language has the same frequency in all of them, so that a
language with few texts is not favoured by words that it lacks.

Defined cases: a null text or one without letters is `und` with score 0; without labelled texts every text is
`und`; ties go to the first language in alphabetical order; repeated rows score alike; an empty table gives
an empty result; only doc_id, text and (for fitting) lang are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents, whole_text

FIT_TEXTS = 5_000
#: Texts sampled of each language at least, or all that it has: the sample has FIT_TEXTS or LEAST_TEXTS a language at most, about.
LEAST_TEXTS = 250
#: Words kept in the model: those seen twice or more in the sample. Lengths of n-grams, longest first.
MIN_COUNT, LENGTHS = 2, (5, 4, 3, 2, 1)
SMOOTH = 0.5
WORD = r"\p{L}[\p{L}\p{M}]*"


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, fit_texts: int = FIT_TEXTS) -> dict:
    """docs: text and lang of labelled rows. The model: languages and the log frequencies of words and n-grams."""
    labelled = docs.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    bound = max(LEAST_TEXTS, fit_texts / max(1, len(counts)))
    span = 1 << 30
    upto = docs.sparkSession.createDataFrame(
        [(k, int(min(1.0, bound / n) * span)) for k, n in counts.items()], "of_lang string, upto long"
    )
    sample = labelled.join(F.broadcast(upto), F.col("lang") == F.col("of_lang")).filter(
        F.pmod(F.xxhash64("doc_id"), F.lit(span)) < F.col("upto")
    )
    words = (
        sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), F.lit(1))).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )
    padded = F.concat(F.lit("<"), F.col("word"), F.lit(">"))

    def of_length(k: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(padded) - (k - 1)), lambda i: F.substring(padded, i, F.lit(k)))
        return F.when(F.length(padded) >= k, every).otherwise(F.array().cast("array<string>"))

    grams = words.select("lang", "n", F.explode(F.flatten(F.array(*map(of_length, LENGTHS)))).alias("word")).groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def table(counts: DataFrame) -> dict:
        rows = counts.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("all")).filter(f"all >= {MIN_COUNT}").collect()
        return {r["word"]: r["by"] for r in rows}

    known, parts = table(words), table(grams)
    langs = sorted({k for by in [*known.values(), *parts.values()] for k in by})

    def logs(counts: dict, size) -> dict:
        totals: dict = {}
        for w, by in counts.items():
            t = totals.setdefault(size(w), np.zeros(len(langs)))
            t += [by.get(k, 0) for k in langs]
        kinds = Counter(size(w) for w in counts)

        def share(w: str, by: dict) -> np.ndarray:
            t = totals[size(w)]
            unseen = SMOOTH / t.mean()
            return (np.array([by.get(k, 0) for k in langs]) / np.maximum(t, 1) + unseen) / (1 + unseen * kinds[size(w)])

        return {w: np.log(share(w, by)).astype(np.float32) for w, by in counts.items()}

    return {"langs": langs, "words": logs(known, lambda w: 0), "grams": logs(parts, len)}


class Scorer:
    def __init__(self, model: dict):
        import regex

        self.langs, self.words, self.grams = model["langs"], model["words"], model["grams"]
        self.find = regex.compile(WORD).findall
        self.unseen: dict[str, np.ndarray] = {}

    def backoff(self, word: str) -> np.ndarray:
        padded = f"<{word}>"
        for k in LENGTHS:
            found = [g for i in range(len(padded) - k + 1) if (g := self.grams.get(padded[i : i + k])) is not None]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.langs), dtype=np.float32)

    def word(self, word: str) -> np.ndarray:
        got = self.words.get(word)
        if got is None:
            got = self.unseen.get(word)
            if got is None:
                if len(self.unseen) >= 100_000:  # a cache only: what is dropped is worked out again
                    self.unseen.clear()
                got = self.unseen[word] = self.backoff(word)
        return got

    def predict(self, text: str | None) -> tuple[str, float]:
        words = self.find(text.lower()) if text else ()
        if not words or not self.langs:
            return "und", 0.0
        total = np.sum([self.word(w) for w in words], axis=0, dtype=np.float64)
        share = np.exp(total - total.max())
        best = int(total.argmax())
        return self.langs[best], float(share[best] / share.sum())


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            found = [scorer.predict(t.as_py()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
