"""Quality rules: one projection of ratios against a threshold table, built-in functions only.

Defined cases: a null or empty text has no words and fails the base rules; rows are judged one by one, so
ties and repeated rows each get their own verdict; an empty table gives an empty result; columns other than
doc_id and text are never read, and names of the working columns cannot clash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import WHITE, WHITE_CHARS, documents

SYMBOLS = "#*$%&|<>"
#: Very frequent function words of the four languages the tables hold.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they "
    "der die und das den von zu mit ist des ein nicht auf eine als dem auch sich im für "
    "de la le et les des un une du en est que pour dans qui par pas sur au plus "
    "el los las y se del una con no su es al lo como más pero sus"
).split()

#: Rule, the ratio it bounds (numerator over denominator), least and greatest allowed (None: no bound), and the measure
#: whose share of the same denominator exempts a text from the rule, with that share. A text outside any bound is rejected.
#: The bounds are wide: prose stays inside. Prose of a language without a list has function words too, and they come
#: again and again: a text of which a tenth of the words are repeats needs no listed stop words.
THRESHOLDS = (
    ("mean_word_length", "word_chars", "n_words", 2.0, 14.0, None),
    ("symbol_ratio", "n_symbols", "n_words", None, 0.10, None),
    ("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.50, None),
    ("stop_word_ratio", "n_stop_words", "n_words", 0.02, None, ("n_again", 0.10)),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_again")


def _let(value: Column, body) -> Column:
    """body applied to a value that is worked out once: inside a lambda an outer expression would be redone for each element."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside a three-word window whose content occurs at two or more places of the same text.

    The windows' 64-bit hashes are sorted with their places; equal neighbours repeat. Two different windows of
    one text share a hash with a probability of about n * n / 2**65.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")
        ),
    )

    def covered(places: Column) -> Column:
        steps = F.transform(
            places, lambda p, k: F.when(k > 0, F.least(p - F.get(places, k - 1), F.lit(3))).otherwise(F.lit(3))
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def count(ordered: Column) -> Column:
        again = F.filter(
            ordered,
            lambda x, k: ((k > 0) & (F.get(ordered, k - 1)["h"] == x["h"]))
            | (F.get(ordered, k + 1)["h"] == x["h"]),
        )
        places = F.array_sort(F.transform(again, lambda x: x["i"]))
        return _let(places, lambda p: F.when(F.size(p) > 0, covered(p)).otherwise(F.lit(0)))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(F.array_sort(windows), count)).cast("long")


def _measures(text: Column) -> Column:
    """All counts that the rules use, as one struct. Texts, words and lines are bound once each: were they columns of
    an earlier projection, a predicate pushed below it would work them out again for every word."""

    def of_words(t: Column, w: Column, line: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(t, WHITE_CHARS, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(line) - F.size(F.array_distinct(line))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(line).cast("long").alias("n_lines"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            (F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("n_again"),
        )

    def words(t: Column) -> Column:
        return F.filter(F.split(t, f"{WHITE}+"), lambda w: w != "")

    def lines(t: Column) -> Column:
        return F.filter(F.split(t, "\n", -1), lambda line: F.trim(F.translate(line, WHITE_CHARS, " ")) != "")

    return _let(text, lambda t: _let(words(t), lambda w: _let(lines(t), lambda line: of_words(t, w, line))))


def verdict(text: Column, thresholds=THRESHOLDS) -> Column:
    """The measures of one text with base_failed, failed_rules (comma-separated names) and kept, as a struct."""

    def judge(m: Column) -> Column:
        broken = []
        for name, over, under, least, most, unless in thresholds:
            ratio = m[over] / F.greatest(m[under], F.lit(1))
            outside = F.lit(False)
            if least is not None:
                outside = outside | (ratio < least)
            if most is not None:
                outside = outside | (ratio > most)
            if unless is not None:
                outside = outside & (m[unless[0]] / F.greatest(m[under], F.lit(1)) < unless[1])
            broken.append(F.when(outside, F.lit(name)))
        base_failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        failed = F.concat_ws(",", *broken)
        return F.struct(
            *[m[k].alias(k) for k in COUNTS],
            base_failed.alias("base_failed"), failed.alias("failed_rules"), (~base_failed & (failed == "")).alias("kept"),
        )

    return _let(_measures(F.coalesce(text, F.lit(""))), judge)


def verdicts(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """doc_id and the fields of its verdict, one row for each row of docs."""
    return docs.select("doc_id", verdict(F.col("text"), thresholds).alias("m")).select("doc_id", "m.*")


def keep_good(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Rows of docs that pass: the verdict is a predicate of the row itself, so nothing is joined or moved."""
    return docs.filter(verdict(docs["text"], thresholds)["kept"])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir))


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    rules = []
    for name, over, under, least, most, unless in THRESHOLDS:
        ratio = f"{over}::double / greatest({under}, 1)"
        tests = [f"{ratio} < {least}"] * (least is not None) + [f"{ratio} > {most}"] * (most is not None)
        but = f" AND {unless[0]}::double / greatest({under}, 1) < {unless[1]}" if unless else ""
        rules.append(f"CASE WHEN ({' OR '.join(tests)}){but} THEN '{name}' END")
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::bigint AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
    (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines,
    coalesce(rep.n, 0)::bigint AS n_repeat_words, len(l)::bigint AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({stop})))::bigint AS n_stop_words,
    (len(w) - len(list_distinct(w)))::bigint AS n_again
  FROM d LEFT JOIN rep USING (r)),
v AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    concat_ws(',', {', '.join(rules)}) AS failed_rules FROM m)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM v"""


SQL = _sql()
