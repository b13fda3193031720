"""Tests of sets held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subset(a: Column, b: Column) -> Column:
    """Whether every element of a is in b: what a derivation read against what its reader may read."""
    return F.size(F.array_except(a, b)) == 0


def common(entries: Column) -> Column:
    """What every one of an array of arrays holds; empty for no entries."""
    return F.aggregate(F.slice(entries, F.lit(2), F.size(entries)), F.coalesce(F.get(entries, F.lit(0)), F.array().cast("array<string>")), lambda a, e: F.array_intersect(a, e))


def same_members(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same elements as often, in any order."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def worth_asking(candidates: Column) -> Column:
    """A choice among candidates is one only if there are two."""
    return F.size(candidates) > 1


def worth_choosing(spans: Column, claims: Column, most_spans: int = 8, most_claims: int = 4) -> Column:
    """Whether there is more than would be carried without asking."""
    return (F.size(spans) > most_spans) | (F.size(claims) > most_claims)
