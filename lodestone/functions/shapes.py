"""Shapes of JSON payloads, and one expression that names the first path at which a payload departs from its shape.

A shape is declared (`closed`, `array`, `text`, ...) and compiled into a Column over a VARIANT; no Python runs for rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A shape takes a value that is there and its path; it gives the first path at fault, or null.
Shape = Callable[[Column, Column], Column]

IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._:~-]{0,127}$"
DOTTED = r"^(?=.{1,128}$)[a-z][a-z0-9-]*(\.[a-z][a-z0-9_-]*)+$"
INSTANT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
DIGEST = r"^sha256:[0-9a-f]{64}$"


def _kind(x: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0)


def _is(x: Column, *kinds: str) -> Column:
    return F.coalesce(_kind(x).isin(*kinds), F.lit(False))


def string_of(x: Column) -> Column:
    """The text of a string; null for anything else."""
    return F.when(_is(x, "STRING"), F.try_variant_get(x, "$", "string"))


def integer_of(x: Column) -> Column:
    return F.when(_is(x, "BIGINT"), F.try_variant_get(x, "$", "bigint"))


def elements(x: Column) -> Column:
    return F.when(_is(x, "ARRAY"), F.try_variant_get(x, "$", "array<variant>"))


def members(x: Column) -> Column:
    return F.when(_is(x, "OBJECT"), F.try_variant_get(x, "$", "map<string, variant>"))


def member(x: Column, *names: str) -> Column:
    """A member of a member, or null."""
    for name in names:
        x = F.element_at(members(x), F.lit(name))
    return x


def _bad(condition: Column, path: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(True)), path)


def matching(pattern: str) -> Shape:
    return lambda x, path: _bad(~string_of(x).rlike(pattern), path)


identifier, dotted_name, instant, digest = (matching(p) for p in (IDENTIFIER, DOTTED, INSTANT, DIGEST))


def text(least: int, most: int) -> Shape:
    """A string of so many characters."""
    return lambda x, path: _bad(~F.length(string_of(x)).between(least, most), path)


def one_of(*values: str) -> Shape:
    return lambda x, path: _bad(~string_of(x).isin(*values), path)


def integer(least: int) -> Shape:
    return lambda x, path: _bad(~(integer_of(x) >= least), path)


def anything(x: Column, path: Column) -> Column:
    return F.lit(None).cast("string")


def array(of: Shape, most: int, least: int = 0, unique: str | None = None) -> Shape:
    """An array of so many elements of a shape; unique: a member whose strings differ from each other."""

    def check(x: Column, path: Column) -> Column:
        held = elements(x)
        faults = F.filter(F.transform(held, lambda e, i: of(e, F.concat(path, F.lit("/"), i.cast("string")))), lambda f: f.isNotNull())
        out = F.coalesce(_bad(~F.size(held).between(least, most), path), F.get(faults, F.lit(0)))
        if unique is not None:
            names = F.transform(held, lambda e: string_of(member(e, unique)))
            out = F.coalesce(out, _bad(F.size(F.array_distinct(names)) < F.size(names), path))
        return out

    return check


def named_texts(most: int, name_most: int, text_most: int) -> Shape:
    """An object of any names, at most so many, each a string."""

    def check(x: Column, path: Column) -> Column:
        held = members(x)
        good = lambda k, v: F.length(k).between(1, name_most) & F.coalesce(F.length(string_of(v)).between(1, text_most), F.lit(False))
        faults = F.array_sort(F.map_keys(F.map_filter(held, lambda k, v: ~good(k, v))))
        return F.coalesce(_bad(~(F.size(F.map_keys(held)) <= most), path), F.concat(path, F.lit("/"), F.get(faults, F.lit(0))))

    return check


def closed(required: dict[str, Shape], optional: dict[str, Shape] | None = None, rule: Shape | None = None) -> Shape:
    """An object of these members alone: an unknown one is at fault first, then one that is missing, then the members in order, then `rule`."""
    optional = optional or {}

    def check(x: Column, path: Column) -> Column:
        held, keys = members(x), F.map_keys(members(x))
        at = lambda name: F.concat(path, F.lit("/"), name)
        unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in (*required, *optional)])))
        parts = [_bad(held.isNull(), path), at(F.get(unknown, F.lit(0)))]
        parts += [F.when(~F.array_contains(keys, name), at(F.lit(name))) for name in required]
        for name, shape in (required | optional).items():
            parts.append(F.when(F.array_contains(keys, name), shape(F.element_at(held, F.lit(name)), at(F.lit(name)))))
        return F.coalesce(*parts, rule(x, path) if rule else F.lit(None).cast("string"))

    return check


def chosen(by: str, shapes: dict[str, Shape]) -> Shape:
    """The shape that a string member names; an unknown name is at fault."""

    def check(x: Column, path: Column) -> Column:
        name, out = string_of(member(x, by)), F.concat(path, F.lit(f"/{by}"))
        for key, shape in shapes.items():
            out = F.when(name == key, shape(x, path)).otherwise(out)
        return out

    return check


def first_fault(payload: Column, shape: Shape, root: str = "/payload") -> Column:
    """The first path at which a JSON text departs from its shape; the root for text that is no JSON, null for a payload that keeps to it."""
    x = F.try_parse_json(payload)
    return F.coalesce(F.when(x.isNull(), root), shape(x, F.lit(root)))
