"""Large results cut down: format, units that tile the bytes, parts to ask about, what is always kept, and a ledger of the rest.

An artifact frame has artifact and content (bytes). Only artifacts of INPUT_BYTES or less are read, so one artifact's lines and units are few
and are folded as one array; artifacts are spread over tasks.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most bytes of a unit, lines of a block, bytes and units of a part, parts, bytes and excerpts of what is shown.
UNIT_BYTES, BLOCK_LINES, PART_BYTES, PART_UNITS, PARTS, SHOWN_BYTES, EXCERPTS = 2048, 20, 32 * 1024, 64, 4, 16 * 1024, 24
INPUT_BYTES = PARTS * PART_BYTES
#: What a shown excerpt costs besides its bytes, and the header once.
EXCERPT_OVERHEAD, HEADER = 96, 512

RUNNING = r"^running [0-9]+ tests?$"
LIBTEST = rf"^test result: |{RUNNING}|^test .*( \.\.\. ok| \.\.\. FAILED)$|^test .* \.\.\. ignored"


def line_class(line: Column) -> Column:
    """What a line of a test run is."""
    return (
        F.when(line == "", "blank").when(line.rlike(rf"^\s*(Running |Doc-tests )|{RUNNING}|^test result: "), "identity").when(line.rlike(r"^test .+ \.\.\. FAILED$"), "failed")
        .when(line.rlike(r"^---- .*(stdout|stderr) ----$"), "block").when(line == "failures:", "failures").when(line.rlike(r"^error(: |\[)"), "error").otherwise("other")
    )


def _one_value(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else: parsing alone would stop after the first value."""
    return F.coalesce(F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")) == 1, F.lit(False))


def sniffed(artifacts: DataFrame) -> DataFrame:
    """Adds size and format: too_large, binary, json, json_lines, libtest or lines, by the first that fits."""
    text = F.col("content").cast("string")
    body = F.trim(F.translate(text, "\n\r\t", "   "))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, "\r\t", "  ")) != "")
    records = (F.size(lines) >= 2) & F.forall(lines, _one_value)
    tests = F.exists(F.split(text, r"\r?\n"), lambda x: x.rlike(LIBTEST))
    form = (
        F.when(F.octet_length("content") > INPUT_BYTES, "too_large").when(~F.is_valid_utf8(text), "binary").when(body.rlike(r"^[\[{]") & _one_value(text), "json")
        .when(records, "json_lines").when(tests, "libtest").otherwise("lines")
    )
    return artifacts.withColumns({"size": F.octet_length("content").cast("long"), "format": form})


GROUP = "struct<start: bigint, end: bigint, kind: string, label: string>"


def line_groups(content: Column, tests: Column) -> Column:
    """Groups of whole lines: blocks of BLOCK_LINES, and in a test run identity lines with the blank ones after them, failed tests, a failure's own
    block up to the next one, and diagnostics up to a blank line. A fold over the lines."""
    whole = F.regexp_extract_all(content.cast("string"), F.lit(r"([^\n]*\n|[^\n]+\z)"), F.lit(1))
    lines = F.transform(whole, lambda x: F.struct(F.octet_length(x).cast("long").alias("n"), F.when(tests, line_class(F.regexp_replace(x, r"[\r\n]+$", ""))).otherwise("other").alias("c")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("mode"), F.lit(0).alias("k"), F.expr(f"cast(array() as array<{GROUP}>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        c, mode = x["c"], s["mode"]
        begins = F.when(c == "identity", "identity").when(c == "failed", "failed").when(c == "block", "block").when(c == "error", "error").otherwise("other")
        goes_on = (
            ((mode == "identity") & (c == "blank"))
            | ((mode == "block") & ~c.isin("block", "failures", "identity"))
            | ((mode == "error") & ~c.isin("blank", "identity"))
            | ((mode == "other") & (begins == "other") & (s["k"] < BLOCK_LINES))
        )
        kind = F.when(begins == "identity", "identity").when(begins == "other", "other").otherwise("failure")
        end = s["at"] + x["n"]
        last = F.get(s["out"], F.size(s["out"]) - 1)
        longer = F.concat(F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1), F.array(F.struct(last["start"].alias("start"), end.alias("end"), last["kind"].alias("kind"), last["label"].alias("label"))))
        more = F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), end.alias("end"), kind.alias("kind"), F.lit("").alias("label"))))
        return F.struct(
            end.alias("at"), F.when(goes_on, mode).otherwise(begins).alias("mode"), F.when(goes_on, s["k"] + 1).otherwise(F.lit(1)).alias("k"), F.when(goes_on, longer).otherwise(more).alias("out")
        )

    return F.aggregate(lines, zero, step, lambda s: s["out"])


_SPACE = re.compile(r"[ \t\r\n]*")
_DECODE = json.JSONDecoder().raw_decode
#: What the members of a record say when it failed, and which members name it.
FAILED_OUTCOMES, NAMES = ("fail", "failed", "failure", "error", "timeout", "harness_error"), ("fixture", "name", "test")


def _children(text: str, at: int) -> list[tuple[int, str | None, int, int]]:
    """(entry, key, start, end) of each child of the container that begins at `at`."""
    out, i, close = [], at + 1, {"{": "}", "[": "]"}[text[at]]
    while True:
        i = _SPACE.match(text, i).end()
        if text[i] == close:
            return out
        entry, key = i, None
        if close == "}":
            key, i = _DECODE(text, i)
            i = _SPACE.match(text, _SPACE.match(text, i).end() + 1).end()
        _, end = _DECODE(text, i)
        out.append((entry, key, i, end))
        i = _SPACE.match(text, end).end()
        i += text[i] == ","


def _said_failed(value) -> bool:
    if not isinstance(value, dict):
        return False
    inner = value.get("message")
    return value.get("outcome") in FAILED_OUTCOMES or value.get("level") == "error" or value.get("success") is False or (isinstance(inner, dict) and inner.get("level") == "error")


def _cut_json(text: str, node: tuple[int, int], label: str, start: int, end: int, root: bool, out: list) -> None:
    """Cuts start..end, which holds the node, by its children while it is more than a unit; a child's range runs to the next one's entry."""
    before, value = len(out), _DECODE(text, node[0])[0]
    children = _children(text, node[0]) if len(text[start:end].encode()) > UNIT_BYTES and text[node[0]] in "{[" else []
    if not children:
        out.append([start, end, "other", label])
    for k, (entry, key, at, upto) in enumerate(children):
        first, last = (start if k == 0 else entry), (children[k + 1][0] if k + 1 < len(children) else end)
        marked = len(out)
        _cut_json(text, (at, upto), f"{label}[{k}]" if key is None else f'{label}."{key}"', first, last, False, out)
        if root and key is not None and not (text[at] == "[" and _DECODE(text, at)[0]):
            for unit in out[marked:]:
                unit[2] = "identity" if unit[2] == "other" else unit[2]
    if _said_failed(value):
        for unit in out[before:]:
            unit[2] = "failure"


def _json_groups(text: str, by_line: bool) -> list[dict]:
    out: list[list] = []
    if not by_line:
        at = _SPACE.match(text, 0).end()
        _cut_json(text, (at, _DECODE(text, at)[1]), "$", 0, len(text), True, out)
    else:
        starts = [m.start() for m in re.finditer(r"^[ \t\r]*[^\s]", text, re.M)]
        for k, start in enumerate(starts):
            at, before = _SPACE.match(text, start).end(), len(out)
            end = starts[k + 1] if k + 1 < len(starts) else len(text)
            value, upto = _DECODE(text, at)
            _cut_json(text, (at, upto), f"line {text.count(chr(10), 0, at) + 1}", start if k else 0, end, False, out)
            if isinstance(value, dict) and value.get("reason") == "build-finished":
                for unit in out[before:]:
                    unit[2] = "identity" if unit[2] == "other" else unit[2]
    # places in characters become places in bytes
    size, at, ends = 0, 0, []
    for start, end, *_ in out:
        size += len(text[at:end].encode())
        ends.append(size)
        at = end
    return [{"start": s, "end": e, "kind": u[2], "label": u[3][:120]} for u, s, e in zip(out, [0, *ends], ends)]


def json_groups(content: Column, form: Column) -> Column:
    """Groups of a JSON text. Places inside JSON are out of reach of SQL functions; the rest of the projection stays with them."""

    def each(body: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([_json_groups(b.decode(), k == "json_lines") if k in ("json", "json_lines") else None for b, k in zip(body, kind)])

    return F.pandas_udf(each, f"array<{GROUP}>")(content, form)


def _pieces(body: bytes, groups) -> list[dict]:
    out = []
    for number, g in enumerate(groups, 1):
        at = g["start"]
        while at < g["end"]:
            cut = g["end"]
            if cut - at > UNIT_BYTES:
                cut = body.rfind(b"\n", at, at + UNIT_BYTES) + 1
                if not cut:
                    cut = at + UNIT_BYTES
                    while body[cut] & 0xC0 == 0x80:
                        cut -= 1
            out.append({"start": at, "end": cut, "kind": g["kind"], "label": g["label"], "group": number})
            at = cut
    return out


UNIT = "struct<start: bigint, end: bigint, kind: string, label: string, group: int>"


def units(artifacts: DataFrame) -> DataFrame:
    """(artifact, format, size, unit, start, end, kind, label, group): units of UNIT_BYTES at most that tile every artifact that is read; a group's units were one thing.
    Kinds: failure, identity, other."""
    rows = sniffed(artifacts).filter("format not in ('binary', 'too_large')")
    is_json = F.col("format").isin("json", "json_lines")
    groups = F.when(is_json, json_groups(F.col("content"), F.col("format"))).otherwise(line_groups(F.col("content"), F.col("format") == "libtest"))
    cut = F.pandas_udf(lambda b, g: pd.Series([_pieces(x, y) for x, y in zip(b, g)]), f"array<{UNIT}>")
    return rows.withColumn("groups", groups).select("artifact", "format", "size", F.posexplode(cut("content", "groups")).alias("unit", "u")).select("artifact", "format", "size", "unit", "u.*")


def parts(cut: DataFrame) -> DataFrame:
    """cut: units. Adds part, from 0, for those that are no identity: a part has so many bytes and units at most, and a group stays whole if it fits a part."""
    offered = cut.filter("kind <> 'identity'")
    sizes = offered.groupBy("artifact", "group").agg(F.array_sort(F.collect_list(F.struct("unit", (F.col("end") - F.col("start")).alias("n")))).alias("u"))
    held = sizes.groupBy("artifact").agg(F.array_sort(F.collect_list(F.struct("group", "u"))).alias("g"))
    zero = F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("k"), F.expr("cast(array() as array<struct<unit: int, part: int>>)").alias("out"))

    def put(s: Column, us: Column, total: Column) -> Column:
        """All of us in one part: the one begun, or the next."""
        n = F.size(us)
        next_ = (s["k"] > 0) & ((s["used"] + total > PART_BYTES) | (s["k"] + n > PART_UNITS))
        part = s["part"] + next_.cast("int")
        rows = F.transform(us, lambda x: F.struct(x["unit"].alias("unit"), part.alias("part")))
        return F.struct(part.alias("part"), (F.when(next_, 0).otherwise(s["used"]) + total).alias("used"), (F.when(next_, 0).otherwise(s["k"]) + n).alias("k"), F.concat(s["out"], rows).alias("out"))

    def step(s: Column, g: Column) -> Column:
        total = F.aggregate(g["u"], F.lit(0).cast("long"), lambda a, x: a + x["n"])
        fits = (total <= PART_BYTES) & (F.size(g["u"]) <= PART_UNITS)
        return F.when(fits, put(s, g["u"], total)).otherwise(F.aggregate(g["u"], s, lambda t, x: put(t, F.array(x), x["n"])))

    placed = held.select("artifact", F.inline(F.aggregate("g", zero, step, lambda s: s["out"])))
    return cut.join(placed, ["artifact", "unit"], "left")


def floor(cut: DataFrame) -> DataFrame:
    """cut: units. Adds carried: every failure, then identity, in order, each only if all that is carried still fits bytes and excerpts;
    adjoining units are one excerpt. If everything fits, all is carried."""
    held = cut.groupBy("artifact").agg(F.array_sort(F.collect_list(F.struct("unit", (F.col("end") - F.col("start")).alias("n"), "kind"))).alias("u"))
    of = lambda kind: F.filter(F.col("u"), lambda x: x["kind"] == kind)

    def cost(excerpts: Column, size: Column) -> Column:
        return HEADER + size + EXCERPT_OVERHEAD * excerpts

    everything = cost(F.lit(1), F.aggregate("u", F.lit(0).cast("long"), lambda a, x: a + x["n"])) <= SHOWN_BYTES
    zero = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("excerpts"), F.expr("cast(array() as array<int>)").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        touching = F.array_contains(s["kept"], x["unit"] - 1).cast("int") + F.array_contains(s["kept"], x["unit"] + 1).cast("int")
        excerpts, size = s["excerpts"] + 1 - touching, s["size"] + x["n"]
        fits = (cost(excerpts, size) <= SHOWN_BYTES) & (excerpts <= EXCERPTS)
        return F.when(fits, F.struct(size.alias("size"), excerpts.alias("excerpts"), F.concat(s["kept"], F.array(x["unit"])).alias("kept"))).otherwise(s)

    kept = held.select("artifact", everything.alias("everything"), F.aggregate(F.concat(of("failure"), of("identity")), zero, step)["kept"].alias("kept"))
    return cut.join(kept, "artifact").withColumn("carried", F.col("everything") | F.array_contains("kept", F.col("unit"))).drop("kept", "everything")


def ledger(artifacts: DataFrame) -> DataFrame:
    """(artifact, extent, start, end, disposition): extents that tile every artifact: carried excerpts, and what is left out with its reason: not_selected, over_projection
    (to be kept, but it did not fit), not_text, insufficient_capacity."""
    kept = floor(units(artifacts))
    state = F.when(F.col("carried"), "carried").when(F.col("kind") == "other", "not_selected").otherwise("over_projection")
    order = Window.partitionBy("artifact").orderBy("unit")
    runs = kept.withColumn("disposition", state).withColumn("new", (~F.col("disposition").eqNullSafe(F.lag("disposition").over(order))).cast("int"))
    runs = runs.withColumn("extent", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = runs.groupBy("artifact", "extent", "disposition").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    other = sniffed(artifacts).filter("format in ('binary', 'too_large') and size > 0")
    why = F.when(F.col("format") == "binary", "not_text").otherwise("insufficient_capacity")
    other = other.select("artifact", F.lit(1).cast("long").alias("extent"), why.alias("disposition"), F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
    return rows.unionByName(other).select("artifact", "extent", "start", "end", "disposition")


def shown(artifacts: DataFrame) -> DataFrame:
    """(artifact, content): the projection itself: a header with size and format, each carried excerpt under its range, and a line for each extent left out."""
    rows = ledger(artifacts).join(sniffed(artifacts).select("artifact", "content", "size", "format"), "artifact")
    text = F.substring("content", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).cast("string")
    block = F.when(F.col("disposition") == "carried", F.concat(F.format_string("[%d-%d]\n", "start", "end"), text)).otherwise(F.format_string("[%d-%d omitted: %s]\n", "start", "end", "disposition"))
    header = F.format_string("artifact %s, %d bytes, %s\n", F.col("artifact").cast("string"), "size", "format")
    return rows.groupBy("artifact", header.alias("header")).agg(F.array_sort(F.collect_list(F.struct("extent", block.alias("b")))).alias("b")).select("artifact", F.concat("header", F.array_join(F.transform("b", lambda x: x["b"]), "")).alias("content"))


def named_failures(artifacts: DataFrame) -> DataFrame:
    """(artifact, tests, errors): failed tests and diagnostics of test runs, counted apart; of records, those with a name and those without."""
    s = sniffed(artifacts).filter("format in ('libtest', 'json_lines')")
    lines = s.select("artifact", "format", F.explode(F.split(F.col("content").cast("string"), r"\r?\n")).alias("line"))
    value = F.try_parse_json("line")
    get = lambda p: F.try_variant_get(value, p, "string")
    failed = F.coalesce(get("$.outcome").isin(*FAILED_OUTCOMES), F.lit(False)) | F.coalesce(get("$.level") == "error", F.lit(False)) | F.coalesce(get("$.success") == "false", F.lit(False)) | F.coalesce(get("$.message.level") == "error", F.lit(False))
    named = F.coalesce(*[F.when(get(f"$.{n}") != "", get(f"$.{n}")) for n in NAMES]).isNotNull()
    c, tests = line_class(F.col("line")), F.col("format") == "libtest"
    return lines.groupBy("artifact").agg(
        F.count_if(F.when(tests, c == "failed").otherwise(failed & named)).alias("tests"), F.count_if(F.when(tests, c == "error").otherwise(failed & ~named)).alias("errors")
    )
