"""Text rules as Column expressions: tokens, chunks, file kinds, clipping, carried bytes, paths, proposed terms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.constants import CHUNK_BYTES, CHUNK_LINES

#: Where an identifier falls into parts: lower then upper, upper then upper-lower, letter then digit and back.
BOUNDARY = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})"
MARK = "\x01"


def _latin() -> tuple[str, str]:
    """Latin letters that are a plain letter with marks, and the plain letters: worked out from Unicode's decompositions."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            pairs[chr(code).lower()] = base.lower()
    return "".join(k for k in pairs if len(k) == 1), "".join(v for k, v in pairs.items() if len(k) == 1)


LATIN, PLAIN = _latin()


def folded(text: Column) -> Column:
    """Lower case without accents; combining marks go."""
    return F.translate(F.lower(F.regexp_replace(text, r"\p{M}+", "")), LATIN, PLAIN)


def _words(text: Column) -> Column:
    marked = F.regexp_replace(text, BOUNDARY, MARK)
    return F.regexp_extract_all(folded(marked), F.lit(rf"([\p{{L}}\p{{N}}{MARK}]+)"), F.lit(1))


def tokens(text: Column) -> Column:
    """What an index holds of a text, in order: each word, and after it its parts if it has more than one."""
    return F.flatten(
        F.transform(
            _words(text),
            lambda w: F.when(F.contains(w, F.lit(MARK)), F.concat(F.array(F.replace(w, F.lit(MARK), F.lit(""))), F.split(w, MARK))).otherwise(F.array(w)),
        )
    )


def query_terms(text: Column) -> Column:
    """The parts of a question's words, in order, repeats kept."""
    return F.flatten(F.transform(_words(text), lambda w: F.split(w, MARK)))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def chunks(text: Column, lines: int = CHUNK_LINES, size: int | None = CHUNK_BYTES) -> Column:
    """Spans that tile the text, cut after a newline once there are `lines` lines or `size` bytes (None: lines alone).

    An array of (start_byte, end_byte, start_line, end_line, text); an empty text has none. A fold over the lengths of
    lines, so no Python and no shuffle.
    """
    sizes = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([^\n]*(?:\n|\z))"), F.lit(1)), lambda x: F.octet_length(x).cast("long")), lambda n: n > 0)
    zero = F.expr("named_struct('b', 0L, 'e', 0L, 'l', 1L, 'n', 0L, 'out', cast(array() as array<struct<start_byte: bigint, end_byte: bigint, start_line: bigint, end_line: bigint>>))")

    def state(b, e, line, n, out) -> Column:
        return F.struct(b.alias("b"), e.alias("e"), line.alias("l"), n.alias("n"), out.alias("out"))

    def span(s: Column, end: Column, n: Column) -> Column:
        return F.array(F.struct(s["b"].alias("start_byte"), end.alias("end_byte"), s["l"].alias("start_line"), (s["l"] + n - 1).alias("end_line")))

    def step(s: Column, x: Column) -> Column:
        end, n = s["e"] + x, s["n"] + 1
        full = n >= lines
        if size is not None:
            full = full | (end - s["b"] >= size)
        return F.when(full, state(end, end, s["l"] + n, F.lit(0).cast("long"), F.concat(s["out"], span(s, end, n)))).otherwise(state(s["b"], end, s["l"], n, s["out"]))

    spans = F.aggregate(sizes, zero, step, lambda s: F.when(s["n"] > 0, F.concat(s["out"], span(s, s["e"], s["n"]))).otherwise(s["out"]))
    raw = text.cast("binary")
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start_byte"].alias("start_byte"), s["end_byte"].alias("end_byte"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line"),
            F.substring(raw, (s["start_byte"] + 1).cast("int"), (s["end_byte"] - s["start_byte"]).cast("int")).cast("string").alias("text"),
        ),
    )


def file_kind(path: Column) -> Column:
    """The extension with its dot; a name that begins with its only dot, or has none, has no extension."""
    kind = F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)
    return F.when(kind == "", "no extension").otherwise(kind)


#: Extension to language.
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go"}


def language_for_path(path: Column) -> Column:
    """The language that anchors are known for; null for any other."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(names, F.regexp_extract(path, r"\.([^./]+)$", 1))


def within(text: Column, size: Column | int) -> Column:
    """The longest start of a text that has at most `size` bytes and ends at a character."""
    size = F.lit(size) if isinstance(size, int) else size
    # at most three bytes of an unfinished character stand at the cut: the first cut that is valid UTF-8 is the longest
    raw = text.cast("binary")
    cuts = [F.substring(raw, F.lit(1), F.greatest(F.lit(0), size - k).cast("int")) for k in range(4)]
    return F.when(F.octet_length(text) <= size, text).otherwise(F.coalesce(*[F.try_validate_utf8(c.cast("string")) for c in cuts]))


def clipped(text: Column, size: int, mark: str = "[cut]") -> Column:
    """within(), with a mark in place of what does not fit; the whole stays within `size` bytes."""
    room = max(0, size - len(mark.encode()))
    return F.when(F.octet_length(text) <= size, text).otherwise(F.concat(within(text, room), F.lit(mark)))


def one_line(text: Column) -> Column:
    """A text on one line: newline, carriage return and tab as escapes, other control characters as \\u00XX."""
    out = F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    for code in (*range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return out


def carried_bytes(text: Column) -> Column:
    """Bytes that a text takes as a JSON string: two for each quote, backslash and short escape, six for other control characters."""
    short = F.octet_length(F.regexp_replace(text, r'[^"\\\n\r\t\x08\x0c]', "")).cast("long")
    long = F.octet_length(F.regexp_replace(text, r"[^\x00-\x07\x0b\x0e-\x1f]", "")).cast("long")
    return F.octet_length(text).cast("long") + short + 5 * long


def join_in_tree(base: Column, relative: Column) -> Column:
    """A relative path from a folder of a tree, without `.` and `..`; null where it climbs out of the tree or is absolute."""
    none = F.lit(None).cast("array<string>")

    def step(out: Column, part: Column) -> Column:
        return (
            F.when(out.isNull(), none)
            .when((part == "") | (part == "."), out)
            .when((part == "..") & (F.size(out) == 0), none)
            .when(part == "..", F.slice(out, F.lit(1), F.size(out) - 1))
            .otherwise(F.concat(out, F.array(part)))
        )

    joined = F.aggregate(F.split(F.concat_ws("/", base, relative), "/"), F.array().cast("array<string>"), step)
    return F.when(~F.startswith(relative, F.lit("/")), F.array_join(joined, "/"))


#: Terms that are proposed for a question: at most so many, of so many bytes.
TERMS, TERM_BYTES = 4, 48


def permitted_terms(proposed: Column) -> Column:
    """Of an array of proposed terms the first TERMS that hold only letters, digits and _-./*: and are short enough."""
    good = F.filter(proposed, lambda t: (t != "") & (F.octet_length(t) <= TERM_BYTES) & t.rlike(r"^[\p{L}\p{N}_\-./*:]+$"))
    return F.slice(good, 1, TERMS)


def proposed_query(proposed: Column) -> Column:
    """The parts of all permitted terms, each once, in order."""
    return F.array_distinct(F.flatten(F.transform(permitted_terms(proposed), query_terms)))


def question(task: Column, selectors: Column) -> Column:
    """A task and its selectors as one text."""
    return F.concat_ws(" ", task, selectors)


def symbols(task: Column, selectors: Column) -> Column:
    """Words that look like identifiers, sorted, each once: selector words of more than two bytes, and words of the task
    with an underscore or dot inside or a capital after a small first letter. Of a dotted word its parts count too."""
    word = F.lit(r"([\p{L}\p{N}_.]+)")

    def cleaned(text: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, word, F.lit(1)), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))

    shaped = F.filter(cleaned(task), lambda w: w.rlike(r"[_.]|^\p{Ll}.*\p{Lu}"))
    named = F.flatten(F.transform(selectors, cleaned))
    found = F.filter(F.concat(shaped, named), lambda w: F.octet_length(w) > 2)
    parts = F.flatten(F.transform(F.filter(found, lambda w: F.contains(w, F.lit("."))), lambda w: F.split(w, r"\.")))
    return F.array_sort(F.array_distinct(F.concat(found, F.filter(parts, lambda w: F.octet_length(w) > 2))))


def hits(terms: Column, text: Column) -> Column:
    """How many of the terms, repeats included, occur in a text as substrings, case aside."""
    return _let(F.lower(text), lambda t: F.size(F.filter(terms, lambda x: F.contains(t, x))))


def locator(repository: Column, path: Column, start_line: Column, end_line: Column, tree: Column) -> Column:
    """How a citation names its lines."""
    return F.format_string("%s:%s lines %d-%d at tree %s", repository, path, start_line, end_line, tree)


def line_range(value: Column) -> Column:
    """(first, last) of `from-to`, counted from 1, both included; null where malformed, which stands for the whole text."""
    m = F.regexp_extract(value, r"^([0-9]{1,15})-([0-9]{1,15})$", 1), F.regexp_extract(value, r"^([0-9]{1,15})-([0-9]{1,15})$", 2)
    first, last = (F.when(x != "", x.cast("long")) for x in m)
    return F.when((first >= 1) & (last >= first), F.struct(first.alias("first"), last.alias("last")))


def lines_of(text: Column, value: Column) -> Column:
    """The lines that a `lines` qualifier names; the whole text where it is malformed."""
    parts = F.regexp_extract_all(text, F.lit(r"([^\n]*\n|[^\n]+\z)"), F.lit(1))
    r = line_range(value)
    picked = F.array_join(F.slice(parts, r["first"].cast("int"), (r["last"] - r["first"] + 1).cast("int")), "")
    return F.when(r.isNull(), text).otherwise(picked)


def excerpt(text: Column, start: Column, end: Column, terms: Column, size: int = CHUNK_BYTES) -> Column:
    """The bytes start to end of a text if there are at most `size`; else a window of that size about the first hit of a term
    in the span, clamped to it and moved outwards to whole characters."""
    raw = text.cast("binary")

    def cut(a: Column, b: Column) -> Column:
        return F.substring(raw, (a + 1).cast("int"), F.greatest(F.lit(0), b - a).cast("int"))

    span = cut(start, end).cast("string")
    found = F.array_min(F.filter(F.transform(terms, lambda t: F.position(t, F.lower(span))), lambda p: p > 0))
    hit = F.octet_length(F.substring(span, F.lit(1), F.coalesce(found, F.lit(1)) - 1))
    room = end - start - size
    at = start + F.greatest(F.lit(0).cast("long"), F.least(hit - size // 2, room)).cast("long")
    # a byte of the form 10xxxxxx goes on with a character: the window begins and ends before no such byte
    def whole(p: Column) -> Column:
        back = [F.when(~F.hex(cut(p - k, p - k + 1)).rlike("^[89AB]"), p - k) for k in range(4)]
        return F.when(p >= end, end).otherwise(F.coalesce(*back, p))

    a = whole(at)
    return F.when(end - start <= size, span).otherwise(cut(a, whole(at + size)).cast("string"))
