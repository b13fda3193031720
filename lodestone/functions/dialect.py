"""Expressions that Spark SQL and DuckDB spell differently, and the text functions built on them."""

from __future__ import annotations

#: Accented Latin letters and their plain forms, in the same order.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


class Dialect:
    def __init__(self, spark: bool):
        self.is_spark = spark
        self.unnest = "explode" if spark else "unnest"

    def pick(self, spark: str, duck: str) -> str:
        return spark if self.is_spark else duck

    def text(self, pattern: str) -> str:
        """A literal whose backslashes stand for themselves."""
        quoted = "'" + pattern.replace("'", "''") + "'"
        return f"r{quoted}" if self.is_spark else quoted

    def replace(self, x: str, pattern: str, by: str) -> str:
        """All matches replaced; groups in `by` as \\1."""
        if self.is_spark:
            return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by.replace(chr(92), '$'))})"
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}, 'g')"

    def matches(self, x: str, pattern: str) -> str:
        return self.pick(f"({x} rlike {self.text(pattern)})", f"regexp_matches({x}, {self.text(pattern)})")

    def extract(self, x: str, pattern: str) -> str:
        """The first group of the first match, empty if none."""
        return f"regexp_extract({x}, {self.text(pattern)}, 1)"

    def extract_all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.text(f'({pattern})')}, 1)"

    def sha256(self, x: str) -> str:
        return self.pick(f"sha2({x}, 256)", f"sha256({x})")

    def octets(self, x: str) -> str:
        return f"cast({self.pick(f'octet_length({x})', f'strlen({x})')} as bigint)"

    def each(self, array: str, alias: str, column: str) -> str:
        """Joins a row to each element of its array."""
        return f"lateral {self.unnest}({array}) as {alias}({column})"

    def lam(self, var: str, body: str) -> str:
        return self.pick(f"{var} -> {body}", f"lambda {var}: {body}")

    def filter(self, array: str, var: str, body: str) -> str:
        return f"{self.pick('filter', 'list_filter')}({array}, {self.lam(var, body)})"

    def transform(self, array: str, var: str, body: str) -> str:
        return f"{self.pick('transform', 'list_transform')}({array}, {self.lam(var, body)})"

    def size(self, array: str) -> str:
        return f"cast({self.pick(f'size({array})', f'len({array})')} as bigint)"

    def distinct(self, array: str) -> str:
        return self.pick(f"array_sort(array_distinct({array}))", f"list_sort(list_distinct({array}))")

    def join(self, array: str, by: str = ",") -> str:
        return self.pick(f"array_join({array}, '{by}')", f"array_to_string({array}, '{by}')")

    def join_agg(self, x: str, order: str | None = None, by: str = ",", distinct: bool = False) -> str:
        d = "distinct " if distinct else ""
        return self.pick(f"listagg({d}{x}, '{by}') within group (order by {order or x})", f"string_agg({d}{x}, '{by}' order by {order or x})")

    def seconds(self, ts: str) -> str:
        return self.pick(f"unix_timestamp(cast({ts} as timestamp))", f"cast(floor(epoch({ts})) as bigint)")

    def day(self, ts: str) -> str:
        return self.pick(f"date_format({ts}, 'yyyy-MM-dd')", f"strftime({ts}, '%Y-%m-%d')")

    def month(self, ts: str) -> str:
        return self.pick(f"date_format({ts}, 'yyyy-MM')", f"strftime({ts}, '%Y-%m')")

    def instant(self, ts: str) -> str:
        return self.pick(f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')")

    def json(self, x: str, path: str) -> str:
        return self.pick(f"get_json_object({x}, '$.{path}')", f"json_extract_string({x}, '$.{path}')")

    def count_if(self, x: str) -> str:
        return f"cast(count_if({x}) as bigint)"

    # text rules

    def split_words(self, x: str) -> str:
        """Identifier parts set apart: lower then upper, upper then upper-lower, letters then digits and back."""
        for pattern in (r"(\p{Ll})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
            x = self.replace(x, pattern, r"\1 \2")
        return x

    def fold(self, x: str) -> str:
        return f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"

    def parts(self, x: str) -> str:
        """Folded identifier parts in order, repeats kept: what questions and texts are matched by."""
        return self.extract_all(self.fold(self.split_words(x)), r"[\p{L}\p{N}]+")


SPARK, DUCKDB = Dialect(True), Dialect(False)
