"""Predicates that decide what a query names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from .text import literal_pattern

KINDS = ("parameter", "return", "base", "interface", "constraint", "attribute")
# fixed values: the language's names for types
KEYWORDS = {
    "System.Boolean": "bool", "System.Byte": "byte", "System.SByte": "sbyte", "System.Char": "char", "System.Decimal": "decimal", "System.Double": "double",
    "System.Single": "float", "System.Int32": "int", "System.UInt32": "uint", "System.IntPtr": "nint", "System.UIntPtr": "nuint", "System.Int64": "long",
    "System.UInt64": "ulong", "System.Int16": "short", "System.UInt16": "ushort", "System.Object": "object", "System.String": "string", "System.Void": "void",
}


def line_matches(line: Column, pattern: str) -> Column:
    """Whether a line matches, by RE2: linear in the line, and refusing what would need backtracking before any scan."""
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid as e:
        raise QueryError("invalid_regex", str(e)) from e

    @F.pandas_udf("boolean")
    def matches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pc.match_substring_regex(pa.array(s, pa.string()), pattern).to_pandas()

    return matches(line)


def names_type(expression: Column, symbol: str) -> Column:
    """Whether a type expression names the symbol between characters that don't belong to names."""
    edge = r"[^\p{L}\p{Nd}_.+]"
    return expression.rlike(f"(^|{edge}){literal_pattern(symbol)}($|{edge})")


def is_exactly(expression: Column, symbol: str, origin: Column) -> Column:
    """Whether the expression is the symbol alone; packages accept the language's keyword for it too."""
    word = KEYWORDS.get(symbol)
    return (expression == symbol) | ((origin == "nuget") & (expression == word) if word else F.lit(False))


def selects_member(name: Column, member: str | Column) -> Column:
    """Equal, or equal up to the type arguments."""
    return (name == member) | ((F.instr(name, "<") > 1) & (F.substring_index(name, "<", 1) == member))


def match_name(namespace: Column, type_name: Column, pattern: str) -> Column:
    """struct(matched_on, depth), null if the pattern names nothing of the type.

    The pattern's segments are looked for as a run of whole segments of namespace and type: a run that ends in the type's name, of more
    than one segment, is its full name; otherwise the type's name may contain the pattern; otherwise a run inside the
    namespace matches it at a depth of the segments that follow.
    """
    part = [p.lower() for p in pattern.split(".")]
    segments = F.split(F.lower(F.concat_ws(".", namespace, type_name)), r"\.")
    n, m = F.size(segments), len(part)
    runs = F.filter(F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))), lambda i: (i + m - 1 <= n) & (F.slice(segments, i, m) == F.array(*[F.lit(p) for p in part])))
    run = F.get(runs, 0) if all(part) else F.lit(None).cast("int")
    last = run + m - 1
    full = (last == n) & F.lit(m > 1)
    inside = F.lower(type_name).contains(pattern.lower())
    space = run.isNotNull() & (last < n)
    kind = F.when(full, "fullName").when(inside, "type").when(space, "namespace")
    return F.when(kind.isNotNull(), F.struct(kind.alias("matched_on"), F.when(kind == "namespace", n - 1 - last).alias("depth")))


def applied_name(application: Column) -> Column:
    """``[assembly: Ns.Foo(1)]`` becomes Ns.Foo."""
    return F.regexp_extract(application, r"^\[?\s*(?:[A-Za-z]+:\s*)?([^(\[\]]*[^(\[\]\s])", 1)


def attribute_short_form(symbol: str) -> str | None:
    """``Ns.FooAttribute`` may be applied as Ns.Foo."""
    simple = symbol.rsplit(".", 1)[-1]
    return symbol[: -len("Attribute")] if simple.endswith("Attribute") and len(simple) > len("Attribute") else None


def check_symbol(symbol: str) -> str:
    """Refuses what could be read as a path or a pattern."""
    if not symbol.strip() or any(c in symbol for c in "/\\:*?[]") or ".." in symbol:
        raise QueryError("invalid_request", f"{symbol!r} is no symbol")
    return symbol
