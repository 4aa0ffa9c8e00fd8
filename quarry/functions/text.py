"""Text functions on columns, and their driver-side forms for caller input."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that ends a line: CRLF, CR, FF, NEL, LS and PS become LF; VT does not end one.
LINE_BREAKS = r"\r\n|[\r\f\x{85}\x{2028}\x{2029}]"
PLACEHOLDER = "To be added."
BUDGET = 300


def normalise_line_breaks(text: Column) -> Column:
    return F.regexp_replace(text, LINE_BREAKS, "\n")


def lines_of(text: Column) -> Column:
    """The lines of a text, a trailing empty one included."""
    return F.split(normalise_line_breaks(text), "\n", -1)


def flatten_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def collapse_paragraphs(text: Column) -> Column:
    """White space becomes one space, but blank lines go on separating paragraphs."""
    paragraphs = F.transform(F.split(text, r"\n[ \t]*\n\s*"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")


def resolve_references(text: Column) -> Column:
    """``<xref:Name*?query>`` becomes Name, percent signs decoded.

    Each reference is decoded by itself; a plus sign is no space there, so it is escaped before.
    """
    pattern = r"<xref:([^>?]*?)\**(?:\?[^>]*)?>"
    names = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: F.coalesce(F.try_url_decode(F.replace(n, F.lit("+"), F.lit("%2B"))), n))
    gaps = F.split(text, pattern, -1)
    return F.when(text.contains("<xref:"), F.array_join(F.zip_with(gaps, names, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")).otherwise(text)


def normalise_prose(text: Column, collapse: bool = True) -> Column:
    """Null for blank or placeholder prose."""
    resolved = resolve_references(text)
    out = F.trim(collapse_paragraphs(resolved) if collapse else resolved)
    return F.when((out != "") & (out != PLACEHOLDER), out)


def within_budget(text: Column, budget: int = BUDGET) -> tuple[Column, Column]:
    """(text cut to the budget, whether it was cut)."""
    if budget <= 0:
        raise ValueError("the budget must be positive")
    return F.substring(text, 1, budget), F.length(text) > budget


def strip_id_prefix(name: Column) -> Column:
    """``T:System.String`` becomes System.String."""
    return F.regexp_replace(name, r"^[A-Za-z]:(?=.)", "")


def strip_arity(name: Column) -> Column:
    """``Span`1`` becomes Span; a back-tick in the middle stays."""
    return F.regexp_replace(name, r"(?<=.)`\d+$", "")


def strip_all_arity(name: Column) -> Column:
    """``Outer`1.Inner`2`` becomes Outer.Inner."""
    return F.regexp_replace(name, r"`\d*", "")


def strip_arguments(name: Column) -> Column:
    """``Outer<T>.Inner<K, V>`` becomes Outer.Inner: what stands between angle brackets goes, however deep they are nested."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "<", 1).when(c == ">", -1).otherwise(0)
        return F.struct(F.concat(s["out"], F.when((s["depth"] == 0) & ~c.isin("<", ">"), c).otherwise(F.lit(""))).alias("out"), depth.alias("depth"))

    return F.when(F.contains(name, F.lit("<")), F.aggregate(F.split(name, ""), state, step, lambda s: s["out"])).otherwise(name)


def longest_token(query: str) -> str:
    """The longest run of characters other than white space, the first of equals; the query itself if it has none."""
    return max(query.split(), key=len, default=query)


def collapse_quoted(message: Column) -> Column:
    """``The 'x' of 'y'`` becomes ``The '<>' of '<>'``; an unclosed quote keeps ``'<``."""
    return F.regexp_replace(F.regexp_replace(message, "'[^']*'", "'<>'"), "(^|[^>])'(?!<>')[^']*$", "$1'<")


_STRAIGHT = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "\u00a0": " "})


_ENTITY = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def decode_entities(value: str) -> str:
    """Numeric and known named entities that end in a semicolon, each decoded once; all else stays."""
    return _ENTITY.sub(lambda m: html.unescape(m[0]) if m[1][0] == "#" or f"{m[1]};" in html5 else m[0], value)


def repair_input(value: str) -> tuple[str, bool]:
    """Entities decoded, curly quotes straightened, no-break spaces made plain; and whether anything changed."""
    fixed = decode_entities(value).translate(_STRAIGHT)
    return fixed, fixed != value


def repair_column(text: Column) -> Column:
    """The same for a column. Every entity is decoded, by an Arrow batch; rows without an ampersand don't leave the JVM's values as they are."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(decode_entities, na_action="ignore")

    decoded = F.when(F.contains(text, F.lit("&")), decode(text)).otherwise(text)
    return F.translate(decoded, "‘’“”\u00a0", "''\"\" ")


def literal_pattern(value: str) -> str:
    """A value as a piece of a pattern that Java and RE2 read alike."""
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", value)
