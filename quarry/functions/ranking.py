"""Ranks that order search results; smaller comes first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import literal_pattern, strip_arity

# fixed values: trees of documents about the past, and of guidance
HISTORICAL = ("meetings/", "docs/release-notes/", "docs/archive/")
GUIDANCE = (
    "docs/api/", "docs/concepts/", "docs/consume-packages/", "docs/create-packages/", "docs/guides/", "docs/hosting-packages/", "docs/nuget-org/", "docs/policies/",
    "docs/quickstart/", "docs/reference/", "docs/visual-studio-extensibility/",
)


def document_tier(path: Column) -> Column:
    """0 proposals and specifications, 1 guidance, 2 other, 3 historical; 3 is decided before 1."""
    p = F.lower(path)
    holds = lambda names: p.rlike("|".join(literal_pattern(n) for n in names))
    return F.when(p.rlike("(^|/)(proposals|spec)/"), 0).when(holds(HISTORICAL), 3).when(holds(GUIDANCE), 1).otherwise(2)


def heading_rank(line: Column) -> Column:
    return F.when(F.regexp_replace(line, r"^\s+", "").startswith("#"), 0).otherwise(1)


def match_tier(matched_on: Column) -> Column:
    return F.when(matched_on == "fullName", 0).when(matched_on == "type", 1).when(matched_on == "namespace", 2).otherwise(3)


def name_tier(name: Column, matched_on: Column, pattern: str) -> Column:
    """0 if the simple name is the pattern's last segment, 1 if it begins with it, else 2; 0 for namespaces."""
    leaf = pattern.rsplit(".", 1)[-1].lower()
    simple = F.lower(strip_arity(F.substring_index(name, ".", -1)))
    return F.when((matched_on == "namespace") | (simple == leaf), 0).when(simple.startswith(leaf), 1).otherwise(2)


def dot_count(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))


def element_rank(element: Column) -> Column:
    e = element
    return (
        F.when(e == "summary", 0).when(e == "returns", 1).when(e == "remarks", 2).when(e == "value", 3)
        .when(e.startswith("param") | e.startswith("typeparam"), 4).when(e == "exception", 5).otherwise(6)
    )


def whole_word_rank(text: Column, query: str) -> Column:
    """0 if any occurrence stands between characters that are neither letters nor digits."""
    edge = r"[^\p{L}\p{Nd}]"
    return F.when(text.rlike(f"(?iu)(^|{edge}){literal_pattern(query)}($|{edge})"), 0).otherwise(1)
