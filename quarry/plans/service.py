"""The operations on API declarations over all sources: selection, composition, and one page of each answer.

A backend is the repository half of a source or one of its packages at one framework. Backends are composed in one order: all
repositories by source, then all packages; that order decides which of several declarations with one id wins. Plans are built without running a
job; the functions that return a dict collect one page of at most 100 rows and a few counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import matching, text
from ..operators import cursor, ranked
from ..sources import catalog, inverted, skipping
from . import api

DETAIL = ("signatures", "full")
OUTCOMES = ("found", "member_not_found", "not_found")
MAX_PAGE = 100


@dataclass(frozen=True)
class Backend:
    """One half of a source: its tables, with all frameworks of a package in a column ``framework``."""

    origin: str  # git or nuget
    source: str
    revision: str
    tables: dict[str, DataFrame]  # types, members, prose, uses and perhaps skipped
    package: tuple[str, ...] = ()  # id, assembly, version, digest, feed
    default_framework: str | None = None
    frameworks: tuple[str, ...] = ()
    indexes: dict[str, inverted.Inverted | skipping.Skipping] = field(default_factory=dict)  # of types, uses (by name) and prose (by trigrams)

    @property
    def order(self) -> tuple:
        return (self.origin != "git", self.package or (), self.default_framework or "") if self.origin != "git" else (False, (self.source,), "")


@dataclass(frozen=True)
class Composition:
    """The backends that answer a request, as one set of tables with origin, source, priority and revision of each row."""

    backends: list[Backend]
    framework: str | None
    default_framework: str | None
    frameworks: tuple[str, ...]
    _cache: dict = field(default_factory=dict, compare=False)

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            parts = [self._one(i, b, name) for i, b in enumerate(self.backends) if name in b.tables]
            self._cache[name] = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return self._cache[name]

    def narrowed(self, name: str, pick: Callable[[inverted.Inverted | skipping.Skipping], DataFrame | None]) -> DataFrame:
        """As ``table``, but of a backend with an index of that table the rows that ``pick`` takes from it."""
        parts = []
        for i, b in enumerate(self.backends):
            if name in b.tables:
                index = b.indexes.get(name)
                parts.append(self._one(i, b, name, pick(index) if index is not None else None))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def types_for(self, pattern: str) -> DataFrame:
        return self.narrowed("types", lambda index: inverted.types_for(index, pattern))

    def types_spelled(self, *names: str) -> DataFrame:
        return self.narrowed("types", lambda index: inverted.types_spelled(index, list(names)))

    def uses_of(self, symbol: str) -> DataFrame:
        return self.narrowed("uses", lambda index: inverted.uses_of(index, symbol))

    def prose_with(self, query: str) -> DataFrame:
        return self.narrowed("prose", lambda index: index.read([query]))

    def _one(self, priority: int, b: Backend, name: str, found: DataFrame | None = None) -> DataFrame:
        rows = b.tables[name] if found is None else found
        if b.origin == "nuget" and "framework" in rows.columns:
            rows = rows.filter(F.col("framework") == self.framework)
        own = {"origin": F.lit(b.origin), "source": F.lit(b.source), "priority": F.lit(priority), "revision": F.lit(b.revision)}
        if b.package:
            own["package_id"] = F.lit(b.package[0])
        return rows.withColumns(own)

    @property
    def revisions(self) -> list[str]:
        return [b.revision for b in self.backends]


def compose(backends: list[Backend], source: str | None = None, framework: str | None = None) -> Composition:
    """Selects the backends of a source, or of all, at the framework asked for or the default; the others have no part in the answer."""
    names = {b.source for b in backends}
    if source is not None and source not in names:
        raise QueryError("invalid_request", f"source is one of {', '.join(sorted(names))}")
    chosen = sorted((b for b in backends if source in (None, b.source)), key=lambda b: b.order)
    packages = [b for b in chosen if b.origin == "nuget"]
    if framework is not None and not packages:
        raise QueryError("invalid_request", "a framework is chosen of packages only")
    effective = None
    if packages:
        if len({(b.default_framework, b.frameworks) for b in packages}) > 1:
            raise QueryError("source_invalid", "the packages don't offer the same frameworks")
        wanted, offered = framework or packages[0].default_framework, packages[0].frameworks
        effective = next((f for f in offered if f.lower() == (wanted or "").lower()), None)
        if effective is None:
            raise QueryError("framework_not_available", f"{wanted!r} is none of {', '.join(offered)}; the default is {packages[0].default_framework!r}")
    return Composition(chosen, effective, packages[0].default_framework if packages else None, packages[0].frameworks if packages else ())


def snapshot_backends(spark: SparkSession, sources: dict[str, catalog.Source], cache: str) -> list[Backend]:
    """The backends of all sources that hold declarations, as they are synced; any that isn't is an error, never left out."""
    out = []
    for name, source in sorted(sources.items()):
        if source.markdown:
            continue
        state, tables = catalog.snapshot(spark, sources, cache, name)
        revision = catalog.revision_key("git", repository=state["repository"], ref=state["ref"], commit=state["commit"])
        out.append(Backend("git", name, revision, {t: df for t, df in tables.items() if t != "skipped"}, indexes=catalog.indexes(spark, cache, name, state)))
        for p, found in catalog.package_tables(spark, cache, name, state):
            revision = catalog.revision_key("nuget", package=p["packageId"], version=p["version"], sha512=p["sha512"], feed=p["feed"])
            package = tuple(p[k] for k in ("packageId", "assemblyName", "version", "sha512", "feed"))
            default = next(f for f in p["availableFrameworks"] if f.lower() == p["defaultFramework"].lower())
            out.append(Backend("nuget", name, revision, {t: df.drop("source") for t, df in found.items()}, package, default, tuple(p["availableFrameworks"])))
    return out


def selects_type(symbol: str) -> Column:
    """Whether a type row is named by the symbol: repositories by file name, with or without arity; packages also by display name, with or without arguments.

    A dotted symbol is compared with whole names, any other with simple ones.
    """
    dotted = "." in symbol
    shown = F.col("full_name") if dotted else F.coalesce("display_name", "type_name")
    stored = F.col("search_name") if dotted else F.substring_index("search_name", ".", -1)
    package = (shown == symbol) | (text.strip_arguments(shown) == symbol) | (stored == symbol) | (text.strip_all_arity(stored) == symbol)
    file = F.col("search_name") if dotted else F.col("type_name")
    return F.when(F.col("origin") == "nuget", package).otherwise((file == symbol) | F.startswith(file, F.lit(symbol + "`")))


def resolve(c: Composition, symbol: str) -> DataFrame:
    """Type rows with ``member``: the whole symbol as a type, and, of the backends that have no such type, its last segment as a member.

    One pass over the types; what a backend has is decided among the rows that match.
    """
    matching.check_symbol(symbol)
    types = c.types_spelled(symbol, symbol.rpartition(".")[0] or symbol)
    types = types if "display_name" in types.columns else types.withColumn("display_name", F.col("type_name"))
    head, dot, tail = symbol.rpartition(".")
    whole = F.coalesce(selects_type(symbol), F.lit(False))
    if not dot or not head:
        return types.filter(whole).withColumn("member", F.lit(None).cast("string"))
    split = F.coalesce(selects_type(head), F.lit(False))
    found = types.filter(whole | split).withColumn("_whole", whole)
    found = found.withColumn("_any", F.bool_or("_whole").over(Window.partitionBy("priority"))).filter("_whole OR NOT _any")
    return found.withColumn("member", F.when(~F.col("_whole"), F.lit(tail))).drop("_whole", "_any")


DOCS = ("summary", "parameters", "returns", "remarks")


def _held(c: Composition, symbol: str) -> DataFrame:
    """Every type that a symbol resolves to in some backend, with each of that backend's members that it selects, or none."""
    found = resolve(c, symbol).select("priority", F.col("declaration_id").alias("type_id"), "full_name", "revision", "source", F.col("member").alias("wanted"))
    m = c.table("members")
    keep = [d for d in DOCS if d in m.columns]
    m = m.select(F.col("priority").alias("_p"), F.col("type_id").alias("_t"), F.col("declaration_id").alias("member_id"), "name", "signature", "ord", F.col("origin").alias("member_origin"), *keep)
    selected = F.col("wanted").isNull() | matching.selects_member(F.col("name"), F.col("wanted"))
    return found.join(m, (F.col("priority") == F.col("_p")) & (F.col("type_id") == F.col("_t")) & selected, "left").drop("_p", "_t")


def lookup_rows(c: Composition, symbol: str, seen: Observation | None = None) -> DataFrame:
    """One row of each member of each type found, and one with a null member of each type without; with ``detail``, in no order. ``seen`` takes the outcome meanwhile.

    A type that is found as the holder of a member counts only if some backend has that member. Of the types with one id the first backend's
    gives the type's row; the members of all of them are merged by id.
    """
    rows = _held(c, symbol)
    if seen is not None:
        rows = rows.observe(seen, *_outcome())
    by_type = Window.partitionBy("type_id")
    first = F.first(F.struct("full_name", "revision", "source", F.when(F.col("wanted").isNull(), "signatures").otherwise("full").alias("detail"))).over(by_type.orderBy("priority", "full_name"))
    counts = F.bool_or(F.col("wanted").isNull() | F.col("member_id").isNotNull()).over(by_type)
    merged = F.row_number().over(Window.partitionBy("type_id", "member_id").orderBy("priority", "ord", "signature"))
    rows = rows.withColumns({"_type": first, "_counts": counts, "_n": F.count("member_id").over(by_type), "_rn": merged})
    rows = rows.filter("_counts AND _rn = 1 AND (member_id IS NOT NULL OR _n = 0)")
    docs = [F.when(F.col("_type.detail") == "full", F.col(d)).alias(d) for d in DOCS if d in rows.columns]
    return rows.select("type_id", "_type.*", "member_id", "name", "signature", "member_origin", *docs)


def lookup_order() -> list[str | Column]:
    return ["full_name", "revision", "type_id", F.coalesce("name", F.lit("")), F.coalesce("signature", F.lit("")), "member_id"]


def lookup_page(c: Composition, symbol: str, limit: int = 20, offset: int = 0) -> DataFrame:
    return ranked.page(lookup_rows(c, symbol), lookup_order(), limit, offset, more="is_partial")


def nest(page: DataFrame) -> DataFrame:
    """A page's rows put together again by type: (position of its first row, full_name, revision, detail, members, is_partial)."""
    fields = ["name", "signature", *[d for d in DOCS if d in page.columns]]
    member = F.when(F.col("member_id").isNotNull(), F.struct("position", *fields))
    rows = page.groupBy("full_name", "revision", "detail", "is_partial").agg(F.min("position").alias("position"), F.sort_array(F.collect_list(member)).alias("m"))
    return rows.select("position", "full_name", "revision", "detail", F.transform("m", lambda m: F.struct(*[m[f].alias(f) for f in fields])).alias("members"), "is_partial")


def _outcome() -> list[Column]:
    """What a look-up's outcome is told from: the rows that count, and the names of all types that the symbol resolved to."""
    return [F.count_if(F.col("wanted").isNull() | F.col("member_id").isNotNull()).alias("n"), F.array_sort(F.collect_set("full_name")).alias("resolved_types")]


def lookup_outcome(c: Composition, symbol: str) -> DataFrame:
    """One row: outcome, and the names of all types that the symbol resolved to, sorted."""
    got = _held(c, symbol).agg(*_outcome())
    return got.select(F.when(F.col("n") > 0, "found").when(F.size("resolved_types") > 0, "member_not_found").otherwise("not_found").alias("outcome"), "resolved_types")


def search_page(c: Composition, pattern: str, limit: int = 20, offset: int = 0) -> DataFrame:
    return ranked.page(api.search_names(c.types_for(pattern), pattern, first=("priority",)), [*api.NAME_ORDER, "revision"], limit, offset, more="is_partial")


def hint_for(pattern: str, n: int) -> str | None:
    """Advice for a search by a name in several parts that found nothing: look the whole up, as it may be a member, or search for its last part."""
    last = pattern.rpartition(".")[2]
    if n or last == pattern or "" in pattern.split("."):
        return None
    return f"Nothing is named {pattern!r}. A member is found with lookup_api({pattern!r}); a type with type parameters with search_api({last!r})."


def text_page(c: Composition, query: str, limit: int = 20, offset: int = 0) -> DataFrame:
    return ranked.page(api.search_prose(c.prose_with(query), query), [*api.PROSE_ORDER[:-1], "revision", "declaration_id"], limit, offset, more="is_partial")


def references(c: Composition, symbol: str) -> DataFrame:
    """All references with their sibling flag. Whether the attribute's long name is a type, each backend's own types decide."""
    return api.find_references(c.uses_of(symbol), symbol, c.types_spelled(symbol, f"{symbol}Attribute"), by=("priority",), siblings=True)


def reference_order() -> list[str | Column]:
    return ["symbol", "kind", F.coalesce("parameter_name", F.lit("")), F.coalesce("type_expression", F.lit("")), "revision", "declaration_id"]


def references_page(c: Composition, symbol: str, kind: str | None = None, exact: bool | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    found = api.filter_references(references(c, symbol).filter("not is_sibling"), kind, exact)
    return ranked.page(found, reference_order(), limit, offset, more="is_partial")


def _reference_totals() -> list[Column]:
    return [*[F.count_if((F.col("kind") == k) & ~F.col("is_sibling")).alias(f"n_{k}") for k in matching.KINDS], F.count_if("is_sibling").alias("sibling_applications")]


def sibling_type(c: Composition, symbol: str) -> DataFrame:
    """One row: the attribute type that takes the symbol's short form, if it exists."""
    return c.types_spelled(f"{symbol}Attribute").filter(F.col("full_name") == f"{symbol}Attribute").agg(F.min("full_name").alias("sibling_type"))


def reference_summary(c: Composition, symbol: str) -> DataFrame:
    """One row: the totals by kind, the sibling type that takes the symbol's short form, if one exists, and how often it is applied so."""
    totals = references(c, symbol).agg(*_reference_totals())
    return totals.withColumn("k", F.lit(0)).join(sibling_type(c, symbol).withColumn("k", F.lit(0)), "k").drop("k")


def skipped_summary(c: Composition) -> DataFrame:
    """(reason, n, partial) over the packages that take part; empty if none of them skipped anything."""
    rows = c.table("skipped").select("package_id", F.col("reason").alias("message"))
    return api.merge_histograms(api.skip_histogram(rows))


# -- answers: one page collected, with what a caller needs to go on. Totals, outcome and the length of the whole answer are taken in the job that makes the page.


def _page(rows: DataFrame, order: list[str | Column], show: Callable[[DataFrame], DataFrame], kind: str, scope: str, c: Composition, token: str | None, limit: int) -> dict:
    offset, seen = cursor.decode(token, kind, scope, c.revisions), Observation()
    page = ranked.page(rows.observe(seen, F.count(F.lit(1)).alias("n")), order, limit, offset, more="is_partial")
    got = show(page).orderBy("position").collect()
    if offset > (seen.get.get("n") or 0):
        raise QueryError("invalid_cursor", "the cursor is beyond the last row")
    partial = bool(got) and got[0]["is_partial"]
    return {
        "rows": [{k: v for k, v in r.asDict(recursive=True).items() if k != "is_partial"} for r in got], "is_partial": partial,
        "next_page_token": cursor.encode(kind, scope, offset + limit, c.revisions) if partial else None, "searched_sources": c.revisions, "offset": offset,
        "effective_framework": c.framework, "default_framework": c.default_framework, "available_frameworks": list(c.frameworks) or None, "skipped_declarations": _skipped(c),
    }


def _skipped(c: Composition) -> dict | None:
    """What the packages left out, by reason: one job over ten reasons of each package at most, which have the package's number with them."""
    if not any("skipped" in b.tables for b in c.backends if b.origin == "nuget"):
        return None
    rows = c.table("skipped").select("package_id", F.col("reason").alias("message"))
    got = api.skip_histogram(rows).collect()
    reasons: dict[str, int] = {}
    for r in got:
        reasons[r["reason"]] = reasons.get(r["reason"], 0) + r["n"]
    total = sum({r["package_id"]: r["total"] for r in got}.values())
    listed = [{"reason": k, "count": n} for k, n in sorted(reasons.items(), key=lambda x: (-x[1], x[0]))]
    return {"declarations": total, "reasons": listed, "reasons_are_partial": any(r["partial"] for r in got)} if total else None


def _limit(limit: int) -> int:
    if not 1 <= limit <= MAX_PAGE:
        raise QueryError("invalid_request", f"limit is 1 to {MAX_PAGE}")
    return limit


def _said(value: str, name: str) -> str:
    if not value or not value.strip():
        raise QueryError("invalid_request", f"{name} is empty")
    return value


def lookup_api(backends: list[Backend], symbol: str, source: str | None = None, framework: str | None = None, limit: int = 20, token: str | None = None) -> dict:
    """Types with the members of one page, the outcome, and the names of all types that the symbol resolved to."""
    _limit(limit)
    matching.check_symbol(_said(symbol, "symbol"))
    c = compose(backends, source, framework)
    scope, seen = cursor.scope(symbol, source, c.framework), Observation()
    out = _page(lookup_rows(c, symbol, seen), lookup_order(), nest, "lookup", scope, c, token, limit)
    out.pop("offset")
    resolved = list(seen.get.get("resolved_types") or [])
    outcome = "found" if seen.get.get("n") else "member_not_found" if resolved else "not_found"
    return {"types": [{k: v for k, v in t.items() if k != "position"} for t in out.pop("rows")], "outcome": outcome, "resolved_types": resolved, **out}


def search_api(backends: list[Backend], pattern: str, framework: str | None = None, limit: int = 20, token: str | None = None) -> dict:
    _limit(limit)
    c = compose(backends, None, framework)
    scope = cursor.scope(_said(pattern, "pattern"), c.framework)
    show = lambda page: page.select("name", "matched_on", "namespace_depth", "revision", "position", "is_partial")
    out = _page(api.search_names(c.types_for(pattern), pattern, first=("priority",)), [*api.NAME_ORDER, "revision"], show, "search", scope, c, token, limit)
    items = out.pop("rows")
    return {"items": items, "note": hint_for(pattern, len(items) + out.pop("offset")), **out}


def search_api_text(backends: list[Backend], query: str, source: str | None = None, framework: str | None = None, limit: int = 20, token: str | None = None) -> dict:
    _limit(limit)
    c = compose(backends, source, framework)
    scope = cursor.scope(_said(query, "query"), source, c.framework)
    show = lambda page: page.select("symbol", "element", "text", "is_truncated", "more_from_symbol", "revision", "position", "is_partial")
    out = _page(api.search_prose(c.prose_with(query), query), [*api.PROSE_ORDER[:-1], "revision", "declaration_id"], show, "search-text", scope, c, token, limit)
    out.pop("offset")
    return {"hits": out.pop("rows"), **out}


def find_api_references(
    backends: list[Backend], symbol: str, kind: str | None = None, exact: bool | None = None, source: str | None = None, framework: str | None = None, limit: int = 20, token: str | None = None
) -> dict:
    """One page of references, the totals by kind before ``kind`` and ``exact`` narrow them, and the sibling attribute that is left out, if there is one."""
    _limit(limit)
    c = compose(backends, source, framework)
    scope, seen = cursor.scope(_said(symbol, "symbol"), kind, exact, source, c.framework), Observation()
    found = api.filter_references(references(c, symbol).observe(seen, *_reference_totals()).filter("not is_sibling"), kind, exact)
    show = lambda page: page.select("symbol", "kind", "parameter_name", "type_expression", "attribute_type", "is_exact", "revision", "position", "is_partial")
    out = _page(found, reference_order(), show, "references", scope, c, token, limit)
    out.pop("offset")
    totals, sibling = seen.get, sibling_type(c, symbol).first()["sibling_type"]
    note = {"sibling_type": sibling, "applications": totals.get("sibling_applications") or 0, "next": f"Its own uses are found with find_api_references({sibling!r})."} if sibling else None
    return {"hits": out.pop("rows"), "totals": {k: totals.get(f"n_{k}") or 0 for k in matching.KINDS}, "note": note, **out}


def to_json(answer: dict | list | str | int | float | bool | None) -> str:
    """An answer as compact JSON, names in camel case, nulls left out."""
    import json

    def camel(name: str) -> str:
        first, *rest = name.split("_")
        return first + "".join(w[:1].upper() + w[1:] for w in rest)

    def clean(x):
        if isinstance(x, dict):
            return {camel(k): clean(v) for k, v in x.items() if v is not None}
        return [clean(v) for v in x] if isinstance(x, list | tuple) else x

    return json.dumps(clean(answer), separators=(",", ":"), ensure_ascii=False, default=str)


