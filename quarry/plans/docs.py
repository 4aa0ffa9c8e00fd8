"""Queries over document trees: line search, sections, outlines, pages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import matching, ranking, text
from ..operators import cursor, outline, paging, ranked
from ..sources import catalog, markdown, skipping

ORDER = ("tier", "head", "path", "line_no", "repo")


def lines(docs: DataFrame) -> DataFrame:
    """(repo, path, line_no from 1, line) of documents; those with ``body_start`` begin there."""
    extra = [c for c in ("body_start", "rendered_from") if c in docs.columns]
    out = docs.select("repo", "path", *extra, F.posexplode(text.lines_of(F.col("text"))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    return out.filter(F.col("line_no") >= F.col("body_start")).drop("body_start") if "body_start" in docs.columns else out


def line_hits(docs: DataFrame, query: str, regex: bool = False) -> DataFrame:
    """Lines that hold the query, case-sensitive, or match it as a pattern. The match sees the whole line, the result a cut one."""
    found = lines(docs)
    found = found.filter(matching.line_matches(F.col("line"), query) if regex else F.col("line").contains(query))
    cut, more = text.within_budget(F.col("line"))
    return found.withColumns({"tier": ranking.document_tier(F.col("path")), "head": ranking.heading_rank(F.col("line")), "text": cut, "is_truncated": more}).drop("line")


def page_sections(page: DataFrame, docs: DataFrame) -> DataFrame:
    """A page's lines with their sections. Of the documents those on the page are parsed only; these are as few as its rows, which the page's limit bounds."""
    here = docs.join(F.broadcast(page.select("repo", "path").distinct()), ["repo", "path"], "left_semi")
    return outline.attribute_sections(page, outline.section_paths(markdown.heading_rows(markdown.structured(here))))


def search(docs: DataFrame, query: str, regex: bool = False, limit: int = 20, offset: int = 0, sections_of: DataFrame | None = None) -> DataFrame:
    """One ranked page of line hits, with their sections if documents to take them from are given."""
    if not query:
        raise QueryError("invalid_request", "the query is empty")
    page = ranked.page(line_hits(docs, query, regex), list(ORDER), limit, offset).drop("tier", "head")
    return page_sections(page, sections_of) if sections_of is not None else page


def search_repaired(docs: DataFrame, query: str, regex: bool = False, limit: int = 20, offset: int = 0) -> tuple[DataFrame, str, bool]:
    """(page, the query that was used, whether it was repaired): repair is tried after no literal hit only, and kept if it finds something."""
    page = search(docs, query, regex, limit, offset)
    fixed, changed = text.repair_input(query)
    if regex or not changed or not fixed.strip() or not line_hits(docs, query).isEmpty():
        return page, query, False
    if line_hits(docs, fixed).isEmpty():
        return page, query, False
    return search(docs, fixed, False, limit, offset), fixed, True


def snapshot_documents(spark: SparkSession, sources: dict[str, catalog.Source], cache: str, source: str | None = None) -> tuple[DataFrame, list[str]]:
    """(documents, revisions) of one source that holds documents, or of all; any that isn't synced is an error, never left out."""
    names = sorted(n for n, s in sources.items() if s.markdown)
    if source is not None and source not in names:
        raise QueryError("invalid_request", f"source is one of {', '.join(names)}")
    found, revisions = [], []
    for name in [source] if source is not None else names:
        state, tables = catalog.snapshot(spark, sources, cache, name)
        found.append(tables["docs"])
        revisions.append(catalog.revision_key("git", repository=state["repository"], ref=state["ref"], commit=state["commit"]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found), revisions


def snapshot_filters(spark: SparkSession, sources: dict[str, catalog.Source], cache: str, source: str | None = None) -> Callable[[list[str]], DataFrame]:
    """For ``search_docs``: what gives the documents of one source, or of all, that may hold some literals, from the files that their filters don't leave out."""
    names = sorted(n for n, s in sources.items() if s.markdown) if source is None else [source]

    def narrow(literals: list[str]) -> DataFrame:
        parts = []
        for name in names:
            state, tables = catalog.snapshot(spark, sources, cache, name)
            index = catalog.indexes(spark, cache, name, state).get("docs")
            parts.append(index.read(literals) if index else tables["docs"])
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    return narrow


def search_docs(
    docs: DataFrame, query: str, regex: bool = False, source: str | None = None, limit: int = 20, token: str | None = None, revisions: list[str] | None = None,
    narrow: Callable[[list[str]], DataFrame] | None = None,
) -> dict:
    """One page of line hits with their sections, where it ends, and notes: how the query was read, and which documents could not be.

    ``docs`` are a source's documents, those that could not be read marked by ``skipped``. ``narrow`` gives those among which all are that hold some literals, by
    their filters (see ``snapshot_filters``). The cursor is bound to the query as it was used.
    """
    if not 1 <= limit <= 100:
        raise QueryError("invalid_request", "limit is 1 to 100")
    if not query or not query.strip():
        raise QueryError("invalid_request", "the query is empty")
    missing = docs.filter("skipped is not null").select("repo", "path", F.col("skipped").alias("reason")) if "skipped" in docs.columns else None

    def readable(asked: str) -> DataFrame:
        found = narrow(skipping.literals_of(asked, regex)) if narrow else docs
        return markdown.structured(found.filter("skipped is null").drop("skipped") if "skipped" in found.columns else found)

    used, fixed = query, text.repair_input(query)[0]
    if not regex and fixed != query and fixed.strip() and line_hits(readable(query), query).isEmpty() and not line_hits(readable(fixed), fixed).isEmpty():
        used = fixed
    here = cursor.scope(used, regex, source, limit)
    offset = cursor.decode(token, "lang-search", here, revisions or [])
    found = line_hits(readable(used), used, regex)
    ranked.check_offset(found, offset)
    page = ranked.page(found, list(ORDER), limit, offset, more="is_partial").drop("tier", "head")
    rows = page.collect()  # the limit bounds them
    if rows:
        on_page = reduce(lambda a, b: a | b, [(F.col("repo") == r) & (F.col("path") == p) for r, p in sorted({(r["repo"], r["path"]) for r in rows})])
        lines_ = docs.sparkSession.createDataFrame(rows, page.schema)
        rows = outline.attribute_sections(lines_, outline.section_paths(markdown.heading_rows(readable(used).filter(on_page)))).orderBy("position").collect()
    partial = bool(rows) and rows[0]["is_partial"]
    skips = [r.asDict() for r in missing.orderBy("repo", "path").collect()] if missing is not None else []
    read = f"The query was read as {used!r}." if used != query else None
    return {
        "hits": [{k: v for k, v in r.asDict().items() if k != "is_partial"} for r in rows], "is_partial": partial, "skipped_documents": skips,
        "next_page_token": cursor.encode("lang-search", here, offset + limit, revisions or []) if partial else None, "searched_sources": revisions or [],
        "note": catalog.combined_note(read, f"{len(skips)} documents could not be read." if skips else None),
    }


def get_outline(docs: DataFrame, repo: str, path: str, limit: int = 100, offset: int = 0) -> DataFrame:
    one = markdown.structured(docs.filter((F.col("repo") == repo) & (F.col("path") == check_path(path))))
    return ranked.page(outline.section_paths(markdown.heading_rows(one)), ["start_line"], limit, offset)


def check_path(path: str) -> str:
    """A relative path of a document inside its root, with forward slashes."""
    clean = path.replace("\\", "/")
    parts = clean.split("/")
    bad = not clean.strip() or clean.startswith("/") or ":" in parts[0] or ".." in parts or not clean.lower().endswith((".md", ".yml", ".yaml"))
    if bad:
        raise QueryError("path_not_found", f"no document {path!r}")
    return "/".join(p for p in parts if p not in ("", "."))


def get_document(docs: DataFrame, repo: str, path: str, section: str | None = None, limit: int = 8000, token: str | None = None, revisions: list[str] | None = None) -> dict:
    """A slice of one document under a budget of characters: {text, start_line, end_line, next}. One row is collected."""
    if not 1000 <= limit <= 50_000:
        raise QueryError("invalid_request", "limit is 1000 to 50000 characters")
    one = docs.filter((F.col("repo") == repo) & (F.col("path") == check_path(path)))
    row = markdown.structured(one).first()
    if row is None:
        raise QueryError("path_not_found", f"no document {path!r} in {repo!r}")
    lines_, first, bound = row["text"].split("\n"), row["body_start"], row["n_lines"] + 1
    if section is not None:
        at = outline.section_paths(markdown.heading_rows(markdown.structured(one))).filter(F.col("section_path") == section).orderBy("start_line").first()
        if at is None:
            raise QueryError("section_not_found", f"no section {section!r}")
        first, bound = at["start_line"], at["end_line"]
    here = cursor.scope(repo, path, section, limit)
    start = cursor.decode(token, "lang-doc", here, revisions or []) or first
    if first >= bound:
        return {"text": "", "start_line": first, "end_line": first, "next": None}
    if not first <= start < bound:
        raise QueryError("invalid_cursor", "the cursor is outside the range")
    cost = paging.np.concatenate([[0], paging.np.cumsum([len(x) + 1 for x in lines_])])
    end = paging.page_end(cost, [(b["start_line"], b["end_line"]) for b in row["blocks"]], start, bound, limit)
    return {"text": "\n".join(lines_[start - 1 : end - 1]), "start_line": start, "end_line": end, "next": cursor.encode("lang-doc", here, end, revisions or []) if end < bound else None}
