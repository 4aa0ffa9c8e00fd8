"""Named queries over the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cursor, outline, paging, ranked
from ..sources import api_xml, assemblies, documents, inverted, markdown, packages, skipping
from . import api, bindings, docs, service
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def doc_line_search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page, from the eleventh hit, of a literal search of lines."""
    return docs.search(bindings.docs(spark, sf_dir), "the", limit=50, offset=10)


@query
def doc_line_search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.search(bindings.docs(spark, sf_dir), r"(?i)\b(th|qu)[a-z]+ (de|of|the) ", regex=True, limit=40)


@query
def doc_search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal search of stored documents: files without its trigrams are not read."""
    return docs.search(bindings.stored_docs(spark, sf_dir).read(["tionle"]), "tionle", limit=50)


@query
def doc_pattern_search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern's literals decide which files are read."""
    pattern = r"[Tt]ion[a-z]*\."
    return docs.search(bindings.stored_docs(spark, sf_dir).read(skipping.literals_of(pattern, True)), pattern, regex=True, limit=50)


@query
def search_filters_keep_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For some needles the documents that hold it, and those among the files that its trigrams leave: the same numbers."""
    stored = bindings.stored_docs(spark, sf_dir)
    needles = ("tion", "tionle", "ouè", "benchmark", "zzzz", "e, l")
    whole = spark.read.parquet(stored.table).agg(*[F.count_if(F.col("text").contains(n)).alias(f"n{i}") for i, n in enumerate(needles)])
    whole = whole.select(F.explode(F.array(*[F.struct(F.lit(n).alias("needle"), F.col(f"n{i}").alias("n")) for i, n in enumerate(needles)])).alias("r")).select("r.*")
    kept = reduce(lambda a, b: a.unionByName(b), [stored.read([n]).agg(F.count_if(F.col("text").contains(n)).alias("n_read")).select(F.lit(n).alias("needle"), "n_read") for n in needles])
    return whole.join(kept, "needle")


def _talks(spark: SparkSession, sf_dir: str, front_matter: bool = False) -> tuple[DataFrame, DataFrame]:
    d = markdown.structured(bindings.conversations_md(spark, sf_dir, front_matter))
    return d, outline.section_paths(markdown.heading_rows(d))


@query
def doc_search_with_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = bindings.conversations_md(spark, sf_dir)
    return docs.search(markdown.structured(raw), "e", limit=60, sections_of=raw)


@query
def doc_search_frontmatter_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = bindings.conversations_md(spark, sf_dir, True)
    return docs.search(markdown.structured(raw), "user", limit=60, sections_of=raw)


@query
def doc_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talks(spark, sf_dir)[1].drop("n_lines")


@query
def doc_atomic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.block_rows(_talks(spark, sf_dir, True)[0])


@query
def doc_pages_by_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bindings.docs(spark, sf_dir).withColumns({"body_start": F.lit(1), "blocks": F.array().cast("array<struct<kind:string,start_line:int,end_line:int>>")})
    return paging.paginate(d, 1000)


@query
def doc_pages_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.paginate(_talks(spark, sf_dir, True)[0], 400)


@query
def doc_line_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every space of a document turned into one of the seven line ends, by its id; then the lines."""
    ends = ["\r\n", "\r", "\f", "\u0085", "\u2028", "\u2029", "\n"]
    end = F.element_at(F.array(*[F.lit(e) for e in ends]), (F.col("doc_id") % 7 + 1).cast("int"))
    d = bindings.table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" "), end).alias("text"))
    return d.select("doc_id", F.posexplode(text.lines_of(F.col("text"))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


@query
def faq_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as question-and-answer files, read, rendered as Markdown, or skipped with the reason."""
    return documents.parse_files(bindings.faq_files(spark, sf_dir), "talks")


@query
def source_xml_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and members of XML descriptions, with their documentation."""
    t = api_xml.tables(api_xml.parse_files(bindings.xml_files(spark, sf_dir)))
    members = t["members"].withColumn("parameters", F.to_json("parameters")).drop("value")
    return members.join(t["types"].select(F.col("declaration_id").alias("type_id"), "namespace", "type_name", "full_name"), "type_id")


@query
def source_xml_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api_xml.tables(api_xml.parse_files(bindings.xml_files(spark, sf_dir)))["uses"]


@query
def source_xml_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api_xml.tables(api_xml.parse_files(bindings.xml_files(spark, sf_dir)))["prose"]


@query
def source_xml_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and members that could not be read, counted by file."""
    return api_xml.tables(api_xml.parse_files(bindings.xml_files(spark, sf_dir)))["skipped"].groupBy("path").agg(F.count("*").alias("n"))


@query
def source_package_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documentation files of package archives, by framework; an archive that is refused is a row with an error."""
    assets = packages.read_archives(bindings.package_files(spark, sf_dir), "Corp")
    docs = api_xml.compiler_doc_rows(assets.filter("error is null").select(F.concat_ws("|", "path", "framework").alias("path"), F.col("xml").alias("content")))
    refused = assets.filter("error is not null").select("path", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("summary"), F.lit(0).alias("n_parameters"), F.lit(True).alias("refused"))
    return docs.select("path", "id", "summary", F.size("parameters").alias("n_parameters"), F.lit(False).alias("refused")).unionByName(refused)


@query
def source_assembly_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible members of compiled assemblies, what was skipped, and which files are none."""
    found = assemblies.member_rows(bindings.assembly_files(spark, sf_dir))
    return found.select("path", "type_id", "full_name", "declaration_id", "name", "kind", "signature", "return_type", F.col("skipped").isNotNull().alias("is_skipped"), F.col("error").isNotNull().alias("is_refused"))


@query
def doc_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of each document under a budget, from where the first one ends."""
    d = _talks(spark, sf_dir, True)[0]
    pages = paging.paginate(d, 400).filter("page = 2")
    return docs.lines(d).join(pages, ["repo", "path"]).filter("line_no >= start_line and line_no < end_line").select("path", "line_no", "line")


@query
def input_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.table(spark, sf_dir, "pages").select("page_id", text.repair_column(F.col("html")).alias("html"))


def _names(found: DataFrame, limit: int) -> DataFrame:
    return ranked.page(found, list(api.NAME_ORDER), limit).select("name", "matched_on", "namespace_depth", "position")


@query
def api_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(api.search_names(bindings.types(spark, sf_dir), "NATION_1"), 100)


@query
def api_type_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(api.search_names(bindings.types(spark, sf_dir), "supplier1"), 20)


@query
def api_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.search_prose(bindings.prose(spark, sf_dir), "tion")
    return ranked.page(found, list(api.PROSE_ORDER), 100).select("symbol", "declaration_id", "element", "text", "is_truncated", "more_from_symbol", "position")


@query
def prose_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bindings.table(spark, sf_dir, "documents")
    t = F.concat(F.replace("text", F.lit(". "), F.lit(".\n \n")), F.lit(" see <xref:"), F.col("source"), F.lit("%2E"), F.col("lang"), F.lit("*?alt=x>"))
    return d.select("doc_id", text.normalise_prose(t).alias("text"))


@query
def api_reference_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.filter_references(api.find_references(bindings.uses(spark, sf_dir), "System.ECONOMY", bindings.types(spark, sf_dir)), kind="parameter")
    return ranked.page(found, ["symbol", "kind", F.coalesce("parameter_name", F.lit("")), "type_expression"], 100).select("symbol", "kind", "parameter_name", "type_expression", "is_exact", "position")


@query
def api_reference_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.reference_totals(api.find_references(bindings.uses(spark, sf_dir), "System.ECONOMY", bindings.types(spark, sf_dir)))


@query
def api_references_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by the canonical names of packages and the expressions of repositories, from the inverted table; those that are not the type alone."""
    symbol = "System.ECONOMY"
    found = api.find_references(inverted.uses_of(bindings.canonical_uses(spark, sf_dir), symbol), symbol, bindings.types(spark, sf_dir))
    found = api.filter_references(found, exact=False)
    return ranked.page(found, ["symbol", "kind", F.coalesce("parameter_name", F.lit("")), "type_expression"], 100).select("origin", "symbol", "kind", "parameter_name", "type_expression", "is_exact", "position")


@query
def api_attribute_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.attribute_references(bindings.attribute_uses(spark, sf_dir), bindings.attribute_types(spark, sf_dir))


@query
def api_lookup_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged members of one type, named without namespace and arity."""
    ids = api.resolve_symbol(bindings.types(spark, sf_dir), "Supplier7").select("type_id")
    found = api.lookup(bindings.members(spark, sf_dir, ids), ids)
    return ranked.page(found, ["full_name", "name", "signature", "declaration_id"], 100).select("full_name", "name", "signature", "origin", "declaration_id", "position")


@query
def api_members_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All types' members at one framework, merged by priority and counted."""
    found = api.lookup(bindings.members(spark, sf_dir), bindings.types(spark, sf_dir).select(F.col("declaration_id").alias("type_id")), framework="NET9.0")
    return found.groupBy("full_name", "origin").agg(F.count("*").alias("n_members"), F.countDistinct("name").alias("n_names"), F.min("signature").alias("first_signature"))


@query
def api_container_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bindings.types(spark, sf_dir)
    nested = t.filter("s_suppkey % 2 = 0").select(F.col("full_name").alias("namespace"), F.concat("full_name", F.lit(".Nested")).alias("full_name"))
    return api.containers(t.select("namespace", "full_name").unionByName(nested))


@query
def docs_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bindings.members(spark, sf_dir)
    d = m.filter("origin = 'nuget'").groupBy("declaration_id").agg(F.max("summary").alias("doc"))
    return api.with_docs(m.select("declaration_id", "origin"), d).select("declaration_id", "origin", F.coalesce("doc", F.lit("")).alias("doc"))


@query
def skip_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.skip_histogram(bindings.skips(spark, sf_dir))


@query
def skip_histogram_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.merge_histograms(api.skip_histogram(bindings.skips(spark, sf_dir)))


@query
def page_cursor_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a search, by the cursor that the first one ends with."""
    here, revisions = cursor.scope("tion", False, None, 20), ["local"]
    token = cursor.encode("lang-search", here, 20, revisions)
    return docs.search(bindings.docs(spark, sf_dir), "tion", limit=20, offset=cursor.decode(token, "lang-search", here, revisions))


@query
def api_lookup_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a look-up over all sources at a framework, its members put together again by type."""
    c = service.compose(bindings.ingested(spark, sf_dir), framework="NET9.0")
    nested = service.nest(service.lookup_page(c, "Supplier7", 5, 5))
    return nested.select("full_name", "revision", "detail", F.to_json("members").alias("members"), "is_partial")


@query
def api_lookup_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look-up by type and member: each backend without such a type takes the last segment as the member; documentation in full."""
    c = service.compose(bindings.ingested(spark, sf_dir))
    return service.lookup_page(c, "Supplier7.Part4", 50).select("full_name", "revision", "detail", "name", "signature", "member_origin", "summary", "returns", "position", "is_partial")


@query
def api_lookup_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of four symbols: a type, one of its members, a member that it doesn't have, and no type."""
    c = service.compose(bindings.ingested(spark, sf_dir))
    rows = [service.lookup_outcome(c, s).select(F.lit(s).alias("symbol"), "outcome", F.array_join("resolved_types", " ").alias("resolved_types")) for s in ("Supplier7<T>", "Supplier7.Part4", "Supplier7.Part77", "Nothing.Such")]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query
def api_search_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a name search over all sources; of a type that several backends have the first one's row."""
    c = service.compose(bindings.ingested(spark, sf_dir))
    return service.search_page(c, "Supplier", 4, 4).select("name", "matched_on", "namespace_depth", "revision", "position", "is_partial")


@query
def api_text_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prose search of one source, repositories and packages, two hits of a symbol at most."""
    c = service.compose(bindings.ingested(spark, sf_dir), source="app")
    return service.text_page(c, "tion", 40).select("symbol", "element", "text", "is_truncated", "more_from_symbol", "revision", "position", "is_partial")


@query
def api_references_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute applications that mean the long name's type are left out where that type exists, and kept elsewhere."""
    c = service.compose(bindings.ingested(spark, sf_dir))
    return service.references_page(c, "System.ECONOMY", kind="attribute", limit=60).select("symbol", "kind", "type_expression", "attribute_type", "is_exact", "revision", "position", "is_partial")


@query
def api_references_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.reference_summary(service.compose(bindings.ingested(spark, sf_dir)), "System.ECONOMY")


@query
def api_skipped_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the packages of an answer left out, by reason."""
    return service.skipped_summary(service.compose(bindings.ingested(spark, sf_dir)))


__all__ = ["ORACLES", "QUERIES"]
