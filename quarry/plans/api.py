"""Queries over API declarations: names, prose, references, look-up, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import matching, ranking, text
from ..operators import ranked


def search_names(types: DataFrame, pattern: str, first: tuple[str, ...] = ()) -> DataFrame:
    """(name, matched_on, namespace_depth and the ranks) of types that the pattern names; of types with one name the first by ``first``.

    Composed backends name a type by ``search_name``, which repositories and packages spell alike, and carry their ``revision``.
    """
    m = matching.match_name(F.col("namespace"), F.col("type_name"), pattern)
    name = F.col("search_name" if first else "full_name")
    found = types.withColumn("m", m).filter("m is not null").select(name.alias("name"), F.col("m.matched_on").alias("matched_on"), F.col("m.depth").alias("namespace_depth"), *([*first, "revision"] if first else []))
    found = ranked.first_wins(found, ["name"], [*first, "matched_on"])
    return found.withColumns({
        "match_tier": ranking.match_tier(F.col("matched_on")), "depth_rank": F.coalesce("namespace_depth", F.lit(0)),
        "name_tier": ranking.name_tier(F.col("name"), F.col("matched_on"), pattern), "dots": ranking.dot_count(F.col("name")),
    })


NAME_ORDER = ("match_tier", "depth_rank", "name_tier", "dots", "name")
PROSE_ORDER = ("element_rank", "word_rank", "symbol", "element", "text", "declaration_id")


def search_prose(prose: DataFrame, query: str, cap: int = 2) -> DataFrame:
    """Hits of prose, case-insensitive, deduplicated, ranked and capped per symbol.

    The match sees the whole text; what follows sees it cut to the budget.
    """
    found = prose.filter(F.lower("text").contains(query.lower()))
    cut, more = text.within_budget(F.col("text"))
    found = found.withColumns({"is_truncated": more, "text": cut})
    found = ranked.first_wins(found, ["declaration_id", "element", text.flatten_line(F.col("text"))], ["priority", "ord"])
    found = found.withColumns({"element_rank": ranking.element_rank(F.col("element")), "word_rank": ranking.whole_word_rank(F.col("text"), query)})
    return ranked.cap_per_key(found, "symbol", list(PROSE_ORDER), cap)


def find_references(uses: DataFrame, symbol: str, types: DataFrame | None = None, by: tuple[str, ...] = (), siblings: bool = False) -> DataFrame:
    """Uses of a type, deduplicated, with ``is_exact``; the type's own declarations are left out.

    ``by`` names the columns within which a type exists: composed backends see their own types only. With ``siblings`` the applications
    left out because they mean a sibling come along, marked ``is_sibling``, and all rows carry their ``attribute_type``.

    Where package rows carry the canonical names of the types in an expression (``type_names``), these decide.
    An applied attribute is a use of the type that it means among ``types`` (see ``attribute_references``) and of those in its
    arguments; where it means a sibling of the symbol it is left out. Without ``types`` only the symbol is taken to exist.
    """
    matching.check_symbol(symbol)
    e = F.col("type_expression")
    named = matching.names_type(e, symbol)
    if "type_names" in uses.columns:
        named = F.when((F.col("origin") == "nuget") & F.col("type_names").isNotNull(), F.array_contains("type_names", symbol)).otherwise(named)
    exact = matching.is_exactly(e, symbol, F.col("origin"))
    applied, suffixed = matching.applied_name(e), F.concat(matching.applied_name(e), F.lit("Attribute"))
    if types is None:
        known, means = uses, F.when(F.lit(matching.attribute_short_form(symbol)) == applied, F.lit(symbol)).otherwise(applied)
    else:
        here = [F.col(c).alias(f"_{c}") for c in by]
        long = types.filter(F.col("full_name").isin(symbol, f"{symbol}Attribute")).select(F.col("full_name").alias("_long"), *here).distinct()
        same = (F.col("kind") == "attribute") & (suffixed == F.col("_long"))
        for c in by:
            same &= F.col(c) == F.col(f"_{c}")
        known, means = uses.join(long, same, "left"), F.coalesce("_long", applied)
    is_attribute = F.col("kind") == "attribute"
    if "type_names" in uses.columns:
        is_attribute &= (F.col("origin") != "nuget") | F.col("type_names").isNull()
    sibling = is_attribute & (means != symbol) & (applied == symbol)
    if "attribute_type" in uses.columns:  # packages state what an application means
        stated = (F.col("origin") == "nuget") & (F.col("kind") == "attribute") & F.col("attribute_type").isNotNull()
        means = F.when(stated, F.col("attribute_type")).otherwise(means)
        exact = F.when(stated, F.col("attribute_type") == symbol).otherwise(exact)
        sibling |= stated & (F.col("attribute_type") == f"{symbol}Attribute") & (applied == symbol)
    named = F.when(is_attribute & (means == symbol), True).when(sibling, False).otherwise(named)
    exact = F.when(is_attribute, means == symbol).otherwise(exact)
    kept = named | sibling if siblings else named
    found = known.filter(kept & (F.col("owner") != symbol)).withColumn("is_exact", exact)
    if siblings:
        found = found.withColumns({"is_sibling": F.coalesce(sibling, F.lit(False)), "attribute_type": F.when(F.col("kind") == "attribute", means)})
    found = found.select(*[c for c in uses.columns if c != "attribute_type" or not siblings], *(["is_sibling", "attribute_type"] if siblings else []), "is_exact")
    keys = ["declaration_id", "kind", F.coalesce("parameter_name", F.lit("")), F.coalesce("type_expression", F.lit(""))]
    return ranked.first_wins(found, keys, ["priority", "symbol"])


def filter_references(found: DataFrame, kind: str | None = None, exact: bool | None = None) -> DataFrame:
    if kind is not None and kind not in matching.KINDS:
        raise QueryError("invalid_request", f"kind is one of {', '.join(matching.KINDS)}")
    found = found.filter(F.col("kind") == kind) if kind else found
    return found if exact is None else found.filter(F.col("is_exact") == exact)


def reference_totals(found: DataFrame) -> DataFrame:
    """One row of counts by kind, over all references whatever the page's filters."""
    return found.agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in matching.KINDS])


def attribute_references(applied: DataFrame, types: DataFrame) -> DataFrame:
    """(declaration_id, application, attribute_type, sibling): applications resolved to the type they mean.

    ``Foo`` means FooAttribute where that type exists, and Foo itself otherwise; ``sibling`` is a type of the bare name that is not meant.
    """
    t = types.select("full_name").distinct()
    a = applied.withColumn("applied", matching.applied_name(F.col("application"))).withColumn("suffixed", F.concat("applied", F.lit("Attribute")))
    a = a.join(t.select(F.col("full_name").alias("suffixed"), F.lit(True).alias("_long")), "suffixed", "left").join(t.select(F.col("full_name").alias("applied"), F.lit(True).alias("_bare")), "applied", "left")
    return a.select(
        "declaration_id", "application", F.when(F.col("_long"), F.col("suffixed")).otherwise(F.col("applied")).alias("attribute_type"), F.when(F.col("_long") & F.col("_bare"), F.col("applied")).alias("sibling")
    )


def lookup(members: DataFrame, type_ids: DataFrame, framework: str | None = None, member: str | None = None) -> DataFrame:
    """Members of the named types, one row of each declaration, repository before package.

    The framework, if given, selects package rows only. Order by full_name, name, signature.
    """
    rows = members.join(type_ids, "type_id", "left_semi")
    if framework is not None:
        rows = rows.filter((F.col("origin") == "git") | (F.lower("framework") == framework.lower()))
    if member is not None:
        rows = rows.filter(matching.selects_member(F.col("name"), member))
    return ranked.merge_by_priority(rows, ties=("framework", "signature"))


def resolve_symbol(types: DataFrame, symbol: str) -> DataFrame:
    """(type_id, member): the whole symbol as a type; only where no type has that name, its last segment as a member. What there is, is told from the rows that match."""
    matching.check_symbol(symbol)

    def named(name: str) -> Column:
        full = F.col("full_name") if "." in name else F.col("type_name")
        return F.coalesce((full == name) | (text.strip_arity(full) == name), F.lit(False))

    head, dot, tail = symbol.rpartition(".")
    whole = named(symbol)
    found = types.filter(whole | named(head) if dot else whole).select(F.col("declaration_id").alias("type_id"), whole.alias("_whole"))
    found = found.withColumn("_any", F.bool_or("_whole").over(Window.partitionBy(F.lit(0)))).filter("_whole OR NOT _any")
    return found.select("type_id", F.when(~F.col("_whole"), F.lit(tail)).alias("member"))


def containers(types: DataFrame) -> DataFrame:
    """(full_name, container): the outermost type that contains a type, or its namespace.

    Every dotted prefix of a name is looked up among the types; no pairs of types are compared.
    """
    p = types.select("full_name", "namespace", F.explode(F.expr("transform(sequence(1, greatest(size(split(full_name, '[.]')) - 1, 1)), i -> array_join(slice(split(full_name, '[.]'), 1, i), '.'))")).alias("prefix"))
    known = types.select(F.col("full_name").alias("prefix")).distinct()
    held = p.join(known, "prefix", "left_semi").filter("prefix <> full_name").groupBy("full_name").agg(F.min_by("prefix", F.length("prefix")).alias("outer"))
    return types.join(held, "full_name", "left").select("full_name", F.coalesce("outer", "namespace").alias("container"))


def skip_histogram(skips: DataFrame, top: int = 10) -> DataFrame:
    """(package_id, reason, n, total, partial) of the most frequent reasons of each package, names in quotes read as one."""
    n = skips.select("package_id", text.collapse_quoted(F.col("message")).alias("reason")).groupBy("package_id", "reason").agg(F.count("*").alias("n"))
    w = Window.partitionBy("package_id")
    ranks = n.withColumns({"_rn": F.row_number().over(w.orderBy(F.desc("n"), "reason")), "total": F.sum("n").over(w), "partial": F.count("*").over(w) > top})
    return ranks.filter(F.col("_rn") <= top).drop("_rn")


def merge_histograms(histogram: DataFrame) -> DataFrame:
    """(reason, n, partial): sums over packages, not cut again; partial if any package's was. The rows are few: ten of each package at most."""
    sums = histogram.groupBy("reason").agg(F.sum("n").alias("n"), F.bool_or("partial").alias("_partial"))
    return sums.withColumn("partial", F.bool_or("_partial").over(Window.partitionBy(F.lit(0)))).drop("_partial")


def with_docs(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Members with their documentation, empty where there is none; documentation of no member is dropped."""
    return members.join(docs, "declaration_id", "left")
