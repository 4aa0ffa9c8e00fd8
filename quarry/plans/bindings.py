"""The driver's tables read as documents and API declarations, so that the plans run on its rows.

Each binding gives one of the engine's tables; the SQL twins in ``oracles`` say the same in another dialect.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import catalog, inverted, skipping
from ..sources.files import Files, shared_folder
from . import assembly_writer
from .service import Backend


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, text): documents spread over five trees."""
    tree = "element_at(array('proposals/', 'docs/reference/', 'docs/wiki/', 'meetings/', 'docs/release-notes/'), int(doc_id % 5) + 1)"
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.expr(f"concat({tree}, lang, '/', doc_id, '.md')").alias("path"), "text")


def conversations_md(spark: SparkSession, sf_dir: str, front_matter: bool = False) -> DataFrame:
    """(repo, path, text): a Markdown document of each conversation, with headings, repeats of them, and fences that hold decoys."""
    part = F.expr(
        "concat('## ', role, '\\n\\n### Turn ', turn, '\\n\\n', text, CASE WHEN role = 'assistant' THEN concat('\\n\\n```\\n# not a heading ', turn, '\\n```') ELSE '' END)"
    )
    body = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", part.alias("part")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    text = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.array_join(F.col("t.part"), "\n\n"))
    if front_matter:
        head = F.concat(F.lit("---\nid: "), F.col("conv_id").cast("string"), F.lit("\nrole: user\n---\n\n"))
        text = F.concat(F.when(F.col("conv_id") % 2 == 0, head).otherwise(F.lit("")), text)
    return body.select(F.lit("talks").alias("repo"), F.concat(F.lit("spec/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(declaration_id, namespace, type_name, full_name): a type of each supplier; every seventh is generic."""
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(
        F.concat(F.lit("Corp."), F.replace("r_name", F.lit(" "), F.lit("")), F.lit("."), F.col("n_name")).alias("namespace"),
        F.expr("concat('Supplier', s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '`1' ELSE '' END)").alias("type_name"),
        "s_suppkey",
    )
    full = F.concat_ws(".", "namespace", "type_name")
    return rows.select("s_suppkey", F.concat(F.lit("T:"), full).alias("declaration_id"), "namespace", "type_name", full.alias("full_name"))


FRAMEWORKS = ("net8.0", "net9.0", "net10.0", "netstandard2.0")


def shipped(spark: SparkSession, sf_dir: str, of: DataFrame) -> DataFrame:
    """The types ``of`` with each part that their supplier ships. Line items of other suppliers go before they are made distinct."""
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").join(of.select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi").distinct()
    return pairs.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(of, F.col("l_suppkey") == F.col("s_suppkey"))


def members(spark: SparkSession, sf_dir: str, type_ids: DataFrame | None = None) -> DataFrame:
    """(origin, priority, framework, type_id, full_name, declaration_id, name, signature, summary): a member for each part a supplier ships.

    A third of the parts is documented by both origins; a member's signature names its origin, so that the merge shows. ``type_ids``
    (type_id) restricts the types at their scan.
    """
    of = types(spark, sf_dir)
    if type_ids is not None:
        of = of.join(type_ids, F.col("declaration_id") == F.col("type_id"), "left_semi")
    rows = shipped(spark, sf_dir, of)
    name = "replace(initcap(p_name), ' ', '')"
    origin = F.explode(F.expr("filter(array(CASE WHEN p_partkey % 3 <> 0 THEN 'git' END, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 2 = 0 THEN 'nuget' END), o -> o IS NOT NULL)"))
    rows = rows.withColumn("origin", origin)
    return rows.select(
        "origin",
        F.when(F.col("origin") == "git", 0).otherwise(1).alias("priority"),
        F.expr("element_at(array('net8.0', 'net9.0', 'net10.0', 'netstandard2.0'), p_size % 4 + 1)").alias("framework"),
        F.col("declaration_id").alias("type_id"), "full_name",
        F.expr(f"concat('M:', full_name, '.', {name}, '(', p_partkey, ')')").alias("declaration_id"),
        F.expr(name).alias("name"),
        F.expr(f"concat('public ', p_type, ' ', {name}, '(', p_brand, ')')").alias("signature"),
        F.expr("concat(origin, ' ', p_name)").alias("summary"),
    )


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, priority, declaration_id, symbol, kind, parameter_name, type_expression, owner): a use of a type for each line item."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    kind = "element_at(array('parameter', 'return', 'base', 'interface', 'constraint', 'attribute'), l_linenumber % 6 + 1)"
    base = "concat('System.', p_type)"
    spelled = f"CASE p_size % 5 WHEN 0 THEN {base} WHEN 1 THEN concat({base}, '[]') WHEN 2 THEN concat({base}, '&') WHEN 3 THEN concat('System.Collections.Generic.IEnumerable<', {base}, '>') ELSE concat({base}, 'Comparer') END"
    return rows.select(
        F.expr("CASE WHEN l_partkey % 3 = 0 THEN 'nuget' ELSE 'git' END").alias("origin"), F.expr("CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END").alias("priority"),
        F.expr("concat('M:Order', l_orderkey, '.Line', l_linenumber)").alias("declaration_id"), F.expr("concat('Order', l_orderkey, '.Line', l_linenumber)").alias("symbol"),
        F.expr(kind).alias("kind"), F.expr(f"CASE WHEN {kind} = 'parameter' THEN 'value' END").alias("parameter_name"), F.expr(spelled).alias("type_expression"),
        F.expr("concat('System.', CASE WHEN l_orderkey % 50 = 0 THEN p_type ELSE concat('Order', l_orderkey) END)").alias("owner"),
    )


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, priority, declaration_id, symbol, element, ord, text): a documentation element for each line of a document; labelled ones are packages."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_l")).distinct()
    rows = d.join(l, F.col("doc_id") == F.col("_l"), "left").select("doc_id", "source", "_l", F.posexplode(F.split("text", "\n", -1)).alias("ord", "text"))
    return rows.select(
        F.expr("CASE WHEN _l IS NULL THEN 'git' ELSE 'nuget' END").alias("origin"), F.expr("CASE WHEN _l IS NULL THEN 0 ELSE 1 END").alias("priority"),
        F.expr("concat('M:', source, '.', doc_id)").alias("declaration_id"), F.expr("concat(source, '.', doc_id % 50)").alias("symbol"),
        F.expr("element_at(array('summary', 'returns', 'remarks', 'param:x', 'exception'), ord % 5 + 1)").alias("element"), "ord", "text",
    )


def faq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a question-and-answer file of each conversation, JSON being YAML; every tenth is another kind of file, every eleventh has no questions."""
    turn = F.struct("turn", F.concat_ws(" ", "role", "turn").alias("question"), F.col("text").alias("answer"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    questions = F.when(F.col("conv_id") % 11 == 0, F.array().cast("array<struct<question:string,answer:string>>")).otherwise(F.transform("t", lambda t: F.struct(t["question"], t["answer"])))
    section = F.struct(F.concat(F.lit("Conversation  "), F.col("conv_id").cast("string")).alias("name"), questions.alias("questions"))
    head = F.when(F.col("conv_id") % 10 == 0, "### YamlMime:Landing\n").otherwise("\n### YamlMime:FAQ\n")
    body = F.to_json(F.struct(F.lit("left out").alias("title"), F.lit("A talk.").alias("summary"), F.array(section).alias("sections")))
    return c.select(F.concat(F.lit("talks/"), F.col("conv_id").cast("string"), F.lit(".yml")).alias("path"), F.concat(head, body).cast("binary").alias("content"))


def xml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): an XML description of a type for each nation, its suppliers the members; every fifth has no C# signature, every seventh a bad id."""
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    place = "concat('Corp.', replace(r_name, ' ', ''))"
    name = "replace(n_name, ' ', '_')"
    signature = "CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat('<MemberSignature Language=\"C#\" Value=\"old\"/><MemberSignature Language=\"C#\" Value=\"public string S', s_suppkey, ' (int index);\"/>') END"
    member = f"""concat('<Member MemberName="S', s_suppkey, '">', {signature}, '<MemberSignature Language="DocId" Value="M:', {place}, '.', {name}, CASE WHEN s_suppkey % 7 = 0 THEN '.S(' ELSE '.S' END, s_suppkey, '(System.Int32)"/>',
      '<MemberType>Method</MemberType><Attributes><Attribute><AttributeName Language="F#">[&lt;X&gt;]</AttributeName><AttributeName>[Corp.Marked(', s_suppkey, ')]</AttributeName></Attribute></Attributes>',
      '<ReturnValue><ReturnType>System.String</ReturnType></ReturnValue><Parameters><Parameter Name="index" Type="System.Int32"/></Parameters><Docs><summary>Supplier', char(10), '   <see cref="T:', {place}, '.', {name}, '"/> at
      <paramref name="index"/>.</summary><param name="index">Balance ', s_acctbal, '</param><remarks>To be added.</remarks></Docs></Member>')"""
    types = rows.groupBy("r_name", "n_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", F.expr(member).alias("m")))), lambda x: x["m"]), "").alias("members"))
    body = f"""concat('<Type Name="', {name}, '" FullName="', {place}, '.', {name}, '"><TypeSignature Language="DocId" Value="T:', {place}, '.', {name}, '"/><Base><BaseTypeName>System.Object</BaseTypeName></Base>',
      '<Docs><summary>Of ', n_name, ' &amp; others.</summary></Docs><Members>', members, '</Members>', CASE WHEN n_name LIKE 'U%' THEN '' ELSE '</Type>' END)"""
    return types.select(F.expr(f"concat({place}, '/', {name}, '.xml')").alias("path"), F.expr(body).cast("binary").alias("content"))


def package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): an archive of each region, with an assembly and its documentation for two frameworks; that of every third region is unsafe."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    member = F.expr("concat('<member name=\"M:Corp.', replace(n_name, ' ', '_'), '.Run\"><summary> Runs  ', n_nationkey, ' </summary><param name=\"p\">The p.</param></member>')")
    docs = rows.groupBy("r_regionkey").agg(F.array_join(F.sort_array(F.collect_list(member)), "").alias("m")).select("r_regionkey", F.concat(F.lit("<doc><members>"), "m", F.lit("</members></doc>")).alias("xml"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, xml in zip(b.column("r_regionkey").to_pylist(), b.column("xml").to_pylist(), strict=True):
                f = io.BytesIO()
                with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                    for framework in ("net8.0", "netstandard2.0"):
                        z.writestr(f"lib/{framework}/Corp.dll", b"MZ" + bytes([key]))
                        z.writestr(f"LIB/{framework}/corp.XML", xml)
                    if key % 3 == 2:
                        z.writestr("../escape", b"")
                out.append(f.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([f"region{k}.nupkg" for k in b.column("r_regionkey").to_pylist()]), pa.array(out, pa.binary())], ["path", "content"])

    return docs.mapInArrow(run, "path string, content binary")


def assembly_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): an assembly of each supplier with one class, a generic method, a constant, and a field that C# has no word for; every seventh is no assembly."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("s_suppkey").to_pylist()
            made = [_assembly(k, n) for k, n in zip(keys, b.column("s_nationkey").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"Supplier{k}.dll" for k in keys]), pa.array(made, pa.binary())], ["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def _assembly(key: int, nation: int) -> bytes:
    if key % 7 == 0:
        return b"no assembly"
    w = assembly_writer
    b = w.Builder(f"Supplier{key}")
    t = b.type(f"Supplier{key}`1", "Corp", 1, b.outer("System.Object"), parameters=["T"])
    visible = 6 if key % 3 else 1
    b.method(f"Run{nation}", w.signature(w.vector(w.TEXT), w.INT, w.of(t, w.mvar(0)), generic=1), visible | 0x140, [("index", 0), ("other", 0)], generic=["K"])
    b.field("Nation", w.INT, 0x8056, (8, nation.to_bytes(4, "little")))
    b.field("Skewed", b"\x14" + w.INT + b"\1\0\0")
    return b.build()


_INGESTED: dict[tuple, str] = {}
_PROSE_ROWS = 20_000


def _ingested(spark: SparkSession, sf_dir: str, kind: str, write: Callable[[str], None]) -> str:
    """A folder in which ``write`` has put what a source of the driver's tables holds; once for each state of these files in a session."""
    files = Files(spark)
    key = (spark.sparkContext.applicationId, sf_dir, kind, *((n, files.changed(f"{sf_dir}/{n}")) for n in files.names(sf_dir)))
    if key not in _INGESTED:
        place = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
        write(place)
        _INGESTED[key] = place
    return _INGESTED[key]


def ingested(spark: SparkSession, sf_dir: str) -> list[Backend]:
    """``backends`` as a service has them after ingest: their tables stored, with indexes of names, uses and prose."""
    made = backends(spark, sf_dir)

    def write(place: str) -> None:
        for name in ("types", "members", "prose", "uses", "skipped"):
            parts = [b.tables[name].withColumn("backend", F.lit(i)) for i, b in enumerate(made) if name in b.tables]
            rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            rows.write.option("maxRecordsPerFile", _PROSE_ROWS if name == "prose" else 0).parquet(f"{place}/{name}")
            catalog.build_index(spark, f"{place}/{name}", f"{place}/index/{name}", name)

    place = _ingested(spark, sf_dir, "backends", write)
    out = []
    for i, b in enumerate(made):
        mine = lambda df, b=b, name=None: df.select(*b.tables[name].columns)
        tables = {n: mine(spark.read.parquet(f"{place}/{n}").filter(F.col("backend") == i), name=n) for n in b.tables}
        indexes = {n: catalog.open_index(spark, f"{place}/{n}", f"{place}/index/{n}", n, only=f"backend = {i}") for n in ("types", "uses", "prose") if n in b.tables}
        out.append(replace(b, tables=tables, indexes=indexes))
    return out


def stored_docs(spark: SparkSession, sf_dir: str) -> skipping.Skipping:
    """``docs`` as a stored table whose files have trigram filters."""

    def write(place: str) -> None:
        docs(spark, sf_dir).repartitionByRange("repo", "path").sortWithinPartitions("repo", "path").write.option("maxRecordsPerFile", _PROSE_ROWS // 80).parquet(f"{place}/docs")
        catalog.build_index(spark, f"{place}/docs", f"{place}/index/docs", "docs")

    place = _ingested(spark, sf_dir, "docs", write)
    return catalog.open_index(spark, f"{place}/docs", f"{place}/index/docs", "docs")


def canonical_uses(spark: SparkSession, sf_dir: str) -> inverted.Inverted:
    """``uses`` as an inverted table, package rows with the canonical names of the types in their expression: a part's type, and what holds it."""
    first = F.concat(F.lit("System."), F.regexp_extract("type_expression", r"System\.([A-Z]{2,})", 1))
    holder = F.when(F.startswith("type_expression", F.lit("System.Collections")), F.array(F.lit("System.Collections.Generic.IEnumerable"), first))
    names = holder.when(F.endswith("type_expression", F.lit("Comparer")), F.array(F.lit("System.Comparer"))).otherwise(F.array(first))

    def write(place: str) -> None:
        uses(spark, sf_dir).withColumn("type_names", F.when(F.col("origin") == "nuget", names)).write.parquet(f"{place}/uses")
        catalog.build_index(spark, f"{place}/uses", f"{place}/index/uses", "uses")

    place = _ingested(spark, sf_dir, "uses", write)
    return catalog.open_index(spark, f"{place}/uses", f"{place}/index/uses", "uses")


def backends(spark: SparkSession, sf_dir: str) -> list[Backend]:
    """A source of repositories only, ``lib``, and one with two packages, ``app``.

    ``lib`` documents three of four types; the packages share the types between them by even and odd supplier, under display names with type
    arguments. A part is a member of one of the first ten suppliers' types, by repository, package, or both.
    """
    t = types(spark, sf_dir).withColumn("search_name", F.col("full_name"))
    shown = {"full_name": F.replace("full_name", F.lit("`1"), F.lit("<T>")), "display_name": F.replace("type_name", F.lit("`1"), F.lit("<T>"))}
    name = "concat('Part', (p_partkey div 10) % 10, CASE WHEN (p_partkey div 10) % 20 >= 10 THEN '<T>' ELSE '' END)"

    def of(rows: DataFrame, origin: str) -> DataFrame:
        held = "p_partkey % 3 <> 0" if origin == "git" else "p_partkey % 3 = 0 OR p_partkey % 2 = 0"
        m = table(spark, sf_dir, "part").filter(held).join(rows, F.col("s_suppkey") == F.col("p_partkey") % 10 + 1)
        return m.select(
            F.expr("element_at(array('net8.0', 'net9.0', 'net10.0', 'netstandard2.0'), p_size % 4 + 1)").alias("framework"), F.col("declaration_id").alias("type_id"),
            F.expr("concat('M:', substr(declaration_id, 3), '.Part', (p_partkey div 10) % 10, '(', p_partkey, ')')").alias("declaration_id"), F.expr(name).alias("name"),
            F.expr(f"concat('public ', p_type, ' ', {name}, '(', p_brand, ' ', p_partkey, ')')").alias("signature"), F.col("p_partkey").alias("ord"),
            F.expr(f"concat('{origin} ', p_name)").alias("summary"), F.expr("concat('a size of ', p_size)").alias("returns"), F.lit(None).cast("string").alias("remarks"),
        )

    def package(name: str, keep: str, **more: DataFrame) -> Backend:
        rows = t.filter(keep)
        tables = {"types": rows.withColumns(shown), "members": of(rows, "nuget"), "skipped": skips(spark, sf_dir).filter(F.col("package_id") == f"package{len(name) % 3}").select(F.col("message").alias("reason"))}
        return Backend("nuget", "app", f"nuget:{name}", tables | more, (name, name, "1.0.0", "digest", "feed"), "net8.0", FRAMEWORKS)

    p, u = prose(spark, sf_dir), uses(spark, sf_dir)
    plain = lambda df, keep: df.filter(keep).drop("origin", "priority")
    lib = t.filter("s_suppkey % 4 <> 1")
    long = spark.range(1).select(F.lit("T:System.ECONOMYAttribute").alias("declaration_id"), F.lit("System").alias("namespace"), F.lit("ECONOMYAttribute").alias("type_name"), F.lit("System.ECONOMYAttribute").alias("full_name"), F.lit("System.ECONOMYAttribute").alias("search_name"))
    nothing = lib.limit(0)
    return [
        Backend("git", "lib", "git:lib", {"types": lib.unionByName(long, allowMissingColumns=True), "members": of(lib, "git").drop("framework"), "prose": plain(p, "origin = 'git' AND ord % 2 = 0"), "uses": plain(u, "origin = 'git'")}),
        Backend("git", "app", "git:app", {"types": nothing, "members": of(nothing, "git").drop("framework"), "prose": plain(p, "origin = 'git' AND ord % 2 = 1"), "uses": plain(u, "false")}),
        package("Pack.Odd", "s_suppkey % 2 = 1", prose=plain(p, "origin = 'nuget'"), uses=plain(u, "origin = 'nuget'")),
        package("Pack.Even", "s_suppkey % 2 = 0", prose=plain(p, "false"), uses=plain(u, "false")),
    ]


def skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(package_id, message): declarations left out of a package's corpus."""
    return table(spark, sf_dir, "events").select(
        F.expr("concat('package', user_id % 3)").alias("package_id"), F.expr("concat(\"The accessor '\", user_id, \"' has incompatible \", event_type, ' level ', event_id % 4)").alias("message")
    )


def attribute_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(full_name): attribute classes; those of odd nations have a sibling class without the suffix."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.explode(F.expr("filter(array(concat('Corp.', n_name, 'Attribute'), CASE WHEN n_nationkey % 2 = 1 THEN concat('Corp.', n_name) END), x -> x IS NOT NULL)")).alias("full_name"))


def attribute_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(declaration_id, application): an attribute applied to each supplier's type, in three spellings."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.expr("concat('T:Supplier', s_suppkey)").alias("declaration_id"),
        F.expr("CASE s_suppkey % 3 WHEN 0 THEN concat('[Corp.', n_name, ']') WHEN 1 THEN concat('[Corp.', n_name, '(', s_suppkey, ')]') ELSE concat('[return: Corp.', n_name, 'Attribute(typeof(int))]') END").alias("application"),
    )
