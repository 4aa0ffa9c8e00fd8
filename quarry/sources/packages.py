"""Packages: zip archives with limits, the stored corpus of their API, and version manifests."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import re
import struct
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..errors import QueryError
from ..functions.text import strip_id_prefix
from . import api_xml, corpus_rules

# fixed values: limits of archives and of stored corpora
MAX_ENTRIES, MAX_ENTRY_BYTES, MAX_TOTAL_BYTES = 1024, 32 << 20, 128 << 20
MAX_ARCHIVE_BYTES, MAX_CORPUS_BYTES, CORPUS_VERSION = 64 << 20, corpus_rules.MAX_BYTES, corpus_rules.VERSION
_RESERVED = {"CON", "PRN", "AUX", "NUL", *(f"{n}{i}" for n in ("COM", "LPT") for i in range(1, 10))}


def valid_package_id(value: str | None) -> bool:
    return bool(value) and len(value) <= 100 and value not in (".", "..") and bool(re.fullmatch(r"[A-Za-z0-9._-]+", value))


def valid_version(value: str | None) -> bool:
    label = r"[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*"
    return bool(value) and len(value) <= 256 and bool(re.fullmatch(rf"[0-9]+(?:\.[0-9]+){{1,3}}(?:-{label})?(?:\+{label})?", value))


def safe_framework(value: str | None) -> bool:
    """Whether a framework's name may name a file anywhere."""
    if not value or not value.strip() or value in (".", "..") or value[-1] in " ." or re.search(r'[/\\:<>"|?*\x00-\x1f\x7f-\x9f]', value):
        return False
    return value.split(".")[0].upper() not in _RESERVED


def verify_sha512(data: bytes, expected: str) -> None:
    if base64.b64encode(hashlib.sha512(data).digest()).decode() != expected:
        raise QueryError("sync_failed", "the archive's SHA-512 differs")


def _stated_entries(data: bytes) -> int:
    """The number of entries that the archive's end record states, before its directory is read."""
    at = data.rfind(b"PK\x05\x06", max(0, len(data) - 65_557))
    if at < 0 or at + 22 > len(data):
        raise QueryError("source_invalid", "no end of central directory")
    n = struct.unpack_from("<H", data, at + 10)[0]
    if n == 0xFFFF or struct.unpack_from("<I", data, at + 16)[0] == 0xFFFFFFFF:
        if at < 20 or data[at - 20 : at - 16] != b"PK\x06\x07":
            raise QueryError("source_invalid", "no ZIP64 locator")
        end = struct.unpack_from("<Q", data, at - 12)[0]
        if end + 56 > len(data) or data[end : end + 4] != b"PK\x06\x06":
            raise QueryError("source_invalid", "no ZIP64 end record")
        n = struct.unpack_from("<Q", data, end + 32)[0]
    return n


def read_archive(data: bytes, assembly: str) -> dict[str, dict[str, bytes]]:
    """{framework: {"dll": bytes, "xml": bytes}} of lib/<framework>/<assembly>.{dll,xml}; names are compared without case."""
    if len(data) > MAX_ARCHIVE_BYTES or _stated_entries(data) > MAX_ENTRIES:
        raise QueryError("source_invalid", "the archive is beyond its limits")
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise QueryError("source_invalid", str(e)) from e
    seen: set[str] = set()
    total, out = 0, {}
    for info in archive.infolist():
        name = info.filename
        parts = name.replace("\\", "/").rstrip("/").split("/")
        if "\\" in name or name.startswith("/") or ":" in name or any(p in ("", ".", "..") or p[-1] in " ." for p in parts):
            raise QueryError("source_invalid", f"unsafe entry {name!r}")
        if (key := "/".join(parts).lower()) in seen:
            raise QueryError("source_invalid", f"repeated entry {name!r}")
        seen.add(key)
        total += info.file_size
        if info.file_size > MAX_ENTRY_BYTES or total > MAX_TOTAL_BYTES:
            raise QueryError("source_invalid", "the archive is beyond its limits")
        if len(parts) == 3 and parts[0].lower() == "lib" and parts[2].lower() in (f"{assembly.lower()}.dll", f"{assembly.lower()}.xml"):
            if not safe_framework(parts[1]):
                raise QueryError("source_invalid", f"unsafe framework {parts[1]!r}")
            with archive.open(info) as f:
                content = f.read(MAX_ENTRY_BYTES + 1)
            if len(content) != info.file_size:
                raise QueryError("source_invalid", f"{name}: its size is not the stated one")
            out.setdefault(parts[1], {})[parts[2][-3:].lower()] = content
    return out


_NAMED = "array<struct<Name:string,Text:string>>"
_DOC = f"struct<Summary:string,Parameters:{_NAMED},TypeParameters:{_NAMED},Returns:string,Value:string,Remarks:string,Exceptions:{_NAMED}>"
_USE = "struct<Name:string,TypeExpression:string,TypeNames:array<string>>"
_ATTRIBUTE = "array<struct<Application:string,AttributeType:string,ArgumentTypeNames:array<string>>>"
_MEMBER = (
    f"struct<EcmaId:string,Name:string,Kind:string,Signature:string,Parameters:array<{_USE}>,ReturnType:{_USE},Constraints:array<{_USE}>,"
    f"Attributes:{_ATTRIBUTE},Documentation:{_DOC}>"
)
_TYPE = (
    f"struct<EcmaId:string,Name:string,FullName:string,BaseType:{_USE},Interfaces:array<{_USE}>,Constraints:array<{_USE}>,"
    f"Attributes:{_ATTRIBUTE},Documentation:{_DOC},Members:array<{_MEMBER}>>"
)
_SKIPPED = "array<struct<Kind:string,DeclaringType:string,Name:string,Reason:string>>"
_CORPUS = f"struct<SchemaVersion:int,Types:array<{_TYPE}>,Skipped:{_SKIPPED}>"
CORPUS = f"SchemaVersion int, PackageId string, Version string, Sha512 string, Framework string, Corpus {_CORPUS}"


def read_archives(files: DataFrame, assembly: str) -> DataFrame:
    """(path, framework, dll, xml, error) of package archives (path, content): a row of each framework, or one with the reason why an archive is refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    rows = [(path, f, v.get("dll"), v.get("xml"), None) for f, v in sorted(read_archive(content.as_py(), assembly).items())]
                except QueryError as e:
                    rows = [(path, None, None, None, str(e))]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = [pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["path", "framework", "dll", "xml", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, framework string, dll binary, xml binary, error string")


def read_corpora(spark: SparkSession, path: str) -> DataFrame:
    """Stored corpora, one row of each file. The job fails at the first that is too large, malformed, of another version or against the rules."""
    schema = to_arrow_schema(StructType.fromDDL(CORPUS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, size, content in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), b.column("content"), strict=True):
                try:
                    if size > MAX_CORPUS_BYTES:
                        raise QueryError("source_invalid", f"more than {MAX_CORPUS_BYTES} bytes")
                    stored = corpus_rules.load(content.as_py())
                except QueryError as e:
                    raise ValueError(f"{e.code}: {name}: {e}") from e
                yield pa.RecordBatch.from_pylist([stored], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "length", "content").mapInArrow(run, CORPUS)


def canonical(corpus: dict) -> dict:
    """A corpus in storage order, whatever order it was built in."""
    by = lambda *keys: lambda x: tuple(str(x.get(k) or "") for k in keys)
    listed = lambda x, key, *order: sorted(x.get(key) or [], key=by(*order))

    def documented(d: dict | None) -> dict:
        d = d or {}
        named = {k: listed(d, k, "Name", "Text") for k in ("Parameters", "TypeParameters", "Exceptions")}
        return {k: d.get(k) for k in ("Summary", "Returns", "Value", "Remarks")} | named

    def common(x: dict) -> dict:
        uses = {k: listed(x, k, "TypeExpression", "Name") for k in ("Interfaces", "Constraints") if k in x}
        return x | uses | {"Attributes": listed(x, "Attributes", "Application", "AttributeType"), "Documentation": documented(x.get("Documentation"))}

    types = [common(t) | {"Members": [common(m) for m in listed(t, "Members", "EcmaId")]} for t in listed(corpus, "Types", "FullName", "EcmaId")]
    return corpus | {"Types": types, "Skipped": listed(corpus, "Skipped", "DeclaringType", "Kind", "Name", "Reason")}


def corpus_json(package_id: str, version: str, sha512: str, framework: str, corpus: dict) -> bytes:
    """A corpus as it is stored: in storage order, checked by the rules that a reader applies."""
    if not (valid_package_id(package_id) and valid_version(version) and safe_framework(framework)):
        raise QueryError("source_invalid", "invalid package identity")
    data = {"SchemaVersion": CORPUS_VERSION, "PackageId": package_id, "Version": version, "Sha512": sha512, "Framework": framework, "Corpus": canonical({"SchemaVersion": CORPUS_VERSION} | corpus)}
    corpus_rules.check(data)
    text = json.dumps(data, ensure_ascii=False, separators=(",", ":")).encode()
    if len(text) > MAX_CORPUS_BYTES:
        raise QueryError("source_invalid", "the corpus is too large")
    return text


def write_corpus(path: str, package_id: str, version: str, sha512: str, framework: str, corpus: dict) -> None:
    """Writes one corpus file under a temporary name and renames it into place."""
    text = corpus_json(package_id, version, sha512, framework, corpus)
    with open(path + ".tmp", "wb") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(path + ".tmp", path)


def documented(corpus: dict, docs: dict[str, dict]) -> dict:
    """A corpus with the compilers' documentation of its declarations, empty where there is none."""

    def of(x: dict) -> dict:
        d = docs.get(x["EcmaId"]) or {}
        named = {k: [{"Name": e["name"], "Text": e["text"]} for e in d.get(f) or []] for k, f in (("Parameters", "parameters"), ("TypeParameters", "type_parameters"), ("Exceptions", "exceptions"))}
        return x | {"Documentation": {k: d.get(k.lower()) for k in ("Summary", "Returns", "Value", "Remarks")} | named}

    return corpus | {"Types": [of(t) | {"Members": [of(m) for m in t["Members"]]} for t in corpus["Types"]]}


def build_corpora(assets: DataFrame, package_id: str, version: str, sha512: str, read_metadata: Callable[[bytes], dict]) -> DataFrame:
    """(framework, corpus: the stored form, error) of a package's assets (framework, dll, xml): metadata joined with documentation, one framework a row.

    Both files must be there; a framework that can't be read is a row with the reason.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for framework, dll, xml in zip(*(b.column(c).to_pylist() for c in ("framework", "dll", "xml")), strict=True):
                text, error = None, None
                try:
                    if dll is None or xml is None:
                        raise QueryError("source_invalid", "the assembly and its documentation file are both required")
                    text = corpus_json(package_id, version, sha512, framework, documented(read_metadata(dll), api_xml.compiler_docs(xml)))
                except QueryError as e:
                    error = f"{framework}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([framework]), pa.array([text], pa.binary()), pa.array([error], pa.string())], ["framework", "corpus", "error"])

    return assets.select("framework", "dll", "xml").mapInArrow(run, "framework string, corpus binary, error string")


def _head() -> list[Column]:
    return [F.col("PackageId").alias("source"), F.col("Framework").alias("framework")]


def _types(t: DataFrame) -> DataFrame:
    """Types with the namespace of the outermost type around them: every dotted prefix of a name is looked up, no pairs of types are compared."""
    name, full, simple = strip_id_prefix(F.col("t.EcmaId")), F.col("t.FullName"), F.col("t.Name")
    bare = F.when(full == simple, "").when(F.endswith(full, F.concat(F.lit("."), simple)), F.expr("substr(t.FullName, 1, length(t.FullName) - length(t.Name) - 1)")).otherwise(F.regexp_replace(name, r"\.?[^.]*$", ""))
    rows = t.select(*_head(), F.col("t.EcmaId").alias("declaration_id"), full.alias("full_name"), simple.alias("display_name"), name.alias("search_name"), bare.alias("own"))
    dots = "split(search_name, '[.]')"
    prefixes = F.explode(F.expr(f"transform(sequence(1, size({dots}) - 1), i -> array_join(slice({dots}, 1, i), '.'))"))
    inner = rows.filter(F.contains("search_name", F.lit("."))).select("source", "framework", "search_name", F.col("full_name").alias("inner_name"), prefixes.alias("prefix"))
    outer = rows.select("source", "framework", F.col("search_name").alias("prefix"), F.col("full_name").alias("outer_name"), F.col("own").alias("outer_own"))
    held = inner.join(outer, ["source", "framework", "prefix"]).filter(F.startswith("inner_name", F.concat("outer_name", F.lit("."))))
    around = held.groupBy("source", "framework", "search_name").agg(F.min_by("outer_own", F.length("prefix")).alias("outer_own"))
    found = rows.join(around, ["source", "framework", "search_name"], "left").withColumn("namespace", F.coalesce("outer_own", "own"))
    type_name = F.when(F.col("namespace") == "", F.col("search_name")).otherwise(F.expr("substr(search_name, length(namespace) + 2)"))
    return found.select("source", "framework", "declaration_id", "namespace", type_name.alias("type_name"), "full_name", "search_name", "display_name")


def _prose(rows: DataFrame, documentation: str) -> DataFrame:
    """A row of each documentation element of (source, framework, declaration_id, symbol, documentation), in the order of the elements."""
    plain = lambda e: f"array(named_struct('element', '{e.lower()}', 'text', {documentation}.{e}))"
    named = lambda e, label: f"transform({documentation}.{e}, d -> named_struct('element', {label}, 'text', d.Text))"
    parts = [
        plain("Summary"), named("Parameters", "concat('param:', d.Name)"), named("TypeParameters", "concat('typeparam:', d.Name)"), plain("Returns"), plain("Value"), plain("Remarks"),
        named("Exceptions", "'exception'"),
    ]
    listed = F.posexplode(F.expr(f"filter(concat({', '.join(f'coalesce({p}, array())' for p in parts)}), x -> x.text IS NOT NULL)")).alias("ord", "x")
    return rows.select("source", "framework", "declaration_id", "symbol", listed).select("source", "framework", "declaration_id", "symbol", "x.element", "x.text", "ord")


def _uses(rows: DataFrame, holder: str, single: tuple[str, str], listed: tuple[tuple[str, str], ...]) -> DataFrame:
    """A row of each use of a type that a declaration makes: one field, several lists, and the attributes."""
    shape = "named_struct('kind', '{k}', 'name', {n}, 'expression', {x}.TypeExpression, 'names', {x}.TypeNames, 'attribute', CAST(NULL AS STRING))"
    one = f"CASE WHEN {holder}.{single[0]} IS NULL THEN array() ELSE array({shape.format(k=single[1], n='CAST(NULL AS STRING)', x=f'{holder}.{single[0]}')}) END"
    lists = [f"coalesce(transform({holder}.{f}, u -> {shape.format(k=k, n='u.Name', x='u')}), array())" for f, k in listed]
    applied = "named_struct('kind', 'attribute', 'name', CAST(NULL AS STRING), 'expression', a.Application, 'names', concat(array(a.AttributeType), a.ArgumentTypeNames), 'attribute', a.AttributeType)"
    attributes = f"coalesce(transform(array_distinct({holder}.Attributes), a -> {applied}), array())"
    exploded = rows.withColumn("u", F.explode(F.expr(f"concat({', '.join([one, *lists, attributes])})")))
    fields = [F.col(f"u.{a}").alias(b) for a, b in (("kind", "kind"), ("name", "parameter_name"), ("expression", "type_expression"), ("names", "type_names"), ("attribute", "attribute_type"))]
    return exploded.select("source", "framework", "declaration_id", "symbol", "owner", "signature", *fields)


def corpus_tables(corpora: DataFrame) -> dict[str, DataFrame]:
    """types, members, prose, uses and skipped rows of stored corpora, as those of the XML tree."""
    t = corpora.select("PackageId", "Framework", F.explode("Corpus.Types").alias("t"))
    head = t.select(*_head(), F.col("t.EcmaId").alias("type_id"), F.col("t.FullName").alias("owner"), "t")
    m = head.select("source", "framework", "type_id", "owner", F.posexplode("t.Members").alias("ord", "m")).withColumns({"declaration_id": F.col("m.EcmaId"), "symbol": F.concat_ws(".", "owner", "m.Name"), "signature": F.col("m.Signature")})
    texts = "map_from_entries(transform(m.Documentation.Parameters, d -> struct(d.Name, d.Text)))"
    described = F.expr(f"transform(m.Parameters, p -> named_struct('name', p.Name, 'description', try_element_at({texts}, p.Name)))")
    prose = [F.col(f"m.Documentation.{x}").alias(x.lower()) for x in ("Summary", "Returns", "Value", "Remarks")]
    members = m.select("source", "framework", "type_id", "declaration_id", F.col("m.Name").alias("name"), F.col("m.Kind").alias("kind"), "signature", "ord", described.alias("parameters"), *prose)
    of_types = head.withColumns({"declaration_id": F.col("type_id"), "symbol": F.col("owner"), "signature": F.lit(None).cast("string")})
    uses = _uses(of_types, "t", ("BaseType", "base"), (("Interfaces", "interface"), ("Constraints", "constraint"))).unionByName(_uses(m, "m", ("ReturnType", "return"), (("Parameters", "parameter"), ("Constraints", "constraint"))))
    skipped = corpora.select(*_head(), F.explode("Corpus.Skipped").alias("s")).select("source", "framework", "s.Kind", "s.DeclaringType", "s.Name", F.col("s.Reason").alias("reason"))
    return {"types": _types(t), "members": members, "prose": _prose(of_types, "t.Documentation").unionByName(_prose(m, "m.Documentation")), "uses": uses, "skipped": skipped}


def cohort_version(manifest: str, prefix: str, packages: list[str]) -> str:
    """The version that all packages have in the manifest's entry of the highest numeric version.

    The manifest maps ``<prefix><version>`` to {package: {"Version": v}}.
    """
    data = json.loads(manifest)
    found = [(tuple(int(x) for x in k[len(prefix) :].split(".")), k) for k in data if k.startswith(prefix) and re.fullmatch(r"\d+(\.\d+)*", k[len(prefix) :])]
    if not found:
        raise QueryError("source_invalid", f"no entry {prefix!r}")
    best = max(v for v, _ in found)
    top = [k for v, k in found if v == best]
    if len(top) > 1:
        raise QueryError("source_invalid", "the highest version is ambiguous")
    versions = {(data[top[0]].get(p) or {}).get("Version") for p in packages}
    if len(versions) != 1 or not valid_version(version := versions.pop()):
        raise QueryError("source_invalid", "the packages' versions differ")
    return version
