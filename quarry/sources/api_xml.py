"""API descriptions in XML: a file of each type below a folder of its namespace, and compilers' documentation files."""

from __future__ import annotations

import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..errors import QueryError
from ..functions import declaration_ids as ids
from ..functions.text import PLACEHOLDER
from .files import shared_folder

TYPES = "declaration_id string, namespace string, type_name string, full_name string, search_name string"
MEMBERS = "type_id string, declaration_id string, name string, kind string, signature string, ord int, parameters array<struct<name:string,description:string>>, summary string, returns string, value string, remarks string"
PROSE = "declaration_id string, symbol string, element string, text string, ord int"
USES = "declaration_id string, symbol string, kind string, parameter_name string, type_expression string, owner string, signature string"
SKIPPED = "path string, reason string"
NESTED = {"types": TYPES, "members": MEMBERS, "prose": PROSE, "uses": USES, "skipped": SKIPPED}
# fixed values: the documentation elements that hold prose
ELEMENTS = ("summary", "remarks", "returns", "value", "param", "typeparam", "exception")


def normalise(text: str, collapse: bool = True) -> str | None:
    """Prose with references resolved and, if asked, white space collapsed within paragraphs; null if nothing is said."""
    text = re.sub(r"<xref:([^>?]*?)\**(?:\?[^>]*)?>", lambda m: unquote(m[1]), text)
    if collapse:
        text = "\n\n".join(p for x in re.split(r"\n[ \t]*\n\s*", text) if (p := " ".join(x.split())))
    text = text.strip()
    return text if text and text != PLACEHOLDER else None


def render(element: ET.Element | None) -> str | None:
    """The text of a documentation element: references without content become what they refer to."""
    if element is None:
        return None
    parts: list[str] = []

    def walk(e: ET.Element) -> None:
        parts.append(e.text or "")
        for child in e:
            name = child.tag.rpartition("}")[2]
            said = None
            if name in ("see", "seealso") and not len(child) and not child.text:
                cref = child.get("cref")
                said = re.sub(r"^[A-Za-z]:(?=.)", "", cref) if cref else child.get("langword") or child.get("href") or ""
            elif name in ("paramref", "typeparamref"):
                said = child.get("name")
            if said is None:
                walk(child)
            else:
                parts.append(said)
            parts.append(child.tail or "")

    walk(element)
    return normalise("".join(parts), collapse=element.find(".//format") is None)


def _doc_rows(docs: ET.Element | None, declaration_id: str, symbol: str) -> list[dict]:
    rows = []
    for e in docs if docs is not None else ():
        if e.tag in ELEMENTS and (text := render(e)) is not None:
            label = f"{e.tag}:{e.get('name')}" if e.get("name") else e.tag
            rows.append({"declaration_id": declaration_id, "symbol": symbol, "element": label, "text": text, "ord": len(rows)})
    return rows


def _constraints(node: ET.Element) -> Iterator[tuple[str, str]]:
    for p in node.iterfind("TypeParameters/TypeParameter"):
        for c in p.iterfind("Constraints/*"):
            if c.tag in ("BaseTypeName", "InterfaceName") and c.text:
                yield p.get("Name") or "", c.text.strip()


def _attributes(node: ET.Element) -> list[str]:
    """Of each attribute the first spelling in C# or in no language; each spelling once."""
    found = []
    for a in node.iterfind("Attributes/Attribute"):
        said = next((n.text for n in a.iterfind("AttributeName") if n.get("Language") in (None, "C#") and n.text), None)
        if said and said.strip() not in found:
            found.append(said.strip())
    return found


def parse_type(path: str, content: bytes) -> dict[str, list[dict]]:
    """types, members, prose, uses and skipped rows of one file; ValueError for XML that can't be read; other roots give nothing.

    A member without a canonical id is skipped; one without a C# signature has no row among the members, but its prose and uses count.
    """
    out: dict[str, list[dict]] = {k: [] for k in NESTED}
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        raise ValueError(f"malformed XML: {e}") from e
    parts = path.split("/")
    stem, folder = parts[-1].rsplit(".", 1)[0], parts[-2] if len(parts) > 1 else ""
    if root.tag == "Namespace":
        name = root.get("FullName") or root.get("Name") or ""
        if not ids.is_namespace_name(name):
            raise QueryError("source_invalid", f"{path}: no canonical namespace name")
        out["prose"] = _doc_rows(root.find("Docs"), f"N:{name}", name)
        return out
    if root.tag != "Type":
        return out
    spelled = [s.get("Value") for s in root.iterfind("TypeSignature") if s.get("Language") == "DocId"]
    if len(spelled) != 1 or not ids.is_type_id(spelled[0]):
        raise QueryError("source_invalid", f"{path}: no canonical type id")
    type_id, full = spelled[0], root.get("FullName") or root.get("Name") or f"{folder}.{stem}"
    out["types"].append({"declaration_id": type_id, "namespace": folder, "type_name": stem, "full_name": full, "search_name": f"{folder}.{stem}"})
    out["prose"] += _doc_rows(root.find("Docs"), type_id, full)

    def use(declaration_id: str, symbol: str, kind: str, expression: str | None, parameter: str | None = None, signature: str | None = None) -> None:
        if expression and expression.strip():
            row = {"declaration_id": declaration_id, "symbol": symbol, "kind": kind, "parameter_name": parameter, "type_expression": expression.strip(), "owner": full}
            out["uses"].append(row | {"signature": signature})

    use(type_id, full, "base", root.findtext("Base/BaseTypeName"))
    for x in root.iterfind("Interfaces/Interface/InterfaceName"):
        use(type_id, full, "interface", x.text)
    for name, x in _constraints(root):
        use(type_id, full, "constraint", x, name)
    for x in _attributes(root):
        use(type_id, full, "attribute", x)
    for n, m in enumerate(root.iterfind("Members/Member")):
        spellings = [(s.get("Language"), s.get("Value") or "") for s in m.iterfind("MemberSignature")]
        try:
            member_id = ids.choose_member_id([v for language, v in spellings if language == "DocId"], type_id)
        except QueryError as e:
            out["skipped"].append({"path": path, "reason": f"member '{m.get('MemberName')}': {e}"})
            continue
        signature = next((v for language, v in reversed(spellings) if language == "C#"), None)
        name, docs = m.get("MemberName") or "", m.find("Docs")
        symbol = f"{full}.{name}" if name else full
        if signature is not None:
            said = {e.get("name"): render(e) for e in reversed(docs.findall("param"))} if docs is not None else {}
            prose = {t: render(docs.find(t)) if docs is not None else None for t in ("summary", "returns", "value", "remarks")}
            parameters = [{"name": p.get("Name"), "description": said.get(p.get("Name"))} for p in m.iterfind("Parameters/Parameter")]
            row = {"type_id": type_id, "declaration_id": member_id, "name": name, "kind": m.findtext("MemberType"), "signature": signature, "ord": n}
            out["members"].append(row | {"parameters": parameters, **prose})
        out["prose"] += _doc_rows(docs, member_id, symbol)
        for p in m.iterfind("Parameters/Parameter"):
            use(member_id, symbol, "parameter", p.get("Type"), p.get("Name"), signature)
        use(member_id, symbol, "return", m.findtext("ReturnValue/ReturnType"), None, signature)
        for p, x in _constraints(m):
            use(member_id, symbol, "constraint", x, p, signature)
        for x in _attributes(m):
            use(member_id, symbol, "attribute", x, None, signature)
    return out


def _fields(ddl: str) -> list[str]:
    return [f.strip() for f in re.split(r",\s*(?![^<]*>)", ddl)]


_SCHEMA = ", ".join(f"{k} array<struct<{', '.join(f'{n}:{t}' for n, t in (f.split(' ', 1) for f in _fields(v)))}>>" for k, v in NESTED.items())


def parse_files(files: DataFrame) -> DataFrame:
    """One row of nested tables for each of (path, content), by Arrow batches; a file that can't be read gives a skipped row."""
    schema = to_arrow_schema(StructType.fromDDL(_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    rows.append(parse_type(path, content.as_py()))
                except (ValueError, QueryError) as e:
                    rows.append({k: [] for k in NESTED} | {"skipped": [{"path": path, "reason": str(e)}]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, _SCHEMA)


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """types, members, prose, uses and skipped of parsed files."""
    return {k: parsed.select(F.explode(k).alias("r")).select("r.*") for k in NESTED}


def scan(spark: SparkSession, root: str, staging: str | None = None) -> dict[str, DataFrame]:
    """The tables types, members, prose, uses and skipped (files and members that can't be read) of a tree of XML files.

    The files are parsed once: the parsed rows are written to ``staging``, or a folder of their own in the one that the cluster shares, and the tables read them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(root)
    parsed = parse_files(files)
    staging = staging or f"{shared_folder(spark)}/xml-{uuid.uuid4().hex}"
    parsed.write.mode("overwrite").parquet(staging)
    return tables(spark.read.schema(_SCHEMA).parquet(staging))


def check_unique(df: DataFrame, key: str = "declaration_id") -> DataFrame:
    """The rows; the job fails if two of them have one id."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("_n", n).withColumn(key, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("source_invalid: repeated id "), F.col(key))).cast("string")).otherwise(F.col(key))).drop("_n")


def checked(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a source; writing them fails if two types, or two members, have one id."""
    return found | {t: check_unique(found[t]) for t in ("types", "members")}


DOC = "id string, summary string, remarks string, returns string, value string, parameters {n}, type_parameters {n}, exceptions {n}".format(n="array<struct<name:string,text:string>>")


def compiler_doc_rows(files: DataFrame) -> DataFrame:
    """(path, DOC's columns, error) of compilers' documentation files (path, content): a row of each member, or one with the reason why a file is refused."""
    ddl = f"path string, {DOC}, error string"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    rows = [{"path": path, "id": i, **entry} for i, entry in compiler_docs(content.as_py()).items()]
                except QueryError as e:
                    rows = [{"path": path, "error": str(e)}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, ddl)


def compiler_docs(content: bytes) -> dict[str, dict]:
    """{member id: {summary, remarks, returns, value, parameters, type_parameters, exceptions}} of a compiler's documentation file."""
    if b"<!DOCTYPE" in content:
        raise QueryError("source_invalid", "document type definitions are refused")
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        raise QueryError("source_invalid", f"malformed XML: {e}") from e
    holders = root.findall("members")
    if root.tag != "doc" or len(holders) != 1:
        raise QueryError("source_invalid", "one doc/members element is expected")
    out: dict[str, dict] = {}
    for m in holders[0].iterfind("member"):
        name = m.get("name") or ""
        if not name or name in out:
            raise QueryError("source_invalid", f"missing or repeated id {name!r}")
        entry = {t: render(m.find(t)) for t in ("summary", "remarks", "returns", "value")}
        for tag, key, field in (("param", "name", "parameters"), ("typeparam", "name", "type_parameters"), ("exception", "cref", "exceptions")):
            rows = [(e.get(key) or "", render(e)) for e in m.iterfind(tag)]
            if len({k for k, _ in rows}) != len(rows):
                raise QueryError("source_invalid", f"{name}: repeated {tag}")
            entry[field] = [{"name": k, "text": v} for k, v in sorted(rows, key=lambda r: (r[0], r[1] or "")) if v is not None]
        out[name] = entry
    return out
