"""Markdown structure at ingest: headings, atomic blocks and where the body begins.

Scanned line by line: ATX and setext headings (also inside quotes and list items), fenced code, pipe tables and YAML front matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import normalise_line_breaks

_CONTAINER = re.compile(r"^(?: {0,3}(?:>|[-*+](?= )|\d{1,9}[.)](?= )) ?)+")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_DELIMITER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_INLINE = ((re.compile(r"!\[[^\]]*\]\([^)]*\)|<[^>]*>"), ""), (re.compile(r"\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])"), r"\1"), (re.compile(r"(`+)(.+?)\1"), r"\2"), (re.compile(r"(\*\*|__|\*|(?<!\w)_(?=\S))(.+?)\1"), r"\2"))
STRUCTURE = "headings array<struct<level:int,text:string,start_line:int>>, blocks array<struct<kind:string,start_line:int,end_line:int>>, body_start int, n_lines int"


def plain_heading(text: str) -> str:
    for pattern, to in _INLINE:
        text = pattern.sub(to, text)
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text).strip()


def front_matter_end(lines: list[str]) -> int:
    """The number of lines of front matter; 0 if there is none. Two adjacent rules are none."""
    if lines and lines[0].rstrip() == "---":
        for i in range(1, len(lines)):
            if lines[i].rstrip() in ("---", "..."):
                return i + 1 if i > 1 else 0
    return 0


def scan(text: str) -> dict:
    """headings, blocks, body_start and n_lines of a text whose line ends are normalised. Lines count from 1, ends are exclusive."""
    lines = text.split("\n")
    headings, blocks = [], []
    i = front_matter_end(lines)
    if i:
        blocks.append({"kind": "front_matter", "start_line": 1, "end_line": i + 1})
    body = i + 1
    paragraph = 0  # lines of the paragraph just before
    while i < len(lines):
        raw = lines[i]
        line = raw[m.end() :] if (m := _CONTAINER.match(raw)) else raw
        if m := _FENCE.match(line):
            mark, info = m[1], m[2]
            if mark[0] == "~" or "`" not in info:
                j = i + 1
                close = re.compile(rf"^(?: {{0,3}}> ?)* {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
                while j < len(lines) and not close.match(lines[j]):
                    j += 1
                blocks.append({"kind": "fence", "start_line": i + 1, "end_line": j + 2})
                i, paragraph = j + 1, 0
                continue
        if m := _ATX.match(line):
            headings.append({"level": len(m[1]), "text": plain_heading(m[2] or ""), "start_line": i + 1})
            i, paragraph = i + 1, 0
            continue
        if paragraph and (m := _SETEXT.match(line)):
            held = " ".join(x.strip() for x in lines[i - paragraph : i])
            headings.append({"level": 1 if m[1][0] == "=" else 2, "text": plain_heading(held), "start_line": i - paragraph + 1})
            i, paragraph = i + 1, 0
            continue
        if "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and _DELIMITER.match(lines[i + 1]) and line.strip("| \t").count("|") == lines[i + 1].strip("| \t").count("|"):
            j = i + 2
            while j < len(lines) and lines[j].strip() and not _ATX.match(lines[j]) and not _FENCE.match(lines[j]):
                j += 1
            blocks.append({"kind": "table", "start_line": i + 1, "end_line": j + 1})
            i, paragraph = j, 0
            continue
        indented = re.match(r"^(?: {4}|\t)", line) and not paragraph
        paragraph = paragraph + 1 if line.strip() and not indented and not re.match(r"^ {0,3}([-*_])[ \t]*(\1[ \t]*){2,}$", line) else 0
        i += 1
    return {"headings": headings, "blocks": blocks, "body_start": body, "n_lines": len(lines)}


_PARSED = (
    ("headings", pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string()), ("start_line", pa.int32())]))),
    ("blocks", pa.list_(pa.struct([("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]))),
    ("body_start", pa.int32()), ("n_lines", pa.int32()),
)


def structured(docs: DataFrame) -> DataFrame:
    """The documents (repo, path, text, ...) with headings, blocks, body_start and n_lines; those that have them already, as stored ones do, as they are."""
    if "headings" in docs.columns:
        return docs
    rows = docs.withColumn("text", normalise_line_breaks(F.col("text")))
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t or "") for t in b.column(at).to_pylist()]
            more = [pa.array([f[n] for f in found], kind) for n, kind in _PARSED]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], schema=pa.schema([*b.schema, *(pa.field(n, kind) for n, kind in _PARSED)]))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL(STRUCTURE).fields]))


def heading_rows(docs: DataFrame) -> DataFrame:
    """(repo, path, level, text, start_line, n_lines) of structured documents."""
    return docs.select("repo", "path", "n_lines", F.explode("headings").alias("h")).select("repo", "path", "h.level", "h.text", "h.start_line", "n_lines")


def block_rows(docs: DataFrame) -> DataFrame:
    return docs.select("repo", "path", F.explode("blocks").alias("b")).select("repo", "path", "b.kind", "b.start_line", "b.end_line")
