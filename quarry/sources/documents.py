"""Document trees: Markdown files as they are, question-and-answer YAML rendered as Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAQ_MIME = "FAQ"


def sniff_mime(text: str) -> str | None:
    """The type named by the first line that is not blank, a byte order mark allowed."""
    m = re.match(r"﻿?\s*### YamlMime:([^\r\n]*)", text)
    return m[1].strip() if m else None


def parse_faq(text: str) -> dict:
    """{summary, sections: [(name, [(question, answer)])]}; ValueError says why not."""
    import yaml

    try:
        data = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError as e:
        raise ValueError(f"not valid YAML: {e}") from e
    sections = data.get("sections") if isinstance(data, dict) else None
    if not isinstance(sections, list) or not sections:
        raise ValueError("the FAQ has no sections")
    out = []
    for s in sections:
        name = str((s or {}).get("name") or "")
        questions = (s or {}).get("questions")
        if not isinstance(questions, list) or not questions:
            raise ValueError(f"FAQ section {name!r} has no questions")
        out.append((name, [(str(q.get("question") or ""), str(q.get("answer") or "")) for q in questions]))
    return {"summary": str(data.get("summary") or ""), "sections": out}


def render_faq(faq: dict) -> str:
    """Summary, then a heading for each section and one below it for each question; the title would head them all and is left out."""
    one_line = lambda x: " ".join(x.split())
    parts = [faq["summary"].rstrip()] if faq["summary"].strip() else []
    for name, questions in faq["sections"]:
        parts.append("# " + one_line(name))
        for question, answer in questions:
            parts.append("## " + one_line(question))
            if answer.strip():
                parts.append(answer.rstrip())
    return "".join(p + "\n\n" for p in parts)


def scan(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """(repo, path, text, rendered_from, skipped) of the documents below a root.

    YAML files of other types are no documents; an FAQ that can't be read is a row with ``skipped`` set and no text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root.rstrip("/")).select("path", "content")
    base = re.sub(r"^file:/*", "/", root.rstrip("/")) if not re.match(r"^(?!file:)[a-z]+://", root) else root.rstrip("/")
    inside = F.regexp_replace(F.regexp_replace(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", "/"), "^" + re.escape(base) + "/+", "")
    return parse_files(files.select(inside.alias("path"), "content"), repo)


def parse_files(files: DataFrame, repo: str) -> DataFrame:
    """The documents among files (path, content), by Arrow batches."""
    rows = files.select("path", "content").filter(F.lower("path").rlike(r"\.(md|yml|yaml)$"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                text = content.as_py().decode("utf-8-sig", "replace")
                if path.lower().endswith(".md"):
                    out.append((path, text, None, None))
                elif sniff_mime(text) == FAQ_MIME:
                    try:
                        out.append((path, render_faq(parse_faq(text)), FAQ_MIME, None))
                    except ValueError as e:
                        out.append((path, None, FAQ_MIME, str(e)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["path", "text", "rendered_from", "skipped"])

    found = rows.mapInArrow(run, "path string, text string, rendered_from string, skipped string")
    return found.select(F.lit(repo).alias("repo"), "path", "text", "rendered_from", "skipped")


def readable(docs: DataFrame) -> DataFrame:
    return docs.filter("skipped is null").drop("skipped")


def skipped(docs: DataFrame) -> DataFrame:
    return docs.filter("skipped is not null").select("repo", "path", F.col("skipped").alias("reason"))
