"""Trigram filters for the files of a stored table, so that a search reads only files that may hold what it looks for.

Each part of a file that one task reads has a filter: a map of ``SLICES`` x 32,768 bits, of which the hash of every three bytes of its texts
sets one. A text that holds a literal holds its trigrams, and all of them in one row, so a part that lacks one of them holds no such text: what is left out
never matches, what is read may. Slices are rows of a table that is partitioned by slice; a search reads the slices of its trigrams only and decides in SQL functions.

Filters are about 4 KB for each slice, whatever the part's size, so parts should be large (``spark.sql.files.maxPartitionBytes``): of 128 MB they add a thousandth.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICES = 32
_SLICE_BITS = 1 << 15


def trigrams(data: bytes) -> np.ndarray:
    """The hashes, under SLICES * 32,768, of every three bytes."""
    a = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    code = a[:-2] << 16 | a[1:-1] << 8 | a[2:] if len(a) > 2 else a[:0]
    return (code * np.uint32(0x9E3779B1) >> np.uint32(32 - (SLICES * _SLICE_BITS - 1).bit_length())).astype(np.int64)


def build(spark: SparkSession, table: str, index: str, text: Column) -> None:
    """Writes the filters of a stored table's files, of a text column or an expression of it (``lower`` for searches that ignore case)."""
    rows = spark.read.parquet(table).select(F.col("_metadata.file_name").alias("file"), text.cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, seen = None, np.zeros(SLICES * _SLICE_BITS, dtype=bool)

        def out() -> pa.RecordBatch:
            slices = np.packbits(seen.reshape(SLICES, _SLICE_BITS), axis=1, bitorder="little")
            kept = np.flatnonzero(slices.any(axis=1))
            return pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), pa.array([file] * len(kept), pa.string()), pa.array([slices[k].tobytes() for k in kept], pa.binary())], ["slice", "file", "bits"])

        for b in batches:
            for name, t in zip(b.column("file").to_pylist(), b.column("text"), strict=True):
                if name != file:
                    if file is not None:
                        yield out()
                    file = name
                    seen[:] = False
                if t.is_valid:
                    seen[trigrams(t.as_buffer().to_pybytes())] = True
        if file is not None:
            yield out()

    parts = rows.mapInArrow(run, "slice int, file string, bits binary").withColumn("part", F.spark_partition_id())
    parts.repartition("slice").sortWithinPartitions("slice", "file").write.mode("overwrite").partitionBy("slice").parquet(index)


def required_literals(pattern: str) -> list[str]:
    """Literals that every match of a regular expression holds: runs of plain characters outside groups, classes and alternatives, that aren't repeated or optional."""
    if "|" in pattern or "(?" in pattern or r"\Q" in pattern:
        return []
    out, run, depth, i = [], "", 0, 0

    def end() -> None:
        nonlocal run
        if run:
            out.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            escaped = pattern[i + 1 : i + 2]
            if escaped and not escaped.isalnum() and depth == 0:
                run += escaped
            else:
                end()
                if escaped and escaped in "pPx" and pattern[i + 2 : i + 3] == "{":
                    i = pattern.find("}", i) - 1 if "}" in pattern[i:] else len(pattern)
                elif escaped and (escaped in "pPx" or escaped.isdigit()):
                    return out  # what follows isn't looked at
            i += 2
        elif c == "[":
            end()
            close = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "^" else 2))
            if close < 0 or "[:" in pattern[i : close + 1] or "\\" in pattern[i : close + 1]:
                return out  # what follows isn't looked at
            i = close + 1
        elif c in "*?{":
            run = run[:-1]  # the character before may be missing
            end()
            i = (pattern.find("}", i) + 1 or len(pattern)) if c == "{" else i + 1
        elif c in "()":
            end()
            depth += 1 if c == "(" else -1
            i += 1
        elif c in ".^$+":
            end()
            i += 1
        else:
            run += c if depth == 0 else ""
            i += 1
    end()
    return out


@dataclass(frozen=True)
class Skipping:
    """A stored table with filters; ``folds`` where the filters are of the text in lower case."""

    spark: SparkSession
    table: str
    index: str
    folds: bool = False
    only: str | None = None  # a condition that all rows read are under

    def schema(self) -> StructType:
        return self.spark.read.parquet(self.table).schema

    def files(self, literals: list[str]) -> list[str] | None:
        """The files that may hold a text with all literals; none if nothing can be told from them, as three bytes are the least."""
        needed: dict[int, set[int]] = {}
        for literal in literals:
            for h in trigrams((literal.lower() if self.folds else literal).encode("utf-8", "surrogatepass")).tolist():
                needed.setdefault(h // _SLICE_BITS, set()).add(h % _SLICE_BITS)
        if not needed:
            return None
        ok = F.lit(False)
        for s, places in needed.items():
            held = F.lit(True)
            for p in sorted(places):
                held &= F.conv(F.hex(F.substring("bits", p // 8 + 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(1 << p % 8)) != 0
            ok |= (F.col("slice") == s) & held
        slices = self.spark.read.schema("file string, bits binary, part int, slice int").parquet(self.index).filter(F.col("slice").isin(list(needed)) & ok)
        found = slices.groupBy("file", "part").agg(F.count("*").alias("n")).filter(F.col("n") == len(needed)).select("file").distinct()
        return sorted(r["file"] for r in found.collect())  # names of files, which a scan of the table lists as well

    def read(self, literals: list[str]) -> DataFrame:
        """The table's rows in the files that may hold a text with all literals: a superset of the rows that do."""
        chosen, schema = self.files(literals), self.schema()
        if chosen is None:
            found = self.spark.read.schema(schema).parquet(self.table)
        elif chosen:
            found = self.spark.read.schema(schema).parquet(*[f"{self.table}/{f}" for f in chosen])
        else:
            found = self.spark.createDataFrame([], schema)
        return found.filter(self.only) if self.only else found


def literals_of(query: str, regex: bool = False) -> list[str]:
    return required_literals(query) if regex else [query]
