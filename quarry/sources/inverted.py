"""Inverted tables of type uses and type names: a look-up reads one bucket.

A row stands once for each key that it can be found by, with the bucket of the key's hash as a partition of the stored table; rows of a key are together, so
Parquet's statistics leave out most of the bucket too. Candidates are a superset of what a query selects: the query's own predicates run on them, so its rows
are the same with and without the table.

A hot key, such as a type that a third of all signatures name, is one bucket but many files: ``write`` splits it by a salt.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import matching, text

_RUN = r"[\p{L}\p{Nd}_.+]+"
_SHORT = 3
BUCKETS = 64


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def use_keys(uses: DataFrame) -> Column:
    """The names that a use can be found by: the maximal runs of name characters in its expression, in its canonical names, and in what an application may mean."""
    applied = matching.applied_name(F.col("type_expression"))
    is_attribute = F.col("kind") == "attribute"
    texts = [F.col("type_expression"), F.when(is_attribute, F.concat(applied, F.lit("Attribute")))]
    texts += [F.col("attribute_type")] if "attribute_type" in uses.columns else []
    texts += [F.array_join("type_names", " ")] if "type_names" in uses.columns else []
    return F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", *texts), F.lit(_RUN), F.lit(0)))


def symbol_key(symbol: str) -> str | None:
    """The key under which all uses of a symbol stand: its longest run of name characters. None if it has none."""
    runs = re.findall(r"(?:[^\W]|[.+])+", symbol)
    return max(runs, key=len) if runs and all(r.isascii() for r in runs) else None


def _beginnings(parts: Column) -> Column:
    """``a`1`2`` gives a, a`1 and a`1`2."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "`"))


def _grams(own: Column, k: int) -> Column:
    """Every k characters in a row, as keys."""
    places = F.sequence(F.lit(1), F.length(own) - k + 1)
    return F.when(F.length(own) >= k, F.transform(places, lambda i: F.concat(F.lit("g"), F.substring(own, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))


def exact_keys(types: DataFrame) -> Column:
    """The spellings (``n``) by which a look-up may name a type: its names in full and alone, as they stand, without type arguments, without arity, and up to each arity."""
    names = [F.col(c) for c in ("full_name", "display_name", "type_name", "search_name") if c in types.columns]
    names += [F.substring_index("search_name", ".", -1)] if "search_name" in types.columns else []
    out = []
    for n in names:
        parts = F.split(n, "`")
        out += [F.array(n, text.strip_arguments(n), text.strip_all_arity(n)), _beginnings(parts)]
    spelled = F.filter(F.flatten(F.array(*[F.coalesce(o, F.array().cast("array<string>")) for o in out])), lambda x: x.isNotNull())
    return F.transform(spelled, lambda x: F.concat(F.lit("n"), x))


def name_keys(namespace: Column, type_name: Column) -> Column:
    """The keys of a type's name, in lower case: every run of whole segments of namespace and name (``r``), and every 1 to 3 characters in a row of its own name (``g``)."""
    segments = F.split(F.lower(F.concat_ws(".", namespace, type_name)), r"\.")
    n = F.size(segments)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.concat(F.lit("r"), F.array_join(F.slice(segments, i, k), ".")))))
    own = F.lower(type_name)
    grams = [_grams(own, k) for k in range(1, _SHORT + 1)]
    return F.array_distinct(F.concat(runs, *grams))


def pattern_keys(pattern: str) -> list[str]:
    """The keys of which a type that a pattern names has one at least: the pattern as a run of segments, and three characters of it."""
    low = pattern.lower()
    middle = max(0, len(low) // 2 - 1)
    gram = low if len(low) <= _SHORT else low[min(middle, len(low) - _SHORT) :][:_SHORT]
    return [f"r{low}", f"g{gram}"]


@dataclass(frozen=True)
class Inverted:
    """A stored inverted table."""

    spark: SparkSession
    path: str
    rows_schema: StructType  # of the rows that are found
    buckets: int = BUCKETS
    only: str | None = None  # a condition that all rows read are under

    def rows(self, keys: list[str]) -> DataFrame:
        """The rows under any of the keys, once for each key."""
        found = self.spark.read.schema(StructType([*self.rows_schema.fields, *StructType.fromDDL("key string, bucket int").fields])).parquet(self.path)
        if self.only:
            found = found.filter(self.only)
        # the buckets are folded to constants, so the scan lists theirs only
        places = reduce(lambda a, b: a | b, [(F.col("bucket") == bucket_of(F.lit(k), self.buckets)) & (F.col("key") == k) for k in keys])
        return found.filter(places).drop("key", "bucket")


def write(rows: DataFrame, keys: Column, path: str, buckets: int = BUCKETS, salts: int = 16) -> Inverted:
    """Stores the rows under each of their keys."""
    spread = rows.withColumn("key", F.explode(keys)).withColumn("bucket", bucket_of(F.col("key"), buckets))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if dict(rows.dtypes)[c] in ("string", "int", "bigint")]), F.lit(salts))
    spread.repartition("bucket", salt).sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return Inverted(rows.sparkSession, path, rows.schema, buckets)


def write_uses(uses: DataFrame, path: str, buckets: int = BUCKETS) -> Inverted:
    return write(uses, use_keys(uses), path, buckets)


def write_names(types: DataFrame, path: str, buckets: int = BUCKETS) -> Inverted:
    return write(types, F.array_distinct(F.concat(name_keys(F.col("namespace"), F.col("type_name")), exact_keys(types))), path, buckets)


def uses_of(index: Inverted, symbol: str) -> DataFrame | None:
    """The uses among which all references to a symbol are; none if the symbol has no key."""
    key = symbol_key(symbol)
    return index.rows([key]) if key else None


def types_for(index: Inverted, pattern: str) -> DataFrame:
    """The types among which all that a pattern names are."""
    return index.rows(pattern_keys(pattern))


def types_spelled(index: Inverted, names: list[str]) -> DataFrame:
    """The types among which all are that a look-up of these names selects. A type may come once for each of them."""
    return index.rows([f"n{n}" for n in names]).distinct()
