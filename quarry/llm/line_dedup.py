"""Line deduplication within one edit, as a deletion-neighbourhood join in SQL functions.

A line is dropped if an earlier line is the same, or within the edit bound of it. The bound of two lines is one edit for each
``chars_per_edit`` characters of the shorter, ``max_edits`` (0 or 1) at most: under 16 characters one edit is more than a sixteenth of the
line, and more often makes another line (the next number of a list) than a copy. Lines are ordered by document id, then a hash of the text (for rows that share an id), then place in the text. What comes
first of a distinct line stands for it, whether or not that line is itself dropped.

1. Distinct lines by 128 bits of hash, with their first place and count, combined before the shuffle.
2. One edit leaves the first or the last half of a line as it was: distinct lines that share such a half with another are
   the only ones that go on (keys of halves are counted, and joined back).
3. These are cut into blocks of ``BLOCK`` characters; an edit falls into one block, so lines that agree before and after a
   block are a group, and only the block's characters have variants. This keeps the variants of a long line short.
4. Each line emits its variants as hashed keys: the block itself, and the block without its i-th character. Two lines of
   one length are one substitution apart if they share (i, block without i); two lines whose lengths differ by one
   are one insertion apart if the block of the shorter is a variant of the longer. Each key takes the earliest line of
   either kind, so a key shared by many lines yields one partner a line and never their pairs.
5. The partner is verified by edit distance on the lines themselves.

Lines of white space only are never dropped. Ids are whole numbers, or texts of them; others are an error. Defined results: null and
empty texts stay as they are; texts are split at line feeds and joined by them again, whatever their length; rows with the same id and
text count as one document, and all of them are kept; rows with a null id come last, as one document where their texts are equal; an empty
table gives an empty one; other columns are kept, whatever their names, but for those with the names of the added ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, fresh, stage

BLOCK = 64
_ROW = ["_id", "_hash"]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[F.Column, F.Column]:
    """What tells documents apart, in the order in which they are taken."""
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(2**63 - 1)), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _hash, no from 0, line, h1, h2) of every line that is not blank."""
    i, h = _rows(docs, id_col, text_col)
    lines = docs.filter(F.col(f"`{text_col}`").isNotNull()).select(i.alias("_id"), h.alias("_hash"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n", -1)).alias("no", "line"))
    return lines.filter(F.col("line").rlike(r"\S")).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


def distinct_lines(lines: DataFrame, chars_per_edit: int) -> DataFrame:
    """(h1, h2, first, n, halves): the keys of the halves are empty for short lines."""
    n = F.length("line")
    half = "transform(array_distinct(array(length(line) div 2, (length(line) - 1) div 2)), h -> array(xxhash64('p', h, left(line, h)), xxhash64('s', h, right(line, h))))"
    keys = F.when(n >= chars_per_edit, F.expr(f"flatten({half})")).otherwise(F.array().cast("array<bigint>"))
    place = F.struct("_id", "_hash", "no")
    return lines.select("h1", "h2", place.alias("place"), keys.alias("halves")).groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves"))


def near_lines(lines: DataFrame, distinct: DataFrame, chars_per_edit: int) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line at one edit."""
    keyed = distinct.select("h1", "h2", "first", F.explode("halves").alias("half"))
    shared = keyed.groupBy("half").agg(F.count("*").alias("k")).filter("k > 1").select("half")
    suspects = keyed.join(shared, "half").groupBy("h1", "h2").agg(F.first("first").alias("first"))
    # the text of a suspect is that of its first place
    at = lines.select("h1", "h2", F.struct("_id", "_hash", "no").alias("first"), "line").filter(F.length("line") >= chars_per_edit)
    texts, path = stage(at.join(suspects, ["h1", "h2", "first"]).dropDuplicates(["h1", "h2"]), "suspect-lines")

    # m: the length of the shorter of a pair that the line may be in; w: whether the line itself is that one
    m = texts.select("h1", "h2", "first", "line", F.explode(F.expr("array(named_struct('m', length(line), 'w', true), named_struct('m', length(line) - 1, 'w', false))")).alias("x"))
    blocks = m.select("h1", "h2", "first", "line", "x.m", "x.w", F.explode(F.expr(f"sequence(0, (x.m - 1) div {BLOCK})")).alias("j")).filter("m > 0")
    blocks = blocks.withColumn("after", F.expr(f"greatest(m - (j + 1) * {BLOCK}, 0)"))
    blocks = blocks.select("h1", "h2", "first", "w", F.expr(f"xxhash64(m, j, left(line, j * {BLOCK}), right(line, after))").alias("g"), F.expr(f"substr(line, j * {BLOCK} + 1, length(line) - after - j * {BLOCK})").alias("mid"))
    crowd = blocks.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1").select("g")
    blocks = blocks.join(crowd, "g")
    # kinds: 1 a substitution at i, 2 the shorter line of an insertion, 3 the longer
    cut = "transform(sequence(1, length(mid)), i -> named_struct('kind', {kind}, 'key', xxhash64(g, {salt}, concat(left(mid, i - 1), substr(mid, i + 1)))))"
    variants = F.expr(f"CASE WHEN w THEN concat({cut.format(kind=1, salt='i')}, array(named_struct('kind', 2, 'key', xxhash64(g, 0, mid)))) ELSE array_distinct({cut.format(kind=3, salt='0')}) END")
    emitted = blocks.filter("length(mid) > 0").select("h1", "h2", "first", F.explode(variants).alias("v")).select("h1", "h2", "first", "v.kind", "v.key")
    earliest = lambda *kinds: F.min(F.when(F.col("kind").isin(*kinds), F.struct("first", "h1", "h2")))
    keys = emitted.groupBy("key").agg(earliest(1).alias("same"), earliest(2).alias("short"), earliest(3).alias("long"), F.count("*").alias("k")).filter("k > 1")
    partner = F.when(F.col("kind") == 1, F.col("same")).when(F.col("kind") == 2, F.col("long")).otherwise(F.col("short"))
    pairs = emitted.join(keys, "key").select("h1", "h2", "first", partner.alias("p")).filter("p is not null and p.first < first").select("h1", "h2", F.col("p.h1").alias("g1"), F.col("p.h2").alias("g2")).distinct()
    both = pairs.join(texts.select("h1", "h2", "line"), ["h1", "h2"]).join(texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("other")), ["g1", "g2"])
    found, near_path = stage(both.filter(F.levenshtein("line", "other", 1).between(0, 1)).select("h1", "h2").distinct(), "near-lines")
    drop(texts.sparkSession, path)
    return found


def dropped_lines(docs: DataFrame, max_edits: int = 1, chars_per_edit: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _hash, dropped: places of the lines to drop, sorted, from 0) of documents that lose any."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    lines = explode_lines(docs, id_col, text_col)
    distinct = distinct_lines(lines, chars_per_edit if max_edits else 2**31 - 1)
    if max_edits:
        distinct, _ = stage(distinct, "distinct-lines")
    repeated = distinct.filter("n > 1").select("h1", "h2", "first")
    if max_edits:
        near = near_lines(lines, distinct, chars_per_edit).select("h1", "h2", F.lit(True).alias("near"))
        repeated = distinct.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left").filter("n > 1 or near").select("h1", "h2", F.when(F.col("near").isNull(), F.col("first")).alias("first"))
    gone = lines.select("_id", "_hash", "no", "h1", "h2").join(repeated, ["h1", "h2"]).filter(F.col("first").isNull() | (F.struct("_id", "_hash", "no") != F.col("first")))
    return gone.groupBy(*_ROW).agg(F.sort_array(F.collect_set("no")).alias("dropped"))


def dedup_lines(docs: DataFrame, max_edits: int = 1, chars_per_edit: int = 16, id_col: str = "doc_id", text_col: str = "text", added: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """All columns, the text without the dropped lines, and the numbers of lines before and dropped."""
    row_id, row_hash, dropped = fresh(docs.columns, "id", "hash", "dropped")
    gone = dropped_lines(docs, max_edits, chars_per_edit, id_col, text_col).select(F.col("_id").alias(row_id), F.col("_hash").alias(row_hash), F.col("dropped").alias(dropped))
    i, h = _rows(docs, id_col, text_col)
    names = [c for c in docs.columns if c not in added]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], i.alias(row_id), h.alias(row_hash)).join(gone, [row_id, row_hash], "left")
    text = F.col(f"`{text_col}`")
    gaps = rf"flatten(zip_with(concat(array(-1), {dropped}), concat({dropped}, array(size(ls))), (a, b) -> slice(ls, a + 2, b - a - 1)))"
    left = F.expr(rf"array_join(flatten(transform(array(split(`{text_col}`, '\n', -1)), ls -> {gaps})), '\n')")  # the lines are bound once
    kept = F.when(F.col(dropped).isNull(), text).otherwise(left)
    n = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1)))
    return rows.select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in names], n.alias(added[0]), F.coalesce(F.size(dropped), F.lit(0)).alias(added[1]))
