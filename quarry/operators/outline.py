"""Section trees of headings, by windows over a document's headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DOC = ("repo", "path")
SEPARATOR = " > "


def section_paths(headings: DataFrame) -> DataFrame:
    """Adds section_path and end_line (exclusive) to (repo, path, level, text, start_line, n_lines).

    A heading's ancestors are, of each shallower level, the last heading before it that no shallower or equal one has closed
    since. The k-th heading with the same path in its document gets `` (k)``, which its descendants don't inherit.
    """
    doc = Window.partitionBy(*DOC).orderBy("start_line")
    before, after = doc.rowsBetween(Window.unboundedPreceding, -1), doc.rowsBetween(1, Window.unboundedFollowing)
    h = headings
    for level in range(1, 7):
        h = h.withColumn(f"_a{level}", F.last(F.when(F.col("level") == level, F.struct("start_line", "text")), ignorenulls=True).over(before))
        h = h.withColumn(f"_n{level}", F.first(F.when(F.col("level") == level, F.col("start_line")), ignorenulls=True).over(after))
    live = []
    for level in range(1, 6):
        a = F.col(f"_a{level}")
        closed = F.lit(False)
        for above in range(1, level):
            closed = closed | F.coalesce(F.col(f"_a{above}.start_line") > a["start_line"], F.lit(False))
        live.append(F.when((F.col("level") > level) & ~closed, a["text"]))
    ends = [F.when(F.col("level") >= level, F.col(f"_n{level}")) for level in range(1, 7)]
    h = h.withColumns({"_base": F.concat_ws(SEPARATOR, *live, "text"), "end_line": F.coalesce(F.least(*ends), F.col("n_lines") + 1)})
    again = F.row_number().over(Window.partitionBy(*DOC, "_base").orderBy("start_line"))
    h = h.withColumn("section_path", F.when(again > 1, F.concat("_base", F.lit(" ("), again.cast("string"), F.lit(")"))).otherwise(F.col("_base")))
    return h.drop("_base", *[f"_a{i}" for i in range(1, 7)], *[f"_n{i}" for i in range(1, 7)])


def attribute_sections(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds section_path to lines (repo, path, line_no, ...): that of the last heading at or before the line, '' above the first.

    A heading's section reaches to the next of its level or above, so the last heading before a line is always the innermost
    section around it. Both tables are joined on the document, then each line takes its latest heading.
    """
    s = sections.select(*DOC, F.col("start_line").alias("_start"), F.col("end_line").alias("_end"), F.col("section_path").alias("_section"))
    at = (F.col("line_no") >= F.col("_start")) & (F.col("line_no") < F.col("_end"))
    joined = lines.join(s, list(DOC), "left").withColumn("_hit", F.when(at, F.struct("_start", "_section")))
    keys = [F.col(c) for c in lines.columns]
    return joined.groupBy(*keys).agg(F.coalesce(F.max("_hit")["_section"], F.lit("")).alias("section_path"))
