"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, stage, stage_counting


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """(id, component: the smallest id reachable) of every id that an edge names.

    Each round a vertex takes the smallest label among its own and its neighbours', then the label of that label, and once more
    (pointer jumping), until nothing changes. Minima are combined before the shuffle, and the joins on a vertex can be split where it has very
    many edges. The edges are computed once; rounds are cut by tables in the shared folder.

    With ``rounds`` it stops after so many: ids with one label are connected then, but a component may still have several.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    e, e_path = stage(e.select(ways).select("e.a", "e.b").distinct(), "edges")
    labels, path = e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), None
    done = 0
    while True:
        near = e.join(labels.select(F.col("id").alias("b"), "label"), "b").select(F.col("a").alias("id"), "label", F.lit(None).cast("long").alias("own"))
        both = near.unionByName(labels.select("id", "label", F.col("label").alias("own")))
        joined = both.groupBy("id").agg(F.min("label").alias("label"), F.max("own").alias("before"))
        jump = joined.join(labels.select(F.col("id").alias("label"), F.col("label").alias("next")), "label", "left")
        jump = jump.select("id", F.least("label", F.coalesce("next", "label")).alias("label"), "before")
        jump = jump.join(labels.select(F.col("id").alias("label"), F.col("label").alias("next")), "label", "left")
        new = jump.select("id", F.least("label", F.coalesce("next", "label")).alias("label"), "before")
        new, new_path, seen = stage_counting(new, "labels", changed=F.col("label") < F.col("before"))
        if path:
            drop(spark, path)
        labels, path = new.select("id", "label"), new_path
        done += 1
        if not seen["changed"] or done == rounds:
            break
    drop(spark, e_path)
    return labels.select("id", F.col("label").alias("component"))
