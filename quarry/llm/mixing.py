"""Mixing sources to target weights by the cube method.

Sizes are numbers of words. Sources in code point order, null last, have the weights in turn; together they are to give ``share`` times the size
of all rows. No source gives more than ``cap`` times its own size: what is above is shared again among the others by weight until none is
above. A source of size S and target T then takes every row of it floor(T / S) times, and once more with the probability T / S - floor(T / S).

Which rows are taken once more the cube method decides. The probabilities of a source's rows are a point of a cube; it moves along directions
that leave both the expected words and the expected number of rows as they are (the null-space of these two constraints, which for
three rows is one direction, known in closed form) until a row's probability is 0 or 1, which decides it. The direction's sign is drawn so that expectations stay. At
most two rows of a group stay open when it is done.

1. Rows are dealt into groups of about ``block_rows`` of one source by a hash of the row, so a source of any size is many tasks; each group runs its own flight.
2. What groups leave open is grouped again, until each source has one group.
3. Each group leaves up to ``reserve`` rows, chosen by a hash, out of its flight, so that the last one has rows of common sizes beside those that happen to be open. The landing decides
   these, at most ``reserve`` + 2 of each source, by a beam search for the choice whose words are nearest to the expectation.

Signs come from a hash of the group's number and rows are sorted before they are used, so reruns agree, however the input is partitioned.

Defined results: null texts have the size 0; rows of size 0, and all rows of a source of size 0, take nothing, but count as rows; rows with a null id or source are rows like others; repeated rows are
decided each, in no particular order among themselves; an empty table gives an empty one; other columns are kept, whatever their names, but those with the names of the added ones.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import fresh, stage

WEIGHTS = (5, 2, 1)
ADDED = ("size", "source_size", "target", "taken")
_EPS = 1e-9


def word_count(text_col: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(values: DataFrame, col: str) -> DataFrame:
    """The rows with their place, from 0, in the order of a column, nulls last. What comes to the driver is one number for each partition."""
    spark = values.sparkSession
    ordered, _ = stage(values.orderBy(F.col(col).asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    starts = spark.createDataFrame(starts, "p long, before long")
    return ordered.withColumn("p", part).join(F.broadcast(starts), "p").withColumn("place", F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "p", "before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """(source, source_size, n_rows, target) of sources (source, source_size, n_rows); the share is a fraction."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    rows, _ = stage(numbered(sizes, "source").withColumn("weight", weight), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    top, bottom = share
    # per unit of weight: budget / (bottom * open_weight); each round takes out the sources whose cap is below that
    budget, open_weight = None, None
    empty = full = F.col("source_size") <= 0
    exact = lambda x: F.lit(x).cast("decimal(38,0)")
    while True:
        seen = rows.agg(F.sum(F.when(~full, F.col("weight"))).alias("w"), F.sum(F.when(full, F.col("source_size"))).alias("s")).first()
        left, now = top * total - bottom * cap * (seen["s"] or 0), seen["w"] or 0
        done = (left, now) == (budget, open_weight) or not now
        budget, open_weight = left, now
        if done:
            break
        full = empty | (F.col("weight").cast("decimal(10,0)") * exact(budget) > F.col("source_size").cast("decimal(19,0)") * exact(cap * bottom * open_weight))
    target = F.when(full | F.lit(not open_weight), F.col("source_size").cast("double") * cap).otherwise(F.col("weight").cast("double") * float(budget) / float(bottom * (open_weight or 1)))
    return rows.select("source", "source_size", "n_rows", target.alias("target"), full.alias("full"))


def flight(p: list[float], size: list[int], draw: random.Random) -> list[int]:
    """Moves probabilities to 0 or 1, leaving sum(p) and sum(p * size) as they are; returns the places of at most two that are still between."""
    open_: list[int] = []
    for i in range(len(p)):
        if p[i] <= _EPS or p[i] >= 1 - _EPS:
            p[i] = round(p[i])
            continue
        open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = open_
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])  # orthogonal to (1, 1, 1) and to the sizes
        if not any(u):
            u = (1, -1, 0)
        up = min((1 - p[k]) / x if x > 0 else -p[k] / x for k, x in zip(open_, u, strict=True) if x)
        down = min(p[k] / x if x > 0 else (p[k] - 1) / x for k, x in zip(open_, u, strict=True) if x)
        step = up if draw.random() * (up + down) < down else -down
        for k, x in zip(open_, u, strict=True):
            p[k] += step * x
        open_ = [k for k in open_ if _EPS < p[k] < 1 - _EPS]
        for k in (a, b, c):
            if k not in open_:
                p[k] = round(p[k])
    return open_


def landing(p: list[float], size: list[int], places: list[int], width: int = 256) -> None:
    """Decides the few places that are left, by falling size: of the ``width`` best choices so far that with the words, then the rows, nearest to those expected."""
    states: list[tuple[float, float, tuple]] = [(0.0, 0.0, ())]  # words and rows above the expectation, what is taken
    for k in sorted(places, key=lambda k: (-size[k], k)):
        more = {}
        for words, rows, taken in states:
            for take in (0, 1):
                state = words + (take - p[k]) * size[k], rows + take - p[k], (k, taken) if take else taken
                more.setdefault((round(state[0], 6), round(state[1], 6)), state)
        states = sorted(more.values(), key=lambda s: (abs(s[0]), abs(s[1])))[:width]
    taken = states[0][2]
    for k in places:
        p[k] = 0.0
    while taken:
        k, taken = taken
        p[k] = 1.0


def _decide(p: np.ndarray, size: np.ndarray, seed: int, last: bool, reserve: int) -> np.ndarray:
    draw = random.Random(seed)
    held = min(reserve, max(len(p) // 4, min(len(p), 12) if last else 0))
    probabilities, sizes = p.tolist(), size.tolist()
    moving = probabilities[held:]
    open_ = flight(moving, sizes[held:], draw)
    probabilities[held:] = moving
    if last:
        landing(probabilities, sizes, [*range(held), *(k + held for k in open_)])
    return np.array(probabilities)


def _flights(p: str, order: str, group: str, round_no: int, last: bool, reserve: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """What is done with a group: its rows, with their probabilities moved."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.drop_columns([group]).sort_by([(order, "ascending"), ("size", "ascending")])
        name = key[0].as_py()
        seed = random.Random(f"{round_no} {key[1].as_py()} {name is None} {name}").getrandbits(64)
        moved = _decide(table.column(p).to_numpy(), table.column("size").to_numpy(), seed, last, reserve)
        return table.set_column(table.column_names.index(p), p, pa.array(moved, pa.float64()))

    return run


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str | None = "text", size_col: str | None = None, weights: tuple[int, ...] = WEIGHTS,
    share: tuple[int, int] = (3, 2), cap: int = 2, block_rows: int = 4096, reserve: int = 32,
) -> DataFrame:
    """All columns but the text, and size, source_size, target and taken: the words that the mix takes of the row, repeats counted.

    Texts are read once and not shuffled: join the result with them by what identifies a row, and take taken / size copies. Sizes of another kind come from ``size_col``.
    """
    if block_rows < 8:
        raise ValueError("block_rows is at least 8")
    names = [c for c in docs.columns if c != text_col and c.lower() not in ADDED]
    source, copies, p, group, order = fresh(docs.columns, "source", "copies", "p", "group", "order")
    size = F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)) if size_col else word_count(text_col)
    content = F.col(f"`{text_col}`") if text_col else F.lit(None).cast("string")
    kept = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{source_col}`").cast("string").alias(source), size.alias("size"), F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{source_col}`").cast("string"), content).alias(order))
    rows, _ = stage(kept, "sizes")
    sizes = rows.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    targets, _ = stage(source_targets(sizes, weights, share, cap), "targets")
    known = targets.select(F.col("source").alias(group), "source_size", "n_rows", "target", "full")
    ratio = F.when(F.col("source_size") <= 0, 0.0).when(F.col("full"), F.lit(float(cap))).otherwise(F.col("target") / F.col("source_size"))
    whole = F.least(F.floor(ratio), F.lit(cap)).cast("long")
    todo = rows.join(known, F.col(source).eqNullSafe(F.col(group))).withColumns({copies: whole, p: ratio - whole}).drop(group, "full")

    done = []
    most = targets.agg(F.max("n_rows")).first()[0] or 0
    schema, round_no = todo.drop("n_rows").schema, 0
    while True:
        last = most <= block_rows
        n_groups = F.lit(1).cast("long") if last else F.greatest(F.ceil(F.col("n_rows") / F.lit(block_rows)), F.lit(1)).cast("long")
        dealt = todo.withColumn(group, F.pmod(F.xxhash64(F.lit(round_no), order), n_groups)).drop("n_rows")
        keys = [source, group]

        moved, _ = stage(dealt.groupBy(*keys).applyInArrow(_flights(p, order, group, round_no, last, reserve), schema), f"flight-{round_no}")
        undecided = F.col(p).between(_EPS, 1 - _EPS)
        done.append(moved if last else moved.filter(~undecided))
        if last:
            break
        still = moved.filter(undecided)
        counts = still.groupBy(F.col(source).alias(group)).agg(F.count("*").alias("n_rows"))
        most = counts.agg(F.max("n_rows")).first()[0] or 0
        todo, round_no = still.join(counts, F.col(source).eqNullSafe(F.col(group))).drop(group), round_no + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    taken = (F.col(copies) + F.round(F.col(p)).cast("long")) * F.col("size")
    return out.select(*[F.col(f"`{c}`") for c in names], "size", "source_size", "target", taken.alias("taken"))
