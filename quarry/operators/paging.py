"""Pages of a document under a budget of characters, which don't break atomic blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def page_end(cost: np.ndarray, blocks: list[tuple[int, int]], start: int, bound: int, budget: int) -> int:
    """The exclusive end of the page that starts at a line (from 1); cost[i]: characters of lines 1 to i with their line ends.

    At least one line is taken. A block [a, b) that the end would break moves it to b, as long as b is within the bound.
    """
    end = int(np.searchsorted(cost, cost[start - 1] + budget, side="right"))
    end = min(max(end, start + 1), bound)
    moved = True
    while moved:
        moved = False
        for a, b in blocks:
            if a < end < b <= bound:
                end, moved = b, True
    return end


def pages(lines: list[str], blocks: list[tuple[int, int]], start: int, bound: int, budget: int) -> list[tuple[int, int]]:
    """All pages [start, end) from a line to the bound."""
    cost = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
    out = []
    while start < bound:
        end = page_end(cost, blocks, start, bound, budget)
        out.append((start, end))
        start = end
    return out


def paginate(docs: DataFrame, budget: int) -> DataFrame:
    """(repo, path, page from 1, start_line, end_line) of every page of (repo, path, text, body_start, blocks).

    A page starts where the one before ends, so a document is folded as a whole, by prefix sums and bisection; documents are
    independent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for repo, path, text, first, blocks in zip(*(b.column(c).to_pylist() for c in ("repo", "path", "text", "body_start", "blocks")), strict=True):
                lines = (text or "").split("\n")
                found = pages(lines, [(x["start_line"], x["end_line"]) for x in blocks or []], first or 1, len(lines) + 1, budget)
                out += [(repo, path, i + 1, s, e) for i, (s, e) in enumerate(found)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["repo", "path", "page", "start_line", "end_line"])

    return docs.select("repo", "path", "text", "body_start", "blocks").mapInArrow(run, "repo string, path string, page int, start_line int, end_line int")
