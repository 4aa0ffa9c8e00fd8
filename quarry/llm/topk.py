"""Exact top-k inner products by pivot-table elimination.

Vectors are compared as integers floor(64 x). For each candidate the distances to ``n_pivots`` pivots are computed
once. For a query q and a candidate c the largest |d(q, p) - d(c, p)| over the pivots p is a lower bound of d(q, c),
so (|q|^2 + |c|^2 - bound^2) / 2 is an upper bound of their inner product. Candidates are evaluated in the order of
that bound until the k-th best score found exceeds the next bound: nothing that could still enter is left out.

The k-th best score of a query among the bounded sample from which the pivots come is known before any block is
looked at; it is carried along as a threshold, so that no block starts from nothing. Where the bounds leave more than an
eighth of a block, as they must in data without structure, all that is left is evaluated as one matrix product.

Queries and candidates are dealt into blocks of bounded bytes by a hash; a task compares one block of queries with one
block of candidates and keeps k rows a query, and these are merged. Candidates are shipped once for each block of queries, queries once
for each block of candidates: larger blocks ship less and hold more (``block_bytes``). The sample decides the time, never the results.

Scores are exact: products run in float32 or float64 where no sum can exceed 2^24 or 2^53, and in Python's integers beyond.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; vectors of different
lengths are not compared; equal scores go to the smaller id; candidates that share the query's id are its own row and
left out; a repeated candidate row counts as often as it stands there, and a repeated query row is answered each time.
Rows with a null id take no part. Empty inputs give no rows; empty vectors have the score 0. Scaled components and scores must fit 63 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_BLOCK, MAX_BLOCK = 256, 1 << 14  # rows
OUT = "query_id long, query_no long, vec_id long, score long"
_OUT = pa.schema([("query_id", pa.int64()), ("query_no", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def scaled_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float = 64.0) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(F.lit(scale) * c)).alias("v"))


def choose_pivots(sample: np.ndarray, n_pivots: int) -> np.ndarray:
    """Farthest-first pivots among the rows of the sample."""
    x = sample.astype(np.float64)
    if not len(x):
        return x
    far = ((x - x.mean(0)) ** 2).sum(1)
    chosen: list[int] = []
    for _ in range(min(n_pivots, len(x))):
        at = int(far.argmax())
        if chosen and far[at] <= 0:
            break
        chosen.append(at)
        d = ((x - x[at]) ** 2).sum(1)
        far = d if len(chosen) == 1 else np.minimum(far, d)
    return x[chosen]


def bounded_sample(vectors: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most ``rows`` rows, chosen by a hash, of the length that most of them have."""
    got = [(r["vec_id"], r["v"]) for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).collect()]
    lengths = [len(v) for _, v in got]
    common = max(set(lengths), key=lengths.count) if got else 0
    kept = [(i, v) for i, v in got if len(v) == common]
    return np.array([i for i, _ in kept], dtype=np.int64), np.array([v for _, v in kept], dtype=np.int64).reshape(len(kept), common)


def exact_kind(*parts: np.ndarray) -> type:
    """The narrowest type in which the inner products of the parts' rows are exact."""
    top = [max(-int(x.min()), int(x.max())) if x.size else 0 for x in parts]
    size = parts[0].shape[1] * top[0] * top[-1]
    return np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else object


def pivot_distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each row of v to each pivot; no columns where the lengths differ."""
    if not len(pivots) or v.shape[1] != pivots.shape[1]:
        return np.empty((len(v), 0))
    f = v.astype(np.float64)
    return np.sqrt(np.maximum((f * f).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * f @ pivots.T, 0))


def upper_bounds(q: np.ndarray, qd: np.ndarray, c2: np.ndarray, cd: np.ndarray) -> np.ndarray:
    """Of each inner product of a row of q and a candidate with squared norm c2; rounding may only loosen a bound."""
    q2 = (q.astype(np.float64) ** 2).sum(1).astype(np.float32)
    low = np.zeros((len(q), len(c2)), dtype=np.float32)
    gap = np.empty_like(low)
    for p in range(cd.shape[1]):
        np.subtract(cd[:, p], qd[:, p, None], out=gap)
        np.abs(gap, out=gap)
        np.maximum(low, gap, out=low)
    if cd.size:
        low -= np.float32(1e-6) * (1 + max(float(cd.max()), float(qd.max())))
        np.maximum(low, 0, out=low)
    both = q2[:, None] + c2
    return (both * np.float32(1 + 1e-6) - low * low * np.float32(1 - 1e-6)) / 2 + np.float32(1e-3)


def block_top_k(
    qid: np.ndarray, q: np.ndarray, qd: np.ndarray, least: np.ndarray, cid: np.ndarray, c: np.ndarray, cd: np.ndarray, k: int, step: int = 128, chunk: int = 32
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (ids, scores) of its k best candidates, best first, ties to the smaller id; none that score under ``least`` are needed."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    kind = exact_kind(q, c)
    c2, cd = (c.astype(np.float64) ** 2).sum(1).astype(np.float32), np.asfortranarray(cd, dtype=np.float32)
    qd, cs, n = qd.astype(np.float32), c.astype(kind), len(cid)
    for lo in range(0, len(qid), chunk):
        ids, x, floor = qid[lo : lo + chunk], q[lo : lo + chunk].astype(kind), least[lo : lo + chunk].astype(np.float64)
        bound = upper_bounds(x, qd[lo : lo + chunk], c2, cd)
        bound[ids[:, None] == cid] = -np.inf
        # the candidates with the largest bounds first; their k-th best score is a threshold for the others
        size = min(n, max(step, k))
        near = np.argpartition(bound, n - size, axis=1)[:, n - size :] if size < n else np.broadcast_to(np.arange(n), (len(ids), n))
        first = np.einsum("qcd,qd->qc", cs[near], x, optimize=False).astype(np.float64)
        taken = np.take_along_axis(bound, near, 1) > -np.inf
        first[~taken] = -np.inf
        if size >= k:
            floor = np.maximum(floor, np.partition(first, size - k, axis=1)[:, size - k])
        np.put_along_axis(bound, near, np.float32(-np.inf), 1)
        left = (bound >= floor[:, None]) & (bound > -np.inf)
        many = left.sum(1)
        scores = x @ cs.T if many.sum() * 8 > left.size else None
        for i in range(len(ids)):
            at, best = near[i][taken[i]], first[i][taken[i]]
            if scores is not None:
                more = np.flatnonzero(left[i] & (scores[i] >= floor[i]))
                at, best = np.concatenate([at, more]), np.concatenate([best, scores[i][more].astype(np.float64)])
            elif many[i]:
                rest = np.flatnonzero(left[i])
                rest = rest[np.argsort(-bound[i][rest], kind="stable")]
                done, t = 0, floor[i]
                while done < len(rest) and bound[i][rest[done]] >= t:  # in the order of the bounds, until the next is too small
                    part = rest[done : done + step]
                    at, best = np.concatenate([at, part]), np.concatenate([best, (cs[part] @ x[i]).astype(np.float64)])
                    if len(best) >= k:
                        t = max(t, float(np.partition(best, len(best) - k)[len(best) - k]))
                    done += len(part)
            if len(best) > k:  # all that tie with the k-th are ordered by id
                keep = best >= np.partition(best, len(best) - k)[len(best) - k]
                at, best = at[keep], best[keep]
            exact = np.array([int(s) for s in (cs[at] @ x[i]).tolist()], dtype=np.int64) if kind is object else best.astype(np.int64)
            top = np.lexsort((cid[at], -exact))[:k]
            out.append((cid[at][top], exact[top]))
    return out


def _matrix(t: pa.Table, name: str, kind: type) -> np.ndarray:
    column = t.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(t.num_rows, -1) if t.num_rows else flat.reshape(0, 0)


def top_k(
    vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", n_pivots: int = 24, sample_rows: int = 1024, block_bytes: int = 8 << 20,
) -> DataFrame:
    """query_id, rank from 1, vec_id and score of the k best candidates of each row for which ``is_query`` (on vec_id) holds."""
    rows = scaled_vectors(vectors, id_col, vector_col)
    n, n_query, longest = (int(x or 0) for x in rows.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.size("v"))).first())
    sample_ids, sample = bounded_sample(rows, sample_rows)
    pivots = choose_pivots(sample, n_pivots)
    block = max(MIN_BLOCK, min(MAX_BLOCK, block_bytes // (8 * max(longest, 1))))
    q_blocks, c_blocks = -(-n_query // block) or 1, -(-n // block) or 1
    spread = lambda seed, m: F.pmod(F.xxhash64("vec_id", F.hash("v"), F.lit(seed)), F.lit(m)).cast("int")
    dim = F.size("v").alias("dim")
    # what each side is compared with is the number of blocks of the other; a block's rows are bounded by its size
    c = spark_distances(rows, pivots).select("vec_id", "v", "d", dim, spread(1, c_blocks).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    q = spark_distances(rows.filter(is_query), pivots, sample_ids, sample, k)
    q = q.select("vec_id", "v", "d", "least", dim, spread(2, q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _OUT.empty_table()
        qid = left.column("vec_id").to_numpy()
        order = np.lexsort((qid,))
        qid = qid[order]
        found = block_top_k(
            qid, _matrix(left, "v", np.int64)[order], _matrix(left, "d", np.float32)[order], left.column("least").to_numpy()[order],
            right.column("vec_id").to_numpy(), _matrix(right, "v", np.int64), _matrix(right, "d", np.float32), k,
        )
        no = np.arange(len(qid)) - np.searchsorted(qid, qid)  # tells repeated query rows apart
        sizes = [len(x) for x, _ in found]
        return pa.table([np.repeat(qid, sizes), np.repeat(no, sizes), np.concatenate([x for x, _ in found]), np.concatenate([s for _, s in found])], schema=_OUT)

    keys = ["qb", "cb", "dim"]
    local = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(compare, OUT)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def thresholds(ids: np.ndarray, v: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A score that the k-th best candidate of each row reaches at least, from the sample; -inf where that can't tell."""
    out = np.full(len(v), -np.inf)
    if len(sample) >= k and v.shape[1] == sample.shape[1] and (kind := exact_kind(v, sample)) is not object:
        s = (v.astype(kind) @ sample.astype(kind).T).astype(np.float64)
        s[ids[:, None] == sample_ids] = -np.inf
        out = np.partition(s, len(sample) - k, axis=1)[:, len(sample) - k]
    return out


def spark_distances(rows: DataFrame, pivots: np.ndarray, sample_ids: np.ndarray | None = None, sample: np.ndarray | None = None, k: int = 0) -> DataFrame:
    """(vec_id, v, d array<float>) with the distances to the pivots; with a sample also ``least``, the rows' thresholds."""

    def run(batches):
        for b in batches:
            ids, column = b.column("vec_id").to_numpy(zero_copy_only=False), b.column("v")
            sizes = np.asarray(column.value_lengths())
            flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            d: list = [None] * len(sizes)
            least = np.full(len(sizes), -np.inf)
            for size in np.unique(sizes).tolist():
                here = np.flatnonzero(sizes == size)
                v = flat[(at[here][:, None] + np.arange(size)).ravel()].reshape(len(here), size).astype(np.int64)
                for i, x in zip(here.tolist(), pivot_distances(v, pivots).astype(np.float32), strict=True):
                    d[i] = x
                if sample is not None:
                    least[here] = thresholds(ids[here], v, sample_ids, sample, k)
            cols, names = [b.column("vec_id"), column, pa.array(d, pa.list_(pa.float32()))], ["vec_id", "v", "d"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(least, pa.float64())] if sample is not None else cols, [*names, "least"] if sample is not None else names)

    return rows.mapInArrow(run, "vec_id long, v array<long>, d array<float>" + (", least double" if sample is not None else ""))
