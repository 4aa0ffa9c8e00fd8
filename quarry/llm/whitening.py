"""Whitening of embeddings by matrix-free block subspace iteration.

Each entry c becomes the integer floor(scale * c); the fit list holds each distinct vector once. With n of them and sums S per dimension, rows are
centred at S / n before anything is multiplied. The covariance V is never made: a pass over the fit list gives Xᵀ(XQ) / n for a block Q of
directions, as one small matrix a task, which are summed in two levels, in a fixed order. On the driver, where a block is d x ``block`` numbers whatever the number of rows, a QR
factorisation makes the block orthonormal and a Rayleigh-Ritz step in it gives the best estimates of eigenvalues and -vectors. Passes go on until the residuals
|V u - e u| of all k components are at most ``tolerance`` times the largest eigenvalue. The block is wider than k, and between
two Rayleigh-Ritz steps it is filtered by a Chebyshev polynomial that is small on the eigenvalues beyond it, so that close eigenvalues take few passes.
The filter's degree grows while estimates improve (up to ``MAX_DEGREE``); each degree is a pass.

A last pass over the fit list measures the covariance of the whitened vectors itself, which gives identity_error.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are those with an entry whose integer has more than 53 bits, and
vectors of another length than most (of equally frequent lengths the smallest); they are not part of n. A null id is an id like others. Repeated
rows count once in the fit and are returned each. Components whose eigenvalue is at most ``tolerance`` times the largest, or 0, don't exist: there are fewer than k where the vectors span
fewer dimensions, and no rows where all are equal. Of equal eigenvalues any orthonormal vectors are taken. A deviation beyond 63 bits is an error. An empty table gives no
rows; other columns are kept where asked for (``keep``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._store import drop, fresh, stage

MAX_DEGREE = 8
#: Task results that are summed by one task.
FAN_IN = 64


def integer_vectors(df: DataFrame, vector_col: str, scale: float, keep: list[str], name: str) -> DataFrame:
    """(keep..., name array<long>) of the rows that take part, of any length."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    floors = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * scale >= float(1 << 53)))
    return df.filter(F.size(x) > 0).filter(~F.coalesce(bad, F.lit(True))).select(*[F.col(f"`{c}`") for c in keep], floors.alias(name))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of an array of lists of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _summed(fit: DataFrame, f, d: int) -> np.ndarray:
    """The sum of f(rows) over the batches of the fit list: an array of fixed size from each task, summed by FAN_IN and then on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            part = f(_matrix(b.column("x"), d))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["m"])

    def add(table: pa.Table) -> pa.Table:
        rows = [np.array(r) for r in table.sort_by("task").column("m").to_pylist()]
        return pa.table({"task": [0], "m": [np.sum(rows, axis=0).tolist()]}, schema=pa.schema([("task", pa.int32()), ("m", pa.list_(pa.float64()))]))

    tasks = fit.select("x").mapInArrow(run, "m array<double>").select(F.spark_partition_id().alias("task"), "m")
    summed = tasks.groupBy(F.floor(F.col("task") / FAN_IN)).applyInArrow(add, "task int, m array<double>")
    return np.sum([np.array(r["m"]) for r in summed.collect()], axis=0)


def covariance_times(fit: DataFrame, mean: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """V q, by one pass: Xᵀ(Xq) / n on centred rows."""
    shared = fit.sparkSession.sparkContext.broadcast((mean, q))

    def f(x: np.ndarray) -> np.ndarray:
        centre, directions = shared.value
        rows = x - centre
        return rows.T @ (rows @ directions)

    out = _summed(fit, f, len(mean)).reshape(q.shape) / n
    shared.destroy()
    return out


def components(fit: DataFrame, mean: np.ndarray, n: int, k: int, block: int, tolerance: float, max_passes: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) of the k largest; fewer if the vectors span fewer dimensions."""
    d = len(mean)
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((d, min(d, block))))
    passes, degree, best = 0, 1, np.inf
    while True:
        vq = covariance_times(fit, mean, n, q)
        passes += 1
        t = q.T @ vq
        values, w = np.linalg.eigh((t + t.T) / 2)
        values, w = values[::-1], w[:, ::-1]
        u, vu = q @ w, vq @ w
        top = max(float(values[0]), 0.0)
        real = int((values[:k] > max(top * tolerance, 0.0)).sum())
        residual = np.linalg.norm(vu - u * values, axis=0)
        worst = float(residual[: max(real, 1)].max())
        if top == 0 or worst <= tolerance * top:
            return values[:real], u[:, :real]
        if passes >= max_passes:
            raise RuntimeError(f"residual {worst / top:.1e} after {passes} passes over the vectors")
        degree = min(MAX_DEGREE, degree * 2) if worst < best else 1
        best = worst
        edge = max(float(values[-1]), 0.0)
        if q.shape[1] == d or edge <= 0 or degree == 1:  # a plain step of the iteration
            q, _ = np.linalg.qr(vu)
            continue
        # the Chebyshev polynomial of [0, edge], scaled to stay near 1 at the largest value
        half = edge / 2
        sigma = first = half / (top - half)
        y0, y1 = u, (vu - half * u) * (sigma / half)
        for _ in range(degree - 1):
            following = 1 / (2 / first - sigma)
            vy = covariance_times(fit, mean, n, y1)
            passes += 1
            y0, y1 = y1, (vy - half * y1) * (2 * following / half) - sigma * following * y0
            sigma = following
        q, _ = np.linalg.qr(y1)


def whiten(df: DataFrame, vector_col: str = "embedding", keep: list[str] | None = None, k: int = 4, scale: float = 256.0, block: int = 32, tolerance: float = 1e-12, max_passes: int = 500) -> DataFrame:
    """The columns ``keep`` (default: vec_id) of each remaining row with, for each component from 1: component, n, deviation, whitened, explained and identity_error."""
    keep = ["vec_id"] if keep is None else keep
    (name,) = fresh(df.columns, "x")
    rows = integer_vectors(df, vector_col, scale, keep, name)
    added = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = StructType([*rows.drop(name).schema.fields, *StructType.fromDDL(added).fields])
    found, distinct_path = stage(rows.select(F.col(name).alias("x")).distinct(), "distinct-vectors")
    lengths = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return df.sparkSession.createDataFrame([], schema)
    d, n = lengths["d"], lengths["count"]
    fit = found.filter(F.size("x") == d)
    per_dim = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).collect()  # d rows
    sums = [int(r["s"]) for r in sorted(per_dim, key=lambda r: r["i"])]
    mean = np.array([s / n for s in sums])  # of integers, rounded once
    values, u = components(fit, mean, n, k, block, tolerance, max_passes)
    k = len(values)
    if not k:
        drop(df.sparkSession, distinct_path)
        return df.sparkSession.createDataFrame([], schema)
    axes = u / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        """The sum of squares, the sums of the whitened vectors, and of their products."""
        centred = x - mean
        z = centred @ axes
        return np.concatenate([[(centred**2).sum()], z.sum(axis=0), (z.T @ z).ravel()])

    m = _summed(fit, moments, d) / n
    trace, z_mean = m[0], m[1 : k + 1]
    identity_error = float(np.abs(m[k + 1 :].reshape(k, k) - np.outer(z_mean, z_mean) - np.eye(k)).max())
    explained = values / trace
    drop(df.sparkSession, distinct_path)
    exact = np.array(sums, dtype=object)
    widest = max(abs(s) for s in sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, last = len(b), b.num_columns - 1
            x = _matrix(b.column(last), d)
            top = n * int(np.abs(x).max(initial=0)) + widest
            if d * top * top < 1 << 63:
                deviation = ((n * x - exact.astype(np.int64)) ** 2).sum(axis=1)
            else:
                deviation = ((n * x.astype(object) - exact) ** 2).sum(axis=1)
            z = (x - mean) @ axes
            at = pa.array(np.repeat(np.arange(size), k))
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.take(at) for c in b.columns[:last]), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, n, dtype=np.int64)),
                    pa.array(np.repeat(deviation, k).tolist(), pa.int64()), pa.array(z.ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * k, identity_error)),
                ],
                names=[*b.schema.names[:last], "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.filter(F.size(name) == d).mapInArrow(run, schema)
