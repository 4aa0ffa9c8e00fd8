"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are its distinct n-grams (n from 3 to 8) of lower-cased characters inside a word, with the
space before and after it, hashed to ``buckets``. For each bucket the ratio r of smoothed document counts
in the two classes is taken; the ``features`` buckets with the largest likelihood-ratio statistic are kept,
and an L2-regularised logistic regression is trained on the presence of a bucket times its r. A score is a
sigmoid: higher means that the label is likelier to be 1.

Defined results: null and empty texts have no features, so their score is that of the intercept; texts of any
length are read whole, in pieces with overlap; equal texts get equal scores. With no labels, or labels of one
class only, every score is the smoothed share of label 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sample import labelled_sample
from ._store import drop, stage, with_fields
from ._words import splitmix

SIZES = (3, 4, 5, 6, 7, 8)
_COEFF = [np.uint32(x & 0xFFFFFFFF | 1) for x in splitmix(16, 5).tolist()]
_PIECE = 1 << 16
_WHITE = np.array([9, 10, 11, 12, 13, 0x85, 0xA0, 0x2028, 0x2029, 0x3000], dtype=np.uint32)


@dataclass
class Model:
    bits: int
    weight: np.ndarray  # float32, of each bucket: r times the regression's weight
    bias: float
    used: int = 0


def _piece(text: str, bits: int) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = c <= 32
    if c.max(initial=0) > 126:
        space |= np.isin(c, _WHITE)
    c = np.where(space, np.uint32(32), c)
    inner = np.zeros(len(c) + 1, dtype=np.int32)
    np.cumsum(space, out=inner[1:])
    out = []
    scaled = [c * k for k in _COEFF[: max(SIZES)]]
    for n in SIZES:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = scaled[0][:m] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        for i in range(1, n):
            h = h + scaled[i][i : i + m]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
        out.append((h >> np.uint32(32 - bits))[inner[n - 1 : n - 1 + m] == inner[1 : 1 + m]])
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


def gram_buckets(text: str | None, bits: int) -> Iterator[np.ndarray]:
    """The buckets of a text's n-grams, with repeats, piece by piece."""
    if not text:
        return
    text = f" {text.lower()} "
    for at in range(0, len(text), _PIECE):
        yield _piece(text[max(0, at - max(SIZES) + 1) : at + _PIECE], bits)


def distinct_buckets(text: str | None, bits: int) -> np.ndarray:
    seen = np.zeros(1 << bits, dtype=bool)
    for b in gram_buckets(text, bits):
        seen[b] = True
    return np.flatnonzero(seen)


def log_count_ratios(counts: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """counts: documents of class 0 and 1 that have each bucket."""
    p, q = counts[1] + alpha, counts[0] + alpha
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _information(counts: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """The likelihood-ratio statistic of each bucket's presence against the class."""
    have, total = counts.sum(0), n0 + n1
    out = np.zeros(counts.shape[1])
    for k, n in ((0, n0), (1, n1)):
        for seen, expected in ((counts[k], have * n / total), (n - counts[k], (total - have) * n / total)):
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(seen > 0, seen * np.log(seen / expected), 0)
    return out


def logistic(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 200, chunk: int = 1 << 18) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by accelerated gradient descent: row i has the value scale[j] in each of its columns rows[i].

    Works through chunks of rows with about ``chunk`` entries, so that the entries themselves are all that is held.
    """
    n, k = len(y), len(scale)
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    cols = np.concatenate([np.empty(0, dtype=np.uint16), *rows])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + chunk, side="right")) - 1))
    parts = [(lo, hi, cols[ends[lo] : ends[hi]], np.repeat(np.arange(hi - lo, dtype=np.int32), sizes[lo:hi])) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    w, b = np.zeros(k), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    norm = np.concatenate([np.bincount(r, weights=scale[c] ** 2, minlength=hi - lo) for lo, hi, c, r in parts])
    step = 1.0 / (0.25 * max(1.0, float(np.quantile(norm, 0.98))) * 0.5 + l2 / n)
    v, vb, t = w.copy(), b, 1.0
    loss_before = np.inf
    for _ in range(rounds):
        u, slope, g_sum, loss = v * scale, np.zeros(k), 0.0, 0.0
        for lo, hi, c, r in parts:
            z = np.bincount(r, weights=u[c], minlength=hi - lo) + vb
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[lo:hi]) / n
            slope += np.bincount(c, weights=g[r], minlength=k)
            g_sum += g.sum()
            loss += np.logaddexp(0, np.where(y[lo:hi] > 0, -z, z)).sum() / n
        w2 = v - step * (slope * scale + l2 / n * v)
        b2 = vb - step * g_sum
        loss += l2 / n / 2 * float(v @ v)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if loss > loss_before:  # restart, with a smaller step
            t2, step = 1.0, step * 0.7
            v, vb = w.copy(), b
            loss_before = np.inf
            t = t2
            continue
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        if abs(loss_before - loss) < 1e-8:
            w, b = w2, b2
            break
        w, b, t, loss_before = w2, b2, t2, loss
    return w, b


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2,
    max_rows: int = 24_000, bits: int = 19, features: int = 3000, l2: float = 1.0, parts: int = 12,
) -> Model:
    """Trains on at most ``max_rows`` labelled rows outside the held-out fold; the sample is read twice.

    The driver gets ``parts`` compressed arrays of counts, and, of each row of the sample, the kept buckets only: two bytes each.
    """
    if not 0 < features <= 1 << 16:
        raise ValueError("features is 1 to 65536")
    sample, path = stage(labelled_sample(docs, labels, id_col, text_col, label_col, folds, held_out, max_rows).repartition(parts), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((2, 1 << bits), dtype=np.int32), [0, 0]
        for b in batches:
            for text, label in zip(b.column("text"), b.column("label").to_pylist(), strict=True):
                counts[label][distinct_buckets(text.as_py(), bits)] += 1
                n[label] += 1
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary()), pa.array([n[0]], pa.int64()), pa.array([n[1]], pa.int64())], ["counts", "n0", "n1"])

    counts, n0, n1 = np.zeros((2, 1 << bits), dtype=np.int32), 0, 0
    for r in sample.mapInArrow(count, "counts binary, n0 long, n1 long").collect():
        counts += np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int32).reshape(2, -1)
        n0, n1 = n0 + r["n0"], n1 + r["n1"]
    if not n0 or not n1:
        drop(docs.sparkSession, path)
        return Model(bits, np.zeros(1 << bits, dtype=np.float32), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    gain = _information(counts, n0, n1)
    kept = np.sort(np.argsort(-gain, kind="stable")[:features])
    kept = kept[gain[kept] > 0]
    place = np.full(1 << bits, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text"):
                x = place[distinct_buckets(text.as_py(), bits)]
                rows.append(x[x >= 0].astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), pa.array(rows, pa.binary()), b.column("label")], ["sample_id", "x", "label"])

    kind = sample.schema["sample_id"].dataType.simpleString()
    got = []
    for r in sample.mapInArrow(pick, f"sample_id {kind}, x binary, label int").collect():
        got.append((str(r["sample_id"]), np.frombuffer(r["x"], dtype=np.uint16), r["label"]))
    drop(docs.sparkSession, path)
    got.sort(key=lambda g: (g[0], g[1].tobytes()))  # the same sum of gradients whatever the partitions
    r = log_count_ratios(counts)[kept]
    w, bias = logistic([x for _, x, _ in got], r, np.array([label for _, _, label in got], dtype=float), l2)
    weight = np.zeros(1 << bits, dtype=np.float32)
    weight[kept] = w * r
    return Model(bits, weight, bias, len(got))


def score_texts(texts: Iterator[str | None], model: Model) -> list[float]:
    """A text's score sums each kept bucket once."""
    place, out = np.zeros(1 << model.bits, dtype=bool), []
    for text in texts:
        z, seen = model.bias, []
        for b in gram_buckets(text, model.bits):
            b = b[model.weight[b] != 0]
            new = np.unique(b[~place[b]])
            place[new] = True
            z += float(model.weight[new].sum(dtype=np.float64))
            seen.append(new)
        for b in seen:
            place[b] = False
        out.append(1 / (1 + float(np.exp(-np.clip(z, -700, 700)))))
    return out


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``df`` (but one named as the score) and the score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c != score_col]
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score_texts((x.as_py() for x in b.column(at)), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], schema=b.schema.append(pa.field(score_col, pa.float64())))

    kept = df.select(*[F.col(f"`{c}`") for c in keep])
    return kept.mapInArrow(run, with_fields(kept, f"`{score_col}` double"))
