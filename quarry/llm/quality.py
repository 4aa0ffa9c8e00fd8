"""Quality: regularised quadratic discriminant analysis of document statistics.

Each text gives a fixed vector of statistics (shares of character kinds, word and line repetition, lengths,
entropy), each taken through log, logit or square root; log odds are kept between -5 and 5, which is what 150 observations could show, lest the length
of a text alone be what they tell. A class has a mean and a covariance shrunk first toward
the pooled covariance and then toward its own mean variance; scores are the difference of the two Gaussian
log densities (squared Mahalanobis distances by cached Cholesky factors), plus the log prior ratio, through a sigmoid.

Defined results: null and empty texts have the statistics of no words and get a score like any other; texts of any
length are read whole; equal texts get equal scores. With no labels, or of one class only, every score is the
smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sample import labelled_sample
from ._store import with_fields
from ._words import word_hashes

_KIND = np.full(256, 4, dtype=np.uint8)  # 0 lower case, 1 upper case, 2 digit, 3 white space, 4 other ASCII, 5 sentence mark, 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 6
_KIND[[32, 9, 10, 11, 12, 13]] = 3
_KIND[[44, 46, 59, 58, 63, 33, 39, 45]] = 5
NAMES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "white", "symbol", "mark", "beyond_ascii", "distinct_words", "repeated_neighbours",
    "distinct_pairs", "top_word", "entropy", "distinct_lines", "line_length", "exclamation",
)


def _logit(x: float, n: float) -> float:
    """The log odds of a share of n, away from 0 and 1."""
    e = 0.5 / (n + 1)
    x = min(max(x, e), 1 - e)
    return float(np.log(x / (1 - x)))


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one text, in the order of NAMES."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    a = np.frombuffer(data, dtype=np.uint8)
    hist = np.bincount(a, minlength=256)
    kinds = np.bincount(_KIND, weights=hist, minlength=7) / max(n, 1)
    words = word_hashes(text)
    m = len(words)
    _, counts = np.unique(words, return_counts=True)
    same = float((words[1:] == words[:-1]).mean()) if m > 1 else 0.0
    pairs = len(np.unique(words[1:] * np.uint64(31) + words[:-1])) / (m - 1) if m > 1 else 1.0
    p = hist[hist > 0] / max(n, 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    cap = 5.0  # logits are capped at what 150 observations could show, lest length alone be what they tell
    logit = lambda x: max(-cap, min(cap, _logit(x, max(n, 1))))
    return np.array([
        np.log1p(n), np.log1p(m), np.log1p((n - hist[32]) / max(m, 1)), logit(kinds[1]), logit(kinds[2]), logit(kinds[3]), logit(kinds[4]), logit(kinds[5]),
        logit(kinds[6]), logit(len(counts) / m if m else 1.0), logit(same), logit(pairs), np.sqrt(counts.max() / m) if m else 0.0, float(-(p * np.log(p)).sum()),
        logit(len(set(lines)) / len(lines) if lines else 1.0), np.log1p(n / max(len(lines), 1)), logit(hist[33] / max(n, 1)),
    ])


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # of both classes, standardised
    factors: np.ndarray  # inverse of each class's lower Cholesky factor
    constants: np.ndarray  # log prior - half the log determinant
    one_class: float | None = None
    used: int = 0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.one_class is not None:
            return np.full(len(x), self.one_class)
        z = (x - self.centre) / self.scale
        log = [self.constants[k] - 0.5 * (((z - self.means[k]) @ self.factors[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -700, 700)))


def train(x: np.ndarray, y: np.ndarray, pooled: float = 0.1, ridge: float = 0.05) -> Model:
    """x: statistics; y: 0 or 1. ``pooled`` and ``ridge`` are the weights of the two shrinkage targets."""
    n1 = int(y.sum())
    if n1 < 2 or len(y) - n1 < 2:
        d = len(NAMES)
        return Model(np.zeros(d), np.ones(d), np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), (n1 + 0.5) / (len(y) + 1), len(y))
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    parts = [z[y == k] for k in (0, 1)]
    means = np.array([p.mean(0) for p in parts])
    covs = [np.cov(p.T, bias=True) for p in parts]
    both = sum(c * len(p) for c, p in zip(covs, parts, strict=True)) / len(y)
    factors, constants = [], []
    for c, p in zip(covs, parts, strict=True):
        c = (1 - pooled) * c + pooled * both
        c = (1 - ridge) * c + ridge * np.trace(c) / len(c) * np.eye(len(c))
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        constants.append(np.log(len(p) / len(y)) - np.log(np.diag(low)).sum())
    return Model(centre, scale, means, np.array(factors), np.array(constants), None, len(y))


def _vectors(df: DataFrame) -> DataFrame:
    """sample_id, x, label of (sample_id, text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t.as_py()).tolist() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), pa.array(rows, pa.list_(pa.float64())), b.column("label")], ["sample_id", "x", "label"])

    return df.mapInArrow(run, f"sample_id {df.schema['sample_id'].dataType.simpleString()}, x array<double>, label int")


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0,
    max_rows: int = 40_000, pooled: float = 0.1, ridge: float = 0.05,
) -> Model:
    """Trains on at most ``max_rows`` labelled rows outside the held-out fold; the driver gets their statistics only."""
    rows = sorted(((str(r["sample_id"]), r["x"], r["label"]) for r in _vectors(labelled_sample(docs, labels, id_col, text_col, label_col, folds, held_out, max_rows)).collect()), key=lambda r: (r[0], r[1]))
    x = np.array([r[1] for r in rows], dtype=float).reshape(-1, len(NAMES))
    return train(x, np.array([r[2] for r in rows], dtype=int), pooled, ridge)


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``df`` (but one named as the score) and the score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c != score_col]
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(at)]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.scores(x), pa.float64())], schema=b.schema.append(pa.field(score_col, pa.float64())))

    kept = df.select(*[F.col(f"`{c}`") for c in keep])
    return kept.mapInArrow(run, with_fields(kept, f"`{score_col}` double"))
