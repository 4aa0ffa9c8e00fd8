"""Words, 64-bit word hashes and shingles of UTF-8 text, with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, after A-Z are lower-cased. The hash of
a word is a sum of per-byte random numbers times powers of an odd multiplier, taken from prefix sums,
so a text costs a few vector operations whatever its number of words.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def splitmix(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE = splitmix(256, 11)
_P = 0x5851F42D4C957F2D
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_COEFF = splitmix(64, 77) | _U(1)
_CHUNK = 1 << 20
_pow: list[np.ndarray] = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_pow[0]) < n:
        size = 1 << max(14, (n - 1).bit_length())
        for k, base in ((0, _P), (1, _P_INV)):
            out = np.full(size, base, dtype=_U)
            out[0] = 1
            _pow[k] = np.cumprod(out, dtype=_U)
    return _pow


def _part(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, dtype=np.uint8)
    gap = np.empty(len(a) + 2, dtype=bool)
    gap[0] = gap[-1] = True
    np.take(_SPACE, a, out=gap[1:-1])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    if not len(edge):
        return np.empty(0, dtype=_U)
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(a) + 1)
    total = np.empty(len(a) + 1, dtype=_U)
    total[0] = 0
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def word_hashes(text: str | None) -> np.ndarray:
    """The hash of each word, in order."""
    return hash_words((text or "").encode("utf-8", "surrogatepass").lower())


def hash_words(data: bytes) -> np.ndarray:
    """The hash of each run of bytes other than white space, in order."""
    if len(data) <= _CHUNK:
        return _part(data)
    parts, at = [], 0
    while at < len(data):  # cut at white space only
        to = at + _CHUNK
        while to < len(data) and not _SPACE[data[to]]:
            to += 1
        parts.append(_part(data[at:to]))
        at = to
    return np.concatenate(parts)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words; of the whole sequence if there are fewer."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix((words * _COEFF[:n]).sum(keepdims=True, dtype=_U) + _U(n))
    out = words[: n - k + 1] * _COEFF[0]
    for i in range(1, k):
        out = out + words[i : n - k + 1 + i] * _COEFF[i]
    return mix(out)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct k-word shingles of a text, as hashes."""
    return np.unique(shingle_hashes(word_hashes(text), k))
