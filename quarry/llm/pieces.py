"""SentencePiece encoding and decoding, with N-best segmentations.

The vocabulary is that of a SentencePiece model file; piece scores serve as log probabilities of a piece lattice, as
in a unigram model. White space becomes U+2581 and one is put in front; a character without a piece of its own costs
the least piece score less 10 and is spelled in byte pieces. A segmentation's score is the sum over its pieces.

N best: a forward Viterbi pass gives each position the best score of a path that reaches it. An A* search then walks
backward from the end; a partial path is ranked by its own score plus the forward score where it has arrived. That
heuristic is exact, so complete paths leave the agenda best first. No path of the lattice crosses from a letter into
U+2581, so the lattice of a text is a chain of small lattices, one a word; forward passes are done for many distinct
words at once and remembered. The N best paths of the chain deviate from the best one in no word outside the N - 1 whose
second-best path costs least, so the search runs over the chain of these words only; the result is that of the
whole lattice.

Defined results: null and empty texts have no pieces, score 0 and one (empty) segmentation; a text of any length is
encoded whole; where scores tie the order is fixed but not specified; decoding gives the text back, but for U+2581
itself, which decodes as a space. A text with fewer than N segmentations has them all.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import with_fields

MARK = "▁"
_P = 0x9E3779B97F4A7C15
_VECTOR_LEN, _INF = 40, float("inf")
_CHUNK = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


def read_model(spark: SparkSession | None, path: str) -> bytes:
    """The model file's bytes; from Spark where the path names a store."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


class _Places(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        return at


class Vocabulary:
    """Pieces, scores, and the remembered forward passes of words. ``cache_words`` bounds the memory these take."""

    def __init__(self, model: bytes, cache_words: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only vocabularies without text normalisation are supported")
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("white space as a suffix is not supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        usable = [(i, p) for i, p in enumerate(proto.pieces) if p.type in (1, 4)]
        self.piece = {p.piece: (i, float(p.score)) for i, p in usable}
        if any(MARK in x.lstrip(MARK) or "\n" in x for x in self.piece):
            raise ValueError("a piece crosses words")
        self.longest = max(map(len, self.piece), default=1)
        self.unknown_score = min((float(p.score) for _, p in usable if p.type == 1), default=0.0) - 10
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == 2), 0)
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte = [byte[i] for i in range(256)] if len(byte) == 256 else None
        self.text = [b"" if p.type in (2, 3) else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        for value, i in byte.items():
            self.text[i] = bytes([value])
        self.cache_words = cache_words
        self.found: dict[tuple[tuple[str, ...], int], list[tuple[float, list[np.ndarray]]]] = {}
        self._reset()
        self._tables()

    def _reset(self) -> None:
        """Of each remembered word: best score, cost of the second-best path, and where its ids lie in ``flat``."""
        self.cache = _Places()
        self.score, self.cost = np.empty(0), np.empty(0)
        self.start, self.size = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.flat = np.empty(0, dtype=np.int32)

    # -- forward passes over many words at once

    def _tables(self) -> None:
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.array([1] + [_P] * (self.longest + 1), dtype=np.uint64), dtype=np.uint64)
            keys = np.zeros(len(self.piece), dtype=np.uint64)
            for k, x in enumerate(self.piece):
                h = 0
                for c in x:
                    h = (h * _P + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                keys[k] = h
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        order = np.argsort(keys)
        self.keys = keys[order]
        both = list(self.piece.values())
        self.key_id = np.array([i for i, _ in both], dtype=np.int32)[order]
        self.key_score = np.array([s for _, s in both])[order]
        self.maybe = np.zeros(1 << 18, dtype=bool)
        self.maybe[(self.keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(46)] = True

    def _forward(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(best score, cost of the second-best path, number of pieces, all ids) of words of one length.

        A position's entry is updated for each (start, end) with the words that have a piece there only.
        """
        n, size = len(words), len(words[0])
        c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, size).T
        h = np.zeros((size + 1, n), dtype=np.uint64)
        for e in range(size):
            h[e + 1] = h[e] * np.uint64(_P) + c[e] + np.uint64(1)
        best, second = np.full((size + 1, n), -_INF), np.full((size + 1, n), -_INF)
        best[0] = 0
        length, piece = np.zeros((size + 1, n), dtype=np.int8), np.full((size + 1, n), -1, dtype=np.int32)
        for e in range(1, size + 1):
            k = min(e, self.longest)
            key = h[e] - h[e - k : e] * self.power[k:0:-1, None]
            j, i = np.nonzero(self.maybe[(key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(46)])
            want = key[j, i]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            j, i, at = j[hit], i[hit], at[hit]
            cuts = np.searchsorted(j, np.arange(k + 1))
            b, s2, ln, pc = best[e], second[e], length[e], piece[e]
            for r in range(k):
                lo, hi = cuts[r], cuts[r + 1]
                w, score, ids = i[lo:hi], self.key_score[at[lo:hi]], self.key_id[at[lo:hi]]
                if r == k - 1 and hi - lo < n:  # characters without a piece
                    score, ids, some = np.full(n, self.unknown_score), np.full(n, -1, dtype=np.int32), w
                    score[some], ids[some] = self.key_score[at[lo:hi]], self.key_id[at[lo:hi]]
                    w = np.arange(n)
                elif lo == hi:
                    continue
                v, v2, old = best[e - k + r, w] + score, second[e - k + r, w] + score, b[w]
                better = v > old
                s2[w] = np.where(better, np.maximum(old, v2), np.maximum(s2[w], v))
                x = w[better]
                b[x], ln[x], pc[x] = v[better], k - r, ids[better]
        path, at, row = [], np.full(n, size), np.arange(n)
        while at.any():
            path.append(np.where(at > 0, piece[at, row], -2))
            at = at - np.where(at > 0, length[at, row], 0)
        path = np.array(path[::-1], dtype=np.int32).T
        odd = np.flatnonzero((path == -1).any(1))
        counts = (path >= 0).sum(1)
        if not len(odd):
            return best[size], best[size] - second[size], counts, path[path >= 0]
        parts = [x[x >= 0] for x in path]
        for i in odd.tolist():
            parts[i] = np.frombuffer(self._forward_one(words[i])[2], dtype=np.int32)
            counts[i] = len(parts[i])
        return best[size], best[size] - second[size], counts, np.concatenate(parts)

    def edges(self, word: str) -> list[list[tuple[int, int, float]]]:
        """For each end position the pieces (start, id, score) that end there; id -1 is an unknown character."""
        out: list[list[tuple[int, int, float]]] = [[]]
        get = self.piece.get
        for e in range(1, len(word) + 1):
            here = [(s, *got) for s in range(max(0, e - self.longest), e) if (got := get(word[s:e])) is not None]
            if not here or here[-1][0] != e - 1:
                here.append((e - 1, -1, self.unknown_score))
            out.append(here)
        return out

    def _spell(self, word: str, path: list[tuple[int, int]]) -> bytes:
        """Piece ids as int32 of a path of (start, id), first piece first."""
        out: list[int] = []
        for s, i in path:
            if i >= 0:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in word[s].encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return np.array(out, dtype=np.int32).tobytes()

    def _forward_one(self, word: str) -> tuple[float, float, bytes]:
        best, second, back = [0.0], [-_INF], [(0, 0)]
        for here in self.edges(word)[1:]:
            b = s2 = -_INF
            link = (0, 0)
            for s, i, score in here:
                v = best[s] + score
                if v > b:
                    s2 = max(b, second[s] + score)
                    b, link = v, (s, i)
                else:
                    s2 = max(s2, v)
            best.append(b)
            second.append(s2)
            back.append(link)
        path, at = [], len(word)
        while at:
            path.append(back[at])
            at = back[at][0]
        return best[-1], best[-1] - second[-1], self._spell(word, path[::-1])

    def chunks(self, text: str) -> list[str]:
        """The words of a text as keys of the cache; ``lattice`` gives the string that each stands for.

        Splitting at single spaces is the quick way; texts with runs of spaces or special characters are matched by
        a pattern, and their keys begin with U+0000.
        """
        if not text:
            return []
        if self.prefix and "  " not in text and text[0] != " " and MARK not in text and "\0" not in text:
            return text.replace("\n", " \n").split(" ")
        return ["\0" + x for x in _CHUNK.findall(self.prefix + text.replace(" ", MARK))]

    @staticmethod
    def lattice(key: str) -> str:
        return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else MARK + key

    def prepare(self, texts: list[list[str]]) -> np.ndarray:
        """The places of all words in the cache, after forward passes of those not remembered yet."""
        if len(self.cache) > self.cache_words:
            self._reset()
        base = len(self.cache)
        where = np.fromiter(map(self.cache.__getitem__, itertools.chain.from_iterable(texts)), dtype=np.int64, count=sum(map(len, texts)))
        new = list(itertools.islice(reversed(self.cache), len(self.cache) - base))[::-1]
        if not new:
            return where
        score, cost, size = np.empty(len(new)), np.empty(len(new)), np.empty(len(new), dtype=np.int64)
        start, flat, at = np.empty(len(new), dtype=np.int64), [self.flat], len(self.flat)
        by_length: dict[tuple[int, bool], list[int]] = {}
        words = [self.lattice(w) for w in new]
        for i, w in enumerate(words):
            by_length.setdefault((len(w), w[0] == "\n"), []).append(i)
        head = np.frombuffer(self._spell("\n", [(0, -1)]), dtype=np.int32)
        for (length, broken), group in by_length.items():
            for lo in range(0, len(group), 4096):
                some = group[lo : lo + 4096]
                if length > _VECTOR_LEN or len(some) < 4 or broken and length == 1:
                    got = [self._forward_one(words[i]) for i in some]
                    ids = [np.frombuffer(x, dtype=np.int32) for _, _, x in got]
                    b, c, n, ids = np.array([x for x, _, _ in got]), np.array([x for _, x, _ in got]), np.array([len(x) for x in ids]), np.concatenate(ids)
                else:
                    b, c, n, ids = self._forward([words[i][broken:] for i in some])
                    if broken:  # a line break is a character without a piece; what follows is a lattice of its own
                        ids = np.insert(ids, np.repeat(np.cumsum(n) - n, len(head)), np.tile(head, len(n)))
                        b, n = b + self.unknown_score, n + len(head)
                score[some], cost[some], size[some] = b, c, n
                start[some] = at + np.cumsum(n) - n
                at += len(ids)
                flat.append(ids)
        self.score, self.cost, self.size = np.concatenate([self.score, score]), np.concatenate([self.cost, cost]), np.concatenate([self.size, size])
        self.start, self.flat = np.concatenate([self.start, start]), np.concatenate(flat)
        return where

    # -- segmentations of a text

    def search(self, words: tuple[str, ...], n: int) -> list[tuple[float, list[np.ndarray]]]:
        """The n best paths through the chain of the words' lattices: (score, ids of each word)."""
        if (words, n) in self.found:
            return self.found[words, n]
        edges: list[list[tuple[int, int, float]]] = [[]]
        owner, start = [0], [0]  # of each position of the chain: the word, and where it begins
        for k, w in enumerate(words):
            base = len(edges) - 1
            edges += [[(s + base, i, score) for s, i, score in here] for here in self.edges(w)[1:]]
            owner += [k] * len(w)
            start += [base] * len(w)
        forward = [0.0]
        for here in edges[1:]:
            forward.append(max(forward[s] + score for s, _, score in here))
        agenda: list[tuple[float, int, int, float, tuple | None]] = [(-forward[-1], 0, len(edges) - 1, 0.0, None)]
        count, out = 1, []
        while agenda and len(out) < n:
            _, _, at, score, path = heapq.heappop(agenda)
            if at == 0:
                ids: list[list[tuple[int, int]]] = [[] for _ in words]
                while path is not None:
                    s, e, i, path = path
                    ids[owner[e]].append((s - start[e], i))
                out.append((score, [np.frombuffer(self._spell(w, x), dtype=np.int32) for w, x in zip(words, ids, strict=True)]))
                continue
            for s, i, more in edges[at]:
                heapq.heappush(agenda, (-(score + more + forward[s]), count, s, score + more, (s, at, i, path)))
                count += 1
        if sum(map(len, words)) < 200:
            if len(self.found) > 20_000:
                self.found.clear()
            self.found[words, n] = out
        return out

    def n_best(self, texts: list[list[str]], n: int) -> Iterator[list[tuple[float, np.ndarray]]]:
        """For each text, given as its words, its n best segmentations, best first, as (score, ids)."""
        ends = np.cumsum([len(t) for t in texts]).tolist()
        word = self.prepare(texts)
        size, score, cost = self.size[word], self.score[word], self.cost[word]
        to = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[word] - to + size, size) + np.arange(to[-1] if len(to) else 0)]
        lo = 0
        for chunks, hi in zip(texts, ends, strict=True):
            if lo == hi:
                yield [(0.0, np.empty(0, dtype=np.int32))]
                continue
            first, last = int(to[lo] - size[lo]), int(to[hi - 1])
            total = float(score[lo:hi].sum())
            out = [(total, ids[first:last])]
            if n > 1:
                costs = cost[lo:hi]
                near = np.argpartition(costs, n - 2)[: n - 1] if len(costs) >= n else np.arange(len(costs))
                near = sorted(near[costs[near] < _INF].tolist())
                if near:
                    base = total - float(score[lo:hi][near].sum())
                    for own, parts in self.search(tuple(self.lattice(chunks[i]) for i in near), n)[1:]:
                        pieces, at = [], first
                        for i, part in zip(near, parts, strict=True):
                            end = int(to[lo + i])
                            pieces += [ids[at : end - int(size[lo + i])], part]
                            at = end
                        out.append((base + own, np.concatenate([*pieces, ids[at:last]])))
            yield out
            lo = hi

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.text.__getitem__, ids.tolist()))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_SHARED: dict[str, Vocabulary] = {}


def _vocabulary(model: bytes) -> Vocabulary:
    """One a worker process, however many tasks it runs."""
    key = hashlib.md5(model).hexdigest()
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = Vocabulary(model)
    return _SHARED[key]


def _encoded(column: pa.Array, vocab: Vocabulary, n: int, group_bytes: int = 1 << 21) -> Iterator[tuple[str, list[tuple[float, np.ndarray]]]]:
    """(text, its n best segmentations) for each value, a group of texts at a time."""
    group: list[str] = []
    held = 0

    def flush() -> Iterator[tuple[str, list[tuple[float, np.ndarray]]]]:
        chunks = [vocab.chunks(t) for t in group]
        yield from zip(group, vocab.n_best(chunks, n), strict=True)

    for x in column:
        group.append(x.as_py() or "")
        held += len(group[-1])
        if held > group_bytes:
            yield from flush()
            group, held = [], 0
    yield from flush()


def encode(df: DataFrame, model: bytes, n_best: int = 1, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and n_tokens, token_ids (the best), and n_best: array of (score, ids), best first.

    Columns of ``df`` with these names are replaced.
    """
    new = ("n_tokens", "token_ids", "n_best")
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new])
    at = kept.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = with_fields(kept, "n_tokens int, token_ids array<int>, n_best array<struct<score:double,ids:array<int>>>")
    ids_type = pa.list_(pa.int32())
    nbest_type = pa.list_(pa.struct([("score", pa.float64()), ("ids", ids_type)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                found = [x for _, x in _encoded(b.column(at), vocab, n_best)]
                flat = lambda parts: pa.ListArray.from_arrays(np.cumsum([0] + [len(p) for p in parts], dtype=np.int32), pa.array(np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)))
                best = flat([x[0][1] for x in found])
                every = [y for x in found for y in x]
                pairs = pa.StructArray.from_arrays([pa.array([s for s, _ in every], pa.float64()), flat([i for _, i in every])], ["score", "ids"])
                nb = pa.ListArray.from_arrays(np.cumsum([0] + [len(x) for x in found], dtype=np.int32), pairs)
                fields = [pa.field("n_tokens", pa.int32()), pa.field("token_ids", ids_type), pa.field("n_best", nbest_type)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x[0][1]) for x in found], pa.int32()), best, nb.cast(nbest_type)], schema=pa.schema([*b.schema, *fields]))

    return kept.mapInArrow(run, schema)


def encode_digests(df: DataFrame, model: bytes, n_best: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score, n_segmentations, scores, ids_md5, last_md5, round_trip): what a whole corpus is compared by.

    ids_md5 and last_md5 are of the best and the n-th segmentation's ids as little-endian int32; round_trip: the
    best segmentation decodes to the text (U+2581 read as a space).
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(shared.value)
        for b in batches:
            out = []
            for text, found in _encoded(b.column("text"), vocab, n_best):
                back = text.replace(MARK, " ")
                ok = vocab.decode(found[0][1]) == back
                out.append((len(found[0][1]), found[0][0], len(found), [s for s, _ in found], hashlib.md5(found[0][1].tobytes()).hexdigest(), hashlib.md5(found[-1][1].tobytes()).hexdigest(), ok))
            kinds = [pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.float64()), pa.string(), pa.string(), pa.bool_()]
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], ["id", "n_tokens", "score", "n_segmentations", "scores", "ids_md5", "last_md5", "round_trip"])

    return rows.mapInArrow(run, f"id {kind}, n_tokens int, score double, n_segmentations int, scores array<double>, ids_md5 string, last_md5 string, round_trip boolean").withColumnRenamed("id", id_col)


def decode(df: DataFrame, model: bytes, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` (but one named as the text) and the decoded text; null ids decode to null, ids that do not exist fail."""
    keep = [c for c in df.columns if c != text_col]
    kept = df.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(ids_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(shared.value)
        for b in batches:
            texts = [None if not x.is_valid else vocab.decode(x.values.to_numpy(zero_copy_only=False)) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], schema=b.schema.append(pa.field(text_col, pa.string())))

    return kept.mapInArrow(run, with_fields(kept, f"`{text_col}` string"))
