"""Benchmark decontamination by spaced seeds.

Both texts become words: A-Z lower-cased, ASCII punctuation read as white space. A fixed mask says which positions of
a window of words count and which are ignored, so a seed still matches where an ignored word was substituted. The masks
have weight 6 and together lose nothing at the default rule: wherever 13 or more words (11 or 12, if the item has no more)
are at least 75 % equal, one of them hits. A laxer rule finds what has a hit. Seeds of
the test items and of the documents are joined on their hashes; each hit fixes a diagonal, on which the item and the
document are compared word by word: the overlap is extended to both sides of the hit while a match counts 1, a
substitution -2, and the best-scoring extent is kept. What such extents leave of the diagonal is searched for every other
overlap, longest first, that begins and ends with an equal word; a whole item may also have substitutions at its ends. A document is contaminated if an overlap has at least
min(``min_words``, words of the item) words, of which at least ``min_identity`` are equal. Items shorter than the masks
are looked for as exact runs, of all lengths that occur.

Items of at most ``block_bytes`` of text together are broadcast as an index of their seeds, and the documents pass it once, with no shuffle.
Where there are more, nothing that grows with them is: the seeds are a table, and documents emit those seeds that a bitmap of fixed size
(2^``filter_bits``) lets through. Joined on the hash, these say which blocks of about ``block_bytes`` of items a document, and which blocks of about ``CELL_DOCS`` documents an item has to be sent to.
Each such cell is done as the broadcast is: an index of its items, which its documents pass one after the other. So a passage that many documents
and many items share makes no rows of both, but those of its overlaps. Equal texts are compared once there. Both ways give the same rows. Every window of every text is looked up.

The diagonals of a hash that stands in many places of a document and an item are taken from a convolution, not from their pairs, and all hits of
a diagonal are judged from two running extremes of its prefix sums, so repeated words cost no more than the diagonals that they have.

Defined results: null and empty texts have no overlaps; null or empty items, and items with a null id, match nothing; each
(item, diagonal) gives one overlap however many seeds hit it; repeated rows are judged alike; empty tables give no overlaps or no rows; other columns of
the documents are kept, whatever their names, except one that has the name of the added one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._filter import bitmap, may_hold
from ._store import fresh, stage, with_fields
from ._words import hash_words, mix, splitmix

#: Found greedily: one of them fits every pattern of at least min(13, words of the item) words that are at least 75 % equal.
MASKS = ("1101111", "111010011", "1110001011", "10111011", "11001100011", "10100011011", "100101111", "1110010101", "1010011011", "111111")
#: Places and seeds of one hash that are paired; beyond it their differences come from a convolution.
PAIRS = 1 << 16
#: Documents that pass one index of items, where these are a table.
CELL_DOCS = 256
_TO_WORDS = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i + 32 if 65 <= i <= 90 else i for i in range(256))
_COEFF = splitmix(64, 91) | np.uint64(1)
HITS = "array<struct<item_id:long,item_start:int,doc_start:int,n_words:int,n_equal:int,item_words:int>>"
_HIT = pa.struct([("item_id", pa.int64()), *((n, pa.int32()) for n in ("item_start", "doc_start", "n_words", "n_equal", "item_words"))])


def tokens(text: str | None) -> np.ndarray:
    return hash_words((text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS))


def seed_hashes(words: np.ndarray, positions: list[int], salt: int) -> np.ndarray:
    """The hash of every window of the words at the mask's positions."""
    n = len(words) - positions[-1]
    if n <= 0:
        return words[:0]
    out = np.full(n, np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    for k, p in enumerate(positions):
        out += words[p : p + n] * _COEFF[k]
    return mix(out)


def qualifying(equal: np.ndarray, need: int, identity: float) -> list[tuple[int, int]]:
    """The longest extent of ``need`` words or more that begins and ends with an equal word and is equal enough; then those beside it."""
    out, todo = [], [(0, len(equal))]
    while todo:
        a, b = todo.pop()
        at = a + np.flatnonzero(equal[a:b])
        if b - a < need or not len(at):
            continue
        k = np.arange(len(at))
        before, after = k - identity * at, k + 1 - identity * (at + 1)  # equal words less those required, up to each equal word and with it
        first = np.minimum(np.searchsorted(-np.minimum.accumulate(before), -after - 1e-9), k)  # the earliest begin for each end
        size = at + 1 - at[first]
        e = int(size.argmax())
        if size[e] >= need:
            begin, end = int(at[first[e]]), int(at[e]) + 1
            out.append((begin, end))
            todo += [(a, begin), (end, b)]
    return out


SPAN = max(map(len, MASKS))
_POSITIONS = [[k for k, c in enumerate(m) if c == "1"] for m in MASKS]


def masks_of(n: int) -> list[tuple[int, list[int]]]:
    """(salt, positions) of the masks for an item of n words: the run of all its words if it is shorter than the masks."""
    return list(enumerate(_POSITIONS)) if n >= SPAN else [(len(MASKS) + n, list(range(n)))]


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct x - y of two sets of numbers from 0."""
    if len(a) * len(b) <= 1 << 16:
        return np.unique(a[:, None] - b)
    low, high = int(a.min()), int(b.max())
    x, y = np.zeros(int(a.max()) - low + 1), np.zeros(high - int(b.min()) + 1)
    x[a - low] = 1
    y[high - b] = 1
    size = len(x) + len(y) - 1
    n = 1 << (size - 1).bit_length()
    return np.flatnonzero(np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(y, n), n)[:size] > 0.5) + low - high


def judge(x: np.ndarray, w: np.ndarray, diagonal: int, min_words: int, min_identity: float, rest: bool) -> list[tuple[int, int, int]]:
    """(begin, end, equal words) of the accepted extents of an item's words on a diagonal of a document's."""
    first, last = max(0, -diagonal), min(len(x), len(w) - diagonal)
    equal = x[first:last] == w[first + diagonal : last + diagonal]
    n, need = len(equal), min(min_words, len(x))
    if equal.all():
        return [(first, last, n)] if n >= need else []
    hit = np.zeros(n, dtype=bool)
    for _, positions in masks_of(len(x)):
        m = n - positions[-1]
        if m > 0:
            all_equal = equal[:m].copy()
            for p in positions[1:]:
                all_equal &= equal[p : p + m]
            hit[:m] |= all_equal
    hits = np.flatnonzero(hit)
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    place = np.arange(n)
    back = total[:0:-1]  # for each place the end after it with the largest sum, of equals the first
    ends = n - np.maximum.accumulate(np.where(back == np.maximum.accumulate(back), place, 0))[::-1]
    ahead = total[:n]  # and the begin up to it with the smallest, of equals the last
    begins = np.maximum.accumulate(np.where(ahead == np.minimum.accumulate(ahead), place, 0))
    same = np.concatenate([[0], np.cumsum(equal)])
    covered, extents, k = 0, [], 0
    while (k := k + int(np.searchsorted(hits[k:], covered))) < len(hits):
        j = int(hits[k])
        begin, covered = int(begins[j]), int(ends[j])
        if covered - begin >= need and same[covered] - same[begin] >= min_identity * (covered - begin):
            extents.append((begin, covered))
    if rest and len(hits) and same[n] >= min_identity * need:
        at, more = 0, []
        for begin, end in [*sorted(extents), (n, n)]:  # what lies between those accepted
            if begin > at:
                more += [(at + p, at + q) for p, q in qualifying(equal[at:begin], need, min_identity)]
            at = max(at, end)
        extents += more
        if not extents and n == len(x) and same[n] >= min_identity * n:
            extents.append((0, n))
    return [(b + first, e + first, int(same[e] - same[b])) for b, e in extents]


@dataclass
class SeedIndex:
    """The seeds of some items."""

    ids: list[int]
    words: list[np.ndarray]
    masks: list[tuple[int, list[int]]]
    keys: np.ndarray  # sorted, one for each seed
    item: np.ndarray
    start: np.ndarray
    maybe: np.ndarray | None

    @classmethod
    def of(cls, items: Iterable[tuple[int, str]], bitmap: bool = True) -> SeedIndex:
        ids, words = [], []
        for i, text in items:
            w = tokens(text)
            if len(w):
                ids.append(i)
                words.append(w)
        keys, item, start, masks = [], [], [], {}
        for at, w in enumerate(words):
            for salt, positions in masks_of(len(w)):
                masks[salt] = positions
                h = seed_hashes(w, positions, salt)
                keys.append(h)
                item.append(np.full(len(h), at))
                start.append(np.arange(len(h)))
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, dtype=kind)
        keys, item, start = join(keys, np.uint64), join(item, np.int32), join(start, np.int32)
        order = np.argsort(keys, kind="stable")
        maybe = None
        if bitmap:
            maybe = np.zeros(1 << 20, dtype=bool)
            maybe[keys >> np.uint64(44)] = True
        return cls(ids, words, sorted(masks.items()), keys[order], item[order], start[order], maybe)

    def diagonals(self, w: np.ndarray) -> dict[int, np.ndarray]:
        """The diagonals with a hit, by item."""
        found: dict[int, list[np.ndarray]] = {}
        codes = []  # item and diagonal in one number
        for salt, positions in self.masks:
            h = seed_hashes(w, positions, salt)
            at = np.flatnonzero(self.maybe[h >> np.uint64(44)]) if self.maybe is not None else np.arange(len(h))
            lo = np.searchsorted(self.keys, h[at])
            known = lo < len(self.keys)
            known[known] = self.keys[lo[known]] == h[at[known]]
            at, lo = at[known], lo[known]
            if not len(at):
                continue
            order = np.argsort(lo, kind="stable")
            at, lo = at[order], lo[order]
            firsts, places = np.unique(lo, return_counts=True)
            size = np.searchsorted(self.keys, self.keys[firsts], side="right") - firsts
            many = places * size > PAIRS
            width = np.repeat(np.where(many, 0, size), places)
            for rows in np.array_split(np.arange(len(at)), max(1, int(width.sum()) // (16 * PAIRS))):  # every place with every seed of its hash
                k = np.repeat(rows, width[rows])
                step = np.arange(len(k)) - np.repeat(np.cumsum(width[rows]) - width[rows], width[rows])
                entry = lo[k] + step
                codes.append(np.unique((self.item[entry].astype(np.int64) << 33) + (at[k] - self.start[entry] + (1 << 32))))
            begins = np.cumsum(places) - places
            for g in np.flatnonzero(many).tolist():
                a, b = int(firsts[g]), int(firsts[g] + size[g])
                items, starts = self.item[a:b], self.start[a:b]
                edges = [0, *(np.flatnonzero(items[1:] != items[:-1]) + 1).tolist(), b - a]
                for p, q in zip(edges, edges[1:], strict=False):
                    found.setdefault(int(items[p]), []).append(differences(at[begins[g] : begins[g] + places[g]], starts[p:q]))
        if codes:
            code = np.unique(np.concatenate(codes))
            items = code >> 33
            cuts = np.flatnonzero(items[1:] != items[:-1]) + 1
            for i, part in zip(items[np.concatenate([[0], cuts])].tolist() if len(code) else [], np.split((code & ((1 << 33) - 1)) - (1 << 32), cuts), strict=False):
                found.setdefault(i, []).append(part)
        return {i: np.unique(np.concatenate(d)) if len(d) > 1 else d[0] for i, d in found.items()}

    def overlaps(self, text: str | None | np.ndarray, min_words: int, min_identity: float, rest: bool = False) -> list[dict]:
        """The accepted best extents of the hits; with ``rest`` also the overlaps that these leave on the hits' diagonals."""
        w = text if isinstance(text, np.ndarray) else tokens(text)
        done = []
        for item, diagonals in self.diagonals(w).items():
            for d in diagonals.tolist():
                for begin, end, same in judge(self.words[item], w, d, min_words, min_identity, rest):
                    done.append({"item_id": self.ids[item], "item_start": begin, "doc_start": begin + d, "n_words": end - begin, "n_equal": same, "item_words": len(self.words[item])})
        return sorted(done, key=_place)


def _place(hit: dict) -> tuple[int, int, int, int]:
    return hit["item_id"], hit["doc_start"], hit["item_start"], hit["item_words"]


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", hits_col: str = "overlaps",
    min_words: int = 13, min_identity: float = 0.75, block_bytes: int = 1 << 20, filter_bits: int = 27,
) -> DataFrame:
    """All columns of the documents and their overlaps (HITS), empty if there are none."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).filter("item_id is not null and text is not null").distinct()
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != hits_col])
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > block_bytes:
        return _joined(kept, items, text_col, hits_col, min_words, min_identity, max(block_bytes, 1), total, filter_bits)
    index = SeedIndex.of(sorted((r["item_id"], r["text"]) for r in items.collect()))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.overlaps(t.as_py(), min_words, min_identity, rest=True) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(_HIT))], schema=b.schema.append(pa.field(hits_col, pa.list_(_HIT))))

    return kept.mapInArrow(run, with_fields(kept, f"`{hits_col}` {HITS}"))


def _seeds(items: DataFrame) -> DataFrame:
    """(key, item): the distinct seeds of items (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in zip(b.column("item").to_pylist(), b.column("text"), strict=True):
                keys = np.unique(SeedIndex.of([(0, text.as_py())], bitmap=False).keys).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), i, dtype=np.int64))], ["key", "item"])

    return items.select("item", "text").mapInArrow(run, "key long, item long")


def _joined(docs: DataFrame, items: DataFrame, text_col: str, hits_col: str, min_words: int, min_identity: float, block_bytes: int, total: int, filter_bits: int) -> DataFrame:
    """The same for any number of items: documents and items that share a seed are dealt into cells, and each cell is done as above, with an index of its items."""
    spark = docs.sparkSession
    n_blocks = -(-total // block_bytes)
    items = items.withColumn("item", F.xxhash64("item_id", "text")).withColumn("iblock", F.pmod("item", F.lit(n_blocks)).cast("int"))
    seeds, _ = stage(_seeds(items).withColumn("iblock", F.pmod("item", F.lit(n_blocks)).cast("int")), "seeds")
    shared = spark.sparkContext.broadcast(bitmap(seeds, filter_bits))
    masks = [*enumerate(_POSITIONS), *(masks_of(n)[0] for n in range(1, SPAN))]
    text = F.col(f"`{text_col}`")
    texts = docs.filter(text.isNotNull()).select(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(3), text).alias("h2"), text.alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h1, h2, t in zip(b.column("h1").to_pylist(), b.column("h2").to_pylist(), b.column("text"), strict=True):
                w = tokens(t.as_py())
                keys = np.unique(np.concatenate([seed_hashes(w, positions, salt) for salt, positions in masks]))
                keys = keys[may_hold(shared.value, filter_bits, keys)].view(np.int64)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.full(len(keys), h, dtype=np.int64)) for h in (h1, h2))], ["key", "h1", "h2"])

    found, _ = stage(texts.mapInArrow(emit, "key long, h1 long, h2 long").distinct().join(seeds, "key", "left_semi"), "seed-hits")
    n_docs = found.agg(F.approx_count_distinct("h1")).first()[0]
    dblock = F.pmod("h1", F.lit(max(1, n_docs // CELL_DOCS))).alias("dblock")
    # of a seed that many share: blocks by items and documents by blocks, never documents by items
    cell_items = found.select("key", dblock).distinct().join(seeds.select("key", "item"), "key").select("dblock", "item").distinct()
    cell_docs = found.join(seeds.select("key", "iblock").distinct(), "key").select("h1", "h2", dblock, "iblock").distinct()
    first = texts.join(found.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("text").alias("text"))
    none = F.lit(None).cast("long")
    rows = cell_items.join(items, "item").select("dblock", "iblock", "item_id", none.alias("h1"), none.alias("h2"), "text")
    rows = rows.unionByName(cell_docs.join(first, ["h1", "h2"]).select("dblock", "iblock", none.alias("item_id"), "h1", "h2", "text"))
    rows = rows.repartition("dblock", "iblock").sortWithinPartitions("dblock", "iblock", F.col("item_id").asc_nulls_last(), "text")  # a cell's items come first

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, index = None, [], None
        for b in batches:
            for dblock, iblock, item, h1, h2, text in zip(*(b.column(c).to_pylist() for c in ("dblock", "iblock", "item_id", "h1", "h2")), b.column("text"), strict=True):
                if (dblock, iblock) != cell:
                    cell, held, index = (dblock, iblock), [], None
                if item is not None:
                    held.append((item, text.as_py()))
                    continue
                if index is None:
                    index, held = SeedIndex.of(held), []
                if hits := index.overlaps(text.as_py(), min_words, min_identity, rest=True):
                    yield pa.RecordBatch.from_arrays([pa.array([h1]), pa.array([h2]), pa.array([hits], pa.list_(_HIT))], ["h1", "h2", "hits"])

    f1, f2, hits = fresh(docs.columns, "f1", "f2", "hits")
    place = ["item_id", "doc_start", "item_start", "item_words", "n_words", "n_equal"]  # the order of _place
    ordered = F.array_sort(F.flatten(F.collect_list(F.transform("hits", lambda h: F.struct(*[h[c].alias(c) for c in place])))))
    parts = rows.mapInArrow(compare, f"h1 long, h2 long, hits {HITS}").groupBy("h1", "h2").agg(ordered.alias("hits"))
    result, _ = stage(parts.select(F.col("h1").alias(f1), F.col("h2").alias(f2), F.transform("hits", lambda h: F.struct(*[h[c].alias(c) for c in _HIT.names])).cast(HITS).alias(hits)), "overlaps")
    keyed = docs.withColumns({f1: F.xxhash64(text), f2: F.xxhash64(F.lit(3), text)})
    return keyed.join(result, [f1, f2], "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(hits), F.array().cast(HITS)).alias(hits_col))
