"""Phrase collocations by suffix sorting (Suffix-sigma).

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``. In each language

1. words are counted, combined before the shuffle. A phrase with a word, or a beginning of up to ``LONGEST`` words, that has fewer than ``min_count`` occurrences has fewer itself, so
   suffixes are cut there. Which words are frequent the tasks read from a bitmap of at most 2^``filter_bits`` bits. Phrases of up to ``LONGEST`` words are counted in at most
   2^``filter_bits`` hashed counters, which a task keeps as bytes; what they add up to says which are rare. What either filter lets through besides costs time only.
   The most frequent words (32,509 at most) are written as short numbers.
2. each word begins a suffix of its piece, of ``max_n`` words at most. Equal suffixes of a task are combined, then shuffled by language and
   first word. First words that make up more than 1/``HOT`` of all words (fewer than ``HOT``, by counting) would be too much for a task: their
   suffixes are dealt by the words up to and with the first that isn't one of them, and what only such words make up is summed afterwards.
3. each partition is sorted in reverse lexicographic order and read once with one stack, which holds the count of every prefix of the
   current suffix; a prefix that the next suffix doesn't share is complete. It is done for a batch at a time, and the stack goes from batch to batch.
4. parts are joined afterwards: each candidate's cuts with the counts of both sides. With counts a, l, r and n words in all a cut scores
   floor(1000 a n / (l r)), in decimals of 38 digits; the lowest counts, of equals the shortest first part.
5. candidates that lie inside a longer one with at least ``inside_percent`` of their count go. Phrases between the two in length are in the longer one too and
   at least as frequent as it, so looking one word further is enough.

Defined results: null texts are empty ones, null languages are ``und``; empty texts and tables give no rows; words may hold any bytes but the
separators (bytes under 0x02 are escaped inside); texts of any length are read whole, in windows that overlap by max_n - 1 words; repeated rows count as often as they stand
there; equal scores go to the larger count, then to the phrase that is first in byte order; other columns take no part, whatever their names. 1000 a n must have 38 digits or fewer.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._filter import bitmap, may_hold
from ._store import drop, stage
from ._words import hash_words, mix, splitmix

#: First words with more than this share of all words are split.
HOT = 4096
#: Bytes of text that are taken together; fewer than 2^21 distinct words.
CHUNK = 4 << 20
#: Phrases of up to so many words are counted beforehand, to cut suffixes at rare ones.
LONGEST = 2
#: The most frequent words are written as numbers of one or two bytes (codes have no bytes under 3); others are spelled, after a byte 2.
ONE_BYTE, TWO_BYTES = 125, 128 * 253
#: Suffixes that a task combines at a time.
HELD = 1 << 20
#: Hashed counters that are added up together.
RANGE = 1 << 16
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", 10, 11, 12, 13]] = 2
_GAP = re.compile(rb"[\x20\t.,;:!?\n-\r]")
_WORD = re.compile(rb"[^\x20\t.,;:!?\n-\r]+")
_SALT = splitmix(8, 5) | np.uint64(1)
SEP = b"\0"


def code(rank: int) -> bytes:
    """The number of a word, by its rank."""
    if rank < ONE_BYTE:
        return bytes([131 + rank])
    first, second = divmod(rank - ONE_BYTE, 253)
    return bytes([3 + first, 3 + second])


def escaped(text: bytes) -> bytes:
    """The text without the bytes 0 and, but for escapes, 1; the order of texts stays."""
    return text.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1") if b"\0" in text or b"\1" in text else text


def windows(text: bytes, size: int, ahead: int) -> Iterator[tuple[bytes, int]]:
    """(part, limit): parts of a text cut between words, each with the words ahead of it; those that begin before the limit are its own."""
    at = 0
    while len(text) - at > size and (gap := _GAP.search(text, at + size)):
        to = end = gap.start()
        for _, m in zip(range(ahead), _WORD.finditer(text, to), strict=False):
            end = m.end()
        yield text[at:end], to - at
        at = to
    yield text[at:] if at else text, len(text) - at


@dataclass
class Words:
    """The words of some texts, in order."""

    words: pa.Array  # distinct
    ids: np.ndarray
    lang: np.ndarray
    piece: np.ndarray
    own: np.ndarray  # not one that is only read ahead
    langs: list[bytes]

    @classmethod
    def of(cls, parts: list[tuple[bytes, bytes, int]]) -> Words:
        """Of (language, text, limit)."""
        langs = sorted({p[0] for p in parts})
        data = np.frombuffer(b"\n".join(p[1] for p in parts), dtype=np.uint8)
        kind = _CLASS[data]
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = kind == 0
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        begins = np.cumsum([0, *(len(p[1]) + 1 for p in parts[:-1])])
        part = np.searchsorted(begins, start, side="right") - 1
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside[1:-1]]))]).dictionary_encode()
        own = start < (begins + np.array([p[2] for p in parts]))[part]
        number = {name: i for i, name in enumerate(langs)}
        lang = np.array([number[p[0]] for p in parts], dtype=np.int64)[part]
        return cls(words.dictionary, words.indices.to_numpy().astype(np.int64), lang, np.cumsum(kind == 2)[start], own, langs)

    def keys(self) -> np.ndarray:
        """The hash of each distinct word in each language."""
        return np.stack([word_keys(lang, self.words) for lang in self.langs])

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, word, n) of what stands there."""
        keys, n = np.unique(self.lang[self.own] * len(self.words) + self.ids[self.own], return_counts=True)
        return keys // max(len(self.words), 1), keys % max(len(self.words), 1), n


def word_keys(lang: bytes, words: list[bytes] | pa.Array) -> np.ndarray:
    """The hash of each word in its language."""
    listed = words if isinstance(words, list) else words.to_pylist()
    (salt,) = hash_words(lang.replace(b" ", b"\2") + b"\2l")[:1]
    return mix(hash_words(b" ".join(listed)) * _SALT[7] + salt)


def _read(batches: Iterator[pa.RecordBatch], ahead: int) -> Iterator[Words]:
    held, size = [], 0
    for b in batches:
        for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
            lang, text = escaped(lang.as_py()), escaped(text.as_py()).lower()
            for part, limit in windows(text, CHUNK, ahead):
                if held and size + len(part) > CHUNK:
                    yield Words.of(held)
                    held, size = [], 0
                held.append((lang, part, limit))
                size += len(part) + 1
    if held:
        yield Words.of(held)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of texts (lang, text: both binary)."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _read(batches, 0):
            lang, word, n = w.counts()
            yield pa.RecordBatch.from_arrays([pa.array(w.langs, pa.binary()).take(pa.array(lang)), w.words.take(pa.array(word)), pa.array(n)], ["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(chunks(batches), ["lang", "word"])

    return texts.mapInArrow(run, "lang binary, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def frequent_keys(counts: DataFrame) -> DataFrame:
    """(key): the hashes of words (lang, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed: dict[bytes, list[bytes]] = {}
            for lang, word in zip(b.column("lang").to_pylist(), b.column("word").to_pylist(), strict=True):
                listed.setdefault(lang, []).append(word)
            for lang, words in listed.items():
                yield pa.RecordBatch.from_arrays([pa.array(word_keys(lang, words).view(np.int64))], ["key"])

    return counts.select("lang", "word").mapInArrow(run, "key long")


@dataclass
class Frequent:
    """What tasks know of the corpus: bitmaps of frequent words and phrases, the words that have codes, and the hot words by language."""

    words: np.ndarray
    word_bits: int
    phrases: np.ndarray | None
    phrase_bits: int
    longest: int
    top: list[bytes]
    hot: dict[bytes, list[bytes]]

    def grams(self, w: Words, hashes: np.ndarray, max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1, 2, ... max_n words: whether as many from each place on are one piece's and may all be frequent, and their hash."""
        mine = hashes[w.lang, w.ids]
        kept = may_hold(self.words, self.word_bits, mine)
        alive, key = kept, mine
        yield alive, key
        for j in range(1, max_n):
            longer, both = np.zeros(len(kept), dtype=bool), mix(key * _SALT[5])
            if j < len(kept):
                longer[:-j] = alive[:-j] & kept[j:] & (w.piece[j:] == w.piece[:-j])
                both[:-j] += mine[j:] * _SALT[6]
            key = mix(both)
            if self.phrases is not None and j < self.longest:
                longer[longer] = may_hold(self.phrases, self.phrase_bits, key[longer])
            alive = longer
            yield alive, key


def _width(cap: int) -> int:
    return 1 if cap < 1 << 8 else 4


def _ranges(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """Ranges of counters, compressed: most are 0."""
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([zlib.compress(r[1].tobytes(), 6) for r in rows], pa.binary())], ["at", "counts"])


def frequent_phrases(texts: DataFrame, known: Frequent, min_count: int, bits: int) -> np.ndarray:
    """The bitmap of 2^bits hashed counters of pairs that reach min_count. Tasks count in bytes up to a cap; ranges of counters are added up in two steps."""
    cap = min_count
    kind = f"u{_width(cap)}"
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, dtype=kind)
        for w in _read(batches, known.longest - 1):
            for j, (alive, key) in enumerate(shared.value.grams(w, w.keys(), known.longest)):
                if j:
                    at, n = np.unique((key[alive & w.own] >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
                    held[at] = np.minimum(held[at].astype(np.int64) + n, cap)
        for at in range(0, len(held), RANGE):
            part = held[at : at + RANGE]
            if part.any():
                yield _ranges([(at // RANGE, part)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total = None, None
        for b in batches:  # sorted by range
            for at, counts in zip(b.column("at").to_pylist(), b.column("counts"), strict=True):
                part = np.frombuffer(zlib.decompress(counts.as_buffer()), dtype=kind)
                if at == here:
                    total = np.minimum(total + part, cap)
                    continue
                if here is not None:
                    yield _ranges([(here, total.astype(kind))])
                here, total = at, part.astype(np.int64)
        if here is not None:
            yield _ranges([(here, total.astype(kind))])

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in add(batches):
            (part,) = b.column("counts").to_pylist()
            full = np.frombuffer(zlib.decompress(part), dtype=kind) >= cap
            if full.any():
                yield pa.RecordBatch.from_arrays([b.column("at"), pa.array([np.packbits(full).tobytes()], pa.binary())], ["at", "counts"])

    ddl = "at int, counts binary"
    parts = texts.mapInArrow(count, ddl).withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(64)))
    parts = parts.repartition("at", "slot").sortWithinPartitions("at").select("at", "counts").mapInArrow(add, ddl)
    parts = parts.repartition("at").sortWithinPartitions("at").mapInArrow(reached, ddl)
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in parts.toLocalIterator():  # 2^bits / 8 bytes at most
        out[r["at"] * RANGE // 8 :][: len(r["counts"])] = np.frombuffer(r["counts"], dtype=np.uint8)
    return out


def chunk_suffixes(w: Words, known: Frequent, max_n: int) -> pa.RecordBatch:
    """(key, head, n_hot): the distinct suffixes of a chunk, the bytes of each key that it is dealt by, and in one number its count and, in three bits, its hot words at the beginning."""
    hashes = w.keys()
    is_hot = np.stack([pc.is_in(w.words, value_set=pa.array(known.hot.get(lang, []), pa.binary())).to_numpy(zero_copy_only=False) for lang in w.langs])
    columns = []
    for j, (alive, _) in enumerate(known.grams(w, hashes, max_n)):  # the word at distance j, from 1; 0 where the piece has ended
        columns.append(np.where(alive, np.concatenate([w.ids[j:], np.zeros(min(j, len(w.ids)), dtype=np.int64)]) + 1, 0))
    rows = np.flatnonzero((columns[0] > 0) & w.own)
    packed = [w.lang[rows], *(c[rows] for c in columns)]
    keys = []
    for at in range(0, len(packed), 3):  # three fields of 21 bits
        key = packed[at]
        for c in packed[at + 1 : at + 3]:
            key = key << 21 | c
        keys.append(key)
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), dtype=bool)
    fresh[:1] = True
    for key in keys:
        fresh[1:] |= key[order[1:]] != key[order[:-1]]
    starts = np.flatnonzero(fresh)
    n = np.diff(np.concatenate([starts, [len(order)]]))
    first = order[starts]
    lang, ids = packed[0][first], [c[first] - 1 for c in packed[1:]]
    leading, open_ = np.zeros(len(first), dtype=np.int64), np.ones(len(first), dtype=bool)
    for c in ids:
        open_ &= c >= 0
        open_[open_] = is_hot[lang[open_], c[open_]]
        leading += open_
    names = pa.array(w.langs, pa.binary()).take(pa.array(lang))
    rank = pc.index_in(w.words, value_set=pa.array(known.top, pa.binary()))
    codes = pa.array([code(i) for i in range(len(known.top))], pa.binary())
    words = pc.coalesce(codes.take(rank), pc.binary_join_element_wise(pa.scalar(b"\2", pa.binary()), w.words, pa.scalar(b"", pa.binary())))
    texts = [words.take(pa.array(c, mask=c < 0)) for c in ids]
    key = pc.binary_join_element_wise(names, *texts, pa.scalar(SEP, pa.binary()), null_handling="skip")
    # the head, in bytes: all words up to and with the first that isn't hot
    size = pc.binary_length(words).to_numpy().astype(np.int64) if len(words) else np.empty(0, dtype=np.int64)
    head = pc.binary_length(names).to_numpy().astype(np.int64)
    for j, c in enumerate(ids):
        head += np.where((c >= 0) & (leading >= j), size[c] + 1, 0) if len(size) else 0
    return pa.RecordBatch.from_arrays([key, pa.array(head.astype(np.int32)), pa.array(n.astype(np.int64) << 3 | np.minimum(leading, 7))], ["key", "head", "n_hot"])


def added(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds up ``n`` of equal rows of several chunks, ``HELD`` rows at a time, and sorts them: neighbours share their beginnings, which compresses well."""
    held, size = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).group_by(by).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select([*by, "n"])
        return iter(table.sort_by([(c, "ascending") for c in by]).to_batches(max_chunksize=1 << 16))

    for b in batches:
        held.append(b)
        size += len(b)
        if size >= HELD:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def combined(suffixes: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up equal suffixes of several chunks."""

    def apart() -> Iterator[pa.RecordBatch]:
        for b in suffixes:
            n_hot = b.column("n_hot")
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("head"), pc.bit_wise_and(n_hot, 7), pc.shift_right(n_hot, 3)], ["key", "head", "hot", "n"])

    for b in added(apart(), ["key", "head", "hot"]):
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("head"), pc.bit_wise_or(pc.shift_left(b.column("n"), 3), b.column("hot"))], ["key", "head", "n_hot"])


class PrefixStack:
    """Counts all prefixes of keys that come in reverse lexicographic order: one open prefix for each number of words."""

    def __init__(self, max_n: int, min_count: int):
        self.min_count, self.last = min_count, []
        self.open = [[b"", 0, False] for _ in range(max_n)]  # key, count, whether it is a part of one that other partitions share

    def _close(self, level: int, out: list[tuple[bytes, int]]) -> None:
        key, n, shared = self.open[level]
        if n and (n >= self.min_count or shared):
            out.append((key, n))

    def add(self, keys: pa.Array, hot: np.ndarray, n: np.ndarray) -> list[tuple[bytes, int]]:
        """The prefixes that these rows complete."""
        out: list[tuple[bytes, int]] = []
        if not len(keys):
            return out
        split = pc.split_pattern(keys, SEP)
        at = split.offsets.to_numpy().astype(np.int64)
        at, words = at - at[0], split.flatten()
        ids = words.dictionary_encode().indices.to_numpy()
        width = np.diff(at)
        same = np.ones(len(keys), dtype=bool)  # as the row before, so far
        head = words.slice(0, int(width[0])).to_pylist()
        for level in range(-1, len(self.open)):
            has = width > level + 1
            here = np.where(has, ids[np.minimum(at[:-1] + level + 1, len(ids) - 1)], -1)
            same[1:] &= has[1:] & (here[1:] == here[:-1])
            same[0] = same[0] and len(head) > level + 1 and self.last[level + 1 : level + 2] == [head[level + 1]]
            if level < 0:
                continue
            total = np.concatenate([[0], np.cumsum(np.where(has, n, 0))])
            starts = np.flatnonzero(has & ~same)
            ends = np.concatenate([starts[1:], [len(keys)]]) if len(starts) else starts
            self.open[level][1] += int(total[starts[0]] if len(starts) else total[-1])
            if not len(starts):
                continue
            self._close(level, out)
            sums, shared = total[ends] - total[starts], hot[starts] > level
            name = lambda row, level=level: SEP.join(keys[int(row)].as_py().split(SEP)[: level + 2])
            out += [(name(starts[i]), int(sums[i])) for i in np.flatnonzero((sums[:-1] >= self.min_count) | shared[:-1])]
            self.open[level] = [name(starts[-1]), int(sums[-1]), bool(shared[-1])]
        self.last = keys[len(keys) - 1].as_py().split(SEP)
        return out

    def end(self) -> list[tuple[bytes, int]]:
        out: list[tuple[bytes, int]] = []
        for level in range(len(self.open)):
            self._close(level, out)
        return out


def phrase_counts(texts: DataFrame, counts: DataFrame, total: int, min_count: int, max_n: int, filter_bits: int) -> DataFrame:
    """(key, f): the phrases of 1 to max_n words with f >= min_count; a key is the language and the words, joined by SEP."""
    spark = texts.sparkSession
    hot: dict[bytes, list[bytes]] = {}
    for r in counts.filter(F.col("n") > total // HOT).select("lang", "word").collect():  # fewer than HOT
        hot.setdefault(bytes(r["lang"]), []).append(bytes(r["word"]))
    frequent = counts.filter(F.col("n") >= min_count)
    bits = lambda n: min(max(int(n).bit_length(), 16), filter_bits)
    top = [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "lang", "word").limit(ONE_BYTE + TWO_BYTES).select("word").collect()]
    top = list(dict.fromkeys(top))
    word_bits, phrase_bits = bits(frequent.count() * 64), bits(total // 8)
    known = Frequent(bitmap(frequent_keys(frequent), word_bits), word_bits, None, phrase_bits, min(LONGEST, max_n), top, hot)
    known.phrases = frequent_phrases(texts, known, min_count, phrase_bits)
    shared = spark.sparkContext.broadcast(known)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return combined(chunk_suffixes(w, shared.value, max_n) for w in _read(batches, max_n - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = PrefixStack(max_n, min_count)
        of_code = {code(i): word for i, word in enumerate(shared.value.top)}

        def spelled(key: bytes) -> bytes:
            lang, *words = key.split(SEP)
            return SEP.join([lang, *(w[1:] if w[:1] == b"\2" else of_code[w] for w in words)])

        of = lambda rows: pa.RecordBatch.from_arrays([pa.array([spelled(r[0]) for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], ["key", "f"])
        for b in batches:
            n = b.column("n_hot").to_numpy()
            yield of(stack.add(b.column("key"), n & 7, n >> 3))
        yield of(stack.end())

    suffixes = texts.mapInArrow(emit, "key binary, head int, n_hot long")
    dealt = suffixes.repartition(F.substring("key", F.lit(1), F.col("head"))).select("key", "n_hot").sortWithinPartitions(F.col("key").desc())
    return dealt.mapInArrow(count, "key binary, f long").groupBy("key").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)


def _words(n: F.Column) -> F.Column:
    """The first n words of a phrase, the last -n if it is negative."""
    return F.call_function("substring_index", F.col("phrase"), F.lit("\0"), n)


def _unescaped(c: F.Column) -> F.Column:
    return F.replace(F.replace(c, F.lit("\1\1"), F.lit("\0")), F.lit("\1\2"), F.lit("\1"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = 100, max_n: int = 5, top: int = 2000, inside_percent: int = 100, filter_bits: int = 27) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to max_n words."""
    if not 2 <= max_n <= 7:
        raise ValueError("max_n is 2 to 7")
    text, lang = F.col(f"`{text_col}`"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    texts = docs.filter(F.length(text) > 0).select(lang.cast("binary").alias("lang"), text.cast("binary").alias("text"))
    counts, counts_path = stage(word_counts(texts), "word-counts")
    by_lang = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = phrase_counts(texts, counts, total, max(min_count, 1), max_n, filter_bits)
    key = F.col("key").cast("string")
    sep = F.lit("\0")
    at = F.position(sep, key)
    found, found_path = stage(found.select(F.substring(key, F.lit(1), at - 1).alias("lang"), F.substring(key, at + 1, F.length(key)).alias("phrase"), "f"), "phrases")
    words = F.size(F.split("phrase", "\0", -1))

    cuts = found.withColumn("m", words).filter("m > 1").join(by_lang.select(F.col("lang").cast("string").alias("lang"), "n"), "lang").withColumn("k", F.explode(F.expr("sequence(1, m - 1)")))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "n", "k", _words(F.col("k")).alias("first"), _words(F.col("k") - F.col("m")).alias("rest"))
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(1000 as decimal(4, 0)) * (cast(a as decimal(19, 0)) * cast(n as decimal(19, 0)))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    # what a phrase lies in: those one word longer
    inner = F.array(_words(F.col("m") - 1), _words(1 - F.col("m")))
    longer = found.withColumn("m", words).filter("m > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    best = best.join(longer, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (F.col("around").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * inside_percent))
    out = best.select(_unescaped(F.col("lang")).alias("lang"), _unescaped(F.replace("phrase", sep, F.lit(" "))).alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))  # of 64 parts of each language first, so that no task sorts a whole one
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("place") <= top).drop("place")
    ranked, _ = stage(out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top), "collocations")
    drop(docs.sparkSession, counts_path, found_path)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
