import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import collocations as co


def brute(rows, min_count, max_n=5, top=2000, inside_percent=100):
    """Everything by dictionaries of word tuples."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, max_n + 1):
                    if i + k <= len(w):
                        f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p: c for p, c in counts.items() if c >= min_count}
        found = []
        for p, a in frequent.items():
            inside = any(len(q) > len(p) and 100 * c >= inside_percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in frequent.items())
            if len(p) > 1 and not inside:
                score, k, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2].encode()))[:top]):
            out.append((lang, rank + 1, p, -a, l, r, n[lang], -s))
    return sorted(out)


def corpus(seed, docs=60, vocabulary="a b c d e the of The x\x00 x\x01 \x01 é É 日 aa ab".split()):
    rng = random.Random(seed)
    rows = []
    for _ in range(docs):
        words = rng.choices(vocabulary, k=rng.randrange(0, 60), weights=range(len(vocabulary), 0, -1))
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r\n", "!"]) for w in words)
        rows.append((rng.choice(["en", "de", None, "und", ""]), text))
    return [*rows, ("en", None), (None, ""), ("fr", " .,; "), *[rows[3]] * 8]


@pytest.mark.parametrize(("seed", "min_count", "hot", "chunk", "percent", "held"), [(1, 3, 4096, 1 << 20, 100, 1 << 20), (2, 5, 4, 50, 100, 1), (3, 2, 8, 200, 60, 40), (4, 4, 16, 7, 100, 40), (5, 300, 16, 999, 100, 40)])
def test_equals_brute_force(spark, monkeypatch, seed, min_count, hot, chunk, percent, held):
    """Small chunks cut texts in windows; few words are hot with a large share, so suffixes are split; a bound over 255 counts pairs in wider numbers."""
    monkeypatch.setattr(co, "HELD", held)
    monkeypatch.setattr(co, "LONGEST", 2 + seed % 3)
    monkeypatch.setattr(co, "TWO_BYTES", -120 if seed == 2 else 128 * 253)  # five words have numbers
    monkeypatch.setattr(co, "HOT", hot)
    monkeypatch.setattr(co, "CHUNK", chunk)
    rows = corpus(seed, docs=600 if min_count > 255 else 60)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, n int, rank int")
    for top in (5, 2000):
        got = co.collocations(df, min_count=min_count, top=top, inside_percent=percent, filter_bits=16)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, min_count, top=top, inside_percent=percent)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(df).count() == 0
    assert co.collocations(spark.createDataFrame([("en", None), (None, "..")], "lang string, text string"), min_count=1).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts of which 1000 a n passes 64 bits, put in place of those counted."""
    big = 4 * 10**12
    monkeypatch.setattr(co, "word_counts", lambda texts: spark.createDataFrame([(b"en", b"w", 9 * big)], "lang binary, word binary, n long"))
    found = [(b"en\0new", big + 7), (b"en\0york", big + 3), (b"en\0new\0york", big), (b"en\0of", 3 * big)]
    monkeypatch.setattr(co, "phrase_counts", lambda *a: spark.createDataFrame(found, "key binary, f long"))
    (row,) = co.collocations(spark.createDataFrame([("en", "x")], "lang string, text string")).collect()
    assert row.score == 1000 * big * 9 * big // ((big + 7) * (big + 3)) and (row.l, row.r) == (big + 7, big + 3)


def test_windows_cover_the_text_once():
    rng = random.Random(5)
    for _ in range(50):
        text = bytes(rng.choices(b"ab .,\n", k=rng.randrange(0, 80)))
        parts = list(co.windows(text, 9, 2))
        assert b"".join(p[:limit] for p, limit in parts) == text
        for p, limit in parts[:-1]:
            assert not p[limit:] or len(co._WORD.findall(p[limit:])) <= 2
        assert co.escaped(text) == text


def test_stack_is_the_same_in_any_batches():
    rng = random.Random(6)
    keys = sorted({b"\0".join([b"l%d" % rng.randrange(2), *(bytes([97 + rng.randrange(3)]) for _ in range(rng.randrange(1, 5)))]) for _ in range(150)}, reverse=True)
    n = np.array([rng.randrange(1, 5) for _ in keys])
    want = Counter()
    for k, c in zip(keys, n.tolist(), strict=True):
        words = k.split(b"\0")
        for j in range(2, len(words) + 1):
            want[b"\0".join(words[:j])] += c
    for size in (1, 2, 7, 1000):
        stack, got = co.PrefixStack(4, 3), []
        for at in range(0, len(keys), size):
            got += stack.add(pa.array(keys[at : at + size], pa.binary()), np.zeros(len(keys[at : at + size]), dtype=np.int32), n[at : at + size])
        got += stack.end()
        assert sorted(got) == sorted((k, c) for k, c in want.items() if c >= 3)


def test_plan_shuffles_by_first_word_and_sorts(spark):
    texts = spark.createDataFrame([(b"en", b"a b")], "lang binary, text binary")
    counts = co.word_counts(texts)
    plan = co.phrase_counts(texts, counts, 2, 1, 5, 16)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(substring(key" in plan and "Sort [key" in plan and "Window" not in plan


def test_codes_are_distinct_and_free_of_separators():
    codes = [co.code(i) for i in range(co.ONE_BYTE + co.TWO_BYTES)]
    assert len(set(codes)) == len(codes) and min(min(c) for c in codes) == 3 and max(map(len, codes)) == 2
    assert not {c[0] for c in codes if len(c) == 1} & {c[0] for c in codes if len(c) == 2}
