import random
import re
from fractions import Fraction

import pytest

from quarry.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), cap=2):
    """Targets in fractions, by sharing what is above again."""
    names = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[n] for n in open_)
        above = {n for n in open_ if left * w[n] >= cap * sizes[n] * total}
        if not above:
            return out | {n: left * w[n] / total for n in open_}
        for n in above:
            out[n] = Fraction(cap * sizes[n])
        left -= sum(out[n] for n in above)
        open_ -= above
    return out


def corpus(seed, sources, docs):
    rng = random.Random(seed)
    rows = []
    for i in range(docs):
        s = rng.choices(sources, weights=[len(sources) * 2, *[1] * (len(sources) - 1)])[0]  # the first holds two thirds
        n = rng.choice([0, 1, 5, 20, 20, 40, 60, 300 if rng.random() < 0.1 else 30])
        rows.append((i, s, " \n".join(["w"] * n) if rng.random() > 0.02 else None))
    return rows


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_targets_and_balance(spark, block_rows):
    sources = ["é", "a", "B", None, "z", "b", "𝄞", "ﬀ"]
    rows = corpus(7, sources, 900)
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, source string, text string, SIZE string, extra int")
    got = {r.doc_id: r for r in mixing.mix(df, block_rows=block_rows, reserve=4 if block_rows == 16 else 32).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in rows}
    totals = {s: sum(size[i] for i, x, _ in rows if x == s) for s in sources}
    want = targets(totals)
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "source", "extra", "size", "source_size", "target", "taken"}
    for s in sources:
        mine = [got[i] for i, x, _ in rows if x == s]
        t = want[s] / totals[s]
        for r in mine:
            assert r.size == size[r.doc_id] and r.source_size == totals[s] and r.target == pytest.approx(float(want[s]), rel=1e-12)
            assert r.taken in (t // 1 * r.size, (t // 1 + (t % 1 > 0)) * r.size) and r.taken <= 2 * r.size
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(0.005 * want[s], 3)
        extra = sum(r.taken > t // 1 * r.size for r in mine if r.size)
        expected = t % 1 * sum(r.size > 0 for r in mine)
        assert abs(extra - expected) <= max(0.12 * len(mine), 4)  # documents are balanced too


def test_reruns_agree_however_partitioned(spark):
    rows = corpus(8, ["a", "b", "c"], 400)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    first = sorted(map(tuple, mixing.mix(df, block_rows=32, reserve=4).collect()))
    again = sorted(map(tuple, mixing.mix(df.repartition(7, "text"), block_rows=32, reserve=4).collect()))
    assert first == again


def test_edges(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None), (None, None, None), (1, "a", ""), (2, "a", "  ")]
    assert {(r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(spark.createDataFrame(rows, schema)).collect()} == {(0, 0, 0.0, 0)}
    (one,) = mixing.mix(spark.createDataFrame([(5, None, "one two")], schema)).collect()
    assert (one["size"], one.target) == (2, 3.0) and one.taken in (2, 4)
    same = mixing.mix(spark.createDataFrame([(5, "s", "one two")] * 10, schema)).collect()
    assert sum(r.taken for r in same) == 30 and {r.taken for r in same} == {2, 4}
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([], schema), block_rows=2)


def test_flight_keeps_words_and_rows():
    rng = random.Random(9)
    for _ in range(60):
        p = [rng.choice([0.0, 1.0, rng.random()]) for _ in range(rng.randrange(0, 40))]
        size = [rng.choice([0, 3, 3, rng.randrange(1000)]) for _ in p]
        before = sum(p), sum(a * b for a, b in zip(p, size, strict=True))
        open_ = mixing.flight(p, size, rng)
        assert len(open_) <= 2 and all(x in (0, 1) or i in open_ for i, x in enumerate(p))
        assert (sum(p), sum(a * b for a, b in zip(p, size, strict=True))) == pytest.approx(before, abs=1e-5)


def test_flight_is_unbiased():
    p, size = [0.3, 0.6, 0.8, 0.5, 0.4, 0.7], [5, 9, 2, 40, 7, 7]
    runs, seen = 4000, [0.0] * 6
    for seed in range(runs):
        x = list(p)
        mixing.flight(x, size, random.Random(seed))
        seen = [a + b for a, b in zip(seen, x, strict=True)]
    assert [s / runs for s in seen] == pytest.approx(p, abs=0.04)


def test_landing_is_the_nearest_choice():
    rng = random.Random(10)
    for _ in range(30):
        p, size = [rng.random() for _ in range(8)], [rng.randrange(1, 500) for _ in range(8)]
        want = sum(a * b for a, b in zip(p, size, strict=True))
        best = min(abs(sum(s for i, s in enumerate(size) if m >> i & 1) - want) for m in range(256))
        mixing.landing(p, size, list(range(8)))
        assert abs(sum(a * b for a, b in zip(p, size, strict=True)) - want) == pytest.approx(best)
