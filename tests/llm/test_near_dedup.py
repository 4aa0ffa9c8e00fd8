import random

import numpy as np
import pytest

from quarry.llm import near_dedup
from quarry.llm._words import hash_words, shingle_set, word_hashes
from quarry.llm.components import connected_components


def sets(text, k):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_force(rows, k, percent):
    """The smallest id reachable from each row's id, by comparing all pairs."""
    s = [(i, sets(t, k)) for i, t in rows]
    part = {i: i for i, _ in s if i is not None}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for x in range(len(s)):
        for y in range(x):
            (i, a), (j, b) = s[x], s[y]
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(i), root(j)))
                part[q] = p
    return {i: root(i) for i in part}


def corpus(rng, groups, copies, words=60, edits=2):
    rows, vocab = [], [f"w{i}" for i in range(3000)]
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(words)]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, node string")
    return near_dedup.near_duplicates(df, **kw).collect()


def test_word_hashes_are_of_words():
    a = word_hashes("The CAT\tsat\x0bon\x0c the\r\nmat é")
    assert len(a) == 7 and a[0] == a[4] and a[1] == word_hashes("cat")[0]
    assert (hash_words(b"a b") == word_hashes("A  b ")).all() and len(word_hashes(" \n")) == 0
    long = "word " * 300_000
    assert len(np.unique(word_hashes(long))) == 1 and len(word_hashes(long)) == 300_000


@pytest.mark.parametrize("text, k, n", [("a b c d", 3, 2), ("a b", 3, 1), ("", 3, 0), (None, 3, 0), ("a a a a a", 3, 1), ("A b c a B C", 3, 3)])
def test_shingles(text, k, n):
    assert len(shingle_set(text, k)) == n == len(sets(text, k))


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, k, percent):
    rows = corpus(random.Random(5), 40, 8)
    want = brute_force(rows, k, percent)
    got = run(spark, rows, k=k, percent=percent)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(sets(dict(rows)[r.doc_id], k)) for r in got)


def test_large_groups_take_pivots(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_DOCS", 12)
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 6)
    rng = random.Random(9)
    rows = corpus(rng, 2, 1, words=80)
    base = rows[0][1].split()
    for edits in (0, 1, 2, 3, 4, 5, 6, 8):
        for _ in range(8):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"v{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(w)))
    for rounds in (0, 2, 6):
        got = {r.doc_id: r.component_id for r in run(spark, rows, k=3, percent=70, rounds=rounds, trees=12)}
        assert got == brute_force(rows, 3, 70)


def of_lines(rng, n, lines):
    """Documents made of a few lines of a small pool, some with a word changed: alike, but hardly any of them near duplicates."""
    pool = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(4, 12))) for _ in range(lines)]
    rows = []
    for i in range(n):
        w = "\n".join(rng.choice(pool) for _ in range(rng.randint(2, 6))).split(" ")
        if i % 3 == 0:
            w = rows[rng.randrange(len(rows))][1].split(" ") if rows else w
            w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("k, percent, rounds, node", [(3, 85, 1, 2048), (3, 85, 0, 8), (1, 60, 2, 16)])
def test_documents_of_one_template_are_not_compared_by_all_pairs(spark, monkeypatch, k, percent, rounds, node):
    """Their comparison on whole sets took n * r / BLOCK_DOCS rows, with r of n members that no pivot connects."""
    rows = of_lines(random.Random(2), 400, 15)
    df = spark.createDataFrame([(7, i, t, i * 11, i * 13) for i, t in rows], "grp long, doc_id long, text string, s1 long, s2 long").cache()
    given = []

    def counting(rows, *a, f=near_dedup.small_group_edges):
        given.append(rows.count())
        return f(rows, *a)

    monkeypatch.setattr(near_dedup, "SMALL_DOCS", 12)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 6)
    monkeypatch.setattr(near_dedup, "NODE_DOCS", node, raising=False)
    monkeypatch.setattr(near_dedup, "small_group_edges", counting)
    links = near_dedup.large_group_edges(df.select("grp", "doc_id", "s1", "s2"), df.select("doc_id", "text"), k, percent, rounds, [])
    label = {r.id: r.component for r in connected_components(links).collect()}
    want = brute_force(rows, k, percent)
    assert {i: label.get(i, i) for i, _ in rows} == want and len(set(want.values())) < 400
    assert percent < 85 or sum(given) < 4 * len(rows)


def test_a_pivot_that_links_few_is_the_last(spark, monkeypatch):
    """All rounds were made before, each with four tables, though the join of what is left does the rest at once."""
    rows = of_lines(random.Random(2), 400, 15)
    df = spark.createDataFrame([(7, i, t, i * 11, i * 13) for i, t in rows], "grp long, doc_id long, text string, s1 long, s2 long").cache()
    names = []

    def naming(rows, name, f=near_dedup.stage_counting, **conditions):
        names.append(name)
        return f(rows, name, **conditions)

    monkeypatch.setattr(near_dedup, "SMALL_DOCS", 12)
    monkeypatch.setattr(near_dedup, "stage_counting", naming)
    links = near_dedup.large_group_edges(df.select("grp", "doc_id", "s1", "s2"), df.select("doc_id", "text"), 3, 85, 3, [])
    label = {r.id: r.component for r in connected_components(links).collect()}
    assert {i: label.get(i, i) for i, _ in rows} == brute_force(rows, 3, 85)
    assert names.count("pivots") == 1


@pytest.mark.parametrize("block, parts", [(4, 1), (4, 3), (128, 8)])
def test_pairs_are_confirmed_once_each(spark, monkeypatch, block, parts):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    monkeypatch.setattr(near_dedup, "PAIR_PARTS", parts)
    texts = [(i, "a b c d e f g h" + (" x" if i % 3 == 0 else f" {i} {i} y")) for i in range(40)]
    pairs = [(a, b) for a in (0, 1, 3) for b in range(4, 40)] * 2
    got = near_dedup._confirmed(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(texts, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.a, r.b) for r in got) == sorted((a, b) for a in (0, 3) for b in range(6, 40, 3))


def test_edges(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (7, None), (8, ""), (9, " \t"), (None, "a b c d e f"), (10, "x y"), (11, "x y"), (12, "w " * 50_000), (13, "W " * 60_000)]
    got = run(spark, rows, k=3, percent=85)
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[i].component_id for i in (5, 3, 7, 8, 9, 10, 11, 12, 13)] == [3, 3, 7, 8, 9, 10, 10, 12, 12]
    assert by[7].n_shingles == by[9].n_shingles == 0 and by[7].kept
    null = next(r for r in got if r.doc_id is None)
    assert null.component_id is None and null.kept
    assert run(spark, []) == []


def test_one_id_on_two_texts_counts_as_one_document(spark):
    rows = [(1, "a b c d e f g h"), (1, "m n o p q r s t"), (2, "a b c d e f g h"), (3, "m n o p q r s t")]
    assert {r.component_id for r in run(spark, rows, k=3, percent=85)} == {1}


def test_group_edges_connect_without_all_pairs():
    s = np.arange(50, dtype=np.uint64)
    assert len(near_dedup.group_edges(list(range(30)), [s] * 30, 85)) == 29


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    part = {x: x for e in edges for x in e}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        part[q] = p
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in part if any(i in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges_of_components_are_computed_once(spark, tmp_path):
    """Both directions were computed on their own, so whole sets were compared twice."""
    place = str(tmp_path)

    def seen(batches):
        for b in batches:
            for a in b.column("a").to_pylist():
                with open(f"{place}/seen", "a") as f:
                    f.write(f"{a}\n")
            yield b

    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long").mapInArrow(seen, "a long, b long")
    assert {r.component for r in connected_components(edges).collect()} == {0}
    assert len((tmp_path / "seen").read_text().split()) == 20


def test_components_of_one_round_are_connected(spark):
    edges = [(i, i + 1) for i in range(100)] + [(i, i + 1) for i in range(200, 300)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), rounds=1).collect()}
    assert len(got) == 202 and 2 < len(set(got.values())) < 202 and all((i < 200) == (c < 200) and c <= i for i, c in got.items())
