import random

import pytest

from quarry.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute_force(rows, edits=1, min_chars=16):
    """doc_id: text, by comparing each line with all earlier ones; ids are distinct."""
    seen, first, out = [], {}, {}
    for i, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        kept = []
        for line in text.split("\n"):
            if not line.strip():
                kept.append(line)
                continue
            if line in first:
                continue
            near = edits and len(line) >= min_chars and any(len(o) >= min_chars and abs(len(o) - len(line)) <= 1 and distance(o, line) <= 1 for o in seen)
            first[line] = i
            seen.append(line)
            if not near:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "c", 4, 1, 2, 3) for i, t in rows], "doc_id long, text string, line string, n_lines int, _id int, _text int, _dropped int")
    return line_dedup.dedup_lines(df, **kw).collect()


def edited(rng, line):
    i = rng.randrange(len(line))
    return rng.choice([line[:i] + line[i + 1 :], line[:i] + "z" + line[i:], line[:i] + "z" + line[i + 1 :], line[:i] + "zq" + line[i + 1 :], line])


@pytest.mark.parametrize("length", [(5, 40), (60, 140), (300, 700)])
def test_equals_brute_force(spark, length):
    rng = random.Random(length[0])
    base = ["".join(rng.choice("abcd e") for _ in range(rng.randint(*length))) for _ in range(10)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base)) if rng.random() < 0.8 else "" for _ in range(rng.randint(0, 5)))) for i in range(40)]
    want = brute_force(rows)
    got = {r.doc_id: r for r in run(spark, rows)}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_lines == len(t.split("\n")) and (r.line, r._id, r._text, r._dropped) == ("c", 1, 2, 3) for (i, t) in rows for r in [got[i]])


def test_exact_only(spark):
    rows = [(2, "a line of some length\nother"), (1, "a line of some length\nx"), (3, "A line of some length")]
    assert {r.doc_id: r.text for r in run(spark, rows, max_edits=0)} == brute_force(rows, 0) == {1: "a line of some length\nx", 2: "other", 3: "A line of some length"}
    with pytest.raises(ValueError):
        run(spark, rows, max_edits=2)


def test_a_key_shared_by_many_lines_pairs_with_the_earliest_only(spark):
    rows = [(i, f"this is line number {i % 10}") for i in range(60)]
    got = {r.doc_id: r.text for r in run(spark, rows)}
    assert got == brute_force(rows) and sum(map(bool, got.values())) == 1


def test_edges(spark):
    long = "x" * 30_000
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, long), (5, long[:-1]), (6, "same text of a document"), (6, "same text of a document"), (None, "same text of a document"), (7, "tail line of a text\n"), (8, "ünïcödé líne öf ä text"), (9, "ünïcödé líne öf a text")]
    got = run(spark, rows)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by == {1: [None], 2: [""], 3: [" \n\t\n"], 4: [long], 5: [""], 6: ["same text of a document"] * 2, None: [""], 7: ["tail line of a text\n"], 8: ["ünïcödé líne öf ä text"], 9: [""]}
    assert run(spark, []) == []


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = line_dedup.dedup_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
