import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, html_text, pii, topk

# -- exact top-k


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.2, (300, 8)).round(2)
    x[50:80] = x[49]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = [(i, [math.floor(64 * c) for c in r]) for i, r in rows]
    monkeypatch.setattr(topk, "MIN_BLOCK", 32)
    for block_bytes, sample in ((32 * 64, 40), (8 << 20, 1024), (8 << 20, 0)):
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, 7, n_pivots=5, sample_rows=sample, block_bytes=block_bytes).collect()
        want = set()
        for q, a in v[::20]:
            best = sorted(((-sum(p * r for p, r in zip(a, b, strict=True)), i) for i, b in v if i != q))[:7]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0, None]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (1, [0.5, 0.5]), (2, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (0, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<double>, score int, d int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == sorted([(0, 1, 1, 32 * 64 + 32 * 128), (0, 2, 1, 32 * 64 + 32 * 128)] * 2)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


@pytest.mark.parametrize("spread", [0, 400])
def test_the_bound_never_excludes(spread):
    rng = np.random.default_rng(4)
    c = rng.integers(-30, 30, (4000, 6)) + spread * rng.integers(0, 9, (4000, 1))  # with a spread most candidates are eliminated
    q = np.concatenate([rng.integers(-30, 30, (5, 6)), c[:35]])
    p = c[:20].astype(float)
    qid = np.concatenate([np.arange(10_000, 10_005), np.arange(35)])
    least = topk.thresholds(qid, q, np.arange(100), c[:100], 9)
    got = topk.block_top_k(qid, q, topk.pivot_distances(q, p), least, np.arange(4000), c, topk.pivot_distances(c, p), 9, step=16)
    bound = topk.upper_bounds(q, topk.pivot_distances(q, p).astype(np.float32), (c.astype(float) ** 2).sum(1), topk.pivot_distances(c, p).astype(np.float32))
    assert (bound >= q @ c.T).all()
    for i in range(len(q)):
        s = c @ q[i]
        s = np.where(np.arange(4000) == qid[i], -(10**15), s)
        want = np.lexsort((np.arange(4000), -s))[:9]
        assert least[i] <= s[want[-1]]
        assert (got[i][0] == want).all() and (got[i][1] == s[want]).all()


def test_large_components_are_exact(spark):
    rows = [(0, [float(1 << 24), 1 / 64]), (1, [float(1 << 24), 3 / 64]), (2, [float(1 << 24), 2 / 64]), (3, [-5.0, 1.0])]
    for scale in (1.0, 1 / 4096):
        df = spark.createDataFrame([(i, [x[0] * scale if x[0] > 0 else x[0], x[1]]) for i, x in rows], "vec_id long, embedding array<double>")
        got = [(r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0, 3).orderBy("rank").collect()]
        a = int((1 << 24) * scale) * 64
        assert got == [(1, a * a + 3), (2, a * a + 2), (3, -320 * a + 64)]


# -- benchmark overlaps

WORDS = [f"tok{i}" for i in range(400)]


def test_whole_and_substituted_passages_are_found():
    rng = random.Random(1)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(15, 50)))) for i in range(30)]
    index = decontaminate.SeedIndex.of(items)
    for i, text in items:
        w = text.split()
        for j in range(7, len(w), 9):
            w[j] = "other"
        doc = " ".join(rng.choices(WORDS, k=30)) + " " + " ".join(w).upper().replace(" ", ", ") + ". " + " ".join(rng.choices(WORDS, k=30))
        found = [h for h in index.overlaps(doc, 13, 0.75) if h["item_id"] == i]
        assert found and found[0]["n_equal"] < len(w) + 1 and found[0]["doc_start"] >= 28
    assert not index.overlaps(" ".join(rng.choices(WORDS, k=3000)), 13, 0.75)


def test_spaced_seeds_equal_brute_force():
    rng = random.Random(7)
    w = decontaminate.tokens(" ".join(rng.choices("abcd", k=60)))
    for salt, mask in enumerate(decontaminate.MASKS):
        at = [k for k, c in enumerate(mask) if c == "1"]
        h = decontaminate.seed_hashes(w, at, salt)
        keys = [tuple(int(w[i + p]) for p in at) for i in range(len(w) - len(mask) + 1)]
        assert len(h) == len(keys) and all((h[a] == h[b]) == (keys[a] == keys[b]) for a in range(len(keys)) for b in range(len(keys)))


def test_overlap_frames(spark):
    item = " ".join(WORDS[:20])
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, "short exact run"), (1, item), (5, " ".join(WORDS[100:140]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + item + " y", 1), (2, None, 1), (3, "", 1), (4, "a Short, exact RUN here", 1), (5, "clean words only " * 20_000 + item, 1), (1, "x " + item + " y", 1), (None, "short exact", 1)], "doc_id long, text string, overlaps int")
    docs = docs.withColumns({c: F.lit(1) for c in ("_f1", "_f2", "_hits", "h1", "key", "item_id")})
    for block in (8 << 20, 10):  # as one index, and as joined tables
        got = decontaminate.find_overlaps(docs, bench, block_bytes=block, filter_bits=16).collect()
        assert sorted((str(r.doc_id), [h.item_id for h in r.overlaps]) for r in got) == sorted([("1", [1]), ("2", []), ("3", []), ("4", [4]), ("5", [1]), ("1", [1]), ("None", [])])
    assert decontaminate.find_overlaps(docs, bench.limit(0)).filter("size(overlaps) > 0").count() == 0
    assert decontaminate.find_overlaps(docs.limit(0), bench).count() == 0


def test_joined_tables_give_the_rows_of_the_index(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices(WORDS[:60], k=rng.choice([3, 8, 14, 30])))) for i in range(40)]
    texts = []
    for i in range(60):
        w = [x for _ in range(3) for x in [*rng.choice(items)[1].split(), *rng.choices(WORDS, k=5)]]
        texts.append((i, " ".join("other" if rng.random() < 0.1 else x for x in w)))
    docs = spark.createDataFrame([*texts, *texts[:20]], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted((r.doc_id, [tuple(h) for h in r.overlaps]) for r in decontaminate.find_overlaps(docs, bench, block_bytes=n, filter_bits=18).collect()) for n in (1 << 20, 1))
    assert one == many and sum(bool(h) for _, h in one) > 40
    plan = decontaminate.find_overlaps(docs, bench, block_bytes=1, filter_bits=18)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_a_passage_of_many_documents_and_items(spark, monkeypatch):
    """Cells send an item once to each block of documents; what is made of both is the overlaps themselves."""
    rng = random.Random(12)
    opening = " ".join(WORDS[:16])
    tail = lambda n: " ".join(str(rng.randrange(10**9)) for _ in range(n))
    items = [(i, f"{opening} {tail(20)}") for i in range(60)]
    docs = [(i, f"{tail(30)} {opening} {tail(30)}") for i in range(70)] + [(1000, tail(50))]
    monkeypatch.setattr(decontaminate, "CELL_DOCS", 16)
    made = []
    inner = decontaminate.stage
    monkeypatch.setattr(decontaminate, "stage", lambda df, name: made.append((name, inner(df, name))) or made[-1][1])
    found = decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=4000, filter_bits=18).collect()
    for r in found:
        assert [h.item_id for h in r.overlaps] == ([] if r.doc_id == 1000 else list(range(60))) and all(h.n_equal >= 16 for h in r.overlaps)
    hits = dict((name, df[0]) for name, df in made)["seed-hits"]
    assert hits.select("h1").distinct().count() == 70 and hits.groupBy("key").count().agg({"count": "max"}).first()[0] == 70


@pytest.mark.parametrize("pairs", [0, 3])
def test_diagonals_from_pairs_and_convolutions_are_the_same(monkeypatch, pairs):
    rng = random.Random(13)
    items = [(i, " ".join(rng.choices("a b c".split() + WORDS[:9], k=rng.choice([4, 12, 40])))) for i in range(15)]
    index = decontaminate.SeedIndex.of(items)
    for _ in range(10):
        w = decontaminate.tokens(" ".join(rng.choices("a b c".split() + WORDS[:9], k=80)))
        want = {i: d.tolist() for i, d in index.diagonals(w).items()}
        with monkeypatch.context() as m:
            m.setattr(decontaminate, "PAIRS", max(pairs, 1))
            assert {i: d.tolist() for i, d in index.diagonals(w).items()} == want


@pytest.mark.parametrize("words", [["a"], ["a", "b"], ["a", "b", "c"]])
def test_repeated_words_take_seconds(words):
    import time

    text = " ".join(words * (20_000 // len(words)))
    start = time.perf_counter()
    found = decontaminate.SeedIndex.of([(1, text)]).overlaps(text, 13, 0.75, rest=True)
    assert found and time.perf_counter() - start < 30


def test_differences_of_long_lists():
    rng = np.random.default_rng(8)
    for n in (3, 400, 3000):
        a, b = (np.sort(rng.choice(9000, n, replace=False)) for _ in range(2))
        assert (decontaminate.differences(a, b) == np.unique(a[:, None] - b)).all()


# -- HTML

BODY = "".join(f"<p>Paragraph {i} of the story, which is long enough, with commas, to count as text of the article.</p>" for i in range(4))
WANT = "\n".join(f"Paragraph {i} of the story, which is long enough, with commas, to count as text of the article." for i in range(4))


@pytest.mark.parametrize("page", [
    f"<html><body><nav><a href=x>Home</a></nav><div id=content>{BODY}</div><footer>(c)</footer></body></html>",
    f"<body><div class='sidebar'><p>Something else, quite long, that stands beside the text and is no part of it.</p></div><div>{BODY}</div>",
    f"<article>{BODY}</article><section class='comments'><p>Great post, thank you very much, I liked it a lot, really.</p></section>",
    f"<div>{BODY.replace('</p>', '')}</div>",
    f"<main><form><p>Subscribe to our letter, it is free, and sent to you each day.</p></form><div>{BODY}</div></main>",
    f"<div class='cookie-notice'><p>We use cookies, and so do others, to make all this better.</p></div><div>{BODY}<script>var a='<p>not, text, at, all, really, not</p>';</script></div>",
    f"<!-- <p>comment, comment, comment, comment</p> --><div>{BODY}<style>p{{}}</style></div>",
    f"<div role=banner><p>Banner text, that is long, and goes on, and on, and on.</p></div><DIV>{BODY}</DIV>",
    f"<div>{BODY}</div><aside><p>Related reading, with links, for those who want to go on.</p></aside>",
    f"<div class=ad>Buy this, now, or never, because it is good, cheap and new.</div><div>{BODY}",
])
def test_main_text(page):
    assert html_text.main_text(page) == WANT


def test_sections_headings_and_references():
    page = "<article><h1>A &amp; B</h1><section><p>First   part,\n with&nbsp;more text to be found here.</p></section><section><h2>Next</h2><p>Second <b>bold</b><br>line, and a list of things to come:</p><ul><li>one<li>two</ul></section></article>"
    assert html_text.main_text(page) == "A & B\nFirst part, with more text to be found here.\nNext\nSecond bold line, and a list of things to come:\none\ntwo"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<div", "<p", "</p></p>", "<!--", "<script>", "<div><span></div></span>", "a < b", "<p a='>", "<b>" * 3000])
def test_broken_pages_do_not_fail(page):
    assert isinstance(html_text.main_text(page), str)


def test_extract_frames(spark):
    rows = [(1, "u", f"<div>{BODY}</div>"), (2, None, None), (3, "u", ""), (4, "u", "<p>" + "long text, " * 50_000), (1, "u", f"<div>{BODY}</div>")]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    other = df.withColumns({"_page": F.lit(1), "__page": F.lit(2)})
    assert html_text.extract(other).columns == ["page_id", "url", "_page", "__page", "text", "n_chars"] and html_text.extract(other).filter("n_chars > 0").count() == 3
    got = {r.page_id: r for r in html_text.extract(df, keep=["page_id", "url"]).collect()}
    assert got[1].text == WANT and got[2].text == got[3].text == "" and got[4].n_chars == len(("long text, " * 50_000).strip()) == len(got[4].text)
    assert html_text.extract(df).columns == ["page_id", "url", "text", "n_chars"] and html_text.extract(df.limit(0)).count() == 0


# -- personal data


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0


def card(rng, n=16):
    body = str(rng.randint(1, 9)) + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def masked(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_ip int, _text int, _found int")
    return [r for r in pii.pseudonymise(df, key).orderBy("doc_id").collect()]


def test_formats_and_links(spark):
    rng = random.Random(3)
    cards = [card(rng, n) for n in (13, 15, 16, 16, 19)]
    spaced = " ".join(cards[2][i : i + 4] for i in range(0, 16, 4))
    got = masked(spark, [*cards, spaced, "x@y.org, john.doe+1@mail.example.com", "+1 (988) 555-2485", "(212) 555-0199", "8.8.4.4 255.1.2.3", "1999-12-31 29.02.2000", "078-05-1120", "GB82 WEST 1234 5698 7654 32"])
    for before, r in zip(cards, got, strict=False):
        assert luhn(r.text) and len(r.text) == len(before) and r.n_card == 1
    assert got[5].text.replace(" ", "") == got[2].text and [len(x) for x in got[5].text.split()] == [4] * 4
    assert re.fullmatch(r"[a-z]@[a-z]\.org, [a-z]{4}\.[a-z]{3}\+\d@[a-z]{4}\.[a-z]{7}\.com", got[6].text) and got[6].n_email == 2 and (got[6]._text, got[6]._found) == (2, 3)
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", got[7].text) and re.fullmatch(r"\([2-9]\d\d\) [2-9]\d\d-\d{4}", got[8].text)
    assert all(0 <= int(o) <= 255 for a in got[9].text.split() for o in a.split(".")) and got[9].n_ip == 2
    assert re.fullmatch(r"(19|20)\d\d-\d\d-\d\d \d\d\.\d\d\.(19|20)\d\d", got[10].text)
    assert re.fullmatch(pii._SSN, got[11].text.replace("-", "")) and got[12].n_iban == 1
    iban = got[12].text.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert [r.text for r in masked(spark, cards)] == [r.text for r in got[:5]] != [r.text for r in masked(spark, cards, "other")]


def test_invalid_values_stay(spark):
    texts = ["4041894974608796", "999.1.1.1 1.2.3.4.5", "2020-13-40 2021-02-29", "000-12-3456", "XX89370400440532013000", "order 12345 of 3.14", "a@b", "nothing", "", None, "x" * 200_000 + "@", "1.1.1.1" * 3]
    assert [r.text for r in masked(spark, texts)] == texts


def test_a_permutation_of_its_format(spark):
    dates = spark.sql("SELECT date_format(d, 'yyyy-MM-dd') AS t FROM (SELECT explode(sequence(DATE'1900-01-01', DATE'2099-12-31', INTERVAL 100 DAY)) AS d)")
    numbers = spark.range(2000).selectExpr("concat('212-55', lpad(string(id % 10), 1, '0'), '-', lpad(string(id), 4, '0')) AS t")
    for df in (dates, numbers):
        out = pii.pseudonymise(df, "k", "t").distinct()
        assert out.count() == df.count() == out.filter("n_date + n_phone = 1").count()


def feistel(x, kind, key):
    """The network by itself, of digits and letters."""
    import hashlib

    def half(r, a, b):
        out = []
        for i, c in enumerate(a):
            step = int(hashlib.sha256(f"{key}|{kind}|{r}|{i}|{b}".encode()).hexdigest()[:7], 16)
            first, n = ("0", 10) if c in "0123456789" else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else (None, 0)
            if c in pii.MARKED:
                out.append(pii.MARKED[(pii.MARKED.index(c) + step) % len(pii.MARKED)])
                continue
            out.append(chr(ord(first) + (ord(c) - ord(first) + step) % n) if first else c)
        return "".join(out)

    a, b = x[: len(x) // 2], x[len(x) // 2 :]
    for r in range(1, pii.ROUNDS + 1):
        a, b = b, half(r, a, b)
    return a + b


def number(x, radix, kind, key):
    import hashlib

    a, b = divmod(x, radix)
    for r in range(1, pii.ROUNDS + 1):
        a, b = b, (a + int(hashlib.sha256(f"{key}|{kind}|{r}|n|{b}".encode()).hexdigest()[:7], 16)) % radix
    return a * radix + b


def walked(x, once, valid):
    x = once(x)
    while not valid(x):
        x = once(x)
    return x


def test_pseudonyms_equal_an_independent_network(spark):
    import datetime

    rng, key = random.Random(9), "another key"
    american = lambda d: walked(d, lambda w: feistel(w, "phone", key), lambda w: re.fullmatch(pii._NANP, w))
    texts, want = [], []
    for _ in range(25):
        c = card(rng, rng.choice([13, 15, 16, 19]))
        body = c[0] + feistel(c[1:-1], "card", key)
        texts.append(c)
        want.append(next(body + str(x) for x in range(10) if luhn(body + str(x))))
        n = "2125" + "".join(rng.choices("0123456789", k=6))
        m = american(n)
        texts.append(f"({n[:3]}) {n[3:6]}-{n[6:]}")
        want.append(f"({m[:3]}) {m[3:6]}-{m[6:]}")
        n = "".join(rng.choices("0123456789", k=9))
        texts.append(f"+358{n}")
        want.append("+358" + feistel(n, "phone", key))
        d = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(pii._DATE_DAYS))
        moved = walked((d - datetime.date(1900, 1, 1)).days, lambda w: number(w, pii._DATE_RADIX, "date", key), lambda w: w < pii._DATE_DAYS)
        texts.append(d.isoformat())
        want.append((datetime.date(1900, 1, 1) + datetime.timedelta(moved)).isoformat())
        ip = [rng.randrange(256) for _ in range(4)]
        texts.append(".".join(map(str, ip)))
        want.append(".".join(map(str, number(int.from_bytes(bytes(ip), "big"), 65536, "ip", key).to_bytes(4, "big"))))
        s = f"{rng.randint(1, 665):03d}{rng.randint(1, 99):02d}{rng.randint(1, 9999):04d}"
        t = walked(s, lambda w: feistel(w, "ssn", key), lambda w: re.fullmatch(pii._SSN, w))
        texts.append(f"{s[:3]}-{s[3:5]}-{s[5:]}")
        want.append(f"{t[:3]}-{t[3:5]}-{t[5:]}")
        name = "".join(rng.choices("abcxyz09", k=rng.randint(1, 9)))
        texts.append(f"{name}@sub.site.org")
        want.append(f"{feistel(name, 'email', key)}@{feistel('sub.site.', 'domain', key)}org")
    assert [r.text for r in masked(spark, texts, key)] == want
    (r,) = masked(spark, ["de89370400440532013000"], "k")
    inside = feistel("370400440532013000", "iban", "k")
    check = 98 - int("".join(str(int(c, 36)) for c in inside + "DE00")) % 97
    assert r.text == f"de{check:02d}{inside}"


@pytest.mark.parametrize("spellings", [
    ["+358 40 1234567", "+358401234567", "+358-40-123-4567", "+358 (40) 1234567"], ["+33 1 42 68 53 00", "+33142685300", "+33 (1) 42 68 53 00"], ["+44 20 7946 0958", "+442079460958"],
    ["+1 (212) 555-0199", "(212) 555-0199", "212.555.0199", "+12125550199", "+1 212 555 0199"], ["+7 495 123 45 67", "+74951234567"],
    ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "gb82 west 1234 5698 7654 32", "Gb82 West 1234 5698 7654 32 and more text"], ["John.Doe@Example.org", "john.doe@example.org", "JOHN.DOE@EXAMPLE.ORG"],
    ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111", "4111.1111.1111.1111"],
])
def test_all_spellings_of_a_value_get_one_pseudonym(spark, spellings):
    got = [r.text for r in masked(spark, spellings)]
    plain = {re.sub(r"[^a-z0-9@]", "", t.lower().replace(" and more text", "")) for t in got}
    known = {p[-10:] if spellings[0].startswith("+1 ") else p for p in plain}
    assert len(known) == 1 and not any(a == b for a, b in zip(got, spellings, strict=True))
    assert [re.sub(r"[a-z]", "x", re.sub(r"[0-9]", "9", re.sub(r"[A-Z]", "X", t))) for t in got] == [re.sub(r"[a-z]", "x", re.sub(r"[0-9]", "9", re.sub(r"[A-Z]", "X", t))) for t in spellings]
    if spellings[0].startswith("+"):
        code = re.match(r"\+\d+", spellings[0])[0]
        assert all(t.startswith(code) for t, s in zip(got, spellings, strict=True) if s.startswith("+"))


def test_trunk_zeros_marked_letters_and_more_dates(spark):
    a, b, c, d = (r.text for r in masked(spark, ["+44 20 7946 0958", "+44 (0)20 7946 0958", "+44 (020) 7946 0958", "+39 (06) 6982 0000"]))
    assert b == a.replace("+44 ", "+44 (0)") and c == f"+44 (0{a[4:6]}) {a[7:]}" and re.fullmatch(r"\+39 \(\d\d\) \d{4} \d{4}", d) and d != "+39 (06) 6982 0000"
    mails = ["jürgen@müller.example.com", "JÜRGEN@Müller.example.com", "josé.garcía@example.es", "jurgen@muller.example.com", "请联系zhang@example.com"]
    got = masked(spark, mails)
    assert [r.n_email for r in got] == [1] * 5 and got[0].text.lower() == got[1].text.lower() and got[0].text.split("@")[0].upper() == got[1].text.split("@")[0]
    assert all(m[0] != t.text[0] or not m[0].isascii() for m, t in zip(mails, got, strict=True)) and got[4].text.startswith("请联系")
    for m, t in zip(mails[:4], got, strict=False):
        marked = lambda x: re.sub(f"[{pii.MARKED}]", "é", re.sub("[a-z]", "x", x.lower().rsplit(".", 1)[0]))
        assert marked(m) == marked(t.text)
    assert got[0].text == feistel("jürgen", "email", "k") + "@" + feistel("müller.example.", "domain", "k") + "com"
    (known,) = masked(spark, ["1999-12-31"])
    y, m, d = known.text.split("-")
    dates = masked(spark, ["31-12-1999", "1999/12/31", "31.12.1999", "12-31-1999", "1.2.2020", "01.02.2020", "12.13.14.15 2020/13/01 1-2-34", "v1.2.2020 555-12-31-1999"])
    assert [r.text for r in dates[:4]] == [f"{d}-{m}-{y}", f"{y}/{m}/{d}", f"{d}.{m}.{y}", f"{m}-{d}-{y}"]
    assert [int(x) for x in dates[4].text.split(".")] == [int(x) for x in dates[5].text.split(".")] and dates[4].text != "1.2.2020"
    assert [r.n_date for r in dates] == [1] * 6 + [0, 0] and dates[7].text == "v1.2.2020 555-12-31-1999"


def test_pii_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = pii.pseudonymise(df, "k")
    assert out.count() == 0 and out.columns == ["doc_id", "text", *(f"n_{k}" for k in pii.KINDS)]


def test_pii_plan_is_native(spark):
    plan = pii.pseudonymise(spark.createDataFrame([("a",)], "text string"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("Scan ExistingRDD")[0]


def naive_overlaps(items, doc, min_words, min_identity):
    """By comparing words at every place of every item, without hashes."""
    words = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", t).lower().split()
    d, out = words(doc), set()
    for i, text in items:
        w = words(text)
        masks = [[k for k, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS] if len(w) >= 11 else [list(range(len(w)))]
        for diagonal in range(-len(w) + 1, len(d)):
            same = [0 <= j + diagonal < len(d) and w[j] == d[j + diagonal] for j in range(len(w))]
            inside = [0 <= j + diagonal < len(d) for j in range(len(w))]
            covered = -1
            for j in range(len(w)):
                if j < covered or not any(j + m[-1] < len(w) and all(same[j + p] for p in m) for m in masks):
                    continue
                points = [1 if s else -2 for s in same]
                ends = [e for e in range(j + 1, len(w) + 1) if all(inside[j:e])]
                end = max(ends, key=lambda e: (sum(points[j:e]), -e))
                begin = max([b for b in range(j + 1) if all(inside[b:j])], key=lambda b: (sum(points[b:j]), b))
                covered = end
                if end - begin >= min(min_words, len(w)) and sum(same[begin:end]) >= min_identity * (end - begin):
                    out.add((i, begin, begin + diagonal, end - begin, sum(same[begin:end])))
    return out


def test_overlaps_equal_brute_force():
    rng = random.Random(11)
    for _ in range(40):
        items = [(i, " ".join(rng.choices("a b c d e f".split(), k=rng.choice([4, 7, 12, 18, 25])))) for i in range(5)]
        parts = []
        for _ in range(4):
            w = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "z"
            parts.append(" ".join(w[rng.randint(0, 2) :]) + " " + " ".join(rng.choices("p q r".split(), k=4)))
        doc = ", ".join(parts)
        got = {(h["item_id"], h["item_start"], h["doc_start"], h["n_words"], h["n_equal"]) for h in decontaminate.SeedIndex.of(items).overlaps(doc, 8, 0.7)}
        assert got == naive_overlaps(items, doc, 8, 0.7)


@pytest.mark.parametrize("tag", ["article", "main", "div", "section"])
def test_articles_of_the_small_table_equal_what_stands_in_their_tags(tag):
    """Whatever the element is called: the points alone find it."""
    import html
    from pathlib import Path

    import pandas as pd

    place = Path("/root/testdata/sf0.001/pages.parquet")
    if not place.exists():
        pytest.skip("no driver tables")
    for page in pd.read_parquet(place).html.dropna():
        inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h\d|ul|li|div|blockquote)[^>]*>", inside)]
        assert html_text.main_text(page.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag}>")) == "\n".join(p for p in parts if p)


def test_points_equal_brute_force():
    """By the definition: for each block the sum over all paragraphs below it of their points, halved for each block between."""
    rng = random.Random(6)
    words = "some words, and others, that stand in a text; in no order, " * 20
    for _ in range(60):
        def make(depth):
            if depth == 0 or rng.random() < 0.2:
                k = rng.randrange(200)
                return f"<p>{words[k : k + rng.choice([5, 20, 30, 150, 450])]}</p>"
            tag = rng.choice(["div", "section", "ul", "div class=content", "blockquote", "b", "td", "h2"])
            inner = "".join(make(depth - 1) for _ in range(rng.randint(1, 3)))
            return f"<{tag}>{inner if rng.random() < 0.8 else '<a href=x>' + words[:40] + '</a>' + inner}</{tag.split()[0]}>"

        root = html_text.parse("<body>" + "".join(make(4) for _ in range(3)) + "</body>")
        order = html_text._kept(root)
        html_text.score_tree(order)
        blocks = [x for x in order if x.tag in html_text._BLOCK]

        def block_around(x):
            x = x.parent
            while x.parent is not None and x.tag not in html_text._BLOCK:
                x = x.parent
            return x

        def whole(x, linked, inside=False):
            inside = inside or x.tag == "a"
            return sum((len(k.strip()) if inside or not linked else 0) if isinstance(k, str) else whole(k, linked, inside) for k in x.kids)

        want = {id(x): 0.0 for x in blocks}
        for x in blocks:
            if x.tag[0] == "h" and x.tag[1:].isdigit():
                continue
            t = " ".join(" ".join(html_text._direct(x)).split())
            points = t.count(",") + min(len(t) // 100, 3) + min(1, len(t) / 25)
            up = block_around(x)
            while up.parent is not None:
                want[id(up)] += points
                points, up = points / 2, block_around(up)
        for x in blocks:
            assert x.received == pytest.approx(want[id(x)])
            if want[id(x)] > 0:
                bonus = html_text._TAG_POINTS.get(x.tag, 0) + (15 if "content" in x.attrs else 0)
                assert x.score == pytest.approx((want[id(x)] + bonus) * (1 - whole(x, True) / max(whole(x, False), 1)))


@pytest.mark.parametrize("part, text", [
    ("<div class=footnotes><ol><li>The first note.</ol></div>", "The first note."), ("<fieldset><legend>Boxed</legend>A remark in a box.</fieldset>", "Boxed\nA remark in a box."),
    ("<section class=legal><p>On the law.</p></section>", "On the law."), ("<p>As <math><mi>x</mi><mo>=</mo><mn>2</mn></math> shows.</p>", "As x=2 shows."),
    ("<div class=disclaimer>Said without warranty.</div>", "Said without warranty."), ("<label>A label</label>", "A label"), ("<p>Short.</p>", "Short."),
    ("<form><p>Write to us, today, by this form.</p></form><button>Send</button>", ""), ("<svg><text>drawn</text></svg>", ""),
])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<div>{}</div>"])
def test_parts_of_an_article(part, text, around):
    assert html_text.main_text(around.format(BODY + part)) == WANT + ("\n" + text if text else "")


def test_deep_paragraphs_pass_points_to_all_around():
    deep = "<div>" * 9 + BODY + "</div>" * 9
    assert html_text.main_text(f"<body><div id=content><h1>Title</h1>{deep}</div><div class=sidebar><p>{'Aside, aside, aside, ' * 9}</p></div>") == "Title\n" + WANT


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "<p>x" * 1000, "<b>" * 100_000 + "</i>" * 100_000, "<b><div>" * 100_000 + "</b>" * 100_000, "<li><b>" * 100_000, "<table><tr><td>" * 50_000, "<div>" * 100_000 + "x"])
def test_deep_pages_take_seconds(page):
    import time

    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 20


def test_masks_hit_every_pattern_of_the_rule():
    # any longer one has one of these inside: cut in two, one half is at least as equal
    for n, k in ((11, 2), (12, 3), (13, 3), (16, 4), (20, 5), (24, 6)):
        whole = (1 << n) - 1
        patterns = np.array([whole ^ sum(1 << p for p in gone) for gone in itertools.combinations(range(n), k)])
        hit = np.zeros(len(patterns), dtype=bool)
        for m in decontaminate.MASKS:
            for at in range(n - len(m) + 1):
                bits = int(m, 2) << at
                hit |= patterns & bits == bits
        assert hit.all(), (n, k)


@pytest.mark.parametrize("every", [4, 5, 6])
def test_evenly_spaced_substitutions_are_found(every):
    item = " ".join(WORDS[:60])
    doc = " ".join("other" if j % every == every - 1 else w for j, w in enumerate(item.split()))
    (found,) = decontaminate.SeedIndex.of([(1, item)]).overlaps("before " + doc + " after", 13, 0.75)
    assert found["doc_start"] == 1 and found["n_words"] in (59, 60) and found["n_equal"] == 60 - 60 // every


def has_overlap(item, doc, min_words, min_identity):
    """By all extents of all diagonals, without masks: such as begin and end with an equal word, or the whole item."""
    need = min(min_words, len(item))
    for diagonal in range(-len(item) + 1, len(doc)):
        lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
        same = [item[j] == doc[j + diagonal] for j in range(lo, hi)]
        if hi - lo == len(item) and sum(same) >= min_identity * len(item):
            return True
        at = [j for j, s in enumerate(same) if s]
        if any(b - a + 1 >= need and m - k + 1 >= min_identity * (b - a + 1) for k, a in enumerate(at) for m, b in enumerate(at) if m >= k):
            return True
    return False


def test_every_overlap_of_all_diagonals_is_judged():
    rng = random.Random(23)
    n = 0
    for _ in range(400):
        item = rng.choices(WORDS, k=rng.choice([11, 12, 13, 13, 16, 17, 20, 24, 40]))
        copy = [w if rng.random() > rng.choice([0.15, 0.25, 0.3]) else "other" for w in item]
        doc = rng.choices(WORDS, k=5) + copy[rng.choice([0, 0, 0, 2]) :] + rng.choices(WORDS, k=5)
        found = decontaminate.SeedIndex.of([(1, " ".join(item))]).overlaps(" ".join(doc), 13, 0.75, rest=True)
        assert bool(found) == has_overlap(item, doc, 13, 0.75), (item, doc)
        assert all(h["n_words"] >= min(13, len(item)) and h["n_equal"] >= 0.75 * h["n_words"] for h in found)
        n += bool(found)
    assert 100 < n < 300


def test_exact_runs_in_a_paraphrase_are_found():
    item = WORDS[:70]
    doc = [w if j % 19 < 13 else "other" for j, w in enumerate(item)]
    found = decontaminate.SeedIndex.of([(1, " ".join(item))]).overlaps(" ".join(doc), 13, 0.75, rest=True)
    assert sum(h["n_equal"] for h in found) == 52 and all(h["n_equal"] >= 0.75 * h["n_words"] for h in found)


LONG = "".join(f"<p>{'Words of the text, of which there are many, ' + 'and more of them ' * 9}{i}.</p>" for i in range(5))
SHORT = "<section><p>A short paragraph.</p></section><ul><li>one</li></ul><table><tr><td>cell</td></tr></table><pre>code</pre><blockquote>said</blockquote>"


@pytest.mark.parametrize("page", ["<body><main>{}</main><footer>(c)</footer>", "<body><div class=content>{}</div>", "<body><div>{}</div>", "<body><div id=content><div>{}</div></div>"])
def test_short_parts_beside_the_best_stay(page):
    links = "<ul><li><a href=a>Another page</a></li><li><a href=b>And one more</a></li></ul>"
    got = html_text.main_text(page.format(f"<section>{LONG}</section>{SHORT}{links}")).split("\n")
    assert got[5:10] == ["A short paragraph.", "one", "cell", "code", "said"]


@pytest.mark.parametrize("part, text", [
    (f"<section id={i}><p>What others have done, and why, is told here.</p></section>", "What others have done, and why, is told here.") for i in ("related-work", "search-algorithms", "follow-the-money", "search", "comments-on-the-law")
] + [
    ("<p id=ad-hoc>Ad hoc networks form by themselves.</p>", "Ad hoc networks form by themselves."),
    ("<div class='recipe cookies'><p>Mix butter, sugar and flour.</p></div>", "Mix butter, sugar and flour."),
    ("<p>See <a href=r>the full report of the committee</a>.</p>", "See the full report of the committee."),
    ("<h2>Sources</h2><ul><li><a href=a>First source</a><li><a href=b>Second source</a></ul>", "Sources\nFirst source\nSecond source"),
    ("<div class=cookie-notice><p>We use cookies, and more, to please you.</p></div>", ""), ("<div class='comments-area post-comments'><p>Nice, thanks, and so on.</p></div>", ""),
    ("<section class=related><ul><li><a href=x>Another story</a></ul></section>", ""), ("<div id=share-buttons><a href=x>Share this</a></div>", ""),
    ("<div class='ad css-1x2y3z'><p>Buy this, now, or never.</p></div>", ""), ("<div class='widget widget_categories'><a href=q>All</a> <a href=r>None</a></div>", ""),
])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<article><div>{}</div></article>", "<main><section>{}</section></main>", "<div>{}</div>"])
def test_names_and_links_need_evidence(part, text, around):
    assert html_text.main_text(around.format(BODY + part)) == WANT + ("\n" + text if text else "")


def test_second_articles_teasers_and_wrappers():
    second = BODY.replace("story", "other story")
    both = f"<main><article>{BODY}</article><article>{second}</article><article><a href=x>A teaser, with a link</a></article></main>"
    assert html_text.main_text(both) == WANT + "\n" + WANT.replace("story", "other story")
    assert html_text.main_text(f"<div class=widget><article>{BODY}</article></div>") == WANT
    assert html_text.main_text(f"<div class=related-stories><p>Read this, and that, and more.</p></div><article>{BODY}</article>") == WANT


def test_text_two_levels_away_without_a_landmark():
    far = BODY.replace("Paragraph", "Chapter")
    page = f"<body><div>Site name</div><div><div><div>{BODY}</div></div></div><div><ul><li><a href=x>Home, sweet home</a><li><a href=y>Away, far away</a></ul></div><div><div>{far}</div></div><div>All rights reserved</div>"
    assert html_text.main_text(page) == WANT + "\n" + WANT.replace("Paragraph", "Chapter")


def test_dates_with_slashes(spark):
    got = masked(spark, ["25/12/1999", "12/25/1999", "1999-12-25", "32/12/1999 12/32/1999", "né le 25/12/1999."])
    assert [r.n_date for r in got] == [1, 1, 1, 0, 1] and got[3].text == "32/12/1999 12/32/1999"
    y, m, d = got[2].text.split("-")
    assert got[0].text == f"{d}/{m}/{y}" != "25/12/1999" and got[1].text == f"{m}/{d}/{y}" and got[4].text == f"né le {d}/{m}/{y}."
