import zlib

import numpy as np
import pytest

from quarry.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def _measures(spark, name, column):
    s = getattr(queries, name)(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    return s, s.merge(labels, on="doc_id")[["held_out", "score", "predicted", column]].dropna()


@pytest.mark.parametrize("name, column, folds, fold", [("op3_toxicity", "toxic", 4, 2), ("op8_quality", "quality", 5, 0)])
def test_held_out_accuracy(spark, name, column, folds, fold):
    s, m = _measures(spark, name, column)
    assert len(s) == 1000 and s.score.between(0, 1).all() and ((s.score >= 0.3) == (s.predicted == 1)).all()
    assert all((zlib.crc32(str(i).encode()) % folds == fold) == h for i, h in zip(s.doc_id, s.held_out, strict=True))
    held = m[m.held_out]
    assert (held.predicted == held[column]).mean() >= 0.92  # some markers of this small table stand in no training row
    assert held[held[column] == 1].score.mean() > held[held[column] == 0].score.mean() + 0.3


EDGE = [(1, "fine words"), (2, None), (3, ""), (4, "x " * 60_000), (1, "fine words"), (None, "fine words")]


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_edges(spark, module, label):
    df = spark.createDataFrame([(*r, 9.0, "l") for r in EDGE], "doc_id long, text string, score double, label string")
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    flat = module.score(df, module.fit(df, none)).collect()
    assert len(flat) == 6 and len({r.score for r in flat}) == 1 and 0 < flat[0].score < 1
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (41, None), (1, 0)], f"doc_id long, {label} int")
    docs = spark.createDataFrame([(i, "scum and trash " * 3 if i % 2 else "a calm and pleasant day") for i in range(40)], "doc_id long, text string")
    model = module.fit(docs, labels, folds=1, held_out=-1)
    got = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    assert min(got[i] for i in range(1, 40, 2)) > max(got[i] for i in range(0, 40, 2))
    out = module.score(df, model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.text == "fine words"}) == 1 and len({r.score for r in out if not r.text}) == 1
    assert module.score(df.limit(0), model).count() == 0


def test_log_count_ratio_sign():
    r = toxicity.log_count_ratios(np.array([[0.0, 5, 5], [5.0, 5, 0]]))
    assert r[0] > 0 and r[2] < 0 and abs(r[1]) < abs(r[0])


def test_pieces_of_a_long_text_give_the_same_features(monkeypatch):
    text = "some words that go on and on " * 50
    whole = toxicity.distinct_buckets(text, 16)
    monkeypatch.setattr(toxicity, "_PIECE", 100)
    assert (toxicity.distinct_buckets(text, 16) == whole).all()


def test_a_feature_counts_once():
    m = toxicity.Model(12, np.zeros(1 << 12, dtype=np.float32), 0.0)
    m.weight[toxicity.distinct_buckets("idiot", 12)] = 0.1
    assert toxicity.score_texts(iter(["idiot", "idiot idiot idiot"]), m)[0] == toxicity.score_texts(iter(["idiot  idiot"]), m)[0]


def test_quadratic_scores_are_the_gaussians():
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    x = np.concatenate([rng.normal(0, 1, (300, d)), rng.normal(1, 2, (300, d))])
    y = np.repeat([0, 1], 300)
    m = quality.train(x, y)
    z = (x[:5] - m.centre) / m.scale
    for i in range(5):
        log = []
        for k in (0, 1):
            cov = np.linalg.inv(m.factors[k].T @ m.factors[k])
            diff = z[i] - m.means[k]
            log.append(np.log(0.5) - 0.5 * diff @ np.linalg.inv(cov) @ diff - 0.5 * np.linalg.slogdet(cov)[1])
        assert m.scores(x[i : i + 1])[0] == pytest.approx(1 / (1 + np.exp(log[0] - log[1])), rel=1e-6)


def naive_grams(text):
    """Distinct n-grams inside a word, with the white space before and after it, by slicing."""
    t = "".join(" " if c.isspace() else c for c in f" {text.lower()} ")
    return {t[i : i + n] for n in toxicity.SIZES for i in range(len(t) - n + 1) if " " not in t[i + 1 : i + n - 1]}


def test_toxicity_equals_brute_force(spark):
    """Counts, ratios and selection by the definition, on the grams themselves; the regression by Newton's method."""
    rng = np.random.default_rng(3)
    calm, bad = "river stone walks gently under morning light".split(), "scum trash idiot moron".split()
    rows = [(i, " ".join(rng.choice(calm, 4)) + (" " + " ".join(rng.choice(bad, 2)) if i % 3 == 0 else "")) for i in range(60)]
    y = np.array([float(i % 3 == 0 or i in (7, 20)) for i in range(60)])  # two labels that the words don't tell
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, folds=1, held_out=-1)
    have = [naive_grams(t) for _, t in rows]
    grams = sorted(set().union(*have))
    assert len(grams) < 3000
    x = np.array([[g in h for g in grams] for h in have], dtype=float)
    c1, c0 = x[y == 1].sum(0), x[y == 0].sum(0)
    size = 1 << 19
    ratio = np.log((c1 + 1) / (c1.sum() + size)) - np.log((c0 + 1) / (c0.sum() + size))
    told = np.array([len({(v, k) for v, k in zip(x[:, j], y, strict=True)}) for j in range(len(grams))])
    keep = (told > 1) & (x.mean(0) < 1)
    z = x[:, keep] * ratio[keep]
    z1, w, n = np.concatenate([z, np.ones((60, 1))], axis=1), np.zeros(keep.sum() + 1), 60
    pull = np.eye(len(w)) / n
    pull[-1, -1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-z1 @ w))
        w = w - np.linalg.solve(z1.T @ (z1 * (p * (1 - p))[:, None]) / n + pull, z1.T @ (p - y) / n + pull @ w)
    want = 1 / (1 + np.exp(-z1 @ w))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.abs(np.array([got[i] for i in range(60)]) - want).max() < 0.06  # gradient descent stops a little before the minimum


def test_sparse_regression_does_not_depend_on_chunks():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(50, rng.integers(0, 12), replace=False)).astype(np.uint16) for _ in range(300)]
    y = np.array([float(len(r) and r[0] < 5) for r in rows])
    scale = rng.normal(0, 1, 50)
    one, many = (toxicity.logistic(rows, scale, y, chunk=c) for c in (1 << 18, 7))
    assert np.allclose(one[0], many[0], atol=1e-6) and abs(one[1] - many[1]) < 1e-6


def naive_statistics(text):
    """By the definitions, with plain Python."""
    import math

    data = (text or "").encode()
    n = len(data)
    share = lambda f: sum(map(f, data)) / max(n, 1)

    def logit(p):
        e = 0.5 / (max(n, 1) + 1)
        p = min(max(p, e), 1 - e)
        return min(max(math.log(p / (1 - p)), -5), 5)

    words = data.lower().split()
    m = len(words)
    counts = {w: words.count(w) for w in set(words)}
    neighbours = list(zip(words, words[1:], strict=False))
    lines = [x for x in data.split(b"\n") if x.strip()]
    white, marks = b" \t\n\x0b\x0c\r", b",.;:?!'-"
    entropy = -sum(c / n * math.log(c / n) for c in (data.count(bytes([b])) for b in set(data)))
    return [
        math.log1p(n), math.log1p(m), math.log1p((n - data.count(b" ")) / max(m, 1)), logit(share(lambda b: 65 <= b <= 90)), logit(share(lambda b: 48 <= b <= 57)), logit(share(lambda b: b in white)),
        logit(share(lambda b: b < 128 and not chr(b).isalnum() and b not in white and b not in marks)), logit(share(lambda b: b in marks)), logit(share(lambda b: b >= 128)),
        logit(len(counts) / m if m else 1.0), logit(sum(a == b for a, b in neighbours) / (m - 1) if m > 1 else 0.0), logit(len(set(neighbours)) / (m - 1) if m > 1 else 1.0),
        math.sqrt(max(counts.values()) / m) if m else 0.0, entropy, logit(len(set(lines)) / len(lines) if lines else 1.0), math.log1p(n / max(len(lines), 1)), logit(share(lambda b: b == 33)),
    ]


@pytest.mark.parametrize("text", [None, "", "   ", "one", "Two words, two Words!", "a line\na line\n\nanother LINE 123 #$%", "né à l'été — où?\n" * 40, "the " * 500, "Mixed 1,234.50 (figures) & marks; all: of-them?\n" * 7 + "end"])
def test_statistics_equal_brute_force(text):
    assert quality.statistics(text) == pytest.approx(naive_statistics(text), abs=1e-9)


def test_training_equals_brute_force():
    """Both shrinkages and the densities, from sums over rows."""
    import math

    rng = np.random.default_rng(5)
    d = len(quality.NAMES)
    x = np.concatenate([rng.normal(0, 1, (40, d)), rng.normal(0.7, 1.5, (25, d))]) * rng.uniform(0.5, 3, d) + rng.normal(0, 5, d)
    y = np.repeat([0, 1], [40, 25])
    pooled, ridge = 0.2, 0.1
    m = quality.train(x, y, pooled, ridge)
    n = len(x)
    centre = [sum(x[i][j] for i in range(n)) / n for j in range(d)]
    scale = [math.sqrt(sum((x[i][j] - centre[j]) ** 2 for i in range(n)) / n) + 1e-6 for j in range(d)]
    z = [[(x[i][j] - centre[j]) / scale[j] for j in range(d)] for i in range(n)]
    parts = [[z[i] for i in range(n) if y[i] == k] for k in (0, 1)]
    means = [[sum(r[j] for r in p) / len(p) for j in range(d)] for p in parts]
    raw = [[[sum((r[a] - mu[a]) * (r[b] - mu[b]) for r in p) / len(p) for b in range(d)] for a in range(d)] for p, mu in zip(parts, means, strict=True)]
    both = [[(40 * raw[0][a][b] + 25 * raw[1][a][b]) / n for b in range(d)] for a in range(d)]
    covs = []
    for c in raw:
        c = [[(1 - pooled) * c[a][b] + pooled * both[a][b] for b in range(d)] for a in range(d)]
        level = sum(c[a][a] for a in range(d)) / d
        covs.append(np.array([[(1 - ridge) * c[a][b] + ridge * level * (a == b) for b in range(d)] for a in range(d)]))
    for i in (0, 3, 50):
        log = []
        for k in (0, 1):
            diff = np.array(z[i]) - means[k]
            log.append(math.log(len(parts[k]) / n) - 0.5 * diff @ np.linalg.inv(covs[k]) @ diff - 0.5 * math.log(np.linalg.det(covs[k])))
        assert m.scores(x[i : i + 1])[0] == pytest.approx(1 / (1 + math.exp(min(log[0] - log[1], 700))), rel=1e-6)
