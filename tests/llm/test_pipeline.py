import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quarry.llm import pieces, queries  # noqa: E402

from .test_lines import brute_force as lines_left  # noqa: E402
from .test_near_dedup import brute_force as components  # noqa: E402
from .test_pieces import brute_force as segmentations  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_on_a_small_table(spark):
    docs = queries.table(spark, SF, "documents")
    f = dict(corpus_pipeline.STAGES)
    assert len(f) == 5
    calm = f["toxicity"](spark, docs, SF)
    assert calm.columns == docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in queries.table(spark, SF, "labels").filter("toxic = 1").collect()}
    kept = {r.doc_id for r in calm.collect()}
    assert len(toxic - kept) >= 0.9 * len(toxic) and len(kept) >= 0.8 * len(before)

    lines = f["line dedup"](spark, calm, SF)
    want = lines_left([(i, before[i]) for i in kept])
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.collect()}
    assert got == {i: (t, len(t)) for i, t in want.items() if t.strip() or t == before[i]} and lines.columns == docs.columns

    near = f["near dedup"](spark, lines, SF)
    part = components([(i, t) for i, (t, _) in got.items()], 5, 80)
    assert {r.doc_id for r in near.collect()} == {i for i in part if part[i] == i}

    clean = f["decontamination"](spark, near, SF)
    assert clean.columns == docs.columns and clean.count() <= near.count()
    text = {r.doc_id: r.text for r in clean.collect()}
    bench = [" ".join(r.text.lower().split()) for r in queries.table(spark, SF, "benchmark").collect()]
    assert not any(b in " ".join((t or "").lower().split()) for t in text.values() for b in bench)

    out = f["pieces"](spark, clean, SF)
    back = pieces.decode(out, pieces.read_model(spark, queries.MODEL_FILE)).collect()
    assert {r.doc_id: r.text for r in back} == text and all(r.n_tokens == len(r.token_ids) for r in back)


EDGE = [(1, "some fine words of a document", "en", "web", 29), (2, None, "en", "web", None), (3, "", "en", "web", 0), (4, "many words " * 30_000, "en", "web", 330_000), (5, "another text, quite unlike the first", None, None, 36), (5, "another text, quite unlike the first", None, None, 36), (None, "a text without an id", "en", "web", 20)]
NAMES = ("_score", "_lines", "_dropped", "_overlaps", "_id", "_hash", "_text", "score", "grp", "key")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_edges_of_the_stages(spark, name):
    f = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame([(*r, *range(len(NAMES))) for r in EDGE], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in NAMES))
    out = f(spark, docs, SF)
    rows = out.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in EDGE)
    if name != "pieces":
        assert out.columns == docs.columns and all(tuple(r)[5:] == tuple(range(len(NAMES))) for r in rows)
        assert {r.doc_id: r.text for r in rows} == {r[0]: r[1] for r in EDGE}
    else:
        assert {r.doc_id: r.n_tokens for r in rows if r.doc_id in (2, 3)} == {2: 0, 3: 0}
    assert f(spark, docs.limit(0), SF).count() == 0


def test_run_is_its_stages(spark):
    """By calling the stages one after the other, kept in memory."""
    docs = queries.table(spark, SF, "documents")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF).cache()
        docs.count()
    want = sorted((r.doc_id, r.n_tokens, tuple(r.token_ids)) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens, tuple(r.token_ids)) for r in corpus_pipeline.run(spark, SF).collect()) == want and len(want) > 50


def test_pieces_are_the_n_best(spark):
    """The last stage took the forward pass only, and gave one segmentation."""
    vocab = pieces.Vocabulary(pieces.read_model(None, queries.MODEL_FILE))
    docs = spark.createDataFrame([(1, "the cat"), (2, "a \n b"), (3, "日本 x"), (4, ""), (5, None)], "doc_id long, text string")
    for (i, text), r in zip(docs.collect(), sorted(corpus_pipeline.encode(spark, docs, SF).collect()), strict=True):
        assert r.doc_id == i and [x.score for x in r.n_best] == segmentations(vocab, text, 3) if text else len(r.n_best) == 1
        assert r.token_ids == r.n_best[0].ids and all(vocab.decode(np.array(x.ids, dtype=np.int32)) == (text or "") for x in r.n_best)
