import itertools
import random

import numpy as np
import pytest

from quarry.llm import pieces
from quarry.llm.queries import MODEL_FILE


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(None, MODEL_FILE)


@pytest.fixture(scope="module")
def vocab(model):
    return pieces.Vocabulary(model)


def brute_force(vocab, text, n):
    """The scores of the n best of all segmentations."""
    full = vocab.prefix + text.replace(" ", pieces.MARK)

    def paths(at):
        if at == len(full):
            yield 0.0
            return
        known = [(e, vocab.piece[full[at:e]][1]) for e in range(at + 1, min(len(full), at + vocab.longest) + 1) if full[at:e] in vocab.piece]
        if not known or known[0][0] != at + 1:
            known.append((at + 1, vocab.unknown_score))
        for e, s in known:
            for rest in paths(e):
                yield s + rest

    return sorted(paths(0), reverse=True)[:n]


TEXTS = ["the cat", "hello", "a  b", " lead", "tail ", "x\ny", "\n", "ñandú", "日本 x", "ab\n\n c", "a \n b", "😀", "\0a b", "to be or", "aaaaaaaa"]


@pytest.mark.parametrize("text", TEXTS)
def test_n_best_equals_brute_force(vocab, text):
    got = next(vocab.n_best([vocab.chunks(text)], 6))
    assert [s for s, _ in got] == brute_force(vocab, text, 6)
    assert len({ids.tobytes() for _, ids in got}) == len(got)
    assert all(vocab.decode(ids) == text for _, ids in got)


def test_random_texts(vocab):
    rng = random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice("abeht \n") for _ in range(rng.randint(1, 9)))
        got = next(vocab.n_best([vocab.chunks(text)], 4))
        assert [s for s, _ in got] == brute_force(vocab, text, 4), repr(text)
        assert all(vocab.decode(ids) == text for _, ids in got)


def test_same_as_the_library(vocab, model):
    spm = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = 1
    lib = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for text in ("The onlyer reonin, and theronon", "of the people by the people", "Quantum tunnelling"):
        got = next(vocab.n_best([vocab.chunks(text)], 5))
        want = [sum(proto.pieces[i].score for i in ids) for ids in lib.nbest_encode(text, nbest_size=5)]
        assert [s for s, _ in got] == want


def test_many_words_at_once_equal_one_by_one(vocab):
    words = ["".join(w) for w in itertools.product("aehinorst", repeat=4)][:600]
    texts = [vocab.chunks(w) for w in words]
    for w, got in zip(words, vocab.n_best(texts, 2), strict=True):
        best, cost, ids = vocab._forward_one(pieces.MARK + w)
        assert (got[0][0], got[0][1].tobytes()) == (best, ids) and (len(got) < 2 or got[1][0] == best - cost)


def test_cache_is_bounded_and_long_words_work(model):
    v = pieces.Vocabulary(model, cache_words=10)
    long = "x" * 3000
    for text in (" ".join(f"w{i}" for i in range(50)), long, "a b"):
        got = next(v.n_best([v.chunks(text)], 3))
        assert v.decode(got[0][1]) == text
    assert len(v.cache) <= 12


def test_frames(spark, model):
    rows = [(1, "the cat", 7), (2, None, 7), (3, "", 7), (4, "a " * 40_000, 7), (1, "the cat", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = pieces.encode(df, model, n_best=2)
    assert out.columns == ["doc_id", "text", "n_tokens", "token_ids", "n_best"]
    back = pieces.decode(out.drop("text"), model).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i, t or "") for i, t, _ in rows)
    d = pieces.encode_digests(df, model, 2).collect()
    assert all(r.round_trip for r in d) and {r.doc_id: r.n_segmentations for r in d}[3] == 1
    assert pieces.encode(df.limit(0), model).count() == 0


def test_mark_decodes_as_a_space(vocab):
    got = next(vocab.n_best([vocab.chunks("a▁b")], 1))
    assert vocab.decode(got[0][1]) == "a b"
    assert isinstance(got[0][1], np.ndarray)
