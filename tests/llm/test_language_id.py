import random

import numpy as np
import public_tokenizers as P
import pytest

from callgrain.llm import language_id as m

PATH = P.path("piece_bpe_32k.model")


def by_enumeration(word, prob):
    """The sum over all segmentations, one by one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    vocabulary = sorted({p.lower() for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and len(p := model.id_to_piece(i)) <= 16})
    index = {w: i for i, w in enumerate(vocabulary)}

    def total(rest):
        if not rest:
            return 1.0
        out = 0.0
        for n in range(1, len(rest) + 1):
            i = index.get(rest[:n], len(vocabulary) if n == 1 else None)
            if i is not None:
                out += prob[i] * total(rest[n:])
        return out

    return total(word)


def test_forward_sums_all_segmentations_and_backward_agrees():
    size = len(m.pieces(PATH)[0]) + 1
    prob = np.random.default_rng(1).random((size, 2)) / 50
    for word in ("▁the", "▁ü", "▁interé", "a"):
        lat = m.lattice([word], PATH)
        got = m.forward(lat, prob)[0, -1]
        assert got == pytest.approx([by_enumeration(word, prob[:, 0]), by_enumeration(word, prob[:, 1])])
        assert m.backward(lat, prob)[0, 0] == pytest.approx(got)


def test_long_words_are_summed_whole(monkeypatch):
    size = len(m.pieces(PATH)[0]) + 1
    prob = np.random.default_rng(2).random((size, 2)) / 50
    words = ["▁donaudampfschifffahrtsgesellschaftskapitän", "▁日本語の文章を書く", "▁the"]
    for stretch in (8192, 7):  # in one look-up, or over many stretches
        monkeypatch.setattr(m, "STRETCH", stretch)
        for w in words:
            want = np.log(m.forward(m.lattice([w], PATH), prob)[0, -1])
            assert m.log_sums(w, m.with_none(prob), PATH) == pytest.approx(want)
            assert m.log_likelihoods([w], prob, PATH)[0] == pytest.approx(want)
        long, short = np.zeros(size), np.zeros(size)
        m.expected_of_long(words[0], 2.0, prob[:, :1], PATH, long)
        with monkeypatch.context() as c:
            c.setattr(m, "LONGEST", 100)
            short = m.expected([words[0]], np.array([2.0]), prob[:, :1], PATH)
        assert long == pytest.approx(short, abs=1e-9)
    far = m.log_likelihoods(["▁" + "the" * 5000], prob, PATH)[0]  # no underflow
    assert np.isfinite(far).all() and far.max() < -5000


def test_expected_counts_weigh_each_segmentation():
    size = len(m.pieces(PATH)[0]) + 1
    prob = np.full((size, 1), 1 / size)
    x = m.expected(["ab"], np.array([3.0]), prob, PATH)
    # "a" + "b", or "ab" where the vocabulary has it: shares of the sum
    assert x.sum() == pytest.approx(3 * (2 / size**2 + 1 / size) / (1 / size**2 + 1 / size))


def test_predictions_and_edge_cases(spark):
    r = random.Random(5)
    vocab = {"en": "the of and with this that from house".split(), "de": "der die und nicht mit ist haus eine".split()}
    rows = [(i, lang := r.choice(["en", "de"]), " ".join(r.choice(vocab[lang]) for _ in range(r.randint(3, 40)))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, lang string, text string")
    model = m.fit(df.where("id < 100").selectExpr("lang", "text", "id as key"), PATH)
    assert model.langs == ["de", "en"]
    odd = spark.createDataFrame([(900, None, None), (901, "en", ""), (902, None, "123 !!"), (903, "de", "Die " * 30000), (904, None, "X" * 5000)], "id long, lang string, text string")
    got = {x.id: x for x in m.predict(df.unionByName(odd).selectExpr("id", "text", "5 as score"), model).collect()}
    assert all(got[i].lang_pred == lang for i, lang, _ in rows)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == "de" and 0 <= got[904].score <= 1
    assert m.predict(df.select("id", "text").limit(0), model).count() == 0
    none = m.fit(df.limit(0).selectExpr("lang", "text", "id as key"), PATH)
    assert {x.lang_pred for x in m.predict(df.select("id", "text"), none).collect()} == {"und"}
