import random

import numpy as np
import pytest

from callgrain.llm import toxicity as m


def make(n, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("bcdefghl") + r.choice("aeo") for _ in range(r.randint(1, 3))) for _ in range(200)]
    rows = []
    for i in range(n):
        toxic = int(r.random() < 0.25)
        w = [r.choice(words) for _ in range(r.randint(25, 60))]
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["blork", "snarf", "zanzig" + r.choice(words), "idiot"]))
        rows.append((i, " ".join(w), toxic if r.random() > 0.03 else 1 - toxic, toxic))
    return rows


def test_held_out_accuracy_and_edge_cases(spark):
    rows = make(900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, *_ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows if i % 3] + [(9000, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    model = m.fit(labels, docs)
    got = {r.doc_id: r for r in m.score(docs, model).collect()}
    held = [(truth, got[i].predicted) for i, _, _, truth in rows if i % 3 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "BLORK snarf"), (3, "word " * 60000), (3, "word " * 60000)], "doc_id long, text string")
    out = m.score(odd, model).collect()
    assert len(out) == 5 and [r.predicted for r in out if r.doc_id in (1, 2)] == [0, 0]
    assert m.score(docs.limit(0), model).count() == 0


def test_without_labels_the_word_list_speaks(spark):
    docs = spark.createDataFrame([(1, "you idiot, you stupid moron"), (2, "good day")], "doc_id long, text string")
    model = m.fit(spark.createDataFrame([], "doc_id long, toxic int"), docs)
    assert [r.predicted for r in m.score(docs, model).orderBy("doc_id").collect()] == [1, 0]


def drawn(n=20000, seed=3):
    """Classes and votes of three voters that only the class ties together, one that follows the third nine times of ten, and a copy of the first."""
    r = np.random.default_rng(seed)
    y = (r.random(n) < 0.3).astype(int)
    one = [np.where(r.random(n) < rate[y], 1, 0) for rate in (np.array([0.05, 0.9]), np.array([0.1, 0.7]), np.array([0.2, 0.6]))]
    one.append(np.where(r.random(n) < 0.9, one[2], r.integers(0, 2, n)))
    return y, np.stack([*one, one[0]], axis=1)


def test_label_model_against_bayes():
    y, v = drawn()
    patterns, at = np.unique(v, axis=0, return_inverse=True)
    at = at.ravel()
    gold = np.zeros((len(patterns), 2))
    np.add.at(gold, (at[:4000], y[:4000]), 1)
    got = m.label_model(patterns, np.bincount(at).astype(float), gold)
    # the follower and the copy say nothing that their parents don't say
    odds = np.full(len(patterns), np.log(0.3 / 0.7))
    for j, (clean, toxic) in enumerate(((0.05, 0.9), (0.1, 0.7), (0.2, 0.6))):
        odds += np.where(patterns[:, j] == 1, np.log(toxic / clean), np.log((1 - toxic) / (1 - clean)))
    assert np.abs(got.posterior(patterns) - 1 / (1 + np.exp(-odds)))[np.bincount(at) > 50].max() < 0.1
    assert {(0, 4), (2, 3)} <= {tuple(sorted((j, int(u)))) for j, u in enumerate(got.parent) if u >= 0}
    assert got.share == pytest.approx(0.3, abs=0.05)


def test_posterior_by_the_sum_over_classes():
    r = np.random.default_rng(1)
    labels = m.Labels(0.2, r.uniform(0.05, 0.95, (2, 4, 2)), np.array([-1, 0, 1, -1]))
    patterns = np.array([[a, b, c, d] for a in (0, 1) for b in (0, 1) for c in (0, 1) for d in (0, 1)])
    for x, p in zip(patterns, labels.posterior(patterns), strict=True):
        joint = []
        for c in (0, 1):
            q = (0.8, 0.2)[c]
            for j, u in enumerate(labels.parent):
                fires = labels.fires[c, j, x[u] if u >= 0 else 0]
                q *= fires if x[j] else 1 - fires
            joint.append(q)
        assert p == pytest.approx(joint[1] / sum(joint))


def test_classifier_against_dense_newton_steps():
    r = np.random.default_rng(5)
    dense = r.random((300, 12)) * (r.random((300, 12)) < 0.3)
    y = 1 / (1 + np.exp(-(dense @ r.normal(size=12) * 3 - 0.5)))
    w, bias = m.train_linear(m.Sparse(*np.nonzero(dense), dense[np.nonzero(dense)]), 300, 12, y)
    p = 1 / (1 + np.exp(-(dense @ w + bias)))
    # the slope of the penalised likelihood is nil there
    assert np.abs(dense.T @ (y - p) - 2.0 * w).max() < 1e-3 and abs((y - p).sum()) < 1e-3


def test_vectors_are_the_counts_of_a_plain_reading():
    words = ["idiot", "moron"]
    hashes = np.unique(m._hash_words(words))
    lexicon = m.Lexicon(hashes, np.full(2, 2.0), np.zeros(2, np.int64))
    place = {w: int(np.searchsorted(hashes, m._hash_words([w])[0])) for w in words}
    x = m.vectors([b"idiot moron idiot", b"", b"a moron! A day"], lexicon)
    got = {(int(r), int(c)): float(v) for r, c, v in zip(*x, strict=True)}
    shouts = 2 + len(m.VOTERS) + 1
    want = {(0, place["idiot"]): 1, (0, place["moron"]): 1, (0, 2): np.log(4), (2, place["moron"]): 1, (2, 2): np.log(2), (2, shouts - 1): 1 / 20, (2, shouts): 1 / 4}
    assert got == pytest.approx(want) and list(x.rows) == sorted(x.rows)


def test_voters():
    lexicon = m.Lexicon(*(lambda h: (h, np.full(len(h), 2.0), np.zeros(len(h), np.int64)))(np.unique(m._hash_words(["idiot"]))))
    texts = ["You idiot", "idiot " + "word " * 400, "STOP THAT RIGHT NOW YOU", "no! no! no!", "what the f**k", "so stuuupid", "### head ###", "", "a" * 9]
    told = [[m.VOTERS[j] for j in np.flatnonzero(row)] for row in m.votes([t.encode() for t in texts], lexicon)]
    assert told == [["insults_en"], [], ["capitals"], ["shouts"], ["masked"], ["stretched"], [], [], ["stretched"]]


def test_classifier_learns_from_votes_and_not_from_labels(spark):
    rows = make(900)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    # a document without any vote that is labelled toxic stays clean, as does its copy
    plain = " ".join(["gentle", "meadow", "river"] * 9)
    more = docs.unionByName(spark.createDataFrame([(5000, plain), (5001, plain)], "doc_id long, text string"))
    model = m.fit(spark.createDataFrame([(i, y) for i, _, y, _ in rows] + [(5000, 1)], "doc_id long, toxic int"), more)
    assert {r.predicted for r in m.score(more, model).where("doc_id >= 5000").collect()} == {0}
    assert model.accuracies["insults_en"] > 0.8 and any(v.startswith("words_") for v in model.accuracies)
    assert all(-1 <= c <= 1 for c in model.correlations.values())
