import random
import re

import numpy as np
import pytest

from callgrain.llm import ngram_join as m


def brute(rows, width, percent):
    sets = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    ids = [d for d, _ in rows]
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and ids[i] is not None and ids[j] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in zip(ids, sets)), key=str)


def texts(seed, n):
    r = random.Random(seed)
    words = [r.choice("abcdefgh") * r.randint(1, 4) + str(r.randint(0, 40)) for _ in range(150)]
    out = []
    bases = [[r.choice(words) for _ in range(r.choice([1, 2, 3, 12, 40, 90]))] for _ in range(6)]
    for _ in range(n):
        b = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2])):
            b[r.randrange(len(b))] = r.choice(words)
        if r.random() < 0.1:
            b += ["tail"] * r.randint(1, 3)
        out.append(r.choice([" ", "\n", "\t "]).join(b).upper() if r.random() < 0.2 else " ".join(b))
    return out


@pytest.mark.parametrize("seed,lists", [(1, 64), (2, 3), (3, 2)])
def test_against_brute_force(spark, monkeypatch, seed, lists):
    monkeypatch.setattr(m, "LIST", lists)
    rows = list(enumerate(texts(seed, 120))) + [(500, None), (501, ""), (502, " \n"), (None, "a b c d"), (503, "é x  y z"), (504, "e x y z")]
    df = spark.createDataFrame([(d, t, "extra", 1) for d, t in rows], "doc_id long, text string, n string, key int").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in m.ngram_join(df).collect()), key=str)
    assert got == brute(rows, 3, 90)


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (5, "a b c d e"), (5, "x y z"), (3, "x y z"), (5, "x y z")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in m.ngram_join(df).collect()} == {(1, 1), (5, 1), (3, 1)}
    assert m.ngram_join(df.limit(0)).count() == 0


def test_near_copies_with_indents_at_some_places(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    rows = []
    for d in range(60):
        base = [r.choice(words) for _ in range(62)]
        copy = list(base)
        copy[r.randrange(len(copy))] = "changed"
        places = set(range(10, len(copy), 10)) if d % 2 else {r.randrange(1, len(copy)) for _ in range(6)}
        rows += [(2 * d, " ".join(base)), (2 * d + 1, "".join(("\n        " if i in places else " ") + w for i, w in enumerate(copy)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 3, 90)
    assert sum(c == d - 1 for d, _, c in want) == 60  # each copy links with its original
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in m.ngram_join(df, width=3, percent=90).collect()), key=str) == want


def test_a_shingle_has_one_length_in_every_text():
    one, two = m.shingles([b"aa b ccc d", b"aa\n        b ccc\t d"], 3)
    assert one[0].tolist() == two[0].tolist() and one[1].tolist() == two[1].tolist() and sorted(one[1].tolist()) == [5, 6]


def shuffled(spark):
    """Bytes that the session has written to shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = context.statusStore().stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_sets_of_pairs_that_cannot_link_are_not_moved(spark, monkeypatch):
    monkeypatch.setattr(m, "frequency_levels", lambda docs, width: np.zeros(m.SKETCH, np.uint8))
    r = random.Random(5)
    words = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    shared = [["".join(r.choice("abcdefgh") for _ in range(20)) for _ in range(6)] for _ in range(41)]
    rows = [(d, " ".join(shared[d] + [r.choice(words) for _ in range(2000)] + shared[d + 1])) for d in range(40)]
    rows.append((40, rows[39][1].replace(" a", " b", 20)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        before = shuffled(spark)
        got = m.ngram_join(df, width=5, percent=80).collect()
        moved = shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = brute(rows, 5, 80)
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == want and (40, 39) in {(d, c) for d, _, c in want}
    assert 0 < moved < 16 * sum(n for _, n, _ in want), moved  # texts and postings; moving the sets for every pair takes four times all sets


def test_fine_parities_differ_in_no_more_places_than_sets_in_elements():
    r = np.random.default_rng(3)
    for n, k in ((513, 0), (600, 40), (1000, 200), (1100, 30), (3000, 2400)):
        x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[: len(x) - k // 2], r.integers(0, 2**63, 2 * k, dtype=np.uint64)]))
        bits = [np.unpackbits(np.frombuffer(m._fine(z), np.uint8)) for z in (x, y)]
        differ, most = m._parted(*bits), len(np.setxor1d(x, y))
        assert differ == m._parted(*bits[::-1]) and (differ > 0) == (most > 0) and differ <= most and (most - differ) % 2 == 0
    assert m._fine(x[:512]) is None
