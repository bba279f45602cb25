import numpy as np
import pytest

from callgrain.llm import topk as m


def brute(rows, k, every):
    ok = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    queries = {}
    for i, v in ok:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    for q, a in queries.items():
        found = sorted(((sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q), key=lambda x: (-x[0], x[1]))[:k]
        out += [(q, r, i, s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("queries,bins", [(8192, 256), (5, 7)])
def test_against_brute_force(spark, monkeypatch, queries, bins):
    monkeypatch.setattr(m, "QUERIES", queries)
    monkeypatch.setattr(m, "BINS", bins)
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    rows += [(i, [0.5] * 8) for i in range(150, 260)]  # ties over many rows
    rows += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (304, [1.0, 2.0]), (None, [1.0] * 8), (151, [0.5] * 8), (40, [9.0] * 8), (305, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = m.top_k(df, df.where("vec_id % 10 = 0"), k=5)
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got.collect()) == brute(rows, 5, 10)


def test_few_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0]), (21, [2.0, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in m.top_k(df, df.where("vec_id = 20")).collect()] == [(20, 1, 21, 64 * 64 * 2 + 32 * 128)]
    assert m.top_k(df, df.limit(0)).count() == m.top_k(df.limit(0), df.limit(0)).count() == 0


def test_scores_beyond_doubles():
    q, c = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [2.0**30, 0.0]])
    assert m.scores(q, c).tolist() == [[2**60 + 3, 2**63 - 1]]
