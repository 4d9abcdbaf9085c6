import math

import numpy as np
import pytest
from tabwatch.llm import hnsw as H


def exact(rows, k, every):
    """{query id: [(score, vec_id)]} by comparing all."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    out = {}
    for i, q in good.items():
        if i % every == 0:
            s = sorted((-float(q @ v / (np.linalg.norm(q) * np.linalg.norm(v))), j) for j, v in good.items() if j != i and len(v) == len(q))
            out[i] = s[:k]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[300:340] = x[300]  # one hot vector
    x[400:450] = x[400] + rng.normal(size=(50, 12)) * 1e-3
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return rows + [(1000, None), (1050, []), (1100, [0.0] * 12), (1150, [float("nan")] * 12), (1200, [None] * 12), (1250, [float("inf")] + [0.0] * 11), (None, [1.0] * 12), (1300, [1.0, 2.0]), (1301, [2.0, 1.0])]


def test_recall_order_and_scores(spark, vectors):
    df = spark.createDataFrame([(i, v, 1, 0.0) for i, v in vectors], "vec_id long, embedding array<float>, node int, score double")
    got = {}
    for r in H.nearest(df, k=5, every=10, shard=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact(vectors, 5, 10)
    assert set(got) == set(want) and 1300 in got
    assert [v for _, v, _ in got[1300]] == [1301]
    hits = 0
    for i, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, len(rows) + 1))
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {v for _, v in want[i]}) / len(want[i])
        true = {v: -s for s, v in want[i]}
        assert all(abs(s - true[v]) < 1e-12 for _, v, s in rows if v in true)
    assert hits / len(got) >= 0.97
    assert [v for _, v, _ in got[300]] == [301, 302, 303, 304, 305]  # ties to the smaller id


def test_graph_is_connected_enough():
    x = H.unit(np.random.default_rng(1).normal(size=(1500, 16)))
    layers = H.build_graph(x)
    assert [len(n) for n, _ in layers][-1] == 1500
    found = H.search_graph(x, x, layers, 32)
    assert (found[:, 0] == np.arange(1500)).mean() > 0.98


def test_few_and_none(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert H.nearest(none).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert H.nearest(one).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in H.nearest(two).collect()] == [(0, 1, 1, -1.0)]


def test_scores_of_tiny_and_huge_vectors(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 1e200]), (2, [3e-310, 0.0]), (3, [1.7e308, -1.7e308]), (4, [5e-324, 5e-324]), (5, [0.0, 2.0]), (6, [1e-300, 1e300])]
    got = {(r.query_id, r.vec_id): r.score for r in H.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=6, every=1).collect()}
    turn = {0: 0.0, 1: 45.0, 2: 0.0, 3: -45.0, 4: 45.0, 5: 90.0, 6: 90.0}
    assert len(got) == 42
    for (q, v), s in got.items():
        assert abs(s - math.cos(math.radians(turn[q] - turn[v]))) < 1e-15


def test_scaling_does_not_change_scores():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 9)) * 10.0 ** rng.integers(-3, 4, size=(50, 1))
    y = H.scaled(x)
    ratio = y / x
    assert (ratio == ratio[:, :1]).all() and (np.abs(y).max(1) >= 0.5).all() and (np.abs(y).max(1) < 1).all()
    assert (np.frexp(ratio[:, 0])[0] == 0.5).all()
