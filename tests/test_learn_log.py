import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwatch.operators import learn as L
from tabwatch.operators import predlog as G


@pytest.fixture(scope="module")
def train8(spark):
    pdf = pd.DataFrame({"id": range(100, 108), "wind": [3.5, 8.0, 12.5, 1.0, 7.25, 9.0, 15.0, 6.5], "target": [1, 0, 1, 1, 0, 1, 0, 1]})
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("size,train,test", [(0.2, 6, 2), (0.375, 5, 3)])
def test_split_sizes(train8, size, train, test):
    s = L.stratified_split(train8, "target", "id", test_size=size).toPandas()
    assert (s.split == "train").sum() == train and (s.split == "test").sum() == test
    assert set(s[s.split == "test"].target) == {0, 1}  # both classes kept


def test_metrics_and_auc_brute_force(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    sc = np.round(rng.random(300) * 0.5 + y * 0.3, 2)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": sc, "p": (sc > 0.5).astype(int)}))
    m = L.classification_metrics(df, "y", "p").first()
    tp = int(((y == 1) & (sc > 0.5)).sum())
    assert m["tp"] == tp and 0 <= m["f1"] <= 1 and 0 <= m["accuracy"] <= 1
    auc = L.roc_auc(df, "y", "s").first()["roc_auc"]
    pos, neg = sc[y == 1], sc[y == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert auc == pytest.approx(brute, abs=1e-12)
    flipped = L.roc_auc(df.withColumn("y", 1 - F.col("y")), "y", "s").first()["roc_auc"]
    assert auc + flipped == pytest.approx(1.0)


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(400, 2))
    y = (X @ np.array([1.5, -2.0]) + 0.3 + rng.normal(size=400) > 0).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": X[:, 0], "b": X[:, 1], "y": y}))
    b0, coefs = L.coefficients(L.fit_logistic(df, ["a", "b"], "y"), ["a", "b"])
    # Newton on C * sum logloss + 0.5 ||w||^2 (intercept not penalised), C = 1
    Z = np.hstack([np.ones((400, 1)), X])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-Z @ w))
        g = Z.T @ (p - y) + np.r_[0, w[1:]]
        Hm = Z.T @ (Z * (p * (1 - p))[:, None]) + np.diag([0, 1, 1])
        w -= np.linalg.solve(Hm, g)
    assert [b0, coefs["a"], coefs["b"]] == pytest.approx(w.tolist(), abs=1e-4)


def test_score_and_pick_probability(spark):
    df = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    s = L.score(df, 0.0, {"x": 1.0}, "v1").toPandas()
    assert s.probability.tolist() == pytest.approx([0.5, 1 / (1 + np.exp(-10))]) and s.predicted_class.tolist() == [0, 1]
    arr = spark.createDataFrame([([0.3, 0.7], 1), ([0.2, 0.5, 0.3], 1)], "p array<double>, c int")
    got = [r[0] for r in arr.select(L.pick_probability(F.col("p"), F.col("c"))).collect()]
    assert got == [0.7, 0.5]


@pytest.fixture(scope="module")
def log3(spark):
    t = dt.datetime(2026, 1, 25, 12, 0, 0)
    rows = [("req-001", 0, t, 0.45, "v1"), ("req-002", 0, t + dt.timedelta(seconds=1), 0.72, "v1"),
            ("req-003", 0, t + dt.timedelta(seconds=2), 0.89, "v1")]
    return spark.createDataFrame(rows, "request_id string, pos int, ts timestamp, prediction double, model_version string")


def test_last_n_and_stats(log3):
    last2 = G.last_n(log3, 2).orderBy("seq").toPandas()
    assert last2.request_id.tolist() == ["req-002", "req-003"]
    assert G.last_n(log3, 10).count() == 3
    st = G.log_stats(log3, max_size=100).first()
    assert st["count"] == 3 and st["utilization"] == pytest.approx(0.03) and st["time_span_seconds"] == 2.0


def test_eviction(spark):
    t = dt.datetime(2026, 1, 1)
    log = spark.createDataFrame([(f"r{i}", 0, t + dt.timedelta(seconds=i), i) for i in range(10)],
                                "request_id string, pos int, ts timestamp, i int")
    assert sorted(r["i"] for r in G.retain(log, 5).collect()) == [5, 6, 7, 8, 9]


def test_due_checks(spark):
    t = dt.datetime(2026, 1, 1)
    log = spark.createDataFrame([("v1", t + dt.timedelta(seconds=i)) for i in range(1500)] +
                                [("v2", t + dt.timedelta(seconds=i)) for i in range(500)], "model_version string, ts timestamp")
    state = spark.createDataFrame([("v1", t + dt.timedelta(seconds=1400), 1400)],
                                  "model_version string, last_check_ts timestamp, last_check_count long")
    d = {r["model_version"]: r["due"] for r in G.due_checks(log, state).collect()}
    assert d == {"v1": False, "v2": False}
    d0 = {r["model_version"]: r["due"] for r in G.due_checks(log, None).collect()}
    assert d0 == {"v1": True, "v2": False}  # never checked, enough rows


def test_flatten_and_records(spark):
    df = spark.createDataFrame([("b1", dt.datetime(2026, 1, 1), "v1", [{"a": 1.0}, {"a": 2.0}], [0.1, 0.9])],
                               "request_id string, ts timestamp, model_version string, inst array<map<string,double>>, pred array<double>")
    flat = G.flatten_batch(df, "inst", "pred").orderBy("pos").toPandas()
    assert flat.pos.tolist() == [0, 1] and flat.prediction.tolist() == [0.1, 0.9]
    recs = spark.createDataFrame([({"a": 1.0},), ({"b": 2.0},)], "f map<string,double>")
    t = G.records_to_table(recs, "f").toPandas()
    assert list(t.columns) == ["a", "b"] and t.isna().sum().sum() == 2


@pytest.mark.parametrize("few", [1, 40, 100_000])
def test_split_by_counting_equals_ranks(spark, few, monkeypatch):
    """Any number of narrowing rounds finds the same cut as a full sort of every class."""
    import hashlib

    monkeypatch.setattr(L, "FEW", few)
    rng = np.random.default_rng(2)
    labels = rng.choice(["a", "b", "c", None], 700, p=[0.7, 0.2, 0.07, 0.03])
    df = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "id long, y string").repartition(5)
    got = {r.id: r.split for r in L.stratified_split(df, "y", "id").collect()}
    quotas = {r.y: r.n_train for r in L.split_quotas(df, "y").collect()}
    assert len(got) == 700
    for y, n in quotas.items():
        order = sorted((i for i in range(700) if labels[i] == y), key=lambda i: (hashlib.md5(f"42-{i}".encode()).hexdigest(), i))
        assert [got[i] for i in order] == ["train"] * n + ["test"] * (len(order) - n)


def test_split_has_no_shuffle_and_no_window(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as y")
    plan = L.stratified_split(df, "y", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_newton_equals_the_limited_memory_fit(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(500, 3)) * [1.0, 5.0, 0.2] + [0.0, 3.0, -1.0]
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ [2.0, -0.4, 3.0] + 1)))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    one = L.coefficients(L.fit_logistic(df, ["a", "b", "c"], "y"), ["a", "b", "c"])
    monkeypatch.setattr(L, "NEWTON_FEATURES", 2)
    two = L.coefficients(L.fit_logistic(df, ["a", "b", "c"], "y"), ["a", "b", "c"])
    assert [one[0], *one[1].values()] == pytest.approx([two[0], *two[1].values()], abs=1e-4)


def test_newton_on_separable_rows_stays_finite(spark):
    df = spark.createDataFrame([(float(i), float(i > 9)) for i in range(20)], "x double, y double")
    fit = L.fit_newton(df.withColumnRenamed("y", "_y"), ["x"], "_y")
    z = fit.intercept + fit.coefficients[0] * np.arange(20)
    p = 1 / (1 + np.exp(-z))
    assert abs(((np.arange(20) > 9) - p).sum()) < 1e-6 and abs((((np.arange(20) > 9) - p) * np.arange(20)).sum() - fit.coefficients[0]) < 1e-6
