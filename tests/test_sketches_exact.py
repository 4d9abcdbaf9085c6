"""Mergeable sketches, exact KS p-values, stored pointer paths, error rates of any window."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwatch.functions.pvalues import ks_exact_scalar
from tabwatch.operators import drift as E
from tabwatch.operators import monitor as H
from tabwatch.operators import registry as I
from tabwatch.operators import sketches as S


@pytest.fixture(scope="module")
def days(spark):
    rng = np.random.default_rng(21)
    n = 40_000
    pdf = pd.DataFrame({"day": rng.integers(0, 5, n), "wide": np.round(rng.lognormal(0, 3, n), 4), "few": rng.integers(0, 7, n).astype(float), "hot": np.where(rng.random(n) < 0.4, 5.0, rng.random(n))})
    pdf.loc[::9, "wide"] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_merged_parts_keep_their_bounds(days):
    pdf, df = days
    got = {r.feature: r for r in S.profile_of_parts(S.profile_parts(df, ["wide", "few", "hot"], ["day"])).collect()}
    for f in ("wide", "few", "hot"):
        v, r = np.sort(pdf[f].dropna().to_numpy()), got[f]
        assert (r.n_rows, r.n, r.min, r.max) == (len(pdf), len(v), v[0], v[-1]) and r.mean == pytest.approx(v.mean())
        assert r.missing_rate == pytest.approx(1 - len(v) / len(pdf))
        distinct = len(np.unique(v))
        assert abs(r.n_unique - distinct) <= max(0.5, S.DISTINCT_ERROR * distinct)
        for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95)):
            low, high = np.searchsorted(v, r[name], "left") / len(v), np.searchsorted(v, r[name], "right") / len(v)
            assert low - S.RANK_ERROR <= p <= high + S.RANK_ERROR


def test_a_stored_profile_grows_without_the_old_rows(spark, days, tmp_dir):
    pdf, df = days
    path = tmp_dir + "/parts"
    for day in (0, 1, 2, 2, 3, 4):  # one of them twice
        S.append_parts(S.profile_parts(df.where(F.col("day") == day), ["wide", "few"], ["day"]), path, "day")
    got = {r.feature: r for r in S.profile_of_parts(S.read_parts(spark, path)).collect()}
    assert got["few"].n_rows == len(pdf) and got["few"].n_unique == 7 and got["wide"].n == pdf.wide.notna().sum()
    per = {(r.day, r.feature): r for r in S.profile_of_parts(S.read_parts(spark, path), ["day"]).collect()}
    assert len(per) == 10 and sum(r.n for (_, f), r in per.items() if f == "wide") == pdf.wide.notna().sum()
    with_day = S.merge_parts(S.read_parts(spark, path), ["day"])
    again = {r.feature: r for r in S.profile_of_parts(with_day).collect()}
    assert (again["few"].n_rows, again["few"].n_unique) == (got["few"].n_rows, 7)


def test_sketches_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    [r] = S.profile_of_parts(S.profile_parts(df, ["x"])).collect()
    assert (r.n_rows, r.n, r.n_unique, r.mean, r.p50, r.missing_rate) == (2, 0, 0, None, None, 1.0)
    assert S.profile_of_parts(S.profile_parts(df.limit(0), ["x"])).count() == 0


@pytest.mark.parametrize("m, n", [(1, 1), (2, 3), (4, 4), (3, 6), (5, 4)])
def test_exact_ks_counts_all_orders(m, n):
    """Every order of the pooled values, weighed alike."""
    seen = []
    for first in itertools.combinations(range(m + n), m):
        i = j = top = 0
        for k in range(m + n):
            i, j = (i + 1, j) if k in first else (i, j + 1)
            top = max(top, abs(i * n - j * m))
        seen.append(top)
    for top in sorted(set(seen)):
        want = sum(t >= top for t in seen) / math.comb(m + n, m)
        assert ks_exact_scalar(top / (m * n), m, n) == pytest.approx(want, abs=1e-14)


def test_exact_ks_meets_the_limit_for_large_samples():
    d, m, n = 0.05, 1000, 4000
    lam = d * math.sqrt(m * n / (m + n))
    limit = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 50))
    assert ks_exact_scalar(d, m, n) == pytest.approx(limit, abs=5e-3)
    assert ks_exact_scalar(1.0, 30, 30) == pytest.approx(2 / math.comb(60, 30), rel=1e-9)
    assert ks_exact_scalar(0.0, 5, 5) == 1.0 and math.isnan(ks_exact_scalar(float("nan"), 5, 5))


def test_exact_only_up_to_its_limit(spark):
    rng = np.random.default_rng(5)
    long = lambda n, mu: spark.createDataFrame([(f, float(v)) for f in ("x", "y") for v in rng.normal(mu, 1, n if f == "x" else 5 * n)], "feature string, v double")
    a, b = long(30, 0.0), long(25, 0.5)
    both = {r.feature: r for r in E.ks_two_sample(a, b, exact_up_to=100).collect()}
    plain = {r.feature: r for r in E.ks_two_sample(a, b).collect()}
    assert both["y"].ks_pvalue == plain["y"].ks_pvalue and both["x"].ks_statistic == plain["x"].ks_statistic
    assert both["x"].ks_pvalue == pytest.approx(ks_exact_scalar(plain["x"].ks_statistic, 30, 25)) != plain["x"].ks_pvalue


def test_pointers_by_their_stored_paths(spark):
    rows = [
        ("ok", "s3://b/models/1.onnx", "s3://b/metadata/1.json", "s3://b/baselines/1.json"), ("ok", "s3://b/models/1.onnx", "s3://b/metadata/1.json", "s3://b/baselines/1.json"),
        ("none", "s3://b/models/1.onnx", None, None), ("bucket", "s3://bb/models/1.onnx", None, "x"), ("bare", "models/1.onnx", None, None),
        ("gone", "s3://b/models/1.onnx", "s3://b/metadata/1.json", "s3://b/baselines/9.json"), ("empty", "s3://b/", "s3://b/metadata/1.json", "s3://b/baselines/1.json")]
    pointers = spark.createDataFrame(rows, "environment string, model_path string, metadata_path string, baseline_path string")
    there = spark.createDataFrame([("models/1.onnx",), ("models/1.onnx",), ("metadata/1.json",), ("baselines/1.json",)], "path string")
    got = sorted((r.environment, r.valid, r.reason, r.failed_path) for r in I.validate_pointers(pointers, there, "b").collect())
    assert got == sorted([
        ("ok", True, None, None), ("ok", True, None, None), ("none", False, "missing_key", None), ("bucket", False, "invalid_uri", "s3://bb/models/1.onnx"),
        ("bare", False, "invalid_uri", "models/1.onnx"), ("gone", False, "missing_object", "s3://b/baselines/9.json"), ("empty", False, "missing_object", "s3://b/")], key=lambda x: (x[0], x[1]))
    assert I.validate_pointers(pointers.limit(0), there, "b").count() == 0


@pytest.mark.parametrize("window, slide, length", [("5 minutes", "1 minute", 300), ("90 seconds", "60 seconds", 90), ("2 hours", "30 minutes", 7200)])
def test_error_rate_of_any_window(spark, window, slide, length):
    rng = np.random.default_rng(3)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(s)), "error" if s % 3 else "success") for s in rng.integers(0, 20_000, 300)]
    log = spark.createDataFrame(rows, "ts timestamp, status string")
    got = {r.window_start: (r.errors, r.error_rate) for r in H.error_rate(log, window, slide).collect()}
    step = {"1 minute": 60, "60 seconds": 60, "30 minutes": 1800}[slide]
    want = {}
    for t, s in rows:
        if s == "error":
            at = int((t - dt.datetime(1970, 1, 1)).total_seconds())
            start = at - at % step
            while start > at - length:
                key = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=start)
                want[key] = want.get(key, 0) + 1
                start -= step
    assert {k: v for k, (v, _) in got.items()} == want
    assert all(rate == pytest.approx(n / length) for n, rate in got.values())
