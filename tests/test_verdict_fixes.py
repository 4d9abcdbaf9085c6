"""Inputs that once gave a wrong answer or a crash."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabwatch.functions.pvalues import chi2_sf_scalar
from tabwatch.operators import drift as E
from tabwatch.operators import learn as L
from tabwatch.operators import monitor as H
from tabwatch.operators import predlog as G


def test_chi_square_when_all_categories_are_new(spark):
    profile = spark.createDataFrame([("f", "a", 0.5), ("f", "b", 0.5)], "feature string, category string, share double")
    cur = spark.createDataFrame([("f", "x"), ("f", "y")], "feature string, v string")
    r = E.chi_square_test(cur, profile).first()
    assert r.status == "sum_mismatch" and r.chi2_statistic is None and r.chi2_pvalue is None


@pytest.mark.parametrize("x, dof, want", [
    (3000.0, 2000, 0.0), (2000.0, 2000, 0.495795), (2.0, 2, 0.367879), (11.07, 5, 0.050010), (1e6, 7, 0.0), (0.5, 1, 0.479500)])
def test_chi_square_tail(x, dof, want):
    assert chi2_sf_scalar(x, dof) == pytest.approx(want, abs=2e-6)


def test_auc_counts_beyond_a_long(spark):
    df = spark.range(4).selectExpr("cast(id % 2 as int) as y", "cast(id as double) as s")
    assert L.roc_auc(df, "y", "s").first().roc_auc == pytest.approx(0.75)
    big = spark.sql("select 5000000000L as n_pos, 5000000000L as n_neg, 12.5e18D as num")
    expr = F.try_divide(F.col("num"), F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))
    assert big.select(expr.alias("x")).first().x == pytest.approx(0.5)


def test_split_refuses_a_class_with_one_row(spark):
    df = spark.createDataFrame([(i, 0) for i in range(9)] + [(9, 1)], "id int, y int")
    with pytest.raises(Exception, match="class with one row"):
        L.stratified_split(df, "y", "id").collect()


def test_request_rate_of_other_windows(spark):
    t = dt.datetime(2026, 1, 1)
    log = spark.createDataFrame([(t + dt.timedelta(seconds=10 * i), "e", "v", 2) for i in range(30)], "ts timestamp, endpoint string, model_version string, batch_size int")
    r = H.request_rate(log, window="5 minutes").collect()
    assert [(x.per_minute, x.per_second) for x in r] == [(12, pytest.approx(0.2))]


@pytest.mark.parametrize("n", [5, 2000])
def test_newest_rows_of_a_hot_key_are_cut_before_they_meet(spark, n):
    log = spark.range(9000).selectExpr("'hot' as k", "timestamp_seconds(id) as ts", "cast(id as string) as request_id", "0 as pos")
    out = G.last_n(log, n, ["k"])
    assert out.agg(F.min("ts"), F.count("*")).first()[1] == n
    assert sorted(int(r.request_id) for r in out.collect()) == list(range(9000 - n, 9000))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan


def test_stamping_with_a_given_time(spark):
    df = spark.createDataFrame([(1, None), (2, dt.datetime(2026, 1, 2))], "id int, timestamp timestamp")
    got = [r.timestamp for r in G.ingest(df, now=F.to_timestamp(F.lit("2026-03-01"))).orderBy("id").collect()]
    assert got == [dt.datetime(2026, 3, 1), dt.datetime(2026, 1, 2)]


def test_a_shared_folder_is_needed_off_the_local_master(monkeypatch, spark):
    from tabwatch import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Fake())
