import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwatch.plans import ordered as O


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({
        "k": rng.choice(["a", "b", "c"], 3000, p=[0.7, 0.2, 0.1]),  # one hot key
        "v": np.round(rng.standard_t(3, 3000), 1),  # heavy ties and tails
        "id": np.arange(3000),
    })
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("buckets", [1, 3, 17])
def test_exact_quantiles_match_numpy(data, buckets):
    pdf, df = data
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = O.exact_quantiles(df, ["k"], "v", probs, n_buckets=buckets).toPandas()
    for (k, q), g in got.groupby(["k", "q"]):
        exp = np.quantile(pdf.loc[pdf.k == k, "v"].to_numpy(), q)
        assert g["value"].iloc[0] == pytest.approx(exp, abs=1e-12)


def test_running_sum_partition_independent(spark, data):
    pdf, df = data
    a = O.running_sum(df.repartition(1), ["k"], ["v", "id"], ["id"], n_buckets=5).toPandas()
    b = O.running_sum(df.repartition(7), ["k"], ["v", "id"], ["id"], n_buckets=11).toPandas()
    key = ["k", "v", "id"]
    a, b = a.sort_values(key).reset_index(drop=True), b.sort_values(key).reset_index(drop=True)
    assert (a.id_cum == b.id_cum).all()
    exp = pdf.sort_values(key).groupby("k")["id"].cumsum().to_numpy()
    assert (a.id_cum.to_numpy() == exp).all()


def test_lag_and_forward_fill(spark, data):
    pdf, df = data
    lag = O.ordered_lag(df, ["k"], ["v", "id"], ["id"], n_buckets=6).toPandas().sort_values(["k", "v", "id"])
    assert (lag.prev_id.fillna(-1).to_numpy() == lag.groupby("k")["id"].shift(1).fillna(-1).to_numpy()).all()
    d2 = df.withColumn("x", F.when(F.col("v") > 2.0, F.col("id")))
    ff = O.forward_fill(d2, ["k"], ["v", "id"], "x", "xf", n_buckets=9).toPandas().sort_values(["k", "v", "id"])
    assert (ff.xf.fillna(-1).to_numpy() == ff.groupby("k")["x"].ffill().fillna(-1).to_numpy()).all()


def test_count_below_is_binary_search(spark):
    arr = [1.0, 2.0, 2.0, 5.0, 7.0]
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 1.5, 2, 3, 5, 6, 7, 8]], "v double")
    a = F.array(*[F.lit(x) for x in arr])
    got = df.select("v", O.count_below(a, F.col("v"), 5).alias("lt"),
                    O.count_below(a, F.col("v"), 5, inclusive=True).alias("le")).toPandas()
    for v, lt, le in got.itertuples(index=False):
        assert lt == sum(x < v for x in arr) and le == sum(x <= v for x in arr)


def test_hot_tie_group_is_split_and_exact(spark):
    import datetime as dt
    rng = np.random.default_rng(1)
    n = 6000
    t0 = dt.datetime(2024, 1, 1)
    ts = [t0 + dt.timedelta(seconds=int(x)) for x in rng.integers(0, 4000, n)]
    for i in range(0, n, 3):  # a third of the rows share one timestamp
        ts[i] = t0 + dt.timedelta(seconds=2000)
    pdf = pd.DataFrame({"ts": ts, "seq": np.arange(n), "x": rng.integers(0, 5, n)})
    df = spark.createDataFrame(pdf)
    keyed = df.withColumn("_const_key", F.lit(0))
    bk = O.range_bucket(keyed, ["_const_key"], ["ts", "seq"], n_buckets=16).toPandas()
    assert bk.groupby("_bucket").size().max() < n / 3 / 2  # the hot timestamp spans several buckets
    srt = bk.sort_values(["ts", "seq"])
    assert srt["_bucket"].is_monotonic_increasing  # bucket order follows (ts, seq)
    lag = O.ordered_lag(df, [], ["ts", "seq"], ["seq"], n_buckets=16).toPandas().sort_values(["ts", "seq"])
    assert (lag.prev_seq.fillna(-1).to_numpy() == lag.seq.shift(1).fillna(-1).to_numpy()).all()
    rs = O.running_sum(df, [], ["ts", "seq"], ["x"], n_buckets=16).toPandas().sort_values(["ts", "seq"])
    assert (rs.x_cum.to_numpy() == rs.x.cumsum().to_numpy()).all()


def test_bucket_ids_do_not_depend_on_partitioning(spark, data):
    pdf, df = data
    a = O.range_bucket(df.repartition(1), ["k"], ["v", "id"], n_buckets=9).select("id", "_bucket").toPandas()
    b = O.range_bucket(df.repartition(13, "id"), ["k"], ["v", "id"], n_buckets=9).select("id", "_bucket").toPandas()
    m = a.merge(b, on="id")
    assert len(m) == len(pdf) and (m._bucket_x == m._bucket_y).all()


def test_infinities_do_not_widen_the_grid(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.lognormal(3, 2, 20_000), [np.inf, -np.inf, np.nan]])
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": v, "id": np.arange(len(v))})).withColumn("v", F.when(F.col("id") % 500 != 0, F.col("v")))
    bk = O.range_bucket(df, ["k"], ["v", "id"], n_buckets=16).toPandas()
    assert bk.groupby("_bucket").size().max() < len(v) / 16 * 3
    got = df.join(O.range_bucket(df, ["k"], ["v", "id"], n_buckets=16).select("id", "_bucket"), "id").orderBy("v", "id").collect()
    assert [r._bucket for r in got] == sorted(r._bucket for r in got)  # NULL first, then -inf .. inf, NaN


def test_texts_with_one_prefix_are_split(spark):
    df = spark.range(100_000).selectExpr("'a' as k", "concat('v1992_common_prefix_', lpad(id, 9, '0')) as v", "id")
    bk = O.range_bucket(df, ["k"], ["v"], n_buckets=16)
    sizes = [r["count"] for r in bk.groupBy("_bucket").count().collect()]
    assert len(sizes) >= 16 and max(sizes) < 100_000 / 16 * 3
    lag = O.ordered_lag(df, ["k"], ["v"], ["id"], n_buckets=16)
    assert lag.where("prev_id <> id - 1 or (prev_id is null and id > 0)").count() == 0


def test_side_tables_do_not_grow_with_partitions(spark):
    df = spark.range(3000).selectExpr("id % 2 as k", "cast(id as double) as v")
    few = O.range_bucket(df, ["k"], "v", n_buckets=20_000).select("_bucket").distinct().count()
    assert few <= 2 * O.MAX_BUCKETS * O.SUB_BUCKETS
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "10000")
        assert O.default_buckets(df) > O.MAX_BUCKETS
        plan = O.running_sum(df, ["k"], ["v"], ["v"])._jdf.queryExecution().optimizedPlan().toString()
        assert "20000" not in plan and "1280000" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
