import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabwatch.operators import monitor as H
from tabwatch.operators import registry as I

# the rule: 8 to 128 letters, digits and hyphens, whole string
VALID = ["x" * 8, "Z9" * 64, "-" * 10, "0-1-2-3-4", "AbCdEfGh-01"]
INVALID = ["", "x" * 7, "x" * 129, "tab\tinside-it", "dot.in.the.middle", "ünïcode-letters", "underscore_here", "trailing-line\n"]


def test_request_id_patterns(spark):
    df = spark.createDataFrame([(x,) for x in VALID + INVALID], "rid string")
    got = [r[0] for r in df.select(H.request_id_valid(F.col("rid"))).collect()]
    assert got == [True] * len(VALID) + [False] * len(INVALID)
    cleaned = df.select(H.clean_request_id(F.col("rid")).alias("c")).collect()
    assert [r.c for r in cleaned[:len(VALID)]] == VALID


def _log(spark, lat):
    t = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([(t, "/v1/predict", x) for x in lat], "ts timestamp, endpoint string, latency_s double")


def test_latency_histogram_and_quantiles(spark):
    lat = [0.005, 0.02, 0.02, 0.04, 0.3, 0.3, 0.7, 3.0, 20.0, 0.1]
    h = H.latency_histogram(_log(spark, lat)).orderBy("bucket").toPandas()
    assert h.cum_count.tolist() == [1, 3, 4, 5, 5, 7, 8, 8, 9, 9, 10]
    q = {r["q"]: r["value"] for r in H.bucket_quantiles(H.latency_histogram(_log(spark, lat))).collect()}
    # rank 5 of 10 -> bucket le=0.1 (cum 5, previous cum 4 at le=0.05) -> 0.1
    assert q[0.5] == pytest.approx(0.1)
    assert q[0.99] == pytest.approx(10.0)  # +Inf bucket -> largest finite bound


def test_status_bands(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.9,), (1.0,), (None,)], "x double")
    got = [r[0] for r in df.select(H.status_band(F.col("x"), 0.5, 1.0)).collect()]
    assert got == ["green", "yellow", "yellow", "red", None]


def _promos(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [("production", f"v2025010{i}_120000_abc12{i}", t + dt.timedelta(days=i), i) for i in range(1, 6)]
    rows += [("staging", "v20250101_000000_aaaaaa", t, 10)]
    return spark.createDataFrame(rows, "environment string, model_version string, promoted_at timestamp, promotion_seq long")


def test_pointer_history_rollback(spark):
    p = _promos(spark)
    cur = {r["environment"]: r["model_version"] for r in I.current_pointer(p).collect()}
    assert cur == {"production": "v20250105_120000_abc125", "staging": "v20250101_000000_aaaaaa"}
    h = I.promotion_history(p, limit=3).where("environment = 'production'").orderBy("rank").toPandas()
    assert h.model_version.tolist() == ["v20250104_120000_abc124", "v20250103_120000_abc123", "v20250102_120000_abc122"]
    rb = I.rollback_target(p).where("environment = 'production'").orderBy("promoted_at").toPandas()
    assert rb.previous_version.tolist()[0] is None and rb.previous_version.tolist()[-1] == "v20250104_120000_abc124"
    assert I.promotion_history(p).where("environment = 'staging'").count() == 0


def test_eligibility_and_pointer_check(spark):
    arts = spark.createDataFrame([("models/va.onnx",), ("metadata/va.json",), ("baselines/va_baseline.json",),
                                  ("models/vb.onnx",), ("models/vc.onnx",), ("metadata/vc.json",),
                                  ("baselines/vc_baseline.json",)], "path string")
    models = spark.createDataFrame([("va", "lr", True, True), ("vc", "lr", True, False)],
                                   "model_version string, model_type string, has_schema boolean, has_metrics boolean")
    cands = spark.createDataFrame([("va",), ("vb",), ("vc",), ("xx",), ("vd",)], "model_version string")
    r = {x["model_version"]: x["reason"] for x in I.eligibility(cands, models, arts).collect()}
    assert r == {"va": "eligible", "vb": "metadata_missing", "vc": "metadata_incomplete",
                 "xx": "invalid_format", "vd": "model_missing"}
    ptr = spark.createDataFrame([("production", "vb")], "environment string, model_version string")
    miss = sorted(x["kind"] for x in I.pointer_check(ptr, arts).collect())
    assert miss == ["baseline", "metadata"]


def test_version_in_force(spark):
    t = dt.datetime(2025, 1, 1)
    promos = spark.createDataFrame([(t, 1, "v1"), (t + dt.timedelta(hours=2), 2, "v2")],
                                   "promoted_at timestamp, promotion_seq long, model_version string")
    log = spark.createDataFrame([(1, t - dt.timedelta(hours=1)), (2, t), (3, t + dt.timedelta(hours=1)),
                                 (4, t + dt.timedelta(hours=2)), (5, t + dt.timedelta(hours=3))], "id int, ts timestamp")
    got = {r["id"]: r["version_in_force"] for r in I.version_in_force(log, promos).collect()}
    assert got == {1: None, 2: "v1", 3: "v1", 4: "v2", 5: "v2"}


def test_list_versions(spark):
    m = spark.createDataFrame([("v20250102_000000_aaaaaa",), ("v20250101_000000_aaaaaa",), ("v20250103_000000_aaaaaa",),
                               ("v20250103_000000_aaaaaa",)], "model_version string")
    got = I.list_versions(m).orderBy("rank").toPandas()
    assert got.model_version.tolist() == ["v20250103_000000_aaaaaa", "v20250102_000000_aaaaaa", "v20250101_000000_aaaaaa"]
