import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwatch.operators import contract as C
from tabwatch.operators import profile as D


@pytest.fixture(scope="module")
def table(spark):
    """A parcel table: two whole numbers, one more, a text and the target."""
    return spark.createDataFrame(pd.DataFrame({
        "weight": [3, 8, 13, 21, 34, 55], "distance": [120, 7, 7, 640, 1, 88], "stops": [0, 1, 0, 2, 0, 3],
        "depot": ["north", "quay", "quay", "north", "hill", "quay"], "late": [0, 0, 1, 1, 0, 1]}))


def test_structural_schema_and_hash(table):
    rows = C.structural_rows(table, "late")
    assert [r["name"] for r in rows] == ["weight", "distance", "stops", "depot"]
    assert [r["position"] for r in rows] == [0, 1, 2, 3]
    assert [r["dtype"] for r in rows] == ["int64", "int64", "int64", "object"]
    h = C.schema_hash(table, "late")
    assert re.fullmatch(r"[0-9a-f]{32}", h)
    # statistics never change the hash; structure does
    assert C.schema_hash(table.withColumn("weight", F.col("weight") * 2), "late") == h
    assert C.schema_hash(table.select("distance", "weight", "stops", "depot", "late"), "late") != h
    got = table.select(C.schema_hash_column(table, "late").alias("h")).first()["h"]
    assert got == h


def test_describe_columns(table):
    d = {r["name"]: r for r in C.describe_columns(table, "late").collect()}
    assert d["weight"]["mean"] == pytest.approx(134 / 6) and d["weight"]["num_unique"] == 6 and d["weight"]["type"] == "numeric"
    assert d["distance"]["num_unique"] == 5 and d["depot"]["num_unique"] == 3 and d["depot"]["type"] == "categorical"
    assert d["weight"]["std"] == pytest.approx(np.std([3, 8, 13, 21, 34, 55], ddof=1))


def test_distinct_counts_of_large_integers(spark):
    df = spark.range(1000).selectExpr("id + 9007199254740992 as big", "cast(id % 3 as double) as d")
    got = {r["name"]: r["num_unique"] for r in C.describe_columns(df).collect()}
    assert got == {"big": 1000, "d": 3}


def test_categorical_profile_keeps_all_null_features(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", None)], "x string, empty string")
    got = {(r["feature"], r["category"]): r for r in D.categorical_profile(df, ["x", "empty"]).collect()}
    assert set(got) == {("x", "a"), ("x", "b"), ("empty", None)}
    e = got[("empty", None)]
    assert e["n_unique"] == 0 and e["missing_rate"] == 1 and e["n"] == 0 and e["count"] == 0


def test_batches_as_arrays(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [1]), (3, list(range(1000))), (4, list(range(1001)))], "id int, xs array<int>")
    assert [r["status"] for r in C.check_batch_arrays(df, "xs").orderBy("id").collect()] == ["empty", "empty", "ok", "ok", "too_large"]


def test_strict_order_for_scoring(spark):
    df = spark.createDataFrame([(0, [("a", "1"), ("b", "2")]), (1, [("b", "2"), ("a", "1")])], "id int, kv array<struct<k:string,v:string>>")
    df = df.withColumn("f", F.map_from_entries("kv"))
    loose = [r["error_type"] for r in C.validate_for_scoring(df, "f", ["a", "b"]).orderBy("id").collect()]
    strict = [(r["error_type"], r["invalid_features"]) for r in C.validate_for_scoring(df, "f", ["a", "b"], strict=True).orderBy("id").collect()]
    assert loose == [None, None] and strict == [(None, None), ("schema", "b,a")]


def test_conforming_records(spark):
    df = spark.createDataFrame([("1", "x"), ("two", None), (None, "z")], "n string, t string")
    contract = spark.createDataFrame([("n", 0, "int64"), ("t", 1, "object"), ("gone", 2, "float64")], "name string, position int, dtype string")
    got = {r["name"]: (r["n_records"], r["n_conforming"]) for r in C.conforming_records(df, contract).collect()}
    assert got == {"n": (3, 1), "t": (3, 2), "gone": (3, 0)}


def test_missing_rate(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "c"), (4.0, None), (float("nan"), "e")], "x double, s string")
    d = {r["name"]: r for r in C.describe_columns(df).collect()}
    assert d["x"]["missing_rate"] == pytest.approx(0.4) and d["s"]["missing_rate"] == pytest.approx(0.2)
    m = {r["column"]: r["missing_rate"] for r in D.missing_rate(df).collect()}
    assert m == {"x": pytest.approx(0.4), "s": pytest.approx(0.2)}


def test_compatibility_errors(spark, table):
    contract = C.structural_schema(table, "late")
    assert C.validate_contract(table.drop("late"), contract, n_features=4).count() == 0
    wrong_count = C.validate_contract(table.drop("depot", "late"), contract, n_features=4).toPandas()
    assert set(wrong_count.error_type) == {"feature_count", "feature_names"}
    reordered = table.select("distance", "weight", "stops", "depot")
    assert set(C.validate_contract(reordered, contract, n_features=4).toPandas().error_type) == {"feature_names"}
    retyped = table.drop("late").withColumn("weight", F.col("weight").cast("double"))
    e = C.validate_contract(retyped, contract, n_features=4).toPandas()
    assert list(e.error_type) == ["dtype"] and e.column.iloc[0] == "weight"


def test_record_rules(spark):
    recs = [
        ({f"f{i}": 1.0 for i in range(100)},), ({f"f{i}": 1.0 for i in range(101)},),
        ({"x" * 300: 1.0},), ({},),
    ]
    df = spark.createDataFrame(recs, "features map<string,double>")
    errs = [r["error"] for r in C.check_records(df, "features").collect()]
    assert errs == [None, "too_many_features", "feature_name_too_long", "empty_features"]


def test_batch_bounds(spark):
    df = spark.range(1005).select(F.when(F.col("id") < 1001, F.lit("big")).otherwise(F.lit("ok")).alias("b"))
    s = {r["batch"]: r["status"] for r in C.check_batches(df, "b").collect()}
    assert s == {"big": "too_large", "ok": "ok"}


def test_validate_for_scoring_nan_inf(spark):
    rows = [({"a": "1.0", "b": "2"},), ({"a": "NaN", "b": "1"},), ({"a": "Infinity", "b": "1"},),
            ({"a": "x", "b": "1"},), ({"a": "1"},), ({"a": "1e39", "b": "1"},)]
    df = spark.createDataFrame(rows, "f map<string,string>")
    out = [(r["error_type"], r["invalid_features"]) for r in C.validate_for_scoring(df, "f", ["a", "b"]).collect()]
    assert out == [(None, None), ("non_finite", "a"), ("non_finite", "a"), ("invalid_value", "a"),
                   ("schema", "b"), ("non_finite", "a")]  # 1e39 overflows float32


def test_version_patterns(spark):
    df = spark.createDataFrame([("v20250118_120000_abc123",), ("v20250117_100000_xyz789",), ("20250118",)], "v string")
    r = df.select(C.valid_version(F.col("v")).alias("p"), C.valid_version(F.col("v"), True).alias("s")).collect()
    assert [(x.p, x.s) for x in r] == [(True, True), (True, False), (False, False)]


def test_numeric_and_categorical_profiles(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"x": rng.normal(size=500), "c": rng.choice(list("abcdefghijklmno"), 500)})
    pdf.loc[::10, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    p = D.numeric_profile(df, ["x"]).first()
    s = pdf.x
    assert p["mean"] == pytest.approx(s.mean()) and p["std"] == pytest.approx(s.std())
    for name, q in D.PROFILE_PERCENTILES.items():
        assert p[name] == pytest.approx(s.quantile(q), abs=1e-12)
    assert p["missing_rate"] == pytest.approx(0.1)
    cp = D.categorical_profile(df, ["c"]).orderBy("rank").toPandas()
    vc = pdf.c.value_counts()
    exp = sorted(vc.items(), key=lambda kv: (-kv[1], kv[0]))[:10]
    assert list(cp.category) == [k for k, _ in exp] and len(cp) == 10
    assert cp.share.iloc[0] == pytest.approx(exp[0][1] / 500) and cp.n_unique.iloc[0] == 15


@pytest.mark.parametrize("vals", [[0.1, 0.5, 0.5, 0.9, 1.0, 0.33, 0.0], [0.7] * 5])
def test_histogram_matches_numpy(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    h = D.histogram(df, "p").orderBy("bin").toPandas()
    counts, edges = np.histogram(np.array(vals), bins=20)
    assert h["count"].tolist() == counts.tolist()
    assert np.allclose(h["lo"].to_numpy(), edges[:-1]) and h["hi"].iloc[-1] == edges[-1]


def test_score_and_class_profiles(spark):
    df = spark.createDataFrame([(0.1, [0.2, 0.8]), (0.5, [0.6, 0.4]), (0.9, [0.5, 0.5])], "p double, a array<double>")
    s = D.score_profile(df, "p").first()
    assert s["std"] == pytest.approx(np.std([0.1, 0.5, 0.9]))  # population std
    c = D.class_profile(df, "a").orderBy("class_idx").toPandas()
    assert c.n_classes.iloc[0] == 2 and c["mean"].tolist() == pytest.approx([0.4333333333, 0.5666666667])


def test_int_id_unpivot_matches_named_unpivot(spark):
    from tabwatch.functions.core import feature_name, to_long, to_long_ids
    df = spark.createDataFrame([(1.0, None), (float("nan"), 2.0), (3.0, 4.0)], "a double, b double")
    named = sorted((r["feature"], r["v"]) for r in to_long(df, ["a", "b"]).collect())
    ids = to_long_ids(df, ["a", "b"]).select(feature_name(["a", "b"]).alias("feature"), "v")
    assert sorted((r["feature"], r["v"]) for r in ids.collect()) == named == [("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 4.0)]
    assert to_long_ids(df, ["a", "b"], keep_missing=True).count() == 6


def test_one_wrong_record_fails_its_batch(spark):
    rows = [
        ("ok", {"a": "1", "b": "2.5"}), ("ok", {"a": "-7", "b": "3"}), ("ok", {"a": "2", "b": None}),
        ("none", None), ("none", {"a": "1", "b": "2"}), ("extra", {"a": "1", "b": "2", "z": "0", "y": "0"}), ("extra", {"a": "1", "b": "2"}),
        ("lacking", {"a": "1"}), ("some", {"a": "1"}), ("some", {"a": "1", "b": "2"}), ("order", {"b": "1", "a": "2"}), ("order", {"a": "2", "b": "1"}),
        ("wide", {"a": "1.5", "b": "2"}), ("wide", {"a": "1", "b": "2"}), ("text", {"a": "1", "b": "x"}), ("hole", {"a": None, "b": "2"}),
        ("big", {"a": "1", "b": "1e39"}), ("nan", {"a": "1", "b": "NaN"}), (None, {"a": "1", "b": "2"})]
    pairs = [(g, f and [*f], f and [*f.values()]) for g, f in rows]  # arrays, so that the order of keys is kept
    df = spark.createDataFrame(pairs, "g string, k array<string>, v array<string>").select("g", F.map_from_arrays("k", "v").alias("f")).repartition(4)
    contract = [("a", "int64"), ("b", "float64")]

    def told(**how):
        return {r.g: (r.batch_error, r.batch_features) for r in C.validate_batches(df, "g", "f", contract, **how).collect()}

    got = told()
    assert got.pop(None) == (None, None)
    assert got == {
        "ok": ("non_finite", "b"), "none": ("schema", ""), "extra": ("schema", "y"), "lacking": ("schema", "b"), "some": ("non_finite", "b"),
        "order": ("schema", "order"), "wide": ("dtype", "a:float64"), "text": ("dtype", "b:object"), "hole": ("dtype", "a:float64"),
        "big": ("non_finite", "b"), "nan": ("non_finite", "b")}
    loose = told(strict=False, type_errors=False)
    assert loose["order"] == loose["wide"] == (None, None) and loose["text"] == ("invalid_value", "b") and loose["hole"] == ("non_finite", "a")
    assert C.validate_batches(df.limit(0), "g", "f", contract).count() == 0
