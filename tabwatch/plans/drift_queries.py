"""Registered queries: profiles and drift on the driver tables.

Baseline / current split: ``lineitem`` at ship date 1998-01-01, ``orders`` at
order date 1996-01-01, ``embeddings`` by label.  Every float returned is rounded
to 6 decimals and profiles are rounded before they are used as edges, so Spark and
the DuckDB oracle agree past last-ulp differences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwatch.functions.core import round_floats, to_long
from tabwatch.operators import drift as E
from tabwatch.operators import predlog as G
from tabwatch.operators import profile as D
from tabwatch.operators import sketches as S
from tabwatch.operators.counts import value_counts_of
from tabwatch.plans.baselines import stored_baseline
from tabwatch.session import materialize
from tabwatch.sources.tables import read_table, ts_lit

# Fixed values of the registered plans (mirrored in plans.drift_oracle).
LINEITEM_SPLIT = "1998-01-01"
ORDERS_SPLIT = "1996-01-01"
LINEITEM_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_CATEGORICAL = ["l_returnflag", "l_linestatus"]
ORDERS_CATEGORICAL = ["o_orderstatus", "o_orderpriority"]
# small samples of the exact KS query
EXACT_SPLIT, EXACT_LAST = "2024-01-16", 120
PART_CATEGORICAL = ["p_brand", "p_type"]
# fixed scoring model for the prediction-drift plans: sigmoid(b0 + sum bi*xi)
SCORE_INTERCEPT = -1.0
SCORE_COEFFICIENTS = {"l_quantity": 0.04, "l_discount": 8.0, "l_tax": -10.0}


def lineitem_halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = read_table(spark, sf, "lineitem")
    return li.where(F.col("l_shipdate") < ts_lit(LINEITEM_SPLIT)), li.where(F.col("l_shipdate") >= ts_lit(LINEITEM_SPLIT))


def orders_halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = read_table(spark, sf, "orders")
    return o.where(F.col("o_orderdate") < ts_lit(ORDERS_SPLIT)), o.where(F.col("o_orderdate") >= ts_lit(ORDERS_SPLIT))


def score_column(df: DataFrame) -> DataFrame:
    lin = F.lit(SCORE_INTERCEPT)
    for c, b in SCORE_COEFFICIENTS.items():
        lin = lin + F.lit(b) * F.col(c)
    return df.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-lin)))


def _table_path(sf: str, name: str) -> str:
    return f"{sf.rstrip('/')}/{name}.parquet"


def _base_profile(spark, sf):
    """Baseline profile of the earlier rows: a stored baseline artifact (built
    once from the table, as the reference stores its baseline) read by every
    drift operator."""
    base, cur = lineitem_halves(spark, sf)
    prof = stored_baseline(spark, "lineitem_numeric_profile", [_table_path(sf, "lineitem")],
                           lambda: round_floats(D.numeric_profile(base, LINEITEM_NUMERIC)), spec=(LINEITEM_SPLIT, LINEITEM_NUMERIC))
    return prof, base, cur


# ----------------------------------------------------------------- profiles
def d1_numeric_profile(spark, sf):
    return round_floats(D.numeric_profile(read_table(spark, sf, "lineitem"), LINEITEM_NUMERIC))


def d1_sketch_profile(spark, sf):
    """Sketched parts of each ship year, merged: exact columns as they are, estimates as whether
    they keep their bounds against an exact look at the rows."""
    li = read_table(spark, sf, "lineitem")
    parts = S.profile_parts(li.withColumn("year", F.year("l_shipdate")), LINEITEM_NUMERIC, ["year"])
    probs = D.PROFILE_PERCENTILES
    got = materialize(S.profile_of_parts(parts))  # one row a feature
    counts = value_counts_of(li, LINEITEM_NUMERIC).where("v is not null").join(F.broadcast(got.select("feature", *probs)), "feature")
    below = [F.sum(F.when(F.col("v") < F.col(p), F.col("n")).otherwise(0)).alias(f"{p}_lo") for p in probs]
    upto = [F.sum(F.when(F.col("v") <= F.col(p), F.col("n")).otherwise(0)).alias(f"{p}_hi") for p in probs]
    exact = counts.groupBy("feature").agg(F.count("*").alias("n_exact"), *below, *upto)
    held = F.lit(True)
    for name, p in probs.items():
        held = held & (F.col(f"{name}_lo") <= (p + S.RANK_ERROR) * F.col("n")) & (F.col(f"{name}_hi") >= (p - S.RANK_ERROR) * F.col("n"))
    near = F.abs(F.col("n_unique") - F.col("n_exact")) <= S.DISTINCT_ERROR * F.col("n_exact")
    return got.join(exact, "feature").select("feature", "n_rows", "n", "min", "max", near.alias("distinct_in_bound"), held.alias("ranks_in_bound"))


def d2_categorical_profile(spark, sf):
    part = read_table(spark, sf, "part")
    return round_floats(D.categorical_profile(part, PART_CATEGORICAL))


def d3_missing_rate(spark, sf):
    return round_floats(D.missing_rate(read_table(spark, sf, "documents")))


def d5_score_profile(spark, sf):
    return round_floats(D.score_profile(score_column(read_table(spark, sf, "lineitem")), "score"))


def d6_histogram(spark, sf):
    return round_floats(D.histogram(score_column(read_table(spark, sf, "lineitem")), "score"))


def d7_class_profile(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    return round_floats(D.class_profile(emb, "embedding"))


def d8_describe(spark, sf):
    return round_floats(D.describe(read_table(spark, sf, "customer"), ["c_acctbal", "c_nationkey", "c_custkey"]))


def d9_value_counts(spark, sf):
    return round_floats(D.value_counts(read_table(spark, sf, "orders"), "o_orderpriority"))


def d4_build_baseline(spark, sf):
    li = score_column(read_table(spark, sf, "lineitem"))
    return round_floats(D.build_baseline(li, LINEITEM_NUMERIC, LINEITEM_CATEGORICAL, "score"))


# -------------------------------------------------------------------- drift
def e1_edge_histogram(spark, sf):
    prof, _, cur = _base_profile(spark, sf)
    edges = prof.select("feature", E.quartile_edges(prof).alias("edges"))
    return E.edge_histogram(to_long(cur, LINEITEM_NUMERIC), edges)


def e3_numeric_psi(spark, sf):
    prof, _, cur = _base_profile(spark, sf)
    return round_floats(E.numeric_psi(to_long(cur, LINEITEM_NUMERIC), prof))


def e3_numeric_psi_observed(spark, sf):
    prof, base, cur = _base_profile(spark, sf)
    out = E.numeric_psi(to_long(cur, LINEITEM_NUMERIC), prof, expected="observed",
                        base_long=to_long(base, LINEITEM_NUMERIC))
    return round_floats(out.select("feature", "psi"))


def e6_mean_shift(spark, sf):
    prof, _, cur = _base_profile(spark, sf)
    return round_floats(E.mean_shift(to_long(cur, LINEITEM_NUMERIC), prof))


def e12_numeric_psi_alerts(spark, sf):
    """Flagship: baseline profile -> PSI + mean shift on the current half ->
    alert flag, one row per feature."""
    prof, _, cur = _base_profile(spark, sf)
    long = to_long(cur, LINEITEM_NUMERIC)
    psi = E.numeric_psi(long, prof).select("feature", "psi")
    ms = E.mean_shift(long, prof)
    out = psi.join(ms, "feature").withColumn(
        "alert", F.col("psi").isNotNull() & ~F.isnan("psi") & (F.col("psi") > E.PSI_THRESHOLD)
    )
    return round_floats(out)


def e4_reference_sample(spark, sf):
    prof, _, _ = _base_profile(spark, sf)
    s = E.reference_sample(prof)
    return round_floats(s.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    ))


def e5_ks_two_sample(spark, sf):
    base, cur = lineitem_halves(spark, sf)
    return round_floats(E.ks_two_sample(to_long(base, LINEITEM_NUMERIC), to_long(cur, LINEITEM_NUMERIC)))


def e5_ks_profile(spark, sf):
    prof, _, cur = _base_profile(spark, sf)
    return round_floats(E.ks_against_profile(to_long(cur, LINEITEM_NUMERIC), prof))


def e5_ks_exact(spark, sf):
    """Exact p-values of small samples: the last EXACT_LAST values of each event type before and
    from the date that parts them (fewer where there are fewer)."""
    ev = read_table(spark, sf, "events").select(F.col("event_type").alias("feature"), F.col("value").cast("double").alias("v"), "ts", F.col("event_id"),
                                                (F.col("ts") < ts_lit(EXACT_SPLIT)).alias("early"))
    last = G.last_n(ev, EXACT_LAST, keys=["feature", "early"], order=("ts", "event_id"))
    a, b = (last.where(c).select("feature", "v") for c in ("early", "not early"))
    return round_floats(E.ks_two_sample(a, b, exact_up_to=E.EXACT_KS_ROWS))


def _orders_cat_profile(spark, sf):
    base, cur = orders_halves(spark, sf)
    # shares stay unrounded: rounded ones do not add up to 1 and the test would not apply
    prof = stored_baseline(spark, "orders_categorical_profile", [_table_path(sf, "orders")],
                           lambda: D.categorical_profile(base, ORDERS_CATEGORICAL), spec=(ORDERS_SPLIT, ORDERS_CATEGORICAL))
    return prof, cur


def e7_chi_square(spark, sf):
    prof, cur = _orders_cat_profile(spark, sf)
    return round_floats(E.chi_square(to_long(cur, ORDERS_CATEGORICAL, value_type="string"), prof))


def e7_chi_square_part(spark, sf):
    """Top-10 baseline shares of 25 brands: shares sum below 1, so the statistic is
    NULL with status ``sum_mismatch`` (as the reference's test library raises)."""
    part = read_table(spark, sf, "part")
    base = part.where(F.col("p_size") <= 25)
    cur = part.where(F.col("p_size") > 25)
    prof = round_floats(D.categorical_profile(base, ["p_brand"]))
    return round_floats(E.chi_square(to_long(cur, ["p_brand"], value_type="string"), prof))


def e7_chi_square_test(spark, sf):
    """Statistic and p-value."""
    prof, cur = _orders_cat_profile(spark, sf)
    return round_floats(E.chi_square_test(to_long(cur, ORDERS_CATEGORICAL, value_type="string"), prof))


def _score_base(base: DataFrame) -> DataFrame:
    s = score_column(base)
    h = D.histogram(s, "score")
    agg = h.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("bin", "lo", "hi", "count"))).alias("_b")
    )  # one row of 20 bins
    stats = s.agg(F.avg("score").alias("mean"))
    from tabwatch.functions.core import join_small
    return join_small(agg, stats).select(
        "mean",
        F.concat(F.transform("_b", lambda x: x["lo"]), F.array(F.element_at("_b", -1)["hi"])).alias("edges"),
        F.transform("_b", lambda x: x["count"]).alias("counts"),
    )


def _stored_score_base(spark, sf, base):
    return stored_baseline(spark, "lineitem_score_histogram", [_table_path(sf, "lineitem")],
                           lambda: round_floats(_score_base(base)), spec=(LINEITEM_SPLIT, SCORE_INTERCEPT, SCORE_COEFFICIENTS))


def e8_score_drift(spark, sf):
    base, cur = lineitem_halves(spark, sf)
    return round_floats(E.score_drift(score_column(cur), "score", _stored_score_base(spark, sf, base), n_edges=D.HISTOGRAM_BINS + 1))


def _softmax(col: str):
    ex = F.transform(F.col(col), lambda x: F.exp(x.cast("double")))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, x: a + x)
    return F.transform(ex, lambda x: x / tot)


def e9_class_drift(spark, sf):
    emb = read_table(spark, sf, "embeddings").withColumn("probs", _softmax("embedding"))
    base = emb.where(F.col("label") == 0)
    cur = emb.where(F.col("label") != 0)
    cb = round_floats(D.class_profile(base, "probs"))
    return round_floats(E.class_drift(cur, "probs", cb))


def e10_feature_drift(spark, sf):
    prof, _, cur = _base_profile(spark, sf)
    cat, oc = _orders_cat_profile(spark, sf)
    num = E.feature_drift(cur, prof, None, num_features=LINEITEM_NUMERIC)
    cats = E.feature_drift(oc, None, cat, cat_features=ORDERS_CATEGORICAL)
    return round_floats(num.unionByName(cats))


def e11_prediction_drift(spark, sf):
    base, cur = lineitem_halves(spark, sf)
    out = E.prediction_drift(score_column(cur), "binary_classification", score_col="score",
                             score_base=_stored_score_base(spark, sf, base), n_edges=D.HISTOGRAM_BINS + 1)
    return round_floats(out)


def _alert_scores(spark, sf):
    """The scores that alerts and exported gauges look at: PSI and the KS p-value, of
    numeric features and the prediction; nothing else is computed. One scan counts the
    values of the features and the scores."""
    prof, base, cur = _base_profile(spark, sf)
    cur = score_column(cur)
    counts = value_counts_of(cur, [*LINEITEM_NUMERIC, "score"])
    num = E.feature_drift(cur, prof, None, num_features=LINEITEM_NUMERIC, metrics=["psi", "ks_pvalue"], counts=counts)
    scores = counts.where("feature = 'score' and v is not null").select(F.col("v").alias("score"), "n")
    pred = E.prediction_drift(scores, "binary_classification", score_col="score", score_base=_stored_score_base(spark, sf, base),
                              n_edges=D.HISTOGRAM_BINS + 1, weight="n")
    return round_floats(num).unionByName(round_floats(pred))


def e12_drift_alerts(spark, sf):
    return round_floats(E.drift_alerts(_alert_scores(spark, sf)))


def e13_drift_score_rows(spark, sf):
    return round_floats(E.drift_score_rows(_alert_scores(spark, sf), "v19980101_000000_abcdef"))


QUERIES = {
    "d1_numeric_profile": d1_numeric_profile,
    "d1_sketch_profile": d1_sketch_profile,
    "d2_categorical_profile": d2_categorical_profile,
    "d3_missing_rate": d3_missing_rate,
    "d4_build_baseline": d4_build_baseline,
    "d5_score_profile": d5_score_profile,
    "d6_histogram": d6_histogram,
    "d7_class_profile": d7_class_profile,
    "d8_describe": d8_describe,
    "d9_value_counts": d9_value_counts,
    "e1_edge_histogram": e1_edge_histogram,
    "e3_numeric_psi": e3_numeric_psi,
    "e3_numeric_psi_observed": e3_numeric_psi_observed,
    "e4_reference_sample": e4_reference_sample,
    "e5_ks_two_sample": e5_ks_two_sample,
    "e5_ks_exact": e5_ks_exact,
    "e5_ks_profile": e5_ks_profile,
    "e6_mean_shift": e6_mean_shift,
    "e7_chi_square": e7_chi_square,
    "e7_chi_square_part": e7_chi_square_part,
    "e7_chi_square_test": e7_chi_square_test,
    "e8_score_drift": e8_score_drift,
    "e9_class_drift": e9_class_drift,
    "e10_feature_drift": e10_feature_drift,
    "e11_prediction_drift": e11_prediction_drift,
    "e12_numeric_psi_alerts": e12_numeric_psi_alerts,
    "e12_drift_alerts": e12_drift_alerts,
    "e13_drift_score_rows": e13_drift_score_rows,
}
