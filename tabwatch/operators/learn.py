"""Split, fit, evaluate and score.

The split is deterministic (md5 ordering) and its ranks come from the
distributed running sum, so a class holding a third of the rows does not land in
one task.  Scoring is a codegen'd column expression; only the fitted
coefficients (one number per feature) travel to the driver.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.functions.core import join_small
from tabwatch.plans.ordered import running_sum
from tabwatch.session import materialize

# Split defaults and the L2 strength of the reference estimator.
TEST_SIZE = 0.2
SEED = 42
C_INVERSE_REG = 1.0
MAX_ITER = 1000
#: Rows of a class in one range of the hash that are ranked by a window, at most.
FEW = 100_000
#: Features up to which a fit solves Newton steps; beyond, limited-memory steps.
NEWTON_FEATURES = 40


def _hash_order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def split_quotas(df: DataFrame, label: str, test_size: float = TEST_SIZE) -> DataFrame:
    """Per class ``label, n_class, n_train, n_test`` (largest remainder). A class with
    one row cannot be in both parts: that is an error."""
    return _quotas(df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class")), label, test_size)


def _quotas(per: DataFrame, label: str, test_size: float) -> DataFrame:
    """:func:`split_quotas` from ``label, n_class``."""
    per = per.withColumn("n_class", F.when(F.col("n_class") < 2, F.raise_error(F.concat(
        F.lit("stratified split: class with one row: "), F.col(label).cast("string"))).cast("long")).otherwise(F.col("n_class")))
    w = Window.partitionBy(F.lit(0))  # one row per class
    t = per.withColumn("_n", F.sum("n_class").over(w))
    t = t.withColumn("_ntrain", F.col("_n") - F.ceil(F.lit(test_size) * F.col("_n")))
    product = F.col("_ntrain").cast("decimal(19,0)") * F.col("n_class").cast("decimal(19,0)")  # beyond the range of a long
    t = t.withColumn("_exact", product.cast("double") / F.col("_n"))
    t = t.withColumn("_floor", F.floor("_exact")).withColumn("_frac", F.col("_exact") - F.col("_floor"))
    t = t.withColumn("_left", F.col("_ntrain") - F.sum("_floor").over(w))
    t = t.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_frac"), F.asc(label))))
    t = t.withColumn("n_train", (F.col("_floor") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).cast("long"))
    return t.select(label, "n_class", "n_train", (F.col("n_class") - F.col("n_train")).alias("n_test"))


def _cuts(df: DataFrame, label: str, id_col: str, test_size: float, seed: int) -> DataFrame:
    """Per class the (hash, id) of its last training row, NULL without one: ``label, _ch, _cid``,
    one row a class. Found by counting rows per range of the hash: the range that holds the
    wanted rank is narrowed by four hex digits at a time until few rows are left in it."""
    rows = df.select(label, F.col(id_col).alias("_id"), _hash_order(id_col, seed).alias("_h"))
    ranges, known, want = None, 0, None
    while True:
        inside = rows if ranges is None else rows.join(F.broadcast(ranges), F.col(label).eqNullSafe(F.col("_l")) & F.col("_h").startswith(F.col("_p"))).drop("_l", "_p")
        if ranges is not None and most <= FEW:
            break
        known += 4
        counts = materialize(inside.groupBy(label, F.substring("_h", 1, known).alias("_p")).agg(F.count(F.lit(1)).alias("_n")))  # at most 65536 rows a class
        if want is None:
            want = materialize(_quotas(counts.groupBy(label).agg(F.sum("_n").alias("n_class")), label, test_size).select(F.col(label).alias("_l"), F.col("n_train").alias("_k")))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = counts.withColumn("_b", before).join(F.broadcast(want), F.col(label).eqNullSafe(F.col("_l"))).where((F.col("_b") < F.col("_k")) & (F.col("_k") <= F.col("_b") + F.col("_n")))
        found = materialize(at.select("_l", "_p", (F.col("_k") - F.col("_b")).alias("_k"), "_n"))  # one row a class
        most = found.agg(F.max("_n")).first()[0] or 0
        if known == 32:
            most = 0  # equal hashes are equal ids
        ranges, want = found.select("_l", "_p"), found.select("_l", "_k")
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", "_id"))
    return inside.withColumn("_r", rank).join(F.broadcast(want), F.col(label).eqNullSafe(F.col("_l"))).where("_r = _k").select(
        F.col("_l"), F.col("_h").alias("_ch"), F.col("_id").alias("_cid"))


def stratified_split(df: DataFrame, label: str, id_col: str, test_size: float = TEST_SIZE,
                     seed: int = SEED) -> DataFrame:
    """adds ``split`` in (``train``, ``test``); class shares kept, order within a
    class by ``md5(seed-id)`` then id. The last training row of each class is found by
    counting; then every row is told its part where it stands, without a shuffle or a window.
    Rows that share an id and class are in the same part."""
    cuts = materialize(_cuts(df, label, id_col, test_size, seed))
    told = df.withColumn("_h", _hash_order(id_col, seed)).join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("_l")), "left")  # one row a class
    first = (F.col("_h") < F.col("_ch")) | (F.col("_h") == F.col("_ch")) & F.col(id_col).cast("string").eqNullSafe(F.col("_cid").cast("string"))
    return told.withColumn("split", F.when(first, "train").otherwise("test")).drop("_h", "_l", "_ch", "_cid")


@dataclass
class Fit:
    """A fitted logistic function."""

    intercept: float
    coefficients: np.ndarray
    iterations: int


def fit_newton(df: DataFrame, features: Sequence[str], label: str, c: float = C_INVERSE_REG, max_iter: int = MAX_ITER, tol: float = 1e-10) -> Fit:
    """F2 by Newton steps: each one is a single aggregate of X'WX and X'(y - p) over the rows,
    so a step moves (d + 1)(d + 4) / 2 numbers and no row. A step that raises the objective is
    halved."""
    d = len(features) + 1
    x = [F.lit(1.0), *[F.col(f"`{f}`") for f in features]]
    penalty = np.array([0.0] + [1.0] * (d - 1))
    w = last = step = np.zeros(d)
    best, n = math.inf, 0
    while True:
        z = F.lit(float(w[0]))
        for b, v in zip(w[1:], x[1:], strict=True):
            z = z + F.lit(float(b)) * v
        y, p = F.col("_y"), 1.0 / (1.0 + F.exp(-F.col("_z")))
        loss = F.greatest(F.col("_z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("_z"))) - y * F.col("_z")
        sums = [F.sum(loss)] + [F.sum((y - p) * v) for v in x] + [F.sum(p * (1.0 - p) * x[i] * x[j]) for i in range(d) for j in range(i, d)]
        got = np.array([v or 0.0 for v in df.withColumn("_z", z).agg(*sums).first()])
        objective = c * got[0] + 0.5 * float((penalty * w * w).sum())
        if objective > best + 1e-9 * abs(best) and np.abs(step).max() > tol:
            step = step / 2
            w = last + step
        else:
            best, last = objective, w
            half = np.zeros((d, d))
            half[np.triu_indices(d)] = c * got[1 + d :]
            hessian = half + np.triu(half, 1).T + np.diag(penalty) + 1e-12 * np.eye(d)
            step = np.linalg.solve(hessian, c * got[1 : 1 + d] - penalty * w)
            w = last + step
        n += 1
        if np.abs(step).max() <= tol or n >= max_iter:
            return Fit(float(w[0]), w[1:], n)


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, c: float = C_INVERSE_REG,
                 max_iter: int = MAX_ITER):
    """L2 logistic regression equal to the reference objective
    (C * sum logloss + 0.5 ||w||^2), the intercept free: Newton steps, or for many
    features limited-memory ones (regParam = 1 / (C n), no standardisation)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from pyspark import StorageLevel

    # the optimiser passes over the data once per iteration: snapshot the
    # training columns once (lineage cut, deterministic on retries) and keep
    # them cached for the iterations
    snap = materialize(df.select(*[F.col(f).cast("double").alias(f) for f in features],
                                 F.col(label).cast("double").alias("_y")))
    if len(features) <= NEWTON_FEATURES:
        return fit_newton(snap, features, "_y", c, max_iter)
    data = VectorAssembler(inputCols=list(features), outputCol="_x").transform(snap).select("_x", "_y")
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = data.count()
        lr = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / (c * n), elasticNetParam=0.0,
                                standardization=False, maxIter=max_iter, tol=1e-10, fitIntercept=True)
        return lr.fit(data)
    finally:
        data.unpersist()


def coefficients(model, features: Sequence[str]) -> tuple[float, dict[str, float]]:
    coef = np.asarray(getattr(model.coefficients, "toArray", lambda: model.coefficients)()).tolist()
    return float(model.intercept), dict(zip(features, coef))


def score(df: DataFrame, intercept: float, coefs: dict[str, float], model_version: str | None = None,
          float32: bool = True) -> DataFrame:
    """``probability`` = sigmoid(b0 + sum bi xi), ``predicted_class`` (1 when
    probability > 0.5), ``model_version``.  Features are cast to float32 first,
    as the reference's scoring input."""
    lin = F.lit(float(intercept))
    for f, b in coefs.items():
        x = F.col(f).cast("float").cast("double") if float32 else F.col(f).cast("double")
        lin = lin + F.lit(float(b)) * x
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-lin))
    out = df.withColumn("probability", p).withColumn(
        "predicted_class", F.when(F.col("probability") > 0.5, 1).otherwise(0))
    if model_version is not None:
        out = out.withColumn("model_version", F.lit(model_version))
    return out


def pick_probability(probs: Column, cls: Column) -> Column:
    """two classes -> P(class 1); otherwise P(predicted class)."""
    return F.when(F.size(probs) == 2, F.element_at(probs, 2)).otherwise(F.element_at(probs, cls + 1))


def classification_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """``tp, fp, fn, tn, accuracy, precision, recall, f1`` (0/0 -> 0)."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    c = df.agg(
        F.count(F.when((y == 1) & (p == 1), 1)).alias("tp"), F.count(F.when((y == 0) & (p == 1), 1)).alias("fp"),
        F.count(F.when((y == 1) & (p == 0), 1)).alias("fn"), F.count(F.when((y == 0) & (p == 0), 1)).alias("tn"),
    )

    def div(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    c = c.withColumn("accuracy", div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
    c = c.withColumn("precision", div(F.col("tp"), F.col("tp") + F.col("fp")))
    c = c.withColumn("recall", div(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def roc_auc(df: DataFrame, label: str, score_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """tie-aware AUC = sum pos * (neg below + neg tied / 2) / (P N); NULL when
    one class is absent.  Built on distinct scores with a distributed running sum."""
    keys = list(keys)
    y = F.col(label).cast("int")
    g = df.groupBy(*keys, F.col(score_col).cast("double").alias("_s")).agg(
        F.count(F.when(y == 1, 1)).alias("_pos"), F.count(F.when(y == 0, 1)).alias("_neg"))
    cum = running_sum(g, keys, ["_s"], ["_neg"])
    part = cum.groupBy(*keys).agg(
        F.sum(F.col("_pos") * ((F.col("_neg_cum") - F.col("_neg")) + F.col("_neg") / 2.0)).alias("_num"),
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    return part.select(*keys, "n_pos", "n_neg",
                       F.try_divide(F.col("_num"), F.col("n_pos").cast("double") * F.col("n_neg").cast("double")).alias("roc_auc"))


def run_metadata(spark, model_version: str, model_type: str, metrics: DataFrame, n_train: int, n_test: int,
                 features: Sequence[str], schema_hash: str, started: float | None = None,
                 code_version: str = "unknown") -> DataFrame:
    """one summary row: version, type, metrics, sample counts, hyperparameters, lineage
    (what made it, from which code, in which format) and, with ``started``, the duration."""
    meta = {
        "model_version": model_version, "model_type": model_type, "framework": "spark", "format": "coefficients",
        "training_samples": int(n_train), "test_samples": int(n_test), "n_features": len(features),
        "feature_names": ",".join(features), "C": C_INVERSE_REG, "max_iter": MAX_ITER, "schema_hash": schema_hash,
        "created_by": "training_pipeline", "code_version": code_version}
    if started is not None:
        meta["training_duration_s"] = round(time.time() - started, 3)
    return join_small(spark.createDataFrame([meta]), metrics)


__all__ = ["stratified_split", "split_quotas", "fit_logistic", "fit_newton", "coefficients", "score", "pick_probability",
           "classification_metrics", "roc_auc", "run_metadata", "math"]
