"""Views derived from the driver tables that play the reference's inputs.

* ``request_log``   -- the scoring service's request log, from ``events``.
* ``prediction_log`` -- the prediction log, from ``events``.
* ``promotions``    -- the serving-pointer history, from ``orders``.
* ``models`` / ``artifacts`` -- the model store listing, from ``orders``.

Each mapping is plain column arithmetic, so the work grows with the tables.  The
DuckDB oracles next to the registered queries (``plans.*_queries``) spell out the same mappings in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.sources.tables import ts_lit

# Fixed values of the derivation (mirrored in the oracle SQL).
VERSION_SWITCH = "2024-01-15 00:00:00"
VERSION_OLD = "v20240101_000000_a1b2c3"
VERSION_NEW = "v20240115_000000_d4e5f6"
BATCH_ENDPOINT = "/v1/predict/batch"
SINGLE_ENDPOINT = "/v1/predict"


def version_of(ts_col: str = "ts"):
    """Serving version in force at an event time (switch at VERSION_SWITCH)."""
    return F.when(F.col(ts_col) < ts_lit(VERSION_SWITCH), F.lit(VERSION_OLD)).otherwise(F.lit(VERSION_NEW))


def request_log(events: DataFrame) -> DataFrame:
    """``ts, endpoint, model_version, status, error_type, latency_s, client,
    request_id, batch_size, event_id``."""
    k = F.get_json_object("props", "$.k").cast("long")
    is_batch = F.col("event_type").isin("purchase", "signup")
    return events.select(
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(is_batch, F.lit(BATCH_ENDPOINT)).otherwise(F.lit(SINGLE_ENDPOINT)).alias("endpoint"),
        version_of("ts").alias("model_version"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.when(F.col("event_type") == "error",
               F.when(F.col("value") < 100, F.lit("validation"))
               .when(F.col("value") < 200, F.lit("runtime"))
               .otherwise(F.lit("internal"))).alias("error_type"),
        (F.col("value") / 100.0).alias("latency_s"),
        F.concat(F.lit("client-"), F.col("user_id").cast("string")).alias("client"),
        F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"),
        F.when(is_batch, F.coalesce(k, F.lit(0)) % 20 + 1).otherwise(F.lit(1)).cast("long").alias("batch_size"),
    )


def prediction_log(events: DataFrame) -> DataFrame:
    """``request_id, pos, ts, model_version, prediction, prediction_class,
    value, k, user_id, event_id, event_type``: one scored instance per event.

    ``prediction`` is a fixed logistic map of ``value`` so it lies in (0, 1).
    """
    k = F.get_json_object("props", "$.k").cast("double")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("value") - 100.0) / 50.0))
    return events.select(
        F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"),
        F.lit(0).alias("pos"),
        F.col("ts").cast("timestamp").alias("ts"),
        version_of("ts").alias("model_version"),
        p.alias("prediction"),
        F.when(p >= 0.5, F.lit(1)).otherwise(F.lit(0)).alias("prediction_class"),
        F.col("value"), k.alias("k"), F.col("user_id"), F.col("event_id"), F.col("event_type"),
    )


def _version_of(orders: DataFrame):
    return F.concat(
        F.lit("v"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"),
        F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"), F.lit("_"),
        F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 6),
    )


def promotions(orders: DataFrame) -> DataFrame:
    """Serving-pointer history: one promotion per order.

    ``environment`` = order status, ``promoted_at`` = order date, ``model_version``
    built in the ``vYYYYMMDD_HHMMSS_hex6`` format, ``promotion_seq`` = order key
    (tie-breaker for equal timestamps)."""
    return orders.select(
        F.col("o_orderstatus").alias("environment"),
        _version_of(orders).alias("model_version"),
        F.col("o_orderdate").cast("timestamp").alias("promoted_at"),
        F.col("o_orderkey").alias("promotion_seq"),
        F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("promoted_by"),
        F.col("o_orderpriority").alias("promotion_reason"),
    )


def models(orders: DataFrame) -> DataFrame:
    """Model metadata rows: ``model_version, model_type, has_schema, has_metrics,
    accuracy, training_samples``; metadata lacks ``metrics`` for low priority."""
    return orders.select(
        _version_of(orders).alias("model_version"),
        F.lit("logistic_regression").alias("model_type"),
        F.lit(True).alias("has_schema"),
        (F.col("o_orderpriority") != "5-LOW").alias("has_metrics"),
        F.round(F.col("o_totalprice") / 600000.0, 6).alias("accuracy"),
        F.col("o_custkey").alias("training_samples"),
    )


def artifacts(orders: DataFrame) -> DataFrame:
    """Artifact listing ``path``: every model file; metadata unless the order is
    urgent; baseline when the total price exceeds 1000."""
    v = _version_of(orders)
    model = orders.select(F.concat(F.lit("models/"), v, F.lit(".onnx")).alias("path"))
    meta = orders.where(F.col("o_orderpriority") != "1-URGENT").select(
        F.concat(F.lit("metadata/"), v, F.lit(".json")).alias("path"))
    base = orders.where(F.col("o_totalprice") > 1000).select(
        F.concat(F.lit("baselines/"), v, F.lit("_baseline.json")).alias("path"))
    return model.unionByName(meta).unionByName(base)
