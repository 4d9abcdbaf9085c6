"""Registered queries: registry analytics (I1-I8) and version format (B9) over
the promotion log, model metadata and artifact listing derived from ``orders``;
I8 (as-of) uses signup events as promotions of the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwatch.functions.core import round_floats, ts_string
from tabwatch.operators import registry as I
from tabwatch.operators.contract import valid_version
from tabwatch.sources.derived import artifacts, models, promotions
from tabwatch.sources.tables import read_table


BUCKET = "tabwatch-models"  # of the pointers' stored paths


def _orders(spark, sf):
    return read_table(spark, sf, "orders")


def b9_valid_version(spark, sf):
    p = promotions(_orders(spark, sf)).select("model_version")
    ev = read_table(spark, sf, "events").select(
        F.concat(F.lit("v"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), F.col("event_type")).alias("model_version"))
    v = p.unionByName(ev)
    return v.select("model_version", valid_version(F.col("model_version")).alias("prefix_ok"),
                    valid_version(F.col("model_version"), strict=True).alias("strict_ok"))


def i1_list_versions(spark, sf):
    return I.list_versions(models(_orders(spark, sf)))


def i2_current_pointer(spark, sf):
    c = I.current_pointer(promotions(_orders(spark, sf)))
    return c.select("environment", "model_version", ts_string("promoted_at").alias("promoted_at"), "promoted_by")


def h11_current_model(spark, sf):
    """Dashboard "current model" panel: the serving version per environment."""
    return I.current_pointer(promotions(_orders(spark, sf))).select("environment", "model_version")


def i3_promotion_history(spark, sf):
    h = I.promotion_history(promotions(_orders(spark, sf)))
    return h.select("environment", "rank", "model_version", ts_string("promoted_at").alias("promoted_at"))


def i4_pointer_check(spark, sf):
    o = _orders(spark, sf)
    return I.pointer_check(promotions(o), artifacts(o))


def i4_validate_pointers(spark, sf):
    """Pointers with the paths they store; of each forty some lack one, name another bucket or a key
    that is not there, besides those whose artifacts are missing anyway."""
    o = _orders(spark, sf)
    kind, v, prefix = F.col("promotion_seq") % 40, F.col("model_version"), f"s3://{BUCKET}/"
    stored = promotions(o).select(
        "environment", "model_version", "promotion_seq",
        F.when(kind != 0, F.concat(F.when(kind == 1, F.lit("s3://elsewhere/")).otherwise(F.lit(prefix)), F.lit("models/"), v, F.lit(".onnx"))).alias("model_path"),
        F.concat(F.lit(prefix), F.lit("metadata/"), v, F.when(kind == 2, F.lit(".yaml")).otherwise(F.lit(".json"))).alias("metadata_path"),
        F.when(kind != 3, F.concat(F.lit(prefix), F.lit("baselines/"), v, F.lit("_baseline.json"))).alias("baseline_path"))
    return I.validate_pointers(stored, artifacts(o), BUCKET).select("environment", "model_version", "promotion_seq", "valid", "reason", "failed_path")


def i5_eligibility(spark, sf):
    o = _orders(spark, sf)
    return I.eligibility(promotions(o), models(o), artifacts(o))


def i6_rollback_target(spark, sf):
    r = I.rollback_target(promotions(_orders(spark, sf)))
    return r.select("environment", "model_version", "previous_version", ts_string("promoted_at").alias("promoted_at"),
                    (F.col("previous_version").isNotNull()).alias("can_rollback"))


def i7_model_info(spark, sf):
    o = _orders(spark, sf)
    info = I.model_info(I.current_pointer(promotions(o)), models(o))
    return round_floats(info.select("environment", "model_version", "model_type", "accuracy", "training_samples"))


def i8_version_in_force(spark, sf):
    ev = read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    promos = ev.where(F.col("event_type") == "signup").select(
        F.col("ts").alias("promoted_at"), F.col("event_id").alias("promotion_seq"),
        F.concat(F.lit("v"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"),
                 F.substring(F.md5(F.col("event_id").cast("string")), 1, 6)).alias("model_version"))
    log = ev.where(F.col("event_type") != "signup").select("event_id", "ts")
    return I.version_in_force(log, promos).select("event_id", "version_in_force")


QUERIES = {
    "b9_valid_version": b9_valid_version,
    "i1_list_versions": i1_list_versions,
    "i2_current_pointer": i2_current_pointer,
    "h11_current_model": h11_current_model,
    "i3_promotion_history": i3_promotion_history,
    "i4_pointer_check": i4_pointer_check,
    "i4_validate_pointers": i4_validate_pointers,
    "i5_eligibility": i5_eligibility,
    "i6_rollback_target": i6_rollback_target,
    "i7_model_info": i7_model_info,
    "i8_version_in_force": i8_version_in_force,
}


# ===================================================================== oracle
TS = "'%Y-%m-%d %H:%M:%S'"
VER = ("'v' || strftime(o_orderdate, '%Y%m%d') || '_' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') "
       "|| '_' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 6)")
PROMO = f"""SELECT o_orderstatus AS environment, {VER} AS model_version, CAST(o_orderdate AS TIMESTAMP) AS promoted_at,
    o_orderkey AS promotion_seq, 'user-' || CAST(o_custkey AS VARCHAR) AS promoted_by, o_orderpriority AS promotion_reason
    FROM orders"""
MODELS = f"""SELECT {VER} AS model_version, 'logistic_regression' AS model_type, true AS has_schema,
    o_orderpriority <> '5-LOW' AS has_metrics, round(o_totalprice / 600000.0, 6) AS accuracy, o_custkey AS training_samples
    FROM orders"""
ARTS = f"""SELECT 'models/' || {VER} || '.onnx' AS path FROM orders
    UNION ALL SELECT 'metadata/' || {VER} || '.json' FROM orders WHERE o_orderpriority <> '1-URGENT'
    UNION ALL SELECT 'baselines/' || {VER} || '_baseline.json' FROM orders WHERE o_totalprice > 1000"""
STRICT = "regexp_full_match(model_version, 'v[0-9]{8}_[0-9]{6}_[a-f0-9]{6}')"


def o_b9():
    return f"""WITH p AS ({PROMO}),
        v AS (SELECT model_version FROM p UNION ALL
              SELECT 'v' || strftime(CAST(ts AS TIMESTAMP), '%Y%m%d_%H%M%S') || '_' || event_type FROM events)
        SELECT model_version, starts_with(model_version, 'v') AS prefix_ok, coalesce({STRICT}, false) AS strict_ok FROM v"""


def o_i1():
    return f"""WITH m AS ({MODELS}), v AS (SELECT DISTINCT model_version FROM m)
        SELECT model_version, row_number() OVER (ORDER BY model_version DESC) AS rank FROM v"""


def o_i2():
    return f"""WITH p AS ({PROMO})
        SELECT environment, arg_max(model_version, (promoted_at, promotion_seq)) AS model_version,
            strftime(max(promoted_at), {TS}) AS promoted_at, arg_max(promoted_by, (promoted_at, promotion_seq)) AS promoted_by
        FROM p GROUP BY environment"""


def o_h11():
    return f"""WITH p AS ({PROMO})
        SELECT environment, arg_max(model_version, (promoted_at, promotion_seq)) AS model_version FROM p GROUP BY environment"""


def o_i3():
    return f"""WITH p AS ({PROMO}),
        r AS (SELECT *, row_number() OVER (PARTITION BY environment ORDER BY promoted_at DESC, promotion_seq DESC) AS rn FROM p)
        SELECT environment, CAST(rn - 1 AS INTEGER) AS rank, model_version, strftime(promoted_at, {TS}) AS promoted_at
        FROM r WHERE rn BETWEEN 2 AND 11"""


def o_i4():
    return f"""WITH p AS ({PROMO}), a AS (SELECT DISTINCT path FROM ({ARTS})),
        e AS (SELECT environment, model_version, 'model' AS kind, 'models/' || model_version || '.onnx' AS path FROM p
              UNION ALL SELECT environment, model_version, 'metadata', 'metadata/' || model_version || '.json' FROM p
              UNION ALL SELECT environment, model_version, 'baseline', 'baselines/' || model_version || '_baseline.json' FROM p)
        SELECT environment, model_version, kind, path FROM e WHERE path NOT IN (SELECT path FROM a)"""


def o_i4_stored():
    b = f"s3://{BUCKET}/"
    return f"""WITH p AS (SELECT *, promotion_seq % 40 AS kind FROM ({PROMO})), a AS (SELECT DISTINCT path FROM ({ARTS})),
        s AS (SELECT environment, model_version, promotion_seq,
            CASE WHEN kind <> 0 THEN CASE WHEN kind = 1 THEN 's3://elsewhere/' ELSE '{b}' END || 'models/' || model_version || '.onnx' END AS m,
            '{b}metadata/' || model_version || CASE WHEN kind = 2 THEN '.yaml' ELSE '.json' END AS d,
            CASE WHEN kind <> 3 THEN '{b}baselines/' || model_version || '_baseline.json' END AS l FROM p),
        r AS (SELECT s.*,
            CASE WHEN m IS NULL THEN 'missing_key' WHEN NOT starts_with(m, '{b}') THEN 'invalid_uri' WHEN substr(m, {len(b) + 1}) NOT IN (SELECT path FROM a) THEN 'missing_object' END AS rm,
            CASE WHEN d IS NULL THEN 'missing_key' WHEN NOT starts_with(d, '{b}') THEN 'invalid_uri' WHEN substr(d, {len(b) + 1}) NOT IN (SELECT path FROM a) THEN 'missing_object' END AS rd,
            CASE WHEN l IS NULL THEN 'missing_key' WHEN NOT starts_with(l, '{b}') THEN 'invalid_uri' WHEN substr(l, {len(b) + 1}) NOT IN (SELECT path FROM a) THEN 'missing_object' END AS rl
            FROM s)
        SELECT environment, model_version, promotion_seq, coalesce(rm, rd, rl) IS NULL AS valid, coalesce(rm, rd, rl) AS reason,
            CASE WHEN rm IS NOT NULL THEN m WHEN rd IS NOT NULL THEN d WHEN rl IS NOT NULL THEN l END AS failed_path FROM r"""


def o_i5():
    return f"""WITH p AS ({PROMO}), m AS ({MODELS}), a AS ({ARTS}),
        f AS (SELECT CASE WHEN starts_with(path, 'models/') THEN regexp_extract(path, '^models/(.*)\\.onnx$', 1)
                          WHEN starts_with(path, 'metadata/') THEN regexp_extract(path, '^metadata/(.*)\\.json$', 1)
                          ELSE regexp_extract(path, '^baselines/(.*)_baseline\\.json$', 1) END AS model_version,
                     CASE WHEN starts_with(path, 'models/') THEN 'model' WHEN starts_with(path, 'metadata/') THEN 'metadata'
                          ELSE 'baseline' END AS kind FROM a),
        fl AS (SELECT model_version, bool_or(kind = 'model') AS has_model, bool_or(kind = 'metadata') AS has_metadata,
               bool_or(kind = 'baseline') AS has_baseline FROM f GROUP BY model_version),
        mc AS (SELECT model_version, max(CAST(has_schema AND has_metrics AND model_type IS NOT NULL AS INTEGER)) AS complete
               FROM m GROUP BY model_version),
        c AS (SELECT DISTINCT model_version FROM p)
        SELECT c.model_version, CASE WHEN NOT starts_with(c.model_version, 'v') THEN 'invalid_format'
            WHEN NOT coalesce(fl.has_model, false) THEN 'model_missing'
            WHEN NOT coalesce(fl.has_metadata, false) THEN 'metadata_missing'
            WHEN NOT coalesce(fl.has_baseline, false) THEN 'baseline_missing'
            WHEN coalesce(mc.complete, 0) = 0 THEN 'metadata_incomplete' ELSE 'eligible' END AS reason
        FROM c LEFT JOIN fl USING (model_version) LEFT JOIN mc USING (model_version)"""


def o_i6():
    return f"""WITH p AS ({PROMO})
        SELECT environment, model_version,
            lag(model_version) OVER (PARTITION BY environment ORDER BY promoted_at, promotion_seq) AS previous_version,
            strftime(promoted_at, {TS}) AS promoted_at,
            lag(model_version) OVER (PARTITION BY environment ORDER BY promoted_at, promotion_seq) IS NOT NULL AS can_rollback
        FROM p"""


def o_i7():
    return f"""WITH p AS ({PROMO}), m AS ({MODELS}),
        c AS (SELECT environment, arg_max(model_version, (promoted_at, promotion_seq)) AS model_version FROM p GROUP BY environment)
        SELECT c.environment, c.model_version, m.model_type, round(m.accuracy, 6) AS accuracy, m.training_samples
        FROM c LEFT JOIN m USING (model_version)"""


def o_i8():
    return """WITH ev AS (SELECT *, CAST(ts AS TIMESTAMP) AS t FROM events),
        p AS (SELECT t, event_id AS seq, 'v' || strftime(t, '%Y%m%d_%H%M%S') || '_' || substr(md5(CAST(event_id AS VARCHAR)), 1, 6) AS v
              FROM ev WHERE event_type = 'signup'),
        u AS (SELECT t, 0 AS kind, seq, v, NULL AS event_id FROM p
              UNION ALL SELECT t, 1, NULL, NULL, event_id FROM ev WHERE event_type <> 'signup'),
        f AS (SELECT event_id, kind, last_value(v IGNORE NULLS) OVER (ORDER BY t, kind, seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS version_in_force FROM u)
        SELECT event_id, version_in_force FROM f WHERE kind = 1"""


ORACLE = {
    "b9_valid_version": o_b9,
    "i1_list_versions": o_i1,
    "i2_current_pointer": o_i2,
    "h11_current_model": o_h11,
    "i3_promotion_history": o_i3,
    "i4_pointer_check": o_i4,
    "i4_validate_pointers": o_i4_stored,
    "i5_eligibility": o_i5,
    "i6_rollback_target": o_i6,
    "i7_model_info": o_i7,
    "i8_version_in_force": o_i8,
}
