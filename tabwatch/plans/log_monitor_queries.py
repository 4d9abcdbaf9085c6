"""Registered queries: prediction log (A3-A5, G1-G4, G8, G9) and service
monitoring (H1-H16) over views derived from ``events``."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tabwatch.functions.core import round_floats, ts_string
from tabwatch.operators import drift as E
from tabwatch.operators import monitor as H
from tabwatch.operators import predlog as G
from tabwatch.operators import profile as D
from tabwatch.operators.contract import validate_for_scoring
from tabwatch.sources.derived import (
    BATCH_ENDPOINT, SINGLE_ENDPOINT, VERSION_NEW, VERSION_OLD, VERSION_SWITCH, prediction_log, request_log,
    version_of,
)
from tabwatch.plans.baselines import stored_baseline
from tabwatch.plans.contract_learn_queries import scoring_records
from tabwatch.sources.tables import read_table, ts_lit
from tabwatch.streaming.windows import windowed_numeric_drift

# Fixed values of these plans (mirrored in the SQL below).
LAST_N = 5
GLOBAL_LAST_N = 1000
RETAIN_PER_VERSION = 2000
CHECK_STATE_TS = "2024-01-20 00:00:00"
EVENTS_BASELINE_END = "2024-01-08 00:00:00"
STAMP = "2024-03-01 12:00:00"
# the replayed monitor: features, and a check a week or every DRIFT_WINDOW rows
MONITORED, MONITORED_CATEGORICAL = ["value", "k"], ["event_type"]
MONITOR_INTERVAL_S, MONITOR_RETENTION = 7 * 86400, 2 * G.DRIFT_WINDOW
# limits of the audit and the alert rule that the given rows do exceed
AUDIT_WINDOW, AUDIT_LIMITS = "1 day", {SINGLE_ENDPOINT: 3, BATCH_ENDPOINT: 2}
ALERT_PSI, ALERT_KS = 0.01, 0.5


def _rl(spark, sf):
    return request_log(read_table(spark, sf, "events"))


def _pl(spark, sf):
    return prediction_log(read_table(spark, sf, "events"))


# ----------------------------------------------------------------- A / G
def a3_ingest(spark, sf):
    """Every seventh record comes without a time and is stamped."""
    ts = F.when(F.col("event_id") % 7 != 0, F.col("ts").cast("timestamp"))
    ev = read_table(spark, sf, "events").select("event_id", ts.alias("timestamp"))
    return G.ingest(ev, now=ts_lit(STAMP)).select("event_id", ts_string("timestamp").alias("timestamp"))


def _batches(spark, sf):
    pl = _pl(spark, sf)
    hour = F.date_trunc("hour", "ts")
    # a batch is one user's requests in one hour, split by event-id block so no
    # batch exceeds the 1000-instance contract (C6): collect_list stays bounded
    b = pl.groupBy("user_id", hour.alias("hour"), F.floor(F.col("event_id") / 1000).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("event_id", "k", "prediction"))).alias("_items"),
        F.min("ts").alias("ts"))
    return b.select(
        F.concat(F.lit("batch-"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("hour", "yyyyMMddHH"),
                 F.lit("-"), F.col("block").cast("string")).alias("request_id"),
        "ts", F.lit(VERSION_OLD).alias("model_version"),
        F.transform("_items", lambda x: F.struct(x["event_id"].alias("event_id"), x["k"].alias("k"))).alias("instances"),
        F.transform("_items", lambda x: x["prediction"]).alias("predictions"))


def a4_flatten_batch(spark, sf):
    """Per-user hourly batches (bounded by the 1000-instance batch contract) are
    flattened back to one row per instance."""
    flat = G.flatten_batch(_batches(spark, sf), "instances", "predictions")
    return round_floats(flat.select("request_id", "pos", F.col("features.event_id").alias("event_id"), "prediction"))


def a5_records_to_table(spark, sf):
    ev = read_table(spark, sf, "events").withColumn("features", F.from_json("props", "map<string,double>"))
    return round_floats(G.records_to_table(ev, "features", keep=["event_id"]))


def a5_nested_records(spark, sf):
    """Records as nested JSON texts of several shapes; their columns are found from the texts."""
    ev = read_table(spark, sf, "events")
    kind, origin = F.col("event_id") % 3, F.struct(F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("id")).alias("user"))
    text = (F.when(kind == 0, F.to_json(F.struct(F.col("value"), origin.alias("origin"))))
            .when(kind == 1, F.to_json(F.struct((F.col("event_id") * 2).alias("twice"), origin.alias("origin"))))
            .otherwise(F.to_json(F.struct(F.array("event_id", "user_id").alias("ids")))))
    return round_floats(G.records_to_table(ev.select("event_id", text.alias("features")), "features", keep=["event_id"]).withColumn("ids", F.element_at("ids", 2)))


def g1_last_n(spark, sf):
    out = G.last_n(_pl(spark, sf), LAST_N, keys=["user_id"])
    return round_floats(out.select("user_id", "request_id", "seq", ts_string("ts").alias("ts"), "prediction"))


def g1_last_n_global(spark, sf):
    out = G.last_n(_pl(spark, sf), GLOBAL_LAST_N)
    return out.select("request_id", "seq")


def g2_retain(spark, sf):
    return G.retain(_pl(spark, sf), RETAIN_PER_VERSION, keys=["model_version"]).select("model_version", "request_id")


def g3_log_stats(spark, sf):
    s = G.log_stats(_pl(spark, sf), keys=["model_version"])
    return round_floats(s.select("model_version", "count", "max_size", "utilization", ts_string("oldest").alias("oldest"),
                                 ts_string("newest").alias("newest"), "time_span_seconds"))


def g4_due_checks(spark, sf):
    pl = _pl(spark, sf)
    t0 = F.to_timestamp(F.lit(CHECK_STATE_TS))
    state = pl.groupBy("model_version").agg(F.count(F.when(F.col("ts") < t0, 1)).alias("last_check_count")).withColumn(
        "last_check_ts", t0)
    return round_floats(G.due_checks(pl, state))


def g8_dedup(spark, sf):
    """A replayed log (every row twice) de-duplicated on (request_id, pos)."""
    pl = _pl(spark, sf)
    replay = pl.unionByName(pl)
    d = replay.dropDuplicates(["request_id", "pos"])
    return d.groupBy("model_version").agg(F.count(F.lit(1)).alias("rows"))


def g9_windowed_drift(spark, sf):
    ev = read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    base = ev.where(F.col("ts") < F.to_timestamp(F.lit(EVENTS_BASELINE_END)))
    prof = stored_baseline(spark, "events_value_profile", [f"{sf.rstrip('/')}/events.parquet"],
                           lambda: round_floats(D.numeric_profile(base, ["value"])), spec=EVENTS_BASELINE_END)
    out = windowed_numeric_drift(ev, prof, ["value"], "1 day")
    return round_floats(out.select(ts_string("window_start").alias("window_start"), "feature", "metric", "value"))


def _daily_files(spark, rows, path):
    """One file a day, its modification time in the order of the days, so that a file source
    with one file a trigger replays one day a batch. Days are spread over the tasks."""
    rows.withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    days = sorted(str(st.getPath().toString()) for st in fs.listStatus(folder) if st.isDirectory() and "day=" in st.getPath().getName())
    for n, day in enumerate(days):
        for st in fs.listStatus(jvm.org.apache.hadoop.fs.Path(day)):
            if st.getPath().getName().endswith(".parquet"):
                fs.setTimes(st.getPath(), 1_700_000_000_000 + 1000 * n, -1)


def _version_baselines(spark, sf, pl):
    """Baselines of both model versions, from all their rows."""
    from tabwatch.streaming.monitor import Baselines

    events, key = [f"{sf.rstrip('/')}/events.parquet"], ["model_version"]

    def numeric():
        num = stored_baseline(spark, "events_version_profiles", events, lambda: round_floats(D.numeric_profile(pl, MONITORED, keys=key)), spec=MONITORED)
        return num, stored_baseline(spark, "events_version_samples", events, lambda: E.sample_counts(num, key), spec=MONITORED)

    def categories():
        return stored_baseline(spark, "events_version_categories", events, lambda: D.categorical_profile(pl, MONITORED_CATEGORICAL, keys=key), spec=MONITORED_CATEGORICAL)

    def scores():
        bins = D.histogram(pl, "prediction", keys=key).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("bin", "lo", "hi", "count"))).alias("b"))  # 20 bins a version
        edges = F.concat(F.transform("b", lambda x: x["lo"]), F.array(F.element_at("b", -1)["hi"]))
        return bins.select(*key, F.transform("b", lambda x: x["count"]).alias("counts"), edges.alias("edges")).join(
            pl.groupBy(*key).agg(F.avg("prediction").alias("mean")), key)

    def classes():
        return round_floats(D.class_profile(pl.select(*key, F.array(1.0 - F.col("prediction"), "prediction").alias("probs")), "probs", keys=key))

    # of small jobs each, so they are built side by side
    with ThreadPoolExecutor(4) as pool:
        num, cat, score, classed = [pool.submit(f) for f in (
            numeric, categories, lambda: stored_baseline(spark, "events_version_scores", events, scores),
            lambda: stored_baseline(spark, "events_version_classes", events, classes))]
    return Baselines(num.result()[0], MONITORED, cat.result(), MONITORED_CATEGORICAL, score.result(), D.HISTOGRAM_BINS + 1, classed.result(), "probs", num.result()[1])


def g5_stream_monitor(spark, sf):
    """The prediction log (from ``events``), every row sent twice, replayed as daily
    files through the de-duplicating drift monitor, one day a batch; all scores of all
    checks: numeric and categorical features, the prediction and its classes, against the
    version's own baselines, over the last ``DRIFT_WINDOW`` rows in the live buffer."""
    from tabwatch.session import new_folder
    from tabwatch.streaming.monitor import DriftMonitor, MonitorPaths

    pl = _pl(spark, sf)
    rows = pl.select("request_id", "pos", "ts", "model_version", "prediction", F.struct(*MONITORED, *MONITORED_CATEGORICAL).alias("features"),
                     F.array(1.0 - F.col("prediction"), "prediction").alias("probs"))
    root = new_folder(spark, "stream")
    with ThreadPoolExecutor(1) as pool:  # beside the baselines
        files = pool.submit(_daily_files, spark, rows.select("*", F.explode(F.array(F.lit(1), F.lit(2)))).drop("col"), f"{root}/src")
        baselines = _version_baselines(spark, sf, pl)
        files.result()
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/src")
    monitor = DriftMonitor(baselines, MonitorPaths(*(f"{root}/{x}" for x in ("log", "state", "scores", "alerts"))),
                           interval_s=MONITOR_INTERVAL_S, event_time="ts", retention=MONITOR_RETENTION)
    monitor.start(stream, f"{root}/ckpt", {"availableNow": True}, dedup_watermark="1 day").awaitTermination()
    schema = "feature string, metric string, value double, model_version string, batch_id long"
    checked = any(monitor.opened)  # else no version ever had a full window
    scores = spark.read.schema(schema).parquet(monitor.paths.scores) if checked else spark.createDataFrame([], schema)
    return round_floats(scores.select("model_version", "batch_id", "feature", "metric", "value"))


# --------------------------------------------------------------------- H
def h1_request_counts(spark, sf):
    return H.request_counts(_rl(spark, sf))


def h2_error_counts(spark, sf):
    return H.error_counts(_rl(spark, sf))


def h3_latency_histogram(spark, sf):
    return round_floats(H.latency_histogram(_rl(spark, sf)))


def h4_bucket_quantiles(spark, sf):
    return round_floats(H.bucket_quantiles(H.latency_histogram(_rl(spark, sf))))


def h5_request_rate(spark, sf):
    r = H.request_rate(_rl(spark, sf))
    return round_floats(r.withColumn("window_start", ts_string("window_start")))


def h6_error_rate(spark, sf):
    return round_floats(H.error_rate(_rl(spark, sf)).withColumn("window_start", ts_string("window_start")))


def h7_mean_latency(spark, sf):
    return round_floats(H.mean_latency(_rl(spark, sf)).withColumn("window_start", ts_string("window_start")))


def h8_log_gauges(spark, sf):
    s = G.log_stats(G.retain(_pl(spark, sf)))
    return round_floats(s.select("count", "max_size", "utilization"))


def h9_alert_counts(spark, sf):
    scores = g9_windowed_drift(spark, sf)
    alerts = E.drift_alerts(scores.withColumn("model_version", F.lit(VERSION_OLD)), ["model_version"], ALERT_PSI, ALERT_KS)
    return H.alert_counts(alerts)


def h10_status_band(spark, sf):
    er = H.error_rate(_rl(spark, sf))
    lo, hi = H.ERROR_RATE_BANDS
    out = er.select(ts_string("window_start").alias("window_start"), "error_rate",
                    H.status_band(F.col("error_rate"), lo, hi).alias("error_band"))
    q = H.bucket_quantiles(H.latency_histogram(_rl(spark, sf)), qs=(0.95,))
    plo, phi = H.P95_BANDS
    p95 = q.select(F.concat(F.lit("p95:"), F.col("endpoint")).alias("window_start"), F.col("value").alias("error_rate"),
                   H.status_band(F.col("value"), plo, phi).alias("error_band"))
    return round_floats(out.unionByName(p95))


def h12_limit_audit(spark, sf):
    return H.limit_audit(_rl(spark, sf), AUDIT_WINDOW, AUDIT_LIMITS).withColumn("window_start", ts_string("window_start"))


def h13_version_changes(spark, sf):
    return H.version_changes(_rl(spark, sf)).withColumn("ts", ts_string("ts"))


def h14_validation_error_counts(spark, sf):
    ev = scoring_records(spark, sf).withColumn("model_version", version_of("ts"))
    return H.validation_error_counts(validate_for_scoring(ev, "features", ["k", "value"], strict=True))


def h15_clean_request_id(spark, sf):
    """Ids as given and as cleaned; of the cleaned, whether it is the given or a new UUID."""
    rl = _rl(spark, sf).withColumn("cleaned", H.clean_request_id(F.col("request_id")))
    uuid = F.col("cleaned").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return rl.select("event_id", "request_id", (F.col("cleaned") == F.col("request_id")).alias("kept"), uuid.alias("replaced"))


def h16_latest_score(spark, sf):
    s = g9_windowed_drift(spark, sf)
    return H.latest_score(s.withColumnRenamed("window_start", "ts"))


QUERIES = {
    "a3_ingest": a3_ingest,
    "a4_flatten_batch": a4_flatten_batch,
    "a5_records_to_table": a5_records_to_table,
    "a5_nested_records": a5_nested_records,
    "g1_last_n": g1_last_n,
    "g1_last_n_global": g1_last_n_global,
    "g2_retain": g2_retain,
    "g3_log_stats": g3_log_stats,
    "g4_due_checks": g4_due_checks,
    "g8_dedup": g8_dedup,
    "g9_windowed_drift": g9_windowed_drift,
    "g5_stream_monitor": g5_stream_monitor,
    "h1_request_counts": h1_request_counts,
    "h2_error_counts": h2_error_counts,
    "h3_latency_histogram": h3_latency_histogram,
    "h4_bucket_quantiles": h4_bucket_quantiles,
    "h5_request_rate": h5_request_rate,
    "h6_error_rate": h6_error_rate,
    "h7_mean_latency": h7_mean_latency,
    "h8_log_gauges": h8_log_gauges,
    "h9_alert_counts": h9_alert_counts,
    "h10_status_band": h10_status_band,
    "h12_limit_audit": h12_limit_audit,
    "h13_version_changes": h13_version_changes,
    "h14_validation_error_counts": h14_validation_error_counts,
    "h15_clean_request_id": h15_clean_request_id,
    "h16_latest_score": h16_latest_score,
}


# ===================================================================== oracle
RL = f"""SELECT event_id, CAST(ts AS TIMESTAMP) AS ts,
    CASE WHEN event_type IN ('purchase', 'signup') THEN '{BATCH_ENDPOINT}' ELSE '{SINGLE_ENDPOINT}' END AS endpoint,
    CASE WHEN ts < TIMESTAMP '{VERSION_SWITCH}' THEN '{VERSION_OLD}' ELSE '{VERSION_NEW}' END AS model_version,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
    CASE WHEN event_type = 'error' THEN CASE WHEN value < 100 THEN 'validation' WHEN value < 200 THEN 'runtime'
         ELSE 'internal' END END AS error_type,
    value / 100.0 AS latency_s, 'client-' || CAST(user_id AS VARCHAR) AS client,
    'req-' || CAST(event_id AS VARCHAR) AS request_id,
    CAST(CASE WHEN event_type IN ('purchase', 'signup')
         THEN coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) % 20 + 1 ELSE 1 END AS BIGINT) AS batch_size
    FROM events"""

PL = f"""SELECT 'req-' || CAST(event_id AS VARCHAR) AS request_id, 0 AS pos, CAST(ts AS TIMESTAMP) AS ts,
    CASE WHEN ts < TIMESTAMP '{VERSION_SWITCH}' THEN '{VERSION_OLD}' ELSE '{VERSION_NEW}' END AS model_version,
    1.0 / (1.0 + exp(-(value - 100.0) / 50.0)) AS prediction, value,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, user_id, event_id, event_type FROM events"""

TS = "'%Y-%m-%d %H:%M:%S'"
BOUNDS = "[" + ", ".join(f"CAST({b!r} AS DOUBLE)" for b in H.LATENCY_BUCKETS) + "]"


def o_a3():
    return f"SELECT event_id, strftime(CASE WHEN event_id % 7 <> 0 THEN CAST(ts AS TIMESTAMP) ELSE TIMESTAMP '{STAMP}' END, {TS}) AS timestamp FROM events"


def o_a4():
    return f"""WITH pl AS ({PL})
        SELECT 'batch-' || CAST(user_id AS VARCHAR) || '-' || strftime(date_trunc('hour', ts), '%Y%m%d%H')
               || '-' || CAST(CAST(floor(event_id / 1000) AS BIGINT) AS VARCHAR) AS request_id,
            CAST(row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts), floor(event_id / 1000)
                 ORDER BY event_id, k, prediction) - 1 AS INTEGER) AS pos,
            event_id, round(prediction, 6) AS prediction FROM pl"""


def o_a5():
    return "SELECT event_id, round(CAST(json_extract_string(props, '$.k') AS DOUBLE), 6) AS k FROM events"


def o_a5_nested():
    return """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN user_id END AS ids, CASE WHEN event_id % 3 < 2 THEN event_type END AS origin_kind,
        CASE WHEN event_id % 3 < 2 THEN user_id END AS origin_user_id, CASE WHEN event_id % 3 = 1 THEN event_id * 2 END AS twice,
        CASE WHEN event_id % 3 = 0 THEN round(value, 6) END AS value FROM events"""


def o_g1():
    return f"""WITH pl AS ({PL}),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, request_id DESC, pos DESC) AS rn FROM pl)
        SELECT user_id, request_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, request_id, pos) AS INTEGER) AS seq,
            strftime(ts, {TS}) AS ts, round(prediction, 6) AS prediction FROM r WHERE rn <= {LAST_N}"""


def o_g1_global():
    return f"""WITH pl AS ({PL}),
        t AS (SELECT * FROM pl ORDER BY ts DESC, request_id DESC, pos DESC LIMIT {GLOBAL_LAST_N})
        SELECT request_id, CAST(row_number() OVER (ORDER BY ts, request_id, pos) AS INTEGER) AS seq FROM t"""


def o_g2():
    return f"""WITH pl AS ({PL}),
        r AS (SELECT *, row_number() OVER (PARTITION BY model_version ORDER BY ts DESC, request_id DESC, pos DESC) AS rn FROM pl)
        SELECT model_version, request_id FROM r WHERE rn <= {RETAIN_PER_VERSION}"""


def o_g3():
    return f"""WITH pl AS ({PL})
        SELECT model_version, count(*) AS count, CAST({G.RETENTION} AS BIGINT) AS max_size,
            round(count(*) / {float(G.RETENTION)!r}, 6) AS utilization, strftime(min(ts), {TS}) AS oldest,
            strftime(max(ts), {TS}) AS newest,
            round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS time_span_seconds
        FROM pl GROUP BY model_version"""


def o_g4():
    return f"""WITH pl AS ({PL}),
        a AS (SELECT model_version, count(*) AS total, max(ts) AS newest,
              count(*) FILTER (WHERE ts < TIMESTAMP '{CHECK_STATE_TS}') AS last_count FROM pl GROUP BY model_version)
        SELECT model_version, total, total - last_count AS new_rows,
            round((epoch_us(newest) - epoch_us(TIMESTAMP '{CHECK_STATE_TS}')) / 1e6, 6) AS elapsed_s,
            ((epoch_us(newest) - epoch_us(TIMESTAMP '{CHECK_STATE_TS}')) / 1e6 >= {G.CHECK_INTERVAL_S}
             OR total - last_count >= {G.DRIFT_WINDOW}) AND total >= {G.DRIFT_WINDOW} AS due
        FROM a"""


def o_g5():
    """The same days one after the other: a recursive step per day and version decides what is
    due, and every check is computed from the last rows before it. ``feature`` carries the
    check, so the statistics' fragments for one table serve all checks."""
    from tabwatch.plans.drift_oracle import chi_ctes, chi_tail_sql, edge_hist_ctes, hist20_ctes, ks_ctes, psi_ctes, sample_ctes, with_

    w, sep = G.DRIFT_WINDOW, "chr(1)"
    check = f"c.model_version || {sep} || c.batch_id || {sep} || "
    part = lambda n: f"split_part(feature, {sep}, {n})"
    clean = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"
    long = lambda src, pre: " UNION ALL ".join(f"SELECT {pre}'{f}' AS feature, {clean.format(f)} AS v FROM {src}" for f in MONITORED)
    ctes = [
        ("pl", PL),
        ("days", "SELECT day, row_number() OVER (ORDER BY day) - 1 AS batch_id FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM pl)"),
        ("log", """SELECT pl.*, batch_id, row_number() OVER (PARTITION BY model_version ORDER BY batch_id, ts, request_id, pos) AS rn
            FROM pl JOIN days ON CAST(ts AS DATE) = day"""),
        ("step", """SELECT model_version, batch_id, row_number() OVER (PARTITION BY model_version ORDER BY batch_id) AS i,
            epoch_us(max(ts)) AS now, max(rn) AS total FROM log GROUP BY model_version, batch_id"""),
        ("chk", f"""SELECT model_version, batch_id, i, total, total >= {w} AS due, CASE WHEN total >= {w} THEN now END AS last_ts,
                CASE WHEN total >= {w} THEN total ELSE 0 END AS last_count FROM step WHERE i = 1
            UNION ALL SELECT s.model_version, s.batch_id, s.i, s.total, d.due, CASE WHEN d.due THEN s.now ELSE c.last_ts END,
                CASE WHEN d.due THEN s.total ELSE c.last_count END
            FROM chk c JOIN step s ON s.model_version = c.model_version AND s.i = c.i + 1,
            LATERAL (SELECT s.total >= {w} AND ((s.now - coalesce(c.last_ts, 0)) / 1e6 >= {MONITOR_INTERVAL_S} OR s.total - c.last_count >= {w}) AS due) d"""),
        ("due", "SELECT model_version, batch_id, total FROM chk WHERE due"),
        ("snap", f"""SELECT l.* EXCLUDE (batch_id), c.batch_id FROM log l JOIN due c ON l.model_version = c.model_version
            AND l.rn > c.total - {w} AND l.rn <= c.total"""),
        ("base_long", long("pl", f"model_version || {sep} || ")),
        ("base", """SELECT feature, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
            round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75,
            round(quantile_cont(v, 0.95), 6) AS p95 FROM base_long GROUP BY feature"""),
        ("prof", f"""SELECT {check} split_part(b.feature, {sep}, 2) AS feature, b.* EXCLUDE (feature)
            FROM due c JOIN base b ON split_part(b.feature, {sep}, 1) = c.model_version"""),
        ("cur_long", "SELECT * FROM (" + long("snap c", check) + ") WHERE v IS NOT NULL"),
    ] + edge_hist_ctes("prof", "cur_long", "eh") + [("eh_x", "SELECT *, 0.25 AS expected FROM eh")] + psi_ctes("eh_x", "psi") + [
        ("ms", """SELECT c.feature, abs(avg(c.v) - coalesce(any_value(p.mean), 0.0)) AS mean_shift
            FROM cur_long c JOIN prof p USING (feature) GROUP BY c.feature"""),
        # the sample is drawn by the feature's plain name
        ("plain", f"SELECT split_part(feature, {sep}, 1) AS version, split_part(feature, {sep}, 2) AS feature, mean, std, min, max FROM base"),
    ]
    [(_, drawn)] = sample_ctes("plain", "samp")
    ctes += [
        ("samp", drawn.replace("SELECT p.feature,", "SELECT p.version, p.feature,", 1)),
        ("samp_v", f"SELECT {check} s.feature AS feature, s.v FROM due c JOIN samp s ON s.version = c.model_version"),
    ] + ks_ctes("cur_long", "samp_v", "ks") + [
        ("cat_n", "SELECT model_version, event_type AS category, count(*) AS n FROM pl GROUP BY ALL"),
        ("cat_prof", f"""SELECT {check} 'event_type' AS feature, category, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY c.model_version, c.batch_id) AS share
            FROM due c JOIN cat_n USING (model_version)"""),
        ("cat_long", f"SELECT {check} 'event_type' AS feature, event_type AS v FROM snap c"),
    ] + chi_ctes("cat_long", "cat_prof", "chi")
    for n, v in enumerate((VERSION_OLD, VERSION_NEW)):
        ctes += [(f"pv{n}", f"SELECT prediction FROM pl WHERE model_version = '{v}'")] + hist20_ctes(f"pv{n}", "prediction", f"hv{n}")
    ctes += [
        ("h", f"SELECT '{VERSION_OLD}' AS model_version, * FROM hv0 UNION ALL SELECT '{VERSION_NEW}', * FROM hv1"),
        ("edges", "SELECT model_version, list(lo ORDER BY bin) || [max(hi)] AS edges FROM h GROUP BY model_version"),
        ("sbin", """SELECT c.model_version, c.batch_id, CASE WHEN c.prediction < e.edges[1] OR c.prediction > e.edges[21] THEN NULL ELSE
            least(len(list_filter(e.edges, lambda x: x <= c.prediction)) - 1, 19) END AS bin FROM snap c JOIN edges e USING (model_version)"""),
        ("scnt", "SELECT model_version, batch_id, bin, count(*) AS n FROM sbin WHERE bin IS NOT NULL GROUP BY ALL"),
        ("sbins", f"""SELECT {check} 'prediction' AS feature, h.bin, coalesce(s.n, 0) AS count, h.count AS expected
            FROM due c JOIN h USING (model_version) LEFT JOIN scnt s ON s.model_version = c.model_version AND s.batch_id = c.batch_id AND s.bin = h.bin"""),
    ] + psi_ctes("sbins", "spsi") + [
        ("pmean", "SELECT model_version, avg(prediction) AS mean, round(avg(1.0 - prediction), 6) AS m0, round(avg(prediction), 6) AS m1 FROM pl GROUP BY model_version"),
        ("cmean", "SELECT model_version, batch_id, avg(prediction) AS mean, avg(1.0 - prediction) AS mean0 FROM snap GROUP BY ALL"),
        ("pred", f"""SELECT {check} 'prediction' AS feature, abs(c.mean - p.mean) AS shift, abs(c.mean0 - p.m0) AS s0, abs(c.mean - p.m1) AS s1
            FROM cmean c JOIN pmean p USING (model_version)"""),
        ("scores", f"""SELECT feature, 'psi' AS metric, psi AS value FROM psi UNION ALL SELECT feature, 'ks_statistic', ks_statistic FROM ks
            UNION ALL SELECT feature, 'ks_pvalue', ks_pvalue FROM ks UNION ALL SELECT feature, 'mean_shift', mean_shift FROM ms
            UNION ALL SELECT feature, 'chi2_statistic', chi2_statistic FROM chi WHERE status <> 'too_few_categories'
            UNION ALL SELECT feature, 'chi2_pvalue', {chi_tail_sql("chi2_statistic", "dof")} FROM chi WHERE status <> 'too_few_categories'
            UNION ALL SELECT feature, 'psi', psi FROM spsi UNION ALL SELECT feature, 'mean_shift', shift FROM pred
            UNION ALL SELECT feature, 'class_0_mean_shift', s0 FROM pred UNION ALL SELECT feature, 'class_1_mean_shift', s1 FROM pred"""),
    ]
    final = f"""SELECT {part(1)} AS model_version, CAST({part(2)} AS BIGINT) AS batch_id, {part(3)} AS feature, metric, round(value, 6) AS value FROM scores"""
    return with_(ctes, final).replace("WITH ", "WITH RECURSIVE ", 1)


def o_g8():
    return f"""WITH pl AS ({PL}), r AS (SELECT * FROM pl UNION ALL SELECT * FROM pl),
        d AS (SELECT DISTINCT ON (request_id, pos) * FROM r)
        SELECT model_version, count(*) AS rows FROM d GROUP BY model_version"""


def g9_ctes() -> list[tuple[str, str]]:
    from tabwatch.plans.drift_oracle import numeric_profile_ctes
    ctes = [
        ("ev", "SELECT *, CAST(ts AS TIMESTAMP) AS t FROM events"),
        ("evb", f"SELECT * FROM ev WHERE t < TIMESTAMP '{EVENTS_BASELINE_END}'"),
    ] + numeric_profile_ctes("gprof", "evb", ["value"]) + [
        ("wl", """SELECT time_bucket(INTERVAL '1 day', t) AS w, 'value' AS feature,
            CASE WHEN isnan(value) THEN NULL ELSE value END AS v FROM ev WHERE value IS NOT NULL AND NOT isnan(value)"""),
        ("ge", """SELECT feature, coalesce(min, 0.0) AS e0, coalesce(p25, 0.0) AS e1, coalesce(p50, 0.0) AS e2,
            coalesce(p75, 0.0) AS e3, coalesce(max, 1.0) AS e4, mean FROM gprof WHERE coalesce(p25, p50, p75, p95) IS NOT NULL"""),
        ("gb", """SELECT l.w, l.feature, CASE WHEN l.v < e.e0 OR l.v > e.e4 THEN NULL ELSE
            least(CAST(l.v >= e.e0 AS INTEGER) + CAST(l.v >= e.e1 AS INTEGER) + CAST(l.v >= e.e2 AS INTEGER)
                  + CAST(l.v >= e.e3 AS INTEGER) + CAST(l.v >= e.e4 AS INTEGER) - 1, 3) END AS bin
            FROM wl l JOIN ge e USING (feature)"""),
        ("gc", "SELECT w, feature, bin, count(*) AS c FROM gb WHERE bin IS NOT NULL GROUP BY ALL"),
        ("gall", """SELECT w.w, w.feature, b.range AS bin, coalesce(c.c, 0) AS count
            FROM (SELECT DISTINCT w, feature FROM wl) w CROSS JOIN range(0, 4) b
            LEFT JOIN gc c ON c.w = w.w AND c.feature = w.feature AND c.bin = b.range"""),
        ("gt", "SELECT w, feature, sum(CAST(count AS DOUBLE)) AS a FROM gall GROUP BY ALL"),
        ("gpsi", """SELECT g.w, g.feature, sum((greatest(CASE WHEN t.a = 0 THEN CAST('nan' AS DOUBLE) ELSE count / t.a END, CAST(1e-10 AS DOUBLE)) - 0.25)
              * ln(greatest(CASE WHEN t.a = 0 THEN CAST('nan' AS DOUBLE) ELSE count / t.a END, CAST(1e-10 AS DOUBLE)) / 0.25)) AS psi
            FROM gall g JOIN gt t ON t.w = g.w AND t.feature = g.feature GROUP BY g.w, g.feature"""),
        # exact sums (values and mean have at most six decimals), so row order cannot matter
        ("gms", """SELECT l.w, l.feature, abs(CAST(sum(CAST(CAST(l.v AS VARCHAR) AS DECIMAL(24, 6)))
                - count(*) * any_value(CAST(CAST(coalesce(e.mean, 0.0) AS VARCHAR) AS DECIMAL(18, 6))) AS DOUBLE)) / count(*) AS ms
            FROM wl l JOIN gprof e USING (feature) GROUP BY l.w, l.feature"""),
        ("g9", f"""SELECT strftime(w, {TS}) AS window_start, feature, 'psi' AS metric, round(psi, 6) AS value FROM gpsi
            UNION ALL SELECT strftime(w, {TS}), feature, 'mean_shift', round(ms, 6) FROM gms"""),
    ]
    return ctes


def o_g9():
    from tabwatch.plans.drift_oracle import with_
    return with_(g9_ctes(), "SELECT * FROM g9")


def o_h1():
    return f"""WITH rl AS ({RL}) SELECT endpoint, model_version, status, CAST(sum(batch_size) AS BIGINT) AS requests,
        count(*) AS calls FROM rl GROUP BY ALL"""


def o_h2():
    return f"""WITH rl AS ({RL}) SELECT endpoint, error_type, count(*) AS errors,
        CAST(CASE error_type WHEN 'validation' THEN 400 WHEN 'runtime' THEN 503 WHEN 'internal' THEN 500 END AS INTEGER) AS http_status
        FROM rl WHERE error_type IS NOT NULL GROUP BY ALL"""


def hist_ctes():
    n = len(H.LATENCY_BUCKETS)
    return f"""WITH rl AS ({RL}),
        per AS (SELECT endpoint, len(list_filter({BOUNDS}, lambda x: x < latency_s)) AS bucket, count(*) AS n, sum(latency_s) AS s
                FROM rl WHERE latency_s IS NOT NULL GROUP BY ALL),
        allb AS (SELECT k.endpoint, b.range AS bucket FROM (SELECT DISTINCT endpoint FROM per) k CROSS JOIN range(0, {n + 1}) b),
        t AS (SELECT a.endpoint, a.bucket, p.n, p.s FROM allb a LEFT JOIN per p ON p.endpoint = a.endpoint AND p.bucket = a.bucket),
        hist AS (SELECT endpoint, CAST(bucket AS INTEGER) AS bucket, {BOUNDS}[bucket + 1] AS le,
            CAST(sum(coalesce(n, 0)) OVER (PARTITION BY endpoint ORDER BY bucket) AS BIGINT) AS cum_count,
            sum(s) OVER (PARTITION BY endpoint) AS sum,
            CAST(sum(coalesce(n, 0)) OVER (PARTITION BY endpoint) AS BIGINT) AS count FROM t)"""


def o_h3():
    return hist_ctes() + " SELECT endpoint, bucket, round(le, 6) AS le, cum_count, round(sum, 6) AS sum, count FROM hist"


def quantile_sql(qs: tuple) -> str:
    qlist = "[" + ", ".join(f"CAST({q!r} AS DOUBLE)" for q in qs) + "]"
    return f""",
        h AS (SELECT *, coalesce(lag(le) OVER (PARTITION BY endpoint ORDER BY bucket), 0.0) AS le0,
                 coalesce(lag(cum_count) OVER (PARTITION BY endpoint ORDER BY bucket), 0) AS c0,
                 max(le) OVER (PARTITION BY endpoint) AS maxle FROM hist),
        hq AS (SELECT h.*, q.q, q.q * count AS r FROM h CROSS JOIN (SELECT unnest({qlist}) AS q) q),
        f AS (SELECT endpoint, q, arg_min(struct_pack(le := le, le0 := le0, c0 := c0, cc := cum_count, maxle := maxle, r := r), bucket) AS b
              FROM hq WHERE cum_count >= r GROUP BY endpoint, q),
        bq AS (SELECT endpoint, q, CASE WHEN b.le IS NULL THEN b.maxle WHEN b.cc = b.c0 THEN b.le
              ELSE b.le0 + (b.le - b.le0) * (b.r - b.c0) / (b.cc - b.c0) END AS value FROM f)"""


def o_h4():
    return hist_ctes() + quantile_sql((0.5, 0.95, 0.99)) + " SELECT endpoint, q, round(value, 6) AS value FROM bq"


def o_h5():
    return f"""WITH rl AS ({RL}) SELECT strftime(time_bucket(INTERVAL '1 minute', ts), {TS}) AS window_start, endpoint,
        model_version, CAST(sum(batch_size) AS BIGINT) AS per_minute, round(sum(batch_size) / 60.0, 6) AS per_second
        FROM rl GROUP BY ALL"""


def er_ctes():
    return f"""WITH rl AS ({RL}),
        e AS (SELECT ts FROM rl WHERE status = 'error'),
        w AS (SELECT time_bucket(INTERVAL '1 minute', ts) - INTERVAL (k.range) MINUTE AS ws FROM e CROSS JOIN range(0, 5) k),
        er AS (SELECT ws, count(*) AS errors FROM w GROUP BY ws)"""


def o_h6():
    return er_ctes() + f" SELECT strftime(ws, {TS}) AS window_start, errors, round(errors / 300.0, 6) AS error_rate FROM er"


def o_h7():
    return f"""WITH rl AS ({RL}) SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), {TS}) AS window_start, endpoint,
        round(sum(latency_s) / count(latency_s), 6) AS mean_latency FROM rl GROUP BY ALL"""


def o_h8():
    return f"""WITH pl AS ({PL}), k AS (SELECT count(*) AS n FROM (SELECT * FROM pl ORDER BY ts DESC, request_id DESC, pos DESC LIMIT {G.RETENTION}))
        SELECT n AS count, CAST({G.RETENTION} AS BIGINT) AS max_size, round(n / {float(G.RETENTION)!r}, 6) AS utilization FROM k"""


def o_h9():
    from tabwatch.plans.drift_oracle import with_
    return with_(g9_ctes(), f"""SELECT '{VERSION_OLD}' AS model_version, feature,
        CASE WHEN metric = 'psi' THEN 'psi' ELSE 'ks_test' END AS drift_type, count(*) AS alerts
        FROM g9 WHERE value IS NOT NULL AND NOT isnan(value) AND ((metric = 'psi' AND value > {ALERT_PSI})
              OR (metric = 'ks_pvalue' AND feature <> 'prediction' AND value < {ALERT_KS})) GROUP BY ALL""")


def o_h10():
    lo, hi = H.ERROR_RATE_BANDS
    plo, phi = H.P95_BANDS
    return hist_ctes() + quantile_sql((0.95,)) + "," + er_ctes()[len("WITH "):].replace(f"rl AS ({RL}),", "", 1) + f"""
        SELECT strftime(ws, {TS}) AS window_start, round(errors / 300.0, 6) AS error_rate,
            CASE WHEN errors / 300.0 >= {hi} THEN 'red' WHEN errors / 300.0 >= {lo} THEN 'yellow' ELSE 'green' END AS error_band FROM er
        UNION ALL SELECT 'p95:' || endpoint, round(value, 6),
            CASE WHEN value IS NULL THEN NULL WHEN value >= {phi} THEN 'red' WHEN value >= {plo} THEN 'yellow' ELSE 'green' END FROM bq"""


def o_h12():
    lim = f"CASE endpoint WHEN '{SINGLE_ENDPOINT}' THEN {AUDIT_LIMITS[SINGLE_ENDPOINT]} WHEN '{BATCH_ENDPOINT}' THEN {AUDIT_LIMITS[BATCH_ENDPOINT]} ELSE {H.DEFAULT_RATE_LIMIT} END"
    return f"""WITH rl AS ({RL}), a AS (SELECT client, endpoint, time_bucket(INTERVAL '1 day', ts) AS w, count(*) AS calls
        FROM rl GROUP BY ALL)
        SELECT client, endpoint, strftime(w, {TS}) AS window_start, calls, CAST({lim} AS INTEGER) AS "limit",
            calls - {lim} AS excess FROM a WHERE calls > {lim}"""


def o_h13():
    return f"""WITH rl AS ({RL}), l AS (SELECT ts, model_version, lag(model_version) OVER (ORDER BY ts, request_id) AS prev FROM rl)
        SELECT strftime(ts, {TS}) AS ts, prev AS from_version, model_version AS to_version FROM l
        WHERE prev IS NOT NULL AND prev <> model_version"""


def o_h14():
    from tabwatch.plans.contract_learn_queries import o_c7
    return f"""WITH c AS ({o_c7()}), rl AS ({RL})
        SELECT rl.model_version, c.error_type, count(*) AS errors FROM c JOIN rl USING (event_id)
        WHERE c.error_type IS NOT NULL GROUP BY ALL"""


def o_h15():
    return f"""WITH rl AS ({RL}) SELECT event_id, request_id,
        coalesce(regexp_full_match(request_id, '[a-zA-Z0-9\\-]{{8,128}}'), false) AS kept,
        NOT coalesce(regexp_full_match(request_id, '[a-zA-Z0-9\\-]{{8,128}}'), false) AS replaced FROM rl"""


def o_h16():
    from tabwatch.plans.drift_oracle import with_
    return with_(g9_ctes(), """SELECT feature, metric, arg_max(value, window_start) AS value, max(window_start) AS ts
        FROM g9 GROUP BY feature, metric""")


ORACLE = {
    "a3_ingest": o_a3,
    "a4_flatten_batch": o_a4,
    "a5_records_to_table": o_a5,
    "a5_nested_records": o_a5_nested,
    "g1_last_n": o_g1,
    "g1_last_n_global": o_g1_global,
    "g2_retain": o_g2,
    "g3_log_stats": o_g3,
    "g4_due_checks": o_g4,
    "g5_stream_monitor": o_g5,
    "g8_dedup": o_g8,
    "g9_windowed_drift": o_g9,
    "h1_request_counts": o_h1,
    "h2_error_counts": o_h2,
    "h3_latency_histogram": o_h3,
    "h4_bucket_quantiles": o_h4,
    "h5_request_rate": o_h5,
    "h6_error_rate": o_h6,
    "h7_mean_latency": o_h7,
    "h8_log_gauges": o_h8,
    "h9_alert_counts": o_h9,
    "h10_status_band": o_h10,
    "h12_limit_audit": o_h12,
    "h13_version_changes": o_h13,
    "h14_validation_error_counts": o_h14,
    "h15_clean_request_id": o_h15,
    "h16_latest_score": o_h16,
}
