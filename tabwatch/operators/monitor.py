"""Service-monitoring aggregates over a request log.

The reference exports counters and histograms and a dashboard computes rates
and quantiles from them; here the same numbers are aggregations of the request
log ``(ts, endpoint, model_version, status, error_type, latency_s, client,
request_id, batch_size)``, batch or streaming (event-time windows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.plans.ordered import ordered_lag

# Latency histogram bounds (seconds), HTTP status per error type,
# dashboard bands, per-minute request limits and the request-id pattern.
LATENCY_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
ERROR_STATUS = {"validation": 400, "runtime": 503, "internal": 500}
ERROR_RATE_BANDS = (0.5, 1.0)
P95_BANDS = (0.2, 0.5)
RATE_LIMITS = {"/v1/predict": 50, "/v1/predict/batch": 20}
DEFAULT_RATE_LIMIT = 100
REQUEST_ID_PATTERN = r"^[a-zA-Z0-9\-]{8,128}\z"


def request_counts(log: DataFrame, keys: Sequence[str] = ("endpoint", "model_version", "status")) -> DataFrame:
    """H1: ``keys..., requests (a batch counts its size), calls``."""
    return log.groupBy(*keys).agg(F.sum("batch_size").cast("long").alias("requests"),
                                  F.count(F.lit(1)).alias("calls"))


def error_counts(log: DataFrame) -> DataFrame:
    """H2: ``endpoint, error_type, http_status, errors``."""
    status = F.lit(None).cast("int")
    for k, v in ERROR_STATUS.items():
        status = F.when(F.col("error_type") == k, F.lit(v)).otherwise(status)
    return log.where(F.col("error_type").isNotNull()).groupBy("endpoint", "error_type").agg(
        F.count(F.lit(1)).alias("errors")).withColumn("http_status", status)


def latency_histogram(log: DataFrame, keys: Sequence[str] = ("endpoint",),
                      bounds: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """H3: cumulative ``le`` buckets per key: ``keys..., bucket, le, cum_count,
    sum, count``; ``bucket = len(bounds)`` is ``+Inf`` (``le`` NULL)."""
    keys = list(keys)
    b = F.array(*[F.lit(float(x)) for x in bounds])
    idx = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):  # first bound >= latency
        idx = F.when(F.col("latency_s") <= F.lit(float(bounds[i])), F.lit(i)).otherwise(idx)
    per = log.where(F.col("latency_s").isNotNull()).groupBy(*keys, idx.alias("bucket")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("latency_s").alias("_s"))
    all_b = per.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))).alias("bucket"))
    t = all_b.join(per, [*keys, "bucket"], "left")
    w = Window.partitionBy(*keys).orderBy("bucket")  # len(bounds)+1 rows per key
    wall = Window.partitionBy(*keys)
    return t.select(
        *keys, F.col("bucket").cast("int").alias("bucket"),
        F.try_element_at(b, F.col("bucket") + 1).alias("le"),
        F.sum(F.coalesce(F.col("_n"), F.lit(0))).over(w).cast("long").alias("cum_count"),
        F.sum("_s").over(wall).alias("sum"), F.sum(F.coalesce(F.col("_n"), F.lit(0))).over(wall).cast("long").alias("count"),
    )


def bucket_quantiles(hist: DataFrame, qs: Sequence[float] = (0.5, 0.95, 0.99),
                     keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """H4: quantiles interpolated inside the bucket that holds rank q*n
    (dashboard rule): ``keys..., q, value``.  In the ``+Inf`` bucket the largest
    finite bound is returned."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("bucket")
    h = hist.select(*keys, "bucket", "le", "cum_count", "count",
                    F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("_le0"),
                    F.coalesce(F.lag("cum_count").over(w), F.lit(0)).alias("_c0"),
                    F.max("le").over(Window.partitionBy(*keys)).alias("_maxle"))
    h = h.select("*", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    h = h.withColumn("_r", F.col("q") * F.col("count"))
    first = h.where(F.col("cum_count") >= F.col("_r")).groupBy(*keys, "q").agg(
        F.min_by(F.struct("le", "_le0", "_c0", "cum_count", "_maxle", "_r"), F.col("bucket")).alias("_b"))
    b = F.col("_b")
    val = (F.when(b["le"].isNull(), b["_maxle"])
           .when(b["cum_count"] == b["_c0"], b["le"])
           .otherwise(b["_le0"] + (b["le"] - b["_le0"]) * (b["_r"] - b["_c0"]) / (b["cum_count"] - b["_c0"])))
    return first.select(*keys, "q", val.alias("value"))


def request_rate(log: DataFrame, keys: Sequence[str] = ("endpoint", "model_version"),
                 window: str = "1 minute") -> DataFrame:
    """H5: ``window_start, keys..., per_minute, per_second`` over tumbling windows;
    for other than minute windows ``per_minute`` is the rounded mean."""
    w = F.window("ts", window)
    agg = log.groupBy(w.alias("w"), *keys).agg(F.sum("batch_size").cast("long").alias("_all"))
    per_second = F.col("_all") / (F.unix_seconds("w.end") - F.unix_seconds("w.start")).cast("double")
    return agg.select(F.col("w.start").alias("window_start"), *keys,
                      F.round(per_second * 60).cast("long").alias("per_minute"), per_second.alias("per_second"))


_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def _seconds(interval: str) -> int | None:
    """Length of a plain interval such as ``5 minutes``; None for other forms."""
    number, _, unit = interval.strip().lower().partition(" ")
    unit = _UNIT_SECONDS.get(unit.strip().removesuffix("s"))
    return int(number) * unit if unit and number.isdigit() else None


def error_rate(log: DataFrame, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """H6: errors per second over a sliding window: ``window_start, errors,
    error_rate``.  Only windows with at least one error are present. Where the window is
    a whole number of slides, errors are counted per slide first and only the counts are
    copied to the windows that hold them."""
    errors = log.where(F.col("status") == "error")
    whole, part = _seconds(window), _seconds(slide)
    if whole and part and whole % part == 0:
        per = errors.groupBy(F.window("ts", slide).alias("s")).agg(F.count(F.lit(1)).alias("_n"))
        per = per.select(F.col("s.start").alias("ts"), "_n")
    else:
        per = errors.select("ts", F.lit(1).alias("_n"))
    agg = per.groupBy(F.window("ts", window, slide).alias("w")).agg(F.sum("_n").cast("long").alias("errors"))
    length = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    return agg.select(F.col("w.start").alias("window_start"), "errors", (F.col("errors") / length).alias("error_rate"))


def mean_latency(log: DataFrame, keys: Sequence[str] = ("endpoint",), window: str = "5 minutes") -> DataFrame:
    """H7: ``window_start, keys..., mean_latency`` = sum / count per window."""
    agg = log.groupBy(F.window("ts", window).alias("w"), *keys).agg(
        F.sum("latency_s").alias("_s"), F.count("latency_s").alias("_n"))
    return agg.select(F.col("w.start").alias("window_start"), *keys,
                      F.try_divide(F.col("_s"), F.col("_n").cast("double")).alias("mean_latency"))


def alert_counts(alerts: DataFrame, keys: Sequence[str] = ("model_version", "feature", "drift_type")) -> DataFrame:
    """H9."""
    return alerts.groupBy(*keys).agg(F.count(F.lit(1)).alias("alerts"))


def status_band(c: Column, warn: float, crit: float) -> Column:
    """Green / yellow / red (a value at a threshold takes that band)."""
    return (F.when(c.isNull(), F.lit(None).cast("string")).when(c >= crit, F.lit("red"))
            .when(c >= warn, F.lit("yellow")).otherwise(F.lit("green")))


def limit_audit(log: DataFrame, window: str = "1 minute", limits: dict[str, int] | None = None) -> DataFrame:
    """Requests over the limit of a window per client and endpoint:
    ``client, endpoint, window_start, calls, limit, excess``."""
    lim = F.lit(DEFAULT_RATE_LIMIT)
    for ep, v in (RATE_LIMITS if limits is None else limits).items():
        lim = F.when(F.col("endpoint") == ep, F.lit(v)).otherwise(lim)
    agg = log.groupBy("client", "endpoint", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    agg = agg.withColumn("limit", lim)
    return agg.where(F.col("calls") > F.col("limit")).select(
        "client", "endpoint", F.col("w.start").alias("window_start"), "calls", "limit",
        (F.col("calls") - F.col("limit")).alias("excess"))


def version_changes(log: DataFrame, order: Sequence[str] = ("ts", "request_id"), keys: Sequence[str] = ()) -> DataFrame:
    """``ts, from_version, to_version`` where the serving version changes in
    log order (distributed lag, no single-task global window)."""
    cols = [*keys, *order, "model_version"]
    lagged = ordered_lag(log.select(*dict.fromkeys(cols)), list(keys), list(order), ["model_version"])
    ch = lagged.where(F.col("prev_model_version").isNotNull() & (F.col("prev_model_version") != F.col("model_version")))
    return ch.select(*keys, "ts", F.col("prev_model_version").alias("from_version"),
                     F.col("model_version").alias("to_version"))


def validation_error_counts(checked: DataFrame, keys: Sequence[str] = ("model_version", "error_type")) -> DataFrame:
    """Validation failures (rows with an ``error_type``) by version and type. Rows
    without one are counted as none and dropped afterwards: a filter before the aggregate would
    be pushed below the checks and evaluate them twice."""
    return checked.groupBy(*keys).agg(F.count("error_type").alias("errors")).where(F.col("errors") > 0)


def request_id_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(REQUEST_ID_PATTERN), F.lit(False))


def clean_request_id(c: Column) -> Column:
    """Keep a valid id, otherwise a fresh UUID."""
    return F.when(request_id_valid(c), c).otherwise(F.expr("uuid()"))


def latest_score(scores: DataFrame, keys: Sequence[str] = ("feature", "metric"), ts: str = "ts") -> DataFrame:
    """The newest value per key (``max_by``; partial aggregation per task)."""
    return scores.groupBy(*keys).agg(F.max_by("value", F.col(ts)).alias("value"), F.max(ts).alias(ts))
