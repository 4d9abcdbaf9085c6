"""Prediction log.

The reference keeps a bounded in-memory deque per process; here the log is a
table (or stream) and "the last N" is a top-k per key.  ``row_number() <= n``
lets Spark insert a partial per-partition limit before the shuffle, so a hot key
never ships more than ``n`` rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwatch.functions.core import join_small

# Log ordering, retention multiple and drift-check trigger.
ARRIVAL_ORDER = ("ts", "request_id", "pos")
DRIFT_WINDOW = 1000
RETENTION = 10 * DRIFT_WINDOW
CHECK_INTERVAL_S = 3600
SALTS = 64
#: Spark keeps a task's newest rows of a key before they are shuffled for ``n`` up to this.
CUT_BEFORE_SHUFFLE = 1000
#: Most distinct keys of a map that become columns.
MAX_COLUMNS = 10_000


def ingest(df: DataFrame, ts_col: str = "timestamp", now: Column | None = None) -> DataFrame:
    """A3: stamp the time (``now``, by default the query's) when a record has none."""
    now = F.current_timestamp() if now is None else now
    if ts_col not in df.columns:
        return df.withColumn(ts_col, now)
    return df.withColumn(ts_col, F.coalesce(F.col(ts_col).cast("timestamp"), now))


def flatten_batch(df: DataFrame, instances_col: str, predictions_col: str,
                  keep: Sequence[str] = ("request_id", "ts", "model_version")) -> DataFrame:
    """A4: one row per instance of a batch response, sharing the batch's
    timestamp, version and request id; ``pos`` is the position in the batch."""
    z = F.arrays_zip(F.col(instances_col).alias("instance"), F.col(predictions_col).alias("prediction"))
    return df.select(*keep, F.posexplode(z).alias("pos", "_z")).select(
        *keep, "pos", F.col("_z.instance").alias("features"), F.col("_z.prediction").alias("prediction"))


def records_to_table(df: DataFrame, features_col: str, names: Sequence[str] | None = None,
                     keep: Sequence[str] = ()) -> DataFrame:
    """A5: feature records (struct, map or JSON text) to columns; missing keys become NULL.
    JSON goes by :func:`json_records_to_table`.

    For a map without ``names``, the union of keys is found with a distributed
    distinct and read back as metadata; more than ``MAX_COLUMNS`` keys are an error,
    as no table is that wide."""
    dt = df.schema[features_col].dataType.typeName()
    if dt == "string":
        table = json_records_to_table(df, features_col, keep)
        return table if names is None else table.select(*keep, *[F.col(f"`{n}`") if n in table.columns else F.lit(None).cast("string").alias(n) for n in names])
    if dt == "struct":
        return df.select(*keep, f"{features_col}.*")
    if names is None:
        found = df.select(F.explode(F.map_keys(features_col))).distinct().limit(MAX_COLUMNS + 1).collect()
        if len(found) > MAX_COLUMNS:
            raise ValueError(f"{features_col} has more than {MAX_COLUMNS} distinct keys; name the wanted ones")
        names = sorted(r[0] for r in found)
    return df.select(*keep, *[F.col(features_col).getItem(n).alias(n) for n in names])


def _json_type(t: T.DataType) -> T.DataType:
    """The column type of a JSON value: numbers with a fraction are doubles, values of several
    kinds, or never anything but null, are text."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _json_type(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_json_type(t.elementType))
    if isinstance(t, T.DecimalType):
        return T.DoubleType()
    return T.StringType() if isinstance(t, (T.VariantType, T.NullType)) else t


def json_schema(df: DataFrame, json_col: str) -> T.StructType:
    """The schema that holds every record of a JSON column: merged in each task, then across
    tasks; one line of text is all that reaches the driver."""
    told = df.agg(F.schema_of_variant_agg(F.try_parse_json(json_col)).alias("s")).first()["s"]
    if told in (None, "VOID"):
        return T.StructType()
    if not told.startswith("OBJECT<"):
        raise ValueError(f"{json_col} does not hold objects only: {told[:100]}")
    return _json_type(T._parse_datatype_string(told.replace("OBJECT<", "STRUCT<")))


def json_records_to_table(df: DataFrame, json_col: str, keep: Sequence[str] = (), sep: str = "_") -> DataFrame:
    """A5 for records as JSON text: one column per key of any record, nested keys joined by
    ``sep``, arrays as arrays. A record that is null or no JSON has NULL everywhere."""
    schema = json_schema(df, json_col)
    if not schema.fields:
        return df.select(*keep)
    parsed = df.select(*keep, F.from_json(json_col, schema).alias("_j"))

    def leaves(at: Column, t: T.StructType, name: str) -> list[Column]:
        out = []
        for f in t.fields:
            value = at.getField(f.name)
            out += leaves(value, f.dataType, f"{name}{f.name}{sep}") if isinstance(f.dataType, T.StructType) else [value.alias(f"{name}{f.name}")]
        return out

    return parsed.select(*keep, *leaves(F.col("_j"), schema, ""))


def _order(cols: Sequence[str], desc: bool) -> list[Column]:
    return [F.col(c).desc() if desc else F.col(c).asc() for c in cols]


def last_n(log: DataFrame, n: int, keys: Sequence[str] = (), order: Sequence[str] = ARRIVAL_ORDER, salts: int = SALTS) -> DataFrame:
    """G1: newest ``n`` rows per key (all when fewer), with ``seq`` = 1 for the
    oldest kept row (arrival order).  Without keys this is a top-k
    (``TakeOrderedAndProject``), never a full sort. ``salts=1`` saves a shuffle where few
    tasks read the log and each cuts its rows itself (``n`` up to ``CUT_BEFORE_SHUFFLE``)."""
    keys = list(keys)
    order = [c for c in order if c in log.columns]
    if not keys:
        top = log.orderBy(*_order(order, True)).limit(n)
        w = Window.partitionBy(F.lit(0)).orderBy(*_order(order, False))  # at most n rows
        return top.withColumn("seq", F.row_number().over(w))
    # the newest n of a key are among the newest n of each of its salted parts, so a
    # hot key is cut in as many tasks before its last cut gathers at most n * salts rows
    few = log
    if salts > 1:
        salted = log.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*_order(order, True))
        few = salted.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    w = Window.partitionBy(*keys).orderBy(*_order(order, True))
    kept = few.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    w2 = Window.partitionBy(*keys).orderBy(*_order(order, False))  # at most n rows per key
    return kept.drop("_rn").withColumn("seq", F.row_number().over(w2))


def retain(log: DataFrame, max_size: int = RETENTION, keys: Sequence[str] = ()) -> DataFrame:
    """Bounded retention (newest ``max_size``), written back as compaction."""
    return last_n(log, max_size, keys).drop("seq")


def log_stats(log: DataFrame, max_size: int = RETENTION, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """``keys..., count, max_size, utilization, oldest, newest,
    time_span_seconds``."""
    agg = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.min(ts).alias("oldest"), F.max(ts).alias("newest"))
    return agg.select(
        *keys, "count", F.lit(max_size).cast("long").alias("max_size"),
        (F.col("count") / F.lit(float(max_size))).alias("utilization"), "oldest", "newest",
        ((F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("oldest").cast("timestamp")))
         / 1e6).alias("time_span_seconds"),
    )


def due_checks(log: DataFrame, state: DataFrame | None, keys: Sequence[str] = ("model_version",),
               now: Column | None = None, interval_s: int = CHECK_INTERVAL_S, window: int = DRIFT_WINDOW,
               ts: str = "ts") -> DataFrame:
    """Per key ``total, new_rows, elapsed_s, due``.

    Due when (elapsed >= interval OR new rows >= window) AND total >= window.
    ``state`` holds ``keys..., last_check_ts, last_check_count``; a key without
    state has never been checked (time 0, count 0).  ``now`` defaults to the
    newest log time per key.  Rows are counted monotonically (not the buffer
    size), so the count trigger does not saturate at the retention size."""
    keys = list(keys)
    agg = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.max(ts).alias("_newest"))
    if state is not None:
        agg = agg.join(state, keys, "left")  # one row per key on both sides
    else:
        agg = agg.withColumn("last_check_ts", F.lit(None).cast("timestamp")).withColumn(
            "last_check_count", F.lit(None).cast("long"))
    now_c = now if now is not None else F.col("_newest")
    elapsed = (F.unix_micros(now_c.cast("timestamp"))
               - F.coalesce(F.unix_micros(F.col("last_check_ts").cast("timestamp")), F.lit(0))) / 1e6
    new_rows = F.col("total") - F.coalesce(F.col("last_check_count"), F.lit(0))
    return agg.select(
        *keys, "total", new_rows.alias("new_rows"), elapsed.alias("elapsed_s"),
        (((elapsed >= interval_s) | (new_rows >= window)) & (F.col("total") >= window)).alias("due"),
    )


def clear(log: DataFrame) -> DataFrame:
    """The empty log (same schema); on tables an overwrite with this frame or
    advancing ``check_state`` past the analysed rows."""
    return log.limit(0)


__all__ = ["ingest", "flatten_batch", "records_to_table", "json_records_to_table", "json_schema", "last_n", "retain", "log_stats", "due_checks", "clear",
           "join_small"]
