"""Continuous drift monitoring over a prediction-log stream.

The log arrives as a stream. Each micro-batch (``foreachBatch``) is appended to a log
table, one partition per model version and batch; a state table with one row per version
says what the log holds and when the version was last checked (G4); versions that are due
have their last N rows (G1) scored against their own baseline (G7) with the batch drift
operators (E10/E11). The log is a live buffer (G2): partitions that the newest
``retention`` rows of a version no longer need are dropped, and ``clear_log`` (G6) empties it.

What a batch costs does not grow with the stream:

* state is written in generations, one folder a batch; a batch reads the one before it and
  drops those before that, so at most three are ever there;
* a state row lists the batches that the version's buffer is in, each with the number of rows
  logged up to its end, at most ``retention`` entries; no table of past batches is read;
* of the log only the listed partitions that hold the last N rows are opened, by path, so no
  folder is listed.

A batch only reads the state of the one before and writes folders of its own, and drops
partitions after its own state is stored: one that is replayed, or died anywhere in
between, gives the same result again.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tabwatch.functions.core import is_numeric_type
from tabwatch.operators import drift as E
from tabwatch.operators import predlog as G
from tabwatch.session import drop_folder, materialize, scratch

STATE_SCHEMA = ("version_key string, model_version string, total long, cleared long, last_check_ts timestamp, "
                "last_check_count long, due boolean, batches array<struct<batch_id: long, upto: long>>, dropped array<long>, fresh long")
#: The newest rows are the last logged ones; within a batch, the latest.
LOG_ORDER = ("batch_id", *G.ARRIVAL_ORDER)
#: Up to this window a version's rows of one feature may be checked in one task.
SHORT_WINDOW = 100_000
#: Rows of a batch in one log file, and values of a short check in one task, before there is another.
ROWS_A_FILE = 100_000
VALUES_A_TASK = 20_000


@dataclass
class MonitorPaths:
    log: str
    state: str
    scores: str
    alerts: str


@dataclass
class Baselines:
    """The baselines of all model versions, one row (or one per feature, category, class)
    a version; every version's rows meet its own by ``model_version``."""

    num_profile: DataFrame
    num_features: Sequence[str]
    cat_profile: DataFrame | None = None
    cat_features: Sequence[str] = ()
    score_base: DataFrame | None = None
    score_edges: int | None = None  # edges of its histogram, for a codegen'd search
    class_base: DataFrame | None = None
    class_col: str | None = None  # array of class probabilities in the log
    num_samples: DataFrame | None = None  # stored ``drift.sample_counts`` of num_profile; else drawn by each check
    _known: dict[tuple, DataFrame] = field(default_factory=dict, init=False, repr=False, compare=False)

    def of(self, versions: Sequence[str | None]) -> Baselines:
        """Those of some versions only, so that a check does not work on all others'."""
        tables = ("num_profile", "cat_profile", "score_base", "class_base", "num_samples")
        return replace(self, **{t: getattr(self, t).where(F.col("model_version").isin([v for v in versions if v is not None]))
                                for t in tables if getattr(self, t) is not None})

    def known(self) -> DataFrame:
        """All of them as one table for checks of short windows."""
        return E.short_baselines(["model_version"], self.num_profile, self.cat_profile, self.num_features, self.cat_features,
                                 self.num_samples, self.score_base, self.class_base)

    def known_of(self, versions: Sequence[str | None]) -> DataFrame:
        """``of(versions).known()``; its plan is kept, as a batch mostly checks the versions of the one before."""
        asked = tuple(sorted(v for v in versions if v is not None))
        if asked not in self._known:
            self._known = {asked: self.of(asked).known()}
        return self._known[asked]


def dedup_stream(stream: DataFrame, watermark: str = "10 minutes", ts: str = "ts",
                 keys: tuple[str, ...] = ("request_id", "pos")) -> DataFrame:
    """Drop replayed rows (same request id and position) within the
    watermark; state is bounded by the watermark."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


def version_key(version: Column) -> Column:
    """A folder name for any version, NULL included."""
    return F.md5(F.coalesce(version.cast("string"), F.lit("")))


def _number(batch_id: int, beside: str) -> str:
    """The number of a batch as SQL that is no literal for Spark, which would generate and
    compile the code of a plan anew for each batch. ``beside`` is any text column."""
    return f"bigint(concat('{batch_id}', left(ifnull({beside}, ''), 0)))"


def drift_check(log: DataFrame, baselines: Baselines, window: int, batch_id: int, tasks: int | None = None) -> DataFrame:
    """One drift check per model version over its last ``window`` rows, for versions that have
    as many: long scores ``model_version, batch_id, feature, metric, value`` of numeric and
    categorical features, the prediction and its classes, as far as there are baselines.
    ``tasks`` says how many compute those of short windows."""
    return _check(log, baselines, window, tasks).withColumn("batch_id", F.expr(_number(batch_id, "model_version")))


def _is_short(log: DataFrame, baselines: Baselines, window: int) -> bool:
    """Whether a check is one pipeline, whose plan is built without running a job."""
    numeric = log.select(*[f"features.{f}" for f in baselines.num_features]).schema.fields
    return window <= SHORT_WINDOW and all(is_numeric_type(f.dataType) for f in numeric)


def _check(log: DataFrame, baselines: Baselines, window: int, tasks: int | None, versions: Sequence[str | None] | None = None) -> DataFrame:
    # a short window is cut by the tasks that read the newest partitions, which are few
    salts = 1 if window <= G.CUT_BEFORE_SHUFFLE else G.SALTS
    snap = G.last_n(log.where(F.col("model_version").isNotNull()), window, keys=["model_version"], order=LOG_ORDER, salts=salts)
    snap = snap.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("model_version"))).where(F.col("_n") >= window)  # at most window rows
    nums, cats = list(baselines.num_features), list(baselines.cat_features)
    extra = [baselines.class_col] if baselines.class_base is not None else []
    rows = snap.select("model_version", *[F.col(f"features.{f}").alias(f) for f in [*nums, *cats]], "prediction", *extra)
    if _is_short(log, baselines, window):
        known = baselines.known() if versions is None else baselines.known_of(versions)
        return E.short_drift(rows, known, ["model_version"], nums, cats, None if baselines.score_base is None else "prediction", extra[0] if extra else None, tasks)
    if versions is not None:
        baselines = baselines.of(versions)
    rows = rows.persist()  # every statistic reads these rows, which are cut once
    scores = E.feature_drift(rows, baselines.num_profile, baselines.cat_profile, keys=["model_version"], num_features=nums, cat_features=cats)
    if baselines.score_base is not None:
        scores = scores.unionByName(E.score_drift(rows, "prediction", baselines.score_base, keys=["model_version"], n_edges=baselines.score_edges))
    if baselines.class_base is not None:
        scores = scores.unionByName(E.class_drift(rows, baselines.class_col, baselines.class_base, keys=["model_version"]))
    stored = materialize(scores)
    rows.unpersist()
    return stored


def _generations(spark: SparkSession, state: str) -> list[tuple[int, int, str]]:
    """(batch, edition, folder) of every complete state generation, oldest first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    found = []
    for status in fs.listStatus(hadoop):
        name = status.getPath().getName()
        if name.startswith("generation=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            batch, edition = name.removeprefix("generation=").split("-")
            found.append((int(batch), int(edition), f"{state.rstrip('/')}/{name}"))
    return sorted(found)


def _log_folder(paths: MonitorPaths, key: str, batch_id: int) -> str:
    return f"{paths.log.rstrip('/')}/version_key={key}/batch_id={batch_id}"


def read_state(spark: SparkSession, paths: MonitorPaths, before: int | None = None) -> DataFrame:
    """The newest state (of a batch below ``before``): one row per version."""
    found = [g for g in _generations(spark, paths.state) if before is None or g[0] < before]
    return spark.read.schema(STATE_SCHEMA).parquet(found[-1][2]) if found else spark.createDataFrame([], STATE_SCHEMA)


def buffer_stats(spark: SparkSession, paths: MonitorPaths, retention: int = G.RETENTION) -> DataFrame:
    """G3 of the live buffer, from the state alone: ``model_version, count, max_size, utilization``."""
    count = F.least(F.col("total") - F.col("cleared"), F.lit(retention))
    return read_state(spark, paths).select(
        "model_version", count.alias("count"), F.lit(retention).cast("long").alias("max_size"), (count / float(retention)).alias("utilization"))


def clear_log(spark: SparkSession, paths: MonitorPaths, versions: Sequence[str] | None = None) -> None:
    """Empty the buffer of all versions (or those named) between two batches. A version is
    checked again once a full window has been logged since. State first, partitions after it,
    so a call that dies can be repeated."""
    found = _generations(spark, paths.state)
    if not found:
        return
    batch, edition, folder = found[-1]
    old = spark.read.schema(STATE_SCHEMA).parquet(folder)
    hit = F.lit(True) if versions is None else F.coalesce(F.col("model_version").isin(list(versions)), F.lit(False))
    ids = F.transform("batches", lambda b: b["batch_id"])
    new = old.withColumns({
        "cleared": F.when(hit, F.col("total")).otherwise(F.col("cleared")), "due": F.lit(False),
        "dropped": F.when(hit, F.array_union("dropped", ids)).otherwise(F.col("dropped")),
        "batches": F.when(hit, F.filter("batches", lambda b: F.lit(False))).otherwise(F.col("batches"))})
    new.coalesce(1).write.mode("overwrite").parquet(f"{paths.state.rstrip('/')}/generation={batch}-{edition + 1}")
    _drop_partitions(spark, paths, read_state(spark, paths).where(F.size("dropped") > 0).select("version_key", "dropped").collect())
    drop_folder(spark, folder)


def _drop_partitions(spark: SparkSession, paths: MonitorPaths, told: Sequence[Row]) -> None:
    for r in told:
        for b in r["dropped"]:  # what left the buffer in one batch
            drop_folder(spark, _log_folder(paths, r["version_key"], b))


@dataclass
class DriftMonitor:
    """G5. ``event_time`` names the column whose newest value is the clock of the checks
    (default: the wall clock)."""

    baselines: Baselines
    paths: MonitorPaths
    window: int = G.DRIFT_WINDOW
    interval_s: int = G.CHECK_INTERVAL_S
    retention: int = G.RETENTION
    event_time: str | None = None
    #: Log partitions that each batch's check reads, its own included, newest last (for monitoring and tests).
    opened: list[int] = field(default_factory=list)
    _checked: tuple | None = field(default=None, init=False, repr=False)

    def __post_init__(self):
        if self.retention < self.window:
            raise ValueError("retention must hold at least one window")

    def next_state(self, prior: DataFrame, batch: DataFrame, batch_id: int) -> DataFrame:
        """G4 and G2 of every version after a batch, one row each."""
        clock = F.max(self.event_time) if self.event_time else F.current_timestamp()
        fresh = batch.groupBy("version_key").agg(
            F.first("model_version").alias("_version"), F.count(F.lit(1)).alias("n"), clock.cast("timestamp").alias("_now"))
        none = "cast(array() as array<struct<batch_id: bigint, upto: bigint>>)"
        # one row a version on both sides, so they meet in one task without a shuffle of their own
        s = prior.drop("due", "dropped", "fresh").coalesce(1).join(fresh.coalesce(1), "version_key", "full_outer").selectExpr(
            "version_key", "coalesce(model_version, _version) as model_version", "ifnull(total, 0L) + ifnull(n, 0L) as total", "ifnull(cleared, 0L) as cleared",
            "last_check_ts", "last_check_count", f"ifnull(batches, {none}) as batches", "ifnull(n, 0L) as fresh", "_now")
        elapsed = "(unix_micros(_now) - ifnull(unix_micros(last_check_ts), 0L)) / 1e6D"
        s = s.selectExpr(
            "*", f"concat(batches, if(fresh > 0, array(named_struct('batch_id', {_number(batch_id, 'version_key')}, 'upto', total)), {none})) as _held",
            f"greatest(total - {self.retention}L, cleared) as _low",  # rows at or below this number of logged ones have left the buffer
            # a version without new rows is not due
            f"ifnull(({elapsed} >= {float(self.interval_s)!r}D or total - ifnull(last_check_count, 0L) >= {self.window}) and total - cleared >= {self.window}, false) as _due")
        return s.selectExpr(
            "version_key", "model_version", "total", "cleared", "if(_due, _now, last_check_ts) as last_check_ts", "if(_due, total, last_check_count) as last_check_count",
            "_due as due", "filter(_held, b -> b.upto > _low) as batches", "transform(filter(_held, b -> b.upto <= _low), b -> b.batch_id) as dropped", "fresh")

    def _tasks(self, spark: SparkSession, versions: int) -> int:
        """Tasks of a short check by the values it sorts: rows, and numeric features' samples."""
        known = self.baselines
        numeric, other = len(known.num_features), len(known.cat_features) + (known.score_base is not None) + (known.class_base is not None)
        values = versions * (numeric * (self.window + E.REFERENCE_SAMPLE_SIZE) + other * self.window)
        return max(1, min(-(-values // VALUES_A_TASK), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch."""
        spark, paths = batch.sparkSession, self.paths

        def overwrite(df: DataFrame, path: str, *parts: str) -> None:
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)

        b = batch.withColumn("version_key", version_key(F.col("model_version"))).withColumn("batch_id", F.expr(_number(batch_id, "version_key"))).persist()
        with scratch(spark), ThreadPoolExecutor(4) as pool:
            own = inheritable_thread_target(spark)

            def check(keys: tuple[str, ...], versions: tuple[str | None, ...], older: tuple[str, ...]) -> DataFrame:
                recent = b.where(F.col("version_key").isin(list(keys)))
                if older:
                    recent = recent.unionByName(spark.read.schema(b.schema).option("basePath", paths.log).parquet(*older))
                return _check(recent, self.baselines, self.window, self._tasks(spark, len(versions)), versions)

            state = self.next_state(read_state(spark, paths, before=batch_id), b, batch_id).persist()
            told = state.where("due or size(dropped) > 0 or fresh > 0").selectExpr(
                "version_key", "model_version", "due", f"transform(filter(batches, b -> b.upto > total - {self.window}), b -> b.batch_id) as ids", "dropped", "fresh")
            # the next check is mostly of the versions of the last one, and of new rows only: its
            # plan is built while Spark finds out, and built again if not
            guess = self._checked
            likely = pool.submit(own(lambda: check(*guess))) if guess and not guess[2] and _is_short(b, self.baselines, self.window) else None
            told = told.collect()  # one row a version
            # state, log and check need none of each other
            beside = [pool.submit(own(lambda: state.write.mode("overwrite").parquet(f"{paths.state.rstrip('/')}/generation={batch_id}-0")))]
            fresh = sum(r["fresh"] for r in told)
            if fresh:  # in as many files as the rows ask for, not as many as the stream has partitions
                beside.append(pool.submit(own(lambda: overwrite(b.coalesce(-(-fresh // ROWS_A_FILE)), paths.log, "version_key", "batch_id"))))
            need = sorted((r for r in told if r["due"]), key=lambda r: r["version_key"])
            self.opened.append(sum(len(r["ids"]) for r in need))
            if need:
                due = (tuple(r["version_key"] for r in need), tuple(r["model_version"] for r in need),
                       tuple(_log_folder(paths, r["version_key"], i) for r in need for i in r["ids"] if i != batch_id))
                checked = (likely.result() if likely and due == guess else check(*due)).persist()
                self._checked = due
                scores = checked.withColumn("batch_id", F.expr(_number(batch_id, "model_version")))
                stored = pool.submit(own(lambda: overwrite(scores, paths.scores, "model_version", "batch_id")))
                alerts = E.drift_alerts(scores, keys=["model_version", "batch_id"])
                stored.result()
                overwrite(alerts, paths.alerts, "model_version", "batch_id")
                checked.unpersist()
            for job in beside:
                job.result()
            b.unpersist()
            state.unpersist()
        _drop_partitions(spark, paths, told)
        old = [g for g in _generations(spark, paths.state) if g[0] < batch_id]
        for _, _, folder in old[:-1]:  # the newest of them is what a replay of this batch reads
            drop_folder(spark, folder)

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None, dedup_watermark: str | None = None):
        """Start the monitor; returns the ``StreamingQuery``. ``trigger`` defaults to one every
        60 seconds of processing time; with ``dedup_watermark`` replayed rows are dropped
        first (G8), by request id and position, within that time."""
        if dedup_watermark:
            stream = dedup_stream(stream, dedup_watermark, self.event_time or "ts")
        w = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return w.trigger(**(trigger or {"processingTime": "60 seconds"})).start()
