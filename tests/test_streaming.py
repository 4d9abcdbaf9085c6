import os

import pytest
from pyspark.sql import functions as F

from tabwatch.functions.core import round_floats
from tabwatch.operators import profile as D
from tabwatch.sources.tables import read_table
from tabwatch.streaming import monitor as M
from tabwatch.streaming import windows as W

SF = "/root/testdata/sf0.001"


def _plog(spark):
    ev = read_table(spark, SF, "events")
    return ev.select(
        F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"), F.lit(0).alias("pos"),
        F.col("ts").cast("timestamp").alias("ts"), F.lit("v1").alias("model_version"),
        F.struct(F.col("value"), F.get_json_object("props", "$.k").cast("double").alias("k"), F.col("event_type").alias("kind")).alias("features"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("value") - 100.0) / 50.0))).alias("prediction"),
        F.col("event_id"))


def _write_files(df, path, n):
    # split by event order into n files: a replayable file source
    df = df.withColumn("_f", F.ntile(n).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("event_id")))
    for i in range(1, n + 1):
        df.where(F.col("_f") == i).drop("_f").coalesce(1).write.mode("overwrite").parquet(os.path.join(path, f"part{i}"))


def _monitor(spark, log, root, window, **more):
    base = log.select("model_version", "features.value", "features.k", "features.kind")
    prof = round_floats(D.numeric_profile(base, ["value", "k"], keys=["model_version"]))
    cats = D.categorical_profile(base, ["kind"], keys=["model_version"])
    paths = M.MonitorPaths(*(os.path.join(root, x) for x in ("log", "state", "scores", "alerts")))
    return M.DriftMonitor(M.Baselines(prof, ["value", "k"], cats, ["kind"]), paths, window=window, **more)


def _scores(df):
    return sorted((r.model_version, r.feature, r.metric, None if r.value is None else round(r.value, 9)) for r in df.collect())


def test_stream_monitor_equals_batch(spark, tmp_dir):
    """Every row sent twice, four batches: the last check equals one over the last rows, and
    the log holds no more than it needs."""
    log = _plog(spark)
    n_rows = log.count()
    window = n_rows // 8
    src = os.path.join(tmp_dir, "src")
    _write_files(log.unionByName(log), src, 4)
    monitor = _monitor(spark, log, tmp_dir, window, retention=window, event_time="ts")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    monitor.start(stream, os.path.join(tmp_dir, "ckpt"), {"availableNow": True}, dedup_watermark="400 days").awaitTermination(300)
    scores = spark.read.parquet(monitor.paths.scores)
    last = scores.agg(F.max("batch_id")).first()[0]
    want = M.drift_check(log.withColumn("batch_id", F.lit(0)), monitor.baselines, window, 0)
    got = _scores(scores.where(F.col("batch_id") == last))
    assert got == _scores(want) and {m for _, _, m, _ in got} == {"psi", "ks_statistic", "ks_pvalue", "mean_shift", "chi2_statistic", "chi2_pvalue"}
    [state] = M.read_state(spark, monitor.paths).collect()
    assert state.total == state.last_check_count == n_rows
    assert len(os.listdir(os.path.join(monitor.paths.log, f"version_key={state.version_key}"))) <= 2


def test_short_check_equals_the_general_one(spark, monkeypatch):
    """Ties, missing values, a new category, versions without some or all baselines, a version
    short of a window and one that is NULL."""
    rows = spark.range(900).select(
        F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("request_id"), F.lit(0).alias("pos"),
        F.timestamp_seconds(F.col("id")).alias("ts"), F.lit(0).cast("long").alias("batch_id"),
        F.when(F.col("id") < 20, "few").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("a", "b", "c", None)]), (F.col("id") % 4 + 1).cast("int"))).alias("model_version"),
        F.struct(F.when(F.col("id") % 9 > 0, F.col("id") * 37 % 101 / 3).alias("value"), F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("id") % 7).alias("k"),
                 F.when(F.col("id") % 11 > 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("kind")).alias("features"),
        (F.col("id") % 13 / 13).alias("prediction"), F.array(F.col("id") % 13 / 13).alias("probs"))
    base = rows.where("ts < timestamp_seconds(400) and model_version in ('a', 'b')").select("model_version", "features.value", F.when(F.col("model_version") == "a", F.col("features.k")).alias("k"), "features.kind")
    kinds = D.categorical_profile(base.where("kind <> 'c2' or model_version = 'a'"), ["kind"], keys=["model_version"])
    bins = spark.createDataFrame([("a", 0.4, [0.0, 0.25, 0.5, 0.75, 1.0], [5, 9, 0, 7]), ("c", None, [0.1, 0.25, 0.5, 0.75, 0.8], [5, 9, 1, 7])], "model_version string, mean double, edges array<double>, counts array<long>")
    classes = spark.createDataFrame([("b", 0, 0.3)], "model_version string, class_idx int, mean double")
    prof = D.numeric_profile(base, ["value", "k"], keys=["model_version"])
    from tabwatch.operators import drift as E
    known = M.Baselines(prof, ["value", "k"], kinds, ["kind"], bins, 5, classes, "probs", E.sample_counts(prof, ["model_version"]))
    short = _scores(M.drift_check(rows, known, 150, 3, 2))
    assert short == _scores(M.drift_check(rows, known.of(["a", "b", "c", None]), 150, 3))
    monkeypatch.setattr(M, "SHORT_WINDOW", 0)
    assert short == _scores(M.drift_check(rows, known, 150, 3)) and {v for v, *_ in short} == {"a", "b", "c"}


def _batches(spark, sizes):
    """Batches of two versions, rows numbered on; every third batch has none of the second."""
    at = 0
    for i, n in enumerate(sizes):
        yield i, spark.range(at, at + n).select(
            F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("request_id"), F.lit(0).alias("pos"),
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"),
            F.when((F.col("id") % 4 == 0) & F.lit(i % 3 > 0), F.lit("b/ =%")).otherwise(F.lit("a")).alias("model_version"),
            F.struct((F.col("id") * 37 % 101).cast("double").alias("value"), (F.col("id") % 7).cast("double").alias("k"),
                     F.concat(F.lit("c"), F.col("id") % 3).alias("kind")).alias("features"), F.lit(0.5).alias("prediction"))
        at += n


def _partitions(monitor):
    return sorted((v, b) for v in os.listdir(monitor.paths.log) if v.startswith("version_key=") for b in os.listdir(os.path.join(monitor.paths.log, v)) if b.startswith("batch_id="))


@pytest.fixture(scope="module")
def long_replay(spark):
    """Sixteen batches with the bookkeeping of each."""
    import tempfile

    root = tempfile.mkdtemp(prefix="tabwatch-monitor-")
    batches = dict(_batches(spark, [20] * 16))
    everything = batches[0]
    for i in range(1, 12):
        everything = everything.unionByName(batches[i])
    monitor = _monitor(spark, everything, root, window=50, retention=100, event_time="ts", interval_s=10**9)
    seen = []
    for i, b in batches.items():
        monitor.process(b, i)
        state = {r.model_version: r for r in M.read_state(spark, monitor.paths).collect()}
        seen.append((state, _partitions(monitor), [g[:2] for g in M._generations(spark, monitor.paths.state)]))
    return monitor, batches, seen


def test_what_a_batch_reads_and_keeps_does_not_grow(long_replay):
    monitor, _, seen = long_replay
    for i, (state, partitions, generations) in enumerate(seen):
        assert generations == [(g, 0) for g in (i - 1, i) if g >= 0]
        assert partitions == sorted((f"version_key={r.version_key}", f"batch_id={b.batch_id}") for r in state.values() for b in r.batches)
        for r in state.values():  # the buffer holds retention rows, and no partition more than they need
            first = r.batches[1].upto if len(r.batches) > 1 else r.total
            assert r.total - first < 100 and (r.batches[0].upto > r.total - 100)
            assert len(r.batches) <= 25
    assert len(seen[-1][1]) < 30 and max(monitor.opened) <= 4 + 11


def test_checks_follow_the_count_trigger(spark, long_replay):
    monitor, batches, seen = long_replay
    total, last, want = {"a": 0, "b/ =%": 0}, {}, []
    for i in range(16):
        b = 5 if i % 3 else 0
        total["b/ =%"] += b
        total["a"] += 20 - b
        for v, new in (("a", 20 - b), ("b/ =%", b)):
            # first check: the clock is decades after none; then by count only
            if new and total[v] >= 50 and (v not in last or total[v] - last[v] >= 50):
                want.append((v, i))
                last[v] = total[v]
    got = sorted((r.model_version, r.batch_id) for r in spark.read.schema("feature string, metric string, value double, model_version string, batch_id long").parquet(monitor.paths.scores).select("model_version", "batch_id").distinct().collect())
    assert got == sorted(want) and {v for v, _ in got} == {"a", "b/ =%"}


def test_a_replayed_batch_changes_nothing(spark, long_replay):
    monitor, batches, seen = long_replay
    scores = spark.read.parquet(monitor.paths.scores)
    before = (_scores(scores), _partitions(monitor), M.read_state(spark, monitor.paths).collect())
    monitor.process(batches[15], 15)
    assert (_scores(spark.read.parquet(monitor.paths.scores)), _partitions(monitor), M.read_state(spark, monitor.paths).collect()) == before


def test_a_check_of_a_short_window_takes_few_jobs(spark, tmp_dir):
    """A replay of days is as slow as its checks, which are small: their cost is that of their jobs."""
    [(_, batch)] = _batches(spark, [120])
    monitor = _monitor(spark, batch, tmp_dir, window=50, event_time="ts")
    spark.sparkContext.setJobGroup("one-batch", "one-batch")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a stream with state
    try:
        monitor.process(batch, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert monitor.opened == [1] and 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-batch")) <= 16


def test_a_batch_costs_a_job_each_for_versions_state_log_scores_and_alerts(spark, tmp_dir):
    """However many partitions the stream has; a batch's rows of a version are one log file."""
    [(_, batch)] = _batches(spark, [400])
    monitor = _monitor(spark, batch, tmp_dir, window=50, event_time="ts")
    known = monitor.baselines
    known.num_profile, known.cat_profile = M.materialize(known.num_profile), M.materialize(known.cat_profile)
    known.num_samples = M.materialize(M.E.sample_counts(known.num_profile, ["model_version"]))
    spark.sparkContext.setJobGroup("whole-batch", "whole-batch")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a stream with state
    try:
        monitor.process(batch.repartition(4), 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("whole-batch")) <= 5
    [folder] = [os.path.join(monitor.paths.log, v, b) for v, b in _partitions(monitor)]
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) == 1 and spark.read.parquet(folder).count() == 400
    assert spark.read.parquet(monitor.paths.scores).count() > 0 and os.path.exists(monitor.paths.alerts)


def test_checks_of_changing_versions_equal_the_batch_form(spark, tmp_dir):
    """The plan of a check is built from the last one's versions: right for batch 2, wrong for 1 and 3."""
    batches = dict(_batches(spark, [80] * 4))
    monitor = _monitor(spark, batches[0].unionByName(batches[1]), tmp_dir, window=20, event_time="ts")
    guesses = []
    for i, b in batches.items():
        guesses.append(monitor._checked)
        monitor.process(b, i)
        want = _scores(M.drift_check(b.withColumn("batch_id", F.lit(i)), monitor.baselines, 20, i))
        assert want == _scores(spark.read.parquet(monitor.paths.scores).where(f"batch_id = {i}"))
        assert {v for v, *_ in want} == ({"a", "b/ =%"} if i % 3 else {"a"})
    guesses.append(monitor._checked)
    assert guesses[2] == guesses[3] != guesses[1] == guesses[4] and not guesses[3][2]


def test_the_code_of_a_batch_does_not_hold_its_number(spark):
    plan = lambda n: spark.range(3).select(F.expr(M._number(n, "string(id)")).alias("b"))
    assert [r.b for r in plan(12345).collect()] == [12345] * 3
    code = lambda df: df._jdf.queryExecution().debug().codegenToSeq().toString()
    assert "12345" not in code(plan(12345)).split("Generated code", 1)[-1].split("/* 001 */", 1)[-1]


def test_clear_empties_the_buffer_and_checks_wait_for_a_full_window(spark, tmp_dir):
    batches = dict(_batches(spark, [60] * 8))
    monitor = _monitor(spark, batches[0].unionByName(batches[1]), tmp_dir, window=100, retention=200, event_time="ts")
    for i in range(4):
        monitor.process(batches[i], i)
    M.clear_log(spark, monitor.paths, ["a"])
    M.clear_log(spark, monitor.paths, ["a"])
    state = {r.model_version: r for r in M.read_state(spark, monitor.paths).collect()}
    assert state["a"].batches == [] and state["a"].cleared == state["a"].total == 210 and len(state["b/ =%"].batches) == 2
    assert {v for v, _ in _partitions(monitor)} == {f"version_key={state['b/ =%'].version_key}"}
    assert {r.model_version: r["count"] for r in M.buffer_stats(spark, monitor.paths, 200).collect()} == {"a": 0, "b/ =%": 30}
    opened = len(monitor.opened)
    monitor.process(batches[4], 4)
    assert not M.read_state(spark, monitor.paths).where("model_version = 'a' and due").count()  # 45 rows since
    monitor.process(batches[5], 5)
    monitor.process(batches[6], 6)
    assert M.read_state(spark, monitor.paths).where("model_version = 'a'").first().last_check_count > 210 and len(monitor.opened) == opened + 3
    M.clear_log(spark, monitor.paths)
    assert not _partitions(monitor) or not any(os.listdir(os.path.join(monitor.paths.log, v, b)) for v, b in _partitions(monitor))


def test_dedup_stream(spark, tmp_dir):
    log = _plog(spark).select("request_id", "pos", "ts", "prediction")
    src = os.path.join(tmp_dir, "dup")
    log.write.parquet(os.path.join(src, "a"))
    log.write.parquet(os.path.join(src, "b"))  # replay of the same rows
    stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").parquet(src)
    q = (M.dedup_stream(stream, "1 day").writeStream.format("memory").queryName("dedup_out")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert spark.table("dedup_out").count() == log.count()


def test_windowed_bin_counts_stream_equals_batch(spark, tmp_dir):
    ev = read_table(spark, SF, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    prof = round_floats(D.numeric_profile(ev, ["value"]))
    src = os.path.join(tmp_dir, "ev")
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    agg = W.windowed_bin_counts(stream, prof, ["value"], "1 day", watermark="1 day")
    out = os.path.join(tmp_dir, "bins")
    q = (agg.writeStream.outputMode("complete")
         .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(out))
         .option("checkpointLocation", os.path.join(tmp_dir, "bins_ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    streamed = W.psi_from_bin_counts(spark.read.parquet(out)).toPandas()
    batch = W.windowed_numeric_drift(ev, prof, ["value"], "1 day").where("metric = 'psi'").toPandas()
    m = streamed.merge(batch, on=["window_start", "feature"])
    assert len(m) == len(batch) > 0
    assert (m.psi - m.value).abs().max() < 1e-9
