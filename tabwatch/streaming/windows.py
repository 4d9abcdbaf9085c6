"""Event-time windowed drift.

``windowed_numeric_drift`` works on a batch DataFrame; ``windowed_bin_counts``
is the stateful part that also runs on a stream (watermark + tumbling window,
append mode), leaving only the per-window PSI -- a few rows per window -- to be
computed on each finalized micro-batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.functions.core import as_fixed, join_small, to_long
from tabwatch.operators import drift as E


def windowed_numeric_drift(df: DataFrame, profile: DataFrame, features: Sequence[str], window: str,
                           ts: str = "ts") -> DataFrame:
    """Quartile PSI and mean shift of every tumbling window against one
    baseline profile: ``window_start, feature, metric, value``.

    Rows meet only the profile (one row per feature, broadcast); the window is just
    part of the group key, so nothing that is broadcast grows with the log. One pass
    gives counts and sums per (window, feature, bin), at most six rows a group. Sums of
    values with at most six decimals are exact, whatever order the rows come in."""
    k = ["window_start", "feature"]
    has_pct = F.coalesce(F.col("p25"), F.col("p50"), F.col("p75"), F.col("p95")).isNotNull()
    base = profile.select("feature", "mean", F.when(has_pct, E.quartile_edges(profile)).alias("edges"))
    cur = df.select(F.window(ts, window).start.alias("window_start"), *features)
    j = join_small(to_long(cur, list(features), ids=["window_start"]), base, ["feature"])
    fixed = as_fixed("v")
    bins = j.select(*k, "v", E.bin_index(F.col("v"), F.col("edges"), 5).alias("bin")).groupBy(*k, "bin").agg(
        F.count(F.lit(1)).alias("_c"), F.count("v").alias("_n"), F.sum("v").alias("_s"),
        F.try_sum(fixed).alias("_d"), F.bool_and(F.coalesce(fixed.cast("double") == F.col("v"), F.lit(False))).alias("_exact"))
    per = bins.groupBy(*k).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "_c")))).alias("_m"),
        F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), F.try_sum("_d").cast("decimal(34,6)").alias("_d"), F.bool_and("_exact").alias("_exact"))
    per = join_small(per, base, ["feature"])
    counts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0)).cast("long"))
    psi = F.when(E.edges_valid(F.col("edges")), E.psi_arrays(counts, F.array(*[F.lit(0.25)] * 4)))
    # values and mean of at most six decimals: summed exactly, so the order of rows cannot matter
    mean = F.coalesce(F.col("mean"), F.lit(0.0))
    fixed_mean = as_fixed(mean).cast("decimal(18,6)")
    off = (F.col("_d") - F.col("_n").cast("decimal(18,0)") * fixed_mean).cast("double") / F.col("_n")
    shift = F.abs(F.when(F.col("_exact") & (fixed_mean.cast("double") == mean), off).otherwise(F.col("_s") / F.col("_n") - mean))
    both = F.array(F.struct(F.lit("psi").alias("metric"), psi.alias("value"), F.col("edges").isNotNull().alias("there")),
                   F.struct(F.lit("mean_shift").alias("metric"), shift.alias("value"), F.lit(True).alias("there")))
    return per.select(*k, F.explode(both).alias("x")).where("x.there").select(*k, "x.metric", "x.value")


def windowed_bin_counts(df: DataFrame, profile: DataFrame, features: Sequence[str], window: str,
                        ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """Per (window, feature, bin) counts on the profile's quartile edges; with
    ``watermark`` this is a streaming aggregation that emits each window once
    (append mode) after the watermark passes it."""
    src = df.withWatermark(ts, watermark) if watermark else df
    long = to_long(src.select(ts, *features), list(features), ids=[ts])
    has_pct = F.coalesce(F.col("p25"), F.col("p50"), F.col("p75"), F.col("p95")).isNotNull()
    edges = profile.where(has_pct).select("feature", E.quartile_edges(profile).alias("edges"))
    # stream-static join with a table of one row per feature
    j = long.join(F.broadcast(edges), "feature")
    binned = j.select(ts, "feature", E.bin_index(F.col("v"), F.col("edges"), 5).alias("bin")).where(F.col("bin").isNotNull())
    return binned.groupBy(F.window(ts, window).alias("w"), "feature", "bin").agg(F.count(F.lit(1)).alias("count")).select(
        F.col("w.start").alias("window_start"), "feature", "bin", "count")


def psi_from_bin_counts(counts: DataFrame, n_bins: int = 4) -> DataFrame:
    """PSI per (window, feature) from finalized bin counts (uniform expectation).

    Each (window, feature) holds at most ``n_bins`` rows, gathered into a map;
    missing bins count 0 (no self-join, so it also works on a sink table)."""
    g = counts.groupBy("window_start", "feature").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("_m"))
    full = g.select("window_start", "feature", "_m",
                    F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    full = full.select("window_start", "feature", "bin",
                       F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0)).alias("count"),
                       F.lit(1.0 / n_bins).alias("expected"))
    return E.psi_table(full, ["window_start", "feature"], "count", "expected")
