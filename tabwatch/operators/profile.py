"""Baseline profiles.

Every profile is one scan turned into a long ``(keys..., feature, v)`` table and
aggregated by ``feature``; quantiles go through the distributed exact path in
``plans.ordered``.  ``keys`` lets the same operator profile per model version or
per time window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.functions.core import (
    categorical_columns, feature_name, join_small, nan_div, numeric_columns, to_long, to_long_ids,
)
from tabwatch.operators.counts import category_shares, quantiles, value_counts_of
from tabwatch.plans.ordered import exact_quantiles, quantile_columns

# The profile percentiles and the category count kept per feature.
PROFILE_PERCENTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95}
TOP_K = 10
HISTOGRAM_BINS = 20


def _row_stats(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys, "_fid").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.stddev_pop("v").alias("std_pop"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.avg(F.col("v").isNull().cast("double")).alias("missing_rate"),
    )


def numeric_profile(df: DataFrame, features: Sequence[str] | None = None,
                    keys: Sequence[str] = (), n_buckets: int | None = None) -> DataFrame:
    """``keys..., feature, n_rows, n, mean, std, min, max, p25, p50, p75, p95,
    missing_rate`` (sample std; NaN counts as missing)."""
    keys = list(keys)
    features = list(features) if features is not None else numeric_columns(df, exclude=keys)
    # the shuffles are keyed by a small int feature id; names come back at the end
    long = to_long_ids(df, features, ids=keys, keep_missing=True)
    stats = _row_stats(long, keys)
    qs = quantile_columns(long.where(F.col("v").isNotNull()), [*keys, "_fid"], "v",
                          PROFILE_PERCENTILES, n_buckets)
    # one row per (key, feature) on both sides
    return stats.join(qs, [*keys, "_fid"], "left").select(
        *keys, feature_name(features).alias("feature"), "n_rows", "n", "mean", "std", "min", "max",
        *PROFILE_PERCENTILES.keys(), "missing_rate",
    )


def category_counts(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys..., feature, category, count`` for non-null values (string form)."""
    long = to_long(df, list(features), ids=list(keys), value_type="string")
    return long.groupBy(*keys, "feature", F.col("v").alias("category")).agg(
        F.count(F.lit(1)).alias("count")
    )


def categorical_profile(df: DataFrame, features: Sequence[str] | None = None,
                        keys: Sequence[str] = (), k: int = TOP_K) -> DataFrame:
    """Top-``k`` categories per feature with their share of non-null rows.

    ``keys..., feature, category, count, share, rank, n_unique, n, missing_rate``.
    Ties in count are broken by category ascending. A feature without any non-null
    value has one row with a null category, ``n_unique`` 0 and its missing rate.
    """
    keys = list(keys)
    features = list(features) if features is not None else categorical_columns(df, exclude=keys)
    long = to_long(df, features, ids=keys, value_type="string", keep_missing=True)
    # one scan: counts per (feature, value) including the NULL group; totals,
    # missing rate and distinct count are derived from that aggregated table
    all_counts = long.groupBy(*keys, "feature", F.col("v").alias("category")).agg(
        F.count(F.lit(1)).alias("count"))
    totals = all_counts.groupBy(*keys, "feature").agg(
        F.sum(F.when(F.col("category").isNotNull(), F.col("count")).otherwise(0)).alias("n"),
        F.count("category").alias("n_unique"),
        (F.sum(F.when(F.col("category").isNull(), F.col("count")).otherwise(0))
         / F.sum("count")).alias("missing_rate"),
    )
    counts = all_counts.where(F.col("category").isNotNull())
    w = Window.partitionBy(*keys, "feature").orderBy(F.desc("count"), F.asc("category"))
    # rank <= k over row_number: Spark inserts a partial per-partition top-k before
    # the shuffle (WindowGroupLimit), so a feature with many categories is not
    # gathered into one task
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return (
        totals.join(top, [*keys, "feature"], "left")
        .select(*keys, "feature", "category", F.coalesce("count", F.lit(0).cast("long")).alias("count"),
                F.try_divide(F.col("count").cast("double"), F.col("n").cast("double")).alias("share"),
                F.col("rank").cast("int").alias("rank"), "n_unique", "n", "missing_rate")
    )


def missing_rate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """D3: ``column, n_rows, n_missing, missing_rate`` over all rows."""
    columns = list(columns) if columns is not None else df.columns
    aggs = []
    for c in columns:
        dt = df.schema[c].dataType.simpleString()
        miss = F.col(c).isNull()
        if dt in ("double", "float"):
            miss = miss | F.isnan(c)
        aggs.append(F.sum(miss.cast("long")).alias(c))
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    long = wide.unpivot(["_n"], columns, "column", "n_missing")
    return long.select(
        "column", F.col("_n").alias("n_rows"), F.col("n_missing").cast("long").alias("n_missing"),
        nan_div(F.col("n_missing").cast("double"), F.col("_n").cast("double")).alias("missing_rate"),
    )


def value_counts(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys..., value, count, share`` (share of non-null rows)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("count")
    )
    # totals per key come from an aggregate joined back (one row per key), not
    # from a window, which would put every distinct value of a key in one task
    tot = counts.groupBy(*keys).agg(F.sum("count").alias("_tot"))
    return join_small(counts, tot, list(keys)).withColumn(
        "share", F.col("count") / F.col("_tot")).drop("_tot")


def histogram_edges(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width edges over [min, max] (constant data widened by 0.5 each side).

    ``keys..., lo, hi, edges`` with ``bins + 1`` edges, the last one exactly ``hi``.
    """
    v = F.col(column).cast("double")
    rng = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"))
    rng = rng.select(
        *keys,
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("lo"),
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("hi"),
    )
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    edges = F.transform(
        F.sequence(F.lit(0), F.lit(bins)),
        lambda i: F.when(i == bins, F.col("hi")).otherwise(F.col("lo") + i.cast("double") * step),
    )
    return rng.withColumn("edges", edges)


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS,
              keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``keys..., bin, lo, hi, count`` for every bin (empty bins kept).
    ``weight`` names a column that says how often a value occurs.

    Bin assignment follows NumPy: left-closed bins, last bin closed, computed by
    arithmetic and corrected against the materialised edges.
    """
    keys = list(keys)
    ed = histogram_edges(df, column, bins, keys)
    v = F.col(column).cast("double")
    vals = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v"), (F.col(weight) if weight else F.lit(1)).alias("_w"))
    # one row per key: the broadcast is bounded by the number of keys
    j = join_small(vals, ed, keys)
    norm = F.lit(float(bins)) / (F.col("hi") - F.col("lo"))
    i0 = F.least(F.floor((F.col("_v") - F.col("lo")) * norm).cast("int"), F.lit(bins - 1))
    j = j.withColumn("_i", i0)
    j = j.withColumn("_i", F.when(F.col("_v") < F.element_at("edges", F.col("_i") + 1), F.col("_i") - 1).otherwise(F.col("_i")))
    j = j.withColumn(
        "_i",
        F.when((F.col("_v") >= F.element_at("edges", F.col("_i") + 2)) & (F.col("_i") != bins - 1), F.col("_i") + 1)
        .otherwise(F.col("_i")),
    )
    counts = j.groupBy(*keys, F.col("_i").alias("bin")).agg(F.sum("_w").alias("count"))
    all_bins = ed.select(*keys, "edges", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return all_bins.join(counts, [*keys, "bin"], "left").select(
        *keys, F.col("bin").cast("int").alias("bin"),
        F.element_at("edges", F.col("bin") + 1).alias("lo"),
        F.element_at("edges", F.col("bin") + 2).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
    )


def score_profile(df: DataFrame, column: str, keys: Sequence[str] = (),
                  n_buckets: int | None = None) -> DataFrame:
    """Binary score profile ``keys..., n, mean, std (population), p25..p95``."""
    keys = list(keys)
    v = F.col(column).cast("double")
    base = df.select(*keys, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    stats = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")
    )
    qs = quantile_columns(base, keys, "v", PROFILE_PERCENTILES, n_buckets)
    return join_small(stats, qs, keys, "left")


def class_profile(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per class index ``keys..., class_idx, n, mean, std (population), n_classes``."""
    keys = list(keys)
    ex = df.select(*keys, F.posexplode(column).alias("class_idx", "p"))
    per = ex.groupBy(*keys, "class_idx").agg(
        F.count("p").alias("n"),
        F.avg(F.col("p").cast("double")).alias("mean"),
        F.stddev_pop(F.col("p").cast("double")).alias("std"),
    )
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    # one row per class index, so the window input is tiny
    return per.withColumn("n_classes", F.max("class_idx").over(w) + 1).select(
        *keys, F.col("class_idx").cast("int").alias("class_idx"), "n", "mean", "std",
        F.col("n_classes").cast("int").alias("n_classes"),
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None,
             n_buckets: int | None = None) -> DataFrame:
    """``feature, count, mean, std, min, q25, q50, q75, max`` with exact quartiles."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    long = to_long_ids(df, columns)
    stats = long.groupBy("_fid").agg(
        F.count(F.lit(1)).alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    qs = quantile_columns(long, ["_fid"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, n_buckets)
    return stats.join(qs, "_fid", "left").select(
        feature_name(columns).alias("feature"), "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def build_baseline(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                   score_col: str | None = None, keys: Sequence[str] = (),
                   n_buckets: int | None = None, class_col: str | None = None) -> DataFrame:
    """The whole baseline as long rows ``keys..., section, feature, stat, value``.

    Sections: ``dataset`` (n_samples), ``numeric``, ``categorical`` (share per
    category, stat = category; none for a feature without values), ``prediction``
    (score profile + histogram counts; with ``class_col``, an array of class
    probabilities, mean and std per class and their number).

    Two scans: stored counts of distinct values (``operators.counts``) give quantiles,
    shares and the histogram, the rows themselves means and deviations. The class section
    is a scan of its own.
    """
    keys = list(keys)
    numbers = [*numeric, *([score_col] if score_col and score_col not in numeric else [])]
    parts = []
    if numbers or categorical:
        counts = value_counts_of(df, numbers, list(categorical), keys)
        one = counts.where(F.col("feature") == [*numbers, *categorical][0])
        n = one.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("value"))
    else:
        n = df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("value"))
    parts.append(n.select(*keys, F.lit("dataset").alias("section"), F.lit("").alias("feature"),
                          F.lit("n_samples").alias("stat"), "value"))
    if numbers:
        num = counts.where(F.col("feature").isin(numbers))
        stats = _row_stats(to_long_ids(df, numbers, ids=keys, keep_missing=True), keys).withColumn("feature", feature_name(numbers)).drop("_fid")
        # one row per (key, feature) on both sides
        prof = stats.join(quantiles(num, PROFILE_PERCENTILES, keys, n_buckets), [*keys, "feature"], "left")
        stats = ["mean", "std", "min", "max", *PROFILE_PERCENTILES.keys(), "missing_rate"]
        long = prof.select(*keys, "feature", *[F.col(s).cast("double") for s in [*stats, "std_pop"]]).unpivot(
            [*keys, "feature"], [*stats, "std_pop"], "stat", "value")
        if numeric:
            parts.append(long.where(F.col("feature").isin(list(numeric)) & (F.col("stat") != "std_pop")).select(
                *keys, F.lit("numeric").alias("section"), "feature", "stat", "value"))
        if score_col:
            of_scores = (F.col("feature") == score_col) & F.col("stat").isin("mean", "std_pop", *PROFILE_PERCENTILES)
            parts.append(long.where(of_scores).select(
                *keys, F.lit("prediction").alias("section"), "feature", F.regexp_replace("stat", "_pop$", "").alias("stat"), "value"))
            scores = counts.where((F.col("feature") == score_col) & F.col("v").isNotNull()).select(*keys, F.col("v").alias(score_col), "n")
            h = histogram(scores, score_col, keys=keys, weight="n")
            parts.append(h.select(*keys, F.lit("prediction").alias("section"), F.lit(score_col).alias("feature"),
                                  F.format_string("count:%02d", F.col("bin")).alias("stat"),
                                  F.col("count").cast("double").alias("value")))
    if categorical:
        cats, totals = category_shares(counts.where(F.col("feature").isin(list(categorical))), keys)
        w = Window.partitionBy(*keys, "feature").orderBy(F.desc("count"), F.asc("category"))
        top = cats.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP_K)  # partial top-k before the shuffle
        shares = join_small(top, totals.select(*keys, "feature", F.col("n").alias("_n")), [*keys, "feature"])
        parts.append(shares.select(*keys, F.lit("categorical").alias("section"), "feature",
                                   F.concat(F.lit("share:"), F.col("category")).alias("stat"), (F.col("count") / F.col("_n")).alias("value")))
        meta = totals.select(*keys, "feature", F.col("n_unique").cast("double"), F.col("missing_rate").cast("double"))
        parts.append(meta.unpivot([*keys, "feature"], ["n_unique", "missing_rate"], "stat", "value")
                     .select(*keys, F.lit("categorical").alias("section"), "feature", "stat", "value"))
    if class_col:
        classes = class_profile(df, class_col, keys)
        per = classes.select(*keys, F.col("class_idx").cast("string").alias("_c"), "mean", "std").unpivot([*keys, "_c"], ["mean", "std"], "stat", "value")
        parts.append(per.select(*keys, F.lit("prediction").alias("section"), F.lit(class_col).alias("feature"),
                                F.concat(F.lit("class_"), "_c", F.lit("_"), "stat").alias("stat"), "value"))
        parts.append(classes.groupBy(*keys).agg(F.max("n_classes").cast("double").alias("value")).where("value is not null").select(
            *keys, F.lit("prediction").alias("section"), F.lit(class_col).alias("feature"), F.lit("n_classes").alias("stat"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


__all__ = [
    "numeric_profile", "categorical_profile", "category_counts", "missing_rate", "value_counts",
    "histogram_edges", "histogram", "score_profile", "class_profile", "describe", "build_baseline",
    "exact_quantiles", "PROFILE_PERCENTILES",
]
