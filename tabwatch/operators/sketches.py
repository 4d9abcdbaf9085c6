"""Mergeable profiles (the approximate form of D1 and C3).

A profile part holds, per key and feature, exact counts, sum, minimum and maximum, and two
sketches: distinct values (HyperLogLog) and ranks (KLL). Parts of different days, files or
partitions merge without another look at the rows, so a stored profile grows by the new rows
alone. Sketches have a fixed size whatever they have seen; the exact profile stays the
default elsewhere.

Error bounds at the default sizes, each held in at least 99 of 100 cases: a quantile's rank
is off by at most ``RANK_ERROR`` of the rows, a distinct count by at most ``DISTINCT_ERROR``
of itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwatch.functions.core import feature_name, to_long_ids
from tabwatch.operators.profile import PROFILE_PERCENTILES

#: Sizes of the sketches: KLL's k and HyperLogLog's number of registers as a power of two.
RANK_K, DISTINCT_LG = 800, 14
#: Bounds that follow from these sizes.
RANK_ERROR, DISTINCT_ERROR = 0.005, 0.025


def profile_parts(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys..., feature, n_rows, n, sum, min, max, distinct, ranks`` of the rows of ``df``, in one
    scan; sketches are built in each task and merged."""
    features = list(features)
    long = to_long_ids(df, features, ids=list(keys), keep_missing=True)
    # -0.0 and 0.0 are one value; the distinct sketch takes the bits as a text
    per = long.groupBy(*keys, "_fid").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n"), F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.hll_sketch_agg((F.col("v") + 0.0).cast("string"), DISTINCT_LG).alias("distinct"), F.kll_sketch_agg_double("v", RANK_K).alias("ranks"))
    return per.select(*keys, feature_name(features).alias("feature"), "n_rows", "n", "sum", "min", "max", "distinct", "ranks")


def merge_parts(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Parts merged to ``keys`` (some or none of theirs); the result is a part again."""
    return parts.groupBy(*keys, "feature").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("ranks", RANK_K).alias("ranks"))


def profile_of_parts(parts: DataFrame, keys: Sequence[str] = (), probs: dict[str, float] | None = None) -> DataFrame:
    """D1's columns from merged parts, ``n_unique`` and the quantiles as estimates; NULL
    statistics for a feature without values."""
    probs = PROFILE_PERCENTILES if probs is None else probs
    some = F.col("n") > 0
    named = [F.when(some, F.kll_sketch_get_quantile_double("ranks", F.lit(float(p)))).alias(name) for name, p in probs.items()]
    return merge_parts(parts, keys).select(
        *keys, "feature", "n_rows", "n", F.try_divide("sum", "n").alias("mean"), "min", "max",
        F.hll_sketch_estimate("distinct").alias("n_unique"), *named, F.try_divide(F.col("n_rows") - F.col("n"), "n_rows").alias("missing_rate"))


def append_parts(parts: DataFrame, path: str, by: str) -> None:
    """Store parts, one partition per value of ``by`` (a day, a batch); parts that a rerun
    writes again replace those of the same values."""
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
