"""One stored table of distinct values and their counts, from which every profile and
drift statistic follows.

``value_counts`` reads its input once: numeric and categorical features are stacked into
``(keys..., feature, v, s, n)``, with ``v`` the number or ``s`` the text (both null where the
value is missing), grouped with partial aggregation and stored. Quantiles, histograms, PSI,
KS, mean shifts and category shares of many features then read that table; the input is not
scanned again. A value that a third of all rows hold is one row of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.functions.core import missing_to_null
from tabwatch.plans.ordered import quantiles_of_counts
from tabwatch.session import materialize


def value_counts_of(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (),
                    keys: Sequence[str] = (), store: bool = True) -> DataFrame:
    """``keys..., feature, v (double), s (string), n`` of every distinct value, in one scan.
    Missing values (NULL, NaN) of a feature are one row with neither. A numeric feature and a
    categorical one must not share a name."""
    keys, names = list(keys), [*numeric, *categorical]
    if len(set(names)) < len(names):
        raise ValueError("a feature is both numeric and categorical")
    rows = [f"{i}, CAST(`{c}` AS DOUBLE), CAST(NULL AS STRING)" for i, c in enumerate(numeric)]
    rows += [f"{len(numeric) + i}, CAST(NULL AS DOUBLE), CAST(`{c}` AS STRING)" for i, c in enumerate(categorical)]
    long = df.select(*keys, F.expr(f"stack({len(rows)}, {', '.join(rows)}) AS (_fid, v, s)")).withColumn("v", missing_to_null("v"))
    counts = long.groupBy(*keys, "_fid", "v", "s").agg(F.count(F.lit(1)).alias("n"))
    named = F.element_at(F.array(*[F.lit(f) for f in names]), F.col("_fid") + 1)
    out = counts.select(*keys, named.alias("feature"), "v", "s", "n")
    return materialize(out) if store else out


def quantiles(counts: DataFrame, probs: dict[str, float], keys: Sequence[str] = (), n_buckets: int | None = None) -> DataFrame:
    """One column per named quantile, a row per feature."""
    k = [*keys, "feature"]
    q = quantiles_of_counts(counts.where("v is not null").select(*k, "v", F.col("n").alias("_c")), k, "v", list(probs.values()), n_buckets)
    return q.groupBy(*k).agg(*[F.max(F.when(F.col("q") == float(p), F.col("value"))).alias(name) for name, p in probs.items()])


def category_shares(counts: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(``keys..., feature, category, count``; ``keys..., feature, n, n_unique, missing_rate``) of
    categorical features."""
    k = [*keys, "feature"]
    there = F.col("s").isNotNull()
    totals = counts.groupBy(*k).agg(
        F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("n"), F.count("s").alias("n_unique"),
        (F.sum(F.when(there, F.lit(0)).otherwise(F.col("n"))) / F.sum("n")).alias("missing_rate"))
    return counts.where(there).select(*k, F.col("s").alias("category"), F.col("n").alias("count")), totals
