"""Drift operators.

Inputs are long tables ``(keys..., feature, v)`` (see ``functions.core.to_long``)
and profile tables from ``operators.profile``.  Results are long
``(keys..., feature, metric, value)`` rows: an absent row means the reference
would not report the metric, a NULL value means it failed.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.functions.core import is_numeric_type, join_small, nan_div, to_long
from tabwatch.functions.pvalues import chi2_sf, ks_exact, ks_pvalue
from tabwatch.operators.counts import value_counts_of
from tabwatch.plans.ordered import count_below, running_sum
from tabwatch.session import materialize

# PSI floor, alert thresholds, reference sample size and seed, the
# default means used when a profile lacks one, chi-square sum tolerance, sample size
# up to which the KS p-value may be exact.
PSI_EPSILON = 1e-10
PSI_THRESHOLD = 0.2
KS_PVALUE_THRESHOLD = 0.1
REFERENCE_SAMPLE_SIZE = 10000
REFERENCE_SEED = 42
DEFAULT_SCORE_MEAN = 0.5
CHI2_SUM_RTOL = 1e-8
EXACT_KS_ROWS = 10000


# --------------------------------------------------------------------- E1 / E2
def bin_index(v: Column, edges: Column, n_edges: int | None = None) -> Column:
    """Bin of ``v`` on ``edges`` (NumPy rules), NULL when outside [first, last].

    With ``n_edges`` known at plan time the search is a codegen'd CASE tree."""
    m = F.size(edges) - 1
    if n_edges is not None:
        idx = count_below(edges, v, n_edges, inclusive=True) - 1
    else:
        idx = F.size(F.filter(edges, lambda e: e <= v)) - 1
    inside = (v >= F.element_at(edges, 1)) & (v <= F.element_at(edges, -1))
    return F.when(inside, F.least(idx, m - 1))


def edges_valid(edges: Column) -> Column:
    """NumPy rejects decreasing edges; equal neighbours are allowed."""
    return (F.size(edges) > 1) & (edges == F.array_sort(edges))


def edge_histogram(long: DataFrame, edges: DataFrame, keys: Sequence[str] = (),
                   n_edges: int | None = None) -> DataFrame:
    """``keys..., feature, bin, count`` for every bin of ``edges.edges``.

    ``edges`` has one row per ``(keys, feature)``; rows whose edges decrease are
    returned with ``count`` NULL (the reference fails for them).
    """
    keys = list(keys)
    k = [*keys, "feature"]
    # one row per feature: broadcast bounded by the schema width
    j = join_small(long, edges.select(*k, "edges"), k)
    binned = j.select(*k, bin_index(F.col("v"), F.col("edges"), n_edges).alias("bin")).where(F.col("bin").isNotNull())
    counts = binned.groupBy(*k, "bin").agg(F.count(F.lit(1)).alias("count"))
    all_bins = edges.select(
        *k, edges_valid(F.col("edges")).alias("_ok"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))).alias("bin"),
    )
    return all_bins.join(counts, [*k, "bin"], "left").select(
        *k, F.col("bin").cast("int").alias("bin"),
        F.when(F.col("_ok"), F.coalesce(F.col("count"), F.lit(0))).cast("long").alias("count"),
    )


def psi_table(bins: DataFrame, keys: Sequence[str], actual: str, expected: str,
              eps: float = PSI_EPSILON) -> DataFrame:
    """E2 over a bin table: ``keys..., psi`` = sum (a-e) ln(a/e) after normalising
    both sides and flooring at ``eps``.  A zero total gives NaN (as NumPy)."""
    keys = list(keys)
    tot = bins.groupBy(*keys).agg(
        F.sum(F.col(actual).cast("double")).alias("_A"),
        F.sum(F.col(expected).cast("double")).alias("_E"),
        F.count(F.when(F.col(actual).isNull() | F.col(expected).isNull(), 1)).alias("_bad"),
    )
    j = bins.join(tot, keys)
    a = F.greatest(nan_div(F.col(actual).cast("double"), F.col("_A")), F.lit(eps))
    e = F.greatest(nan_div(F.col(expected).cast("double"), F.col("_E")), F.lit(eps))
    out = j.groupBy(*keys).agg(
        F.sum((a - e) * F.ln(a / e)).alias("psi"), F.max("_bad").alias("_bad")
    )
    return out.select(*keys, F.when(F.col("_bad") == 0, F.col("psi")).alias("psi"))


def psi_arrays(actual: Column, expected: Column, eps: float = PSI_EPSILON) -> Column:
    """E2 on two count arrays (column expression)."""
    sa = F.aggregate(actual, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    se = F.aggregate(expected, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    z = F.arrays_zip(actual.alias("a"), expected.alias("e"))

    def term(acc, t):
        a = F.greatest(nan_div(t["a"].cast("double"), sa), F.lit(eps))
        e = F.greatest(nan_div(t["e"].cast("double"), se), F.lit(eps))
        return acc + (a - e) * F.ln(a / e)

    return F.aggregate(z, F.lit(0.0), term)


# ------------------------------------------------------------------------- E3
def quartile_edges(profile: DataFrame) -> Column:
    """[min, p25, p50, p75, max] with the reference's defaults for missing keys."""
    return F.array(
        F.coalesce(F.col("min"), F.lit(0.0)), F.coalesce(F.col("p25"), F.lit(0.0)),
        F.coalesce(F.col("p50"), F.lit(0.0)), F.coalesce(F.col("p75"), F.lit(0.0)),
        F.coalesce(F.col("max"), F.lit(1.0)),
    ).cast("array<double>")


def bin_vectors(long: DataFrame, edges: DataFrame, keys: Sequence[str] = (),
                n_edges: int | None = None, weight: str | None = None) -> DataFrame:
    """Histogram of ``long.v`` on each key's ``edges`` as one array per key:
    ``keys..., feature, counts (NULL if edges decrease), n_all``.

    One shuffle of (feature, bin) partial counts; the per-key gather holds at
    most ``#bins + 1`` entries, so it is bounded whatever the data size.  Keys
    without current values are absent (the reference skips them)."""
    k = [*keys, "feature"]
    j = join_small(long, edges.select(*k, "edges"), k)  # one row per feature
    b = j.select(*k, bin_index(F.col("v"), F.col("edges"), n_edges).alias("bin"), (F.col(weight) if weight else F.lit(1)).alias("_w"))
    c = b.groupBy(*k, "bin").agg(F.sum("_w").cast("long").alias("_c"))
    g = c.groupBy(*k).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "_c")))).alias("_m"),
        F.sum("_c").alias("n_all"),
    )
    g = join_small(g, edges.select(*k, "edges"), k)
    nb = F.greatest(F.size("edges") - 1, F.lit(1))
    counts = F.transform(F.sequence(F.lit(0), nb - 1),
                         lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0)).cast("long"))
    return g.select(*k, F.when(edges_valid(F.col("edges")), counts).alias("counts"), "n_all")


def numeric_psi(cur_long: DataFrame, profile: DataFrame, keys: Sequence[str] = (),
                expected: str = "uniform", base_long: DataFrame | None = None,
                weight: str | None = None) -> DataFrame:
    """``keys..., feature, psi, out_of_range_rate``.

    ``expected="uniform"`` is the reference (25 % per quartile bin);
    ``expected="observed"`` uses the baseline rows (``base_long``) binned on the
    same edges, which removes the bias on tied data.  ``weight`` names a column of
    ``cur_long`` that says how often a value occurs.
    """
    keys = list(keys)
    k = [*keys, "feature"]
    has_pct = F.coalesce(F.col("p25"), F.col("p50"), F.col("p75"), F.col("p95")).isNotNull()
    edges = profile.where(has_pct).select(*k, quartile_edges(profile).alias("edges"))
    cur = bin_vectors(cur_long, edges, keys, n_edges=5, weight=weight)
    if expected == "observed":
        if base_long is None:
            raise ValueError("expected='observed' needs base_long")
        base = bin_vectors(base_long, edges, keys, n_edges=5).select(*k, F.col("counts").alias("_exp"))
        cur = cur.join(base, k)  # one row per feature on both sides
        exp = F.col("_exp")
    else:
        exp = F.array(*[F.lit(0.25)] * 4)
    n_in = F.aggregate(F.col("counts"), F.lit(0).cast("long"), lambda a, x: a + x)
    return cur.select(
        *k,
        F.when(F.col("counts").isNotNull() & exp.isNotNull(), psi_arrays(F.col("counts"), exp)).alias("psi"),
        (1.0 - n_in / F.col("n_all")).alias("out_of_range_rate"),
    )


# ------------------------------------------------------------------------- E6
def mean_shift(cur_long: DataFrame, profile: DataFrame, keys: Sequence[str] = (),
               default_mean: float = 0.0, weight: str | None = None) -> DataFrame:
    """``keys..., feature, mean_shift`` = |mean(current) - baseline mean|."""
    k = [*keys, "feature"]
    mean = F.avg("v") if weight is None else F.sum(F.col("v") * F.col(weight)) / F.sum(weight)
    cur = cur_long.groupBy(*k).agg(mean.alias("_m"))
    return cur.join(F.broadcast(profile.select(*k, "mean")), k).select(
        *k, F.abs(F.col("_m") - F.coalesce(F.col("mean"), F.lit(default_mean))).alias("mean_shift")
    )


# ------------------------------------------------------------------------- E4
def _md5_uniform(seed: Column) -> Column:
    """Portable uniform in (0, 1) from the first 32 bits of an md5 digest."""
    bits = F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(4294967296.0)


def reference_sample(profile: DataFrame, n: int = REFERENCE_SAMPLE_SIZE, keys: Sequence[str] = (),
                     seed: int = REFERENCE_SEED) -> DataFrame:
    """``keys..., feature, draw, v``: ``n`` normal(mean, std) draws per numeric
    feature, clipped to [min, max].  Deterministic and partition-independent
    (md5-based uniforms + Box-Muller), so the same draws come out on any cluster."""
    k = [*keys, "feature"]
    p = profile.select(
        *k,
        F.coalesce(F.col("mean"), F.lit(0.0)).alias("_mu"),
        F.coalesce(F.col("std"), F.lit(1.0)).alias("_sd"),
        F.coalesce(F.col("min"), F.lit(float("-inf"))).alias("_lo"),
        F.coalesce(F.col("max"), F.lit(float("inf"))).alias("_hi"),
    )
    # one task per feature generates its draws (the profile is tiny and would
    # otherwise sit in one partition)
    draws = p.repartition(*k).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    base = F.concat_ws("-", F.col("feature"), F.lit(str(seed)), F.col("draw").cast("string"))
    u1 = _md5_uniform(F.concat(base, F.lit("-1")))
    u2 = _md5_uniform(F.concat(base, F.lit("-2")))
    z = F.sqrt(-2.0 * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    raw = F.col("_mu") + F.col("_sd") * z
    return draws.select(*k, "draw", F.least(F.greatest(raw, F.col("_lo")), F.col("_hi")).alias("v"))


def sample_counts(profile: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys..., feature, v, c2``: the distinct values of the E4 sample and their counts. They
    follow from the profile alone, so whoever checks against it often stores them."""
    return reference_sample(profile, REFERENCE_SAMPLE_SIZE, keys).groupBy(*keys, "feature", "v").agg(F.count(F.lit(1)).alias("c2"))


# ------------------------------------------------------------------------- E5
def ks_two_sample(a_long: DataFrame, b_long: DataFrame, keys: Sequence[str] = (),
                  n_buckets: int | None = None, exact_up_to: int = 0) -> DataFrame:
    """E5: ``keys..., feature, n1, n2, ks_statistic, ks_pvalue`` per feature present
    on both sides.  The ECDFs are built from distinct-value counts with a
    range-bucketed running sum (no single-task window per feature). The p-value is the
    asymptotic one, or where neither side has more than ``exact_up_to`` values the exact one
    (``EXACT_KS_ROWS`` is the reference's choice)."""
    k = [*keys, "feature"]
    u = a_long.select(*k, "v", F.lit(1).alias("_s")).unionByName(b_long.select(*k, "v", F.lit(2).alias("_s")))
    cnt = u.groupBy(*k, "v").agg(
        F.count(F.when(F.col("_s") == 1, 1)).alias("c1"), F.count(F.when(F.col("_s") == 2, 1)).alias("c2")
    )
    return ks_of_counts(cnt, keys, n_buckets, exact_up_to)


def ks_of_counts(cnt: DataFrame, keys: Sequence[str] = (), n_buckets: int | None = None, exact_up_to: int = 0) -> DataFrame:
    """E5 from the counts ``keys..., feature, v, c1, c2`` of every distinct value on both sides."""
    k = [*keys, "feature"]
    tot = cnt.groupBy(*k).agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2")).where(
        (F.col("n1") > 0) & (F.col("n2") > 0)
    )
    cum = running_sum(cnt, k, ["v"], ["c1", "c2"], n_buckets)
    d = join_small(cum, tot, k).groupBy(*k, "n1", "n2").agg(
        F.max(F.abs(F.col("c1_cum") / F.col("n1") - F.col("c2_cum") / F.col("n2"))).alias("ks_statistic")
    )
    pvalue = ks_pvalue(F.col("ks_statistic"), F.col("n1"), F.col("n2"))
    if exact_up_to:
        small = F.greatest("n1", "n2") <= exact_up_to
        # sizes beyond the limit are blanked, so the function never walks them
        size = lambda c: F.when(small, F.col(c)).otherwise(F.lit(1))
        pvalue = F.when(small, ks_exact(F.when(small, F.col("ks_statistic")), size("n1"), size("n2"))).otherwise(pvalue)
    return d.select(*k, "n1", "n2", "ks_statistic", pvalue.alias("ks_pvalue"))


def ks_against_profile(cur_long: DataFrame, profile: DataFrame, keys: Sequence[str] = (),
                       n: int = REFERENCE_SAMPLE_SIZE, n_buckets: int | None = None, exact_up_to: int = 0) -> DataFrame:
    """E5 in the reference's mode: current values vs the E4 normal sample."""
    ref = reference_sample(profile, n, keys)
    return ks_two_sample(cur_long, ref.select(*keys, "feature", "v"), keys, n_buckets, exact_up_to)


# ------------------------------------------------------------------------- E7
def chi_square(cur_long: DataFrame, cat_profile: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Chi-square goodness of fit of current category counts against baseline
    shares x n.  ``keys..., feature, k, observed_total, expected_total,
    chi2_statistic, dof, status`` with status ``ok`` / ``sum_mismatch`` /
    ``too_few_categories``.  Features without baseline shares are absent."""
    keys = list(keys)
    k = [*keys, "feature"]
    obs = cur_long.groupBy(*k, F.col("v").alias("category")).agg(F.count(F.lit(1)).alias("_o"))
    n_cur = obs.groupBy(*k).agg(F.sum("_o").alias("_n"))
    base = cat_profile.select(*k, "category", "share")
    feats = base.select(*k).distinct().join(n_cur, k)
    # categories: union of both sides, restricted to features on both sides
    cats = obs.join(feats.select(*k), k).join(base, [*k, "category"], "full_outer")
    cats = cats.join(feats, k)
    return _chi_of_cells(cats, k)


def _chi_of_cells(cats: DataFrame, k: list[str]) -> DataFrame:
    """E7 from one row per category: ``share`` of the baseline, observed ``_o`` (NULL: none) and
    the feature's ``_n``."""
    cells = cats.select(
        *k,
        (F.coalesce(F.col("share"), F.lit(0.0)) * F.col("_n")).alias("_e"),
        F.coalesce(F.col("_o"), F.lit(0)).cast("double").alias("_o"),
    ).where(F.col("_e") > 0)
    agg = cells.groupBy(*k).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("_o").alias("observed_total"),
        F.sum("_e").alias("expected_total"),
        F.sum((F.col("_o") - F.col("_e")) * (F.col("_o") - F.col("_e")) / F.col("_e")).alias("_stat"),
    )
    status = _chi_status()
    return agg.select(
        *k, F.col("k").cast("long").alias("k"), "observed_total", "expected_total",
        F.when(status == "ok", F.col("_stat")).alias("chi2_statistic"),
        (F.col("k") - 1).cast("long").alias("dof"), status.alias("status"),
    )


def _chi_status() -> Column:
    """E7's status from the sums ``k, observed_total, expected_total`` over a feature's cells."""
    # nothing observed in any baseline category: no finite difference, so a mismatch
    rel = F.coalesce(F.try_divide(F.abs(F.col("observed_total") - F.col("expected_total")), F.least(
        F.col("observed_total"), F.col("expected_total"))), F.lit(float("inf")))
    return (
        F.when(F.col("k") <= 1, F.lit("too_few_categories"))
        .when(rel > CHI2_SUM_RTOL, F.lit("sum_mismatch"))
        .otherwise(F.lit("ok"))
    )


def chi_square_test(cur_long: DataFrame, cat_profile: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """E7 with the p-value (pandas UDF over one row per feature)."""
    return _with_chi2_pvalue(chi_square(cur_long, cat_profile, keys))


def _chi2_pvalue() -> Column:
    return F.when(F.col("status") == "ok", chi2_sf(F.col("chi2_statistic"), F.col("dof")))


def _with_chi2_pvalue(cs: DataFrame) -> DataFrame:
    return cs.withColumn("chi2_pvalue", _chi2_pvalue())


# ------------------------------------------------------------------ E8 / E9
def score_drift(cur: DataFrame, score_col: str, base: DataFrame, keys: Sequence[str] = (),
                n_edges: int | None = None, weight: str | None = None) -> DataFrame:
    """Binary prediction drift.  ``base`` has one row per key with ``mean``,
    ``edges`` and ``counts`` (the baseline histogram).  Returns long rows
    ``keys..., feature='prediction', metric in (mean_shift, psi), value``; PSI is
    absent when the baseline histogram is malformed.  With ``n_edges`` known (the
    baseline histogram's), binning is a codegen'd search."""
    keys = list(keys)
    v = F.col(score_col).cast("double")
    b = base.select(*keys, "mean", "edges", "counts")
    w = F.col(weight) if weight else F.lit(1)
    x = join_small(cur.select(*keys, v.alias("v"), w.cast("long").alias("_w")).where(F.col("v").isNotNull()), b, keys)  # one row per key
    ok = (F.size("edges") > 1) & (F.size("counts") > 0) & (F.size("counts") == F.size("edges") - 1)
    binned = x.select(*keys, "v", "_w", F.when(ok, bin_index(F.col("v"), F.col("edges"), n_edges)).alias("bin"))
    mean = F.avg("v") if weight is None else F.sum(F.col("v") * F.col("_w")) / F.sum("_w")
    if n_edges is not None:  # one aggregate counts all bins
        counted = F.expr(f"array({', '.join(f'coalesce(sum(if(bin = {i}, _w, 0L)), 0L)' for i in range(n_edges - 1))})")
        res = join_small(binned.groupBy(*keys).agg(mean.alias("_cm"), counted.alias("_counts")), b, keys)
        counts = F.slice("_counts", 1, F.greatest(F.size("edges") - 1, F.lit(1)))
    else:
        # at most #bins entries per key
        per_bin = binned.where(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(F.sum("_w").alias("_c"))
        hist = per_bin.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "_c"))).alias("_m"))
        stats = join_small(binned.groupBy(*keys).agg(mean.alias("_cm")), b, keys)
        res = join_small(stats, hist, keys, how="left") if keys else join_small(stats, hist)
        counts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0))),
                             lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0)).cast("long"))
    out = res.select(
        *keys, F.lit("prediction").alias("feature"), ok.alias("_ok"),
        F.abs(F.col("_cm") - F.coalesce(F.col("mean"), F.lit(DEFAULT_SCORE_MEAN))).alias("mean_shift"),
        F.when(ok, psi_arrays(counts, F.col("counts"))).alias("psi"),
    )
    return _long_metrics(out, [*keys, "feature", "_ok"], ["mean_shift", "psi"]).where((F.col("metric") == "mean_shift") | F.col("_ok")).drop("_ok")


def class_drift(cur: DataFrame, arr_col: str, class_base: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per class index present in both: |mean(current p_i) - baseline mean_i|.
    Long rows ``keys..., feature='prediction', metric='class_<i>_mean_shift', value``."""
    keys = list(keys)
    ex = cur.select(*keys, F.posexplode(arr_col).alias("class_idx", "p"))
    cm = ex.groupBy(*keys, "class_idx").agg(F.avg(F.col("p").cast("double")).alias("_m"))
    j = cm.join(F.broadcast(class_base.select(*keys, "class_idx", "mean")), [*keys, "class_idx"])
    return j.select(
        *keys, F.lit("prediction").alias("feature"),
        F.concat(F.lit("class_"), F.col("class_idx").cast("string"), F.lit("_mean_shift")).alias("metric"),
        F.abs(F.col("_m") - F.coalesce(F.col("mean"), F.lit(0.0))).alias("value"),
    )


# ---------------------------------------------------------------- E10 / E11
def _long_metrics(df: DataFrame, k: list[str], metrics: Sequence[str]) -> DataFrame:
    return df.select(*k, *[F.col(m).cast("double") for m in metrics]).unpivot(k, list(metrics), "metric", "value")


def _numeric_drift(cur: DataFrame, prof: DataFrame, feats: list[str], keys: list[str], n_buckets: int | None,
                   wanted, counts: DataFrame | None, exact_up_to: int) -> DataFrame:
    """The numeric part of E10."""
    k = [*keys, "feature"]
    # numeric columns cast directly; other types are try-cast and any value
    # that fails makes the feature's metrics NULL (the reference errors)
    odd = [f for f in feats if not is_numeric_type(cur.schema[f].dataType)]
    if counts is None:
        casted = cur.select(*keys, *[F.col(f).try_cast("double").alias(f) if f in odd else F.col(f) for f in feats])
        counts = value_counts_of(casted, feats, keys=keys, store=False)
    else:
        counts = counts.where(F.col("feature").isin(feats))
    # current counts c1 next to those of the E4 sample c2: with them one table holds all that follows
    ref = sample_counts(prof, keys)
    both = counts.where(F.col("v").isNotNull()).select(*k, "v", F.col("n").alias("c1"), F.lit(0).cast("long").alias("c2")).unionByName(
        ref.select(*k, "v", F.lit(0).cast("long").alias("c1"), "c2"))
    both = materialize(both.groupBy(*k, "v").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2")))
    own = both.where("c1 > 0")
    present = own.groupBy(*k).agg(F.lit(0).alias("_bad"))
    if odd:
        bad = cur.groupBy(*keys).agg(*[
            F.count(F.when(F.col(f).isNotNull() & F.col(f).try_cast("double").isNull(), 1)).alias(f)
            for f in odd
        ]).unpivot(keys, odd, "feature", "_bad2")
        present = present.join(bad, k, "left").select(*k, F.coalesce(F.col("_bad2"), F.col("_bad")).alias("_bad"))
    # one row per key and feature on all sides
    wide = present.join(numeric_psi(own, prof, keys, weight="c1").select(*k, "psi"), k, "left")
    wide = wide.join(ks_of_counts(both, keys, n_buckets, exact_up_to).select(*k, "ks_statistic", "ks_pvalue"), k, "left")
    if wanted("mean_shift"):
        wide = wide.join(mean_shift(own, prof, keys, weight="c1"), k, "left")
    shown = [m for m in ("psi", "ks_statistic", "ks_pvalue", "mean_shift") if wanted(m)]
    # psi is absent when the profile has no percentiles
    has_pct = prof.where(F.coalesce("p25", "p50", "p75", "p95").isNotNull()).select(*k, F.lit(True).alias("_pct"))
    wide = wide.join(has_pct, k, "left").select(*k, "_pct", *[F.when(F.col("_bad") == 0, F.col(m)).alias(m) for m in shown])
    long = _long_metrics(wide, [*k, "_pct"], shown)
    return long.where((F.col("metric") != "psi") | F.col("_pct").isNotNull()).drop("_pct")


def feature_drift(cur: DataFrame, num_profile: DataFrame | None, cat_profile: DataFrame | None,
                  keys: Sequence[str] = (), n_buckets: int | None = None,
                  with_chi2_pvalue: bool = True, num_features: Sequence[str] | None = None,
                  cat_features: Sequence[str] | None = None, metrics: Sequence[str] | None = None,
                  counts: DataFrame | None = None, exact_up_to: int = 0) -> DataFrame:
    """Every baseline feature at once, long ``keys..., feature, metric, value``.
    ``metrics`` names those that are wanted; the others are not computed.

    The current rows are scanned once, into a stored table of distinct values and their
    counts that all numeric metrics read (``counts``: one that the caller has, see
    ``operators.counts``); a second scan counts the categories.

    Features missing from ``cur``, all-null features and features of unknown type
    are absent.  Non-numeric values in a numeric feature give NULL metrics.
    """
    keys = list(keys)
    k = [*keys, "feature"]
    parts = []

    def wanted(metric: str) -> bool:
        return metrics is None or metric in metrics

    if num_profile is not None:
        feats = list(num_features) if num_features is not None else [
            r[0] for r in num_profile.select("feature").distinct().collect()]  # profile metadata
        feats = [f for f in feats if f in cur.columns]
        if feats:
            parts.append(_numeric_drift(cur, num_profile.where(F.col("feature").isin(feats)), feats, keys, n_buckets, wanted, counts, exact_up_to))
    if cat_profile is not None and (wanted("chi2_statistic") or wanted("chi2_pvalue")):
        feats = list(cat_features) if cat_features is not None else [
            r[0] for r in cat_profile.select("feature").distinct().collect()]  # profile metadata
        feats = [f for f in feats if f in cur.columns]
        if feats:
            long = to_long(cur, feats, ids=keys, value_type="string")
            cs = chi_square_test(long, cat_profile, keys) if with_chi2_pvalue else chi_square(long, cat_profile, keys)
            cs = cs.where(F.col("status") != "too_few_categories")
            parts.append(_long_metrics(cs, k, ["chi2_statistic", "chi2_pvalue"] if with_chi2_pvalue else ["chi2_statistic"]))
    if not parts:  # no feature of the baseline is present: nothing to report
        base = num_profile if num_profile is not None else cat_profile
        if base is None:
            raise ValueError("a numeric or a categorical profile is needed")
        return base.select(*k, F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: What a row of ``short_drift`` is about.
_NUMERIC, _CATEGORY, _SCORE, _CLASS = range(4)
_BASE = "struct<mean: double, ok: boolean, edges: array<double>, counts: array<double>>"
_CELL = "array<struct<kind: int, feature: string, v: double, category: string>>"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@functools.lru_cache(maxsize=8)
def _short_columns(application: str) -> tuple[list[Column], list[Column], Column, Column]:
    """Columns of :func:`short_drift` that are the same for every call: the sums of a feature, its
    metrics, the chi-square p-value and what is shown. Building them takes longer than a check."""
    # of the rows of one feature: v, c1 (1: a current row), base, n1 and n2 (rows of both sides), u1 and u2
    # (those upto v), bin; on a category's row of the baseline: o (observed) and e (expected)
    gap = F.expr("abs(u1 / n1 - try_divide(u2, n2))")
    sums = [
        F.first("base").alias("base"), F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.max(gap).alias("ks_statistic"),
        F.expr("avg(if(c1 > 0, v, null))").alias("_m"),
        F.collect_list("bin").alias("_bins"),  # at most the current rows of one feature
        F.expr("count_if(e > 0)").alias("k"), F.expr("sum(if(e > 0, double(o), 0D))").alias("observed_total"),
        F.expr("sum(if(e > 0, e, 0D))").alias("expected_total"), F.expr("sum(if(e > 0, (o - e) * (o - e) / e, 0D))").alias("_stat")]
    numeric = F.col("kind") == _NUMERIC
    counts = F.expr("transform(sequence(0, greatest(size(base.edges) - 2, 0)), i -> size(filter(_bins, b -> b = i)))")
    expected = F.when(numeric, F.array(*[F.lit(0.25)] * 4)).otherwise(F.col("base.counts"))
    default = F.when(F.col("kind") == _SCORE, F.lit(DEFAULT_SCORE_MEAN)).otherwise(F.lit(0.0))
    psi = F.when(F.col("base.ok") & (~numeric | edges_valid(F.col("base.edges"))), psi_arrays(counts, expected))
    status = _chi_status()
    metrics = [
        psi.alias("psi"), F.when(F.col("base").isNotNull(), F.abs(F.col("_m") - F.coalesce("base.mean", default))).alias("mean_shift"),
        "ks_statistic", F.when(numeric & (F.col("n2") > 0), ks_pvalue(F.col("ks_statistic"), F.col("n1"), F.col("n2"))).alias("ks_pvalue"),
        F.col("base.ok").alias("_ok"), F.when(status == "ok", F.col("_stat")).alias("chi2_statistic"), (F.col("k") - 1).cast("long").alias("dof"), status.alias("status")]
    row = lambda metric, value, on: f"named_struct('metric', {metric}, 'value', double({value}), 'on', {on})"
    shown = F.expr(f"""filter(array({row("'psi'", "psi", f"kind in ({_NUMERIC}, {_SCORE}) and ifnull(_ok, false)")},
        {row("'ks_statistic'", "ks_statistic", f"kind = {_NUMERIC}")}, {row("'ks_pvalue'", "ks_pvalue", f"kind = {_NUMERIC}")},
        {row("'mean_shift'", "mean_shift", f"kind in ({_NUMERIC}, {_SCORE})")}, {row("concat('class_', feature, '_mean_shift')", "mean_shift", f"kind = {_CLASS}")},
        {row("'chi2_statistic'", "chi2_statistic", f"kind = {_CATEGORY} and k > 1")}, {row("'chi2_pvalue'", "chi2_pvalue", f"kind = {_CATEGORY} and k > 1")}), x -> x.on)""")
    return sums, metrics, _chi2_pvalue(), shown


_NOTHING = {"v": "double(null)", "category": "string(null)", "c1": "0L", "c2": "0L", "share": "double(null)", "base": f"cast(null as {_BASE})"}


def short_baselines(keys: Sequence[str], num_profile: DataFrame | None = None, cat_profile: DataFrame | None = None,
                    num_features: Sequence[str] = (), cat_features: Sequence[str] = (), samples: DataFrame | None = None,
                    score_base: DataFrame | None = None, class_base: DataFrame | None = None) -> DataFrame:
    """What :func:`short_drift` compares with, as one table that many checks can share: profiles,
    the E4 sample (``samples``: its stored :func:`sample_counts`), categories, score histograms and
    class means."""
    def say(df: DataFrame, kind: int, feature: str = "feature", **has: str) -> DataFrame:
        return df.selectExpr(*map(_name, keys), f"{kind} as kind", f"{feature} as feature", *[f"{x} as {c}" for c, x in (_NOTHING | has).items()])

    def base(ok: str = "true", edges: str = "null", counts: str = "null") -> str:
        return f"cast(named_struct('mean', double(mean), 'ok', {ok}, 'edges', {edges}, 'counts', {counts}) as {_BASE})"

    known = []
    if num_profile is not None and num_features:
        prof = num_profile.where(F.col("feature").isin(list(num_features)))
        ref = sample_counts(prof, keys) if samples is None else samples.where(F.col("feature").isin(list(num_features)))
        pct = "coalesce(p25, p50, p75, p95) is not null"
        known += [say(prof.withColumn("_edges", quartile_edges(prof)), _NUMERIC, base=base(pct, f"if({pct}, _edges, null)")), say(ref, _NUMERIC, v="v", c2="c2")]
    if cat_profile is not None and cat_features:
        known.append(say(cat_profile.where(F.col("feature").isin(list(cat_features))), _CATEGORY, category="string(category)", share="double(share)"))
    if score_base is not None:
        fits = "ifnull(size(edges) > 1 and size(counts) > 0 and size(counts) = size(edges) - 1, false)"
        known.append(say(score_base, _SCORE, "'prediction'", base=base(fits, "edges", "counts")))
    if class_base is not None:
        known.append(say(class_base, _CLASS, "string(class_idx)", base=base()))
    if not known:
        raise ValueError("a baseline is needed")
    return functools.reduce(DataFrame.unionByName, known)


def short_drift(cur: DataFrame, known: DataFrame, keys: Sequence[str], num_features: Sequence[str] = (), cat_features: Sequence[str] = (),
                score_col: str | None = None, arr_col: str | None = None, tasks: int | None = None) -> DataFrame:
    """E10 with E8 and E9 of few rows a key, such as a monitor's last N: the rows of
    :func:`feature_drift`, :func:`score_drift` and :func:`class_drift` from one scan of ``cur`` and
    one shuffle. A (key, feature) goes to one task, with its rows and what ``known``, the
    :func:`short_baselines`, says of it, so only call this where the rows of a key are bounded.
    Numeric features must have numeric types; ``tasks`` is the number of partitions of the shuffle."""
    keys = list(keys)
    k = [*keys, "kind", "feature"]

    def cell(kind: int, feature: str, v: str = "double(null)", category: str = "string(null)") -> str:
        return f"named_struct('kind', {kind}, 'feature', {feature}, 'v', {v}, 'category', {category})"

    cells = [cell(_NUMERIC, _text(f), f"if(isnan(double({_name(f)})), null, double({_name(f)}))") for f in num_features if f in cur.columns]
    cells += [cell(_CATEGORY, _text(f), category=f"string({_name(f)})") for f in cat_features if f in cur.columns]
    if score_col is not None:
        cells.append(cell(_SCORE, "'prediction'", f"double({_name(score_col)})"))
    cells = f"cast(array({', '.join(cells)}) as {_CELL})"
    if arr_col is not None:
        classes = f"transform({_name(arr_col)}, (p, i) -> {cell(_CLASS, 'string(i)', 'double(p)')})"
        cells = f"concat({cells}, ifnull(cast({classes} as {_CELL}), cast(array() as {_CELL})))"
    rows = cur.selectExpr(*map(_name, keys), f"inline({cells})").where(f"kind = {_CLASS} or v is not null or category is not null")
    rows = rows.selectExpr("*", *[f"{x} as {c}" for c, x in (_NOTHING | {"c1": "1L"}).items() if c not in ("v", "category")]).unionByName(known)
    rows = rows.repartition(tasks, *k) if tasks else rows.repartition(*k)
    # one sort serves all frames: whole feature, values upto this one, equal values
    by = f"partition by {', '.join(map(_name, k))} order by v, category"
    whole, upto, equal = (f"({by} {f})" for f in (
        "rows between unbounded preceding and unbounded following", "range between unbounded preceding and current row", "range between current row and current row"))
    values = rows.selectExpr(
        *map(_name, k), "v", "c1", "share", f"first(base, true) over {whole} as base", f"sum(c1) over {whole} as n1", f"sum(c2) over {whole} as n2",
        f"sum(c1) over {upto} as u1", f"sum(c2) over {upto} as u2", f"sum(c1) over {equal} as o")
    values = values.where(f"n1 > 0 and (kind < {_SCORE} or base is not null)").selectExpr(
        "*", "ifnull(share, 0D) * n1 as e",  # of the baseline's row of a category, which stands for the category
        "if(c1 > 0 and base.ok and v >= base.edges[0] and v <= element_at(base.edges, -1), least(size(filter(base.edges, x -> x <= v)) - 1, size(base.edges) - 2), null) as bin")
    sums, metrics, pvalue, shown = _short_columns(cur.sparkSession.sparkContext.applicationId)
    wide = values.groupBy(*k).agg(*sums).select(*k, "k", *metrics).withColumn("chi2_pvalue", pvalue)
    return wide.select(*keys, F.when(F.col("kind") == _CLASS, F.lit("prediction")).otherwise(F.col("feature")).alias("_f"), F.inline(shown)).select(
        *keys, F.col("_f").alias("feature"), "metric", "value")


def prediction_drift(cur: DataFrame, prediction_type: str | None, score_col: str | None = None,
                     score_base: DataFrame | None = None, arr_col: str | None = None,
                     class_base: DataFrame | None = None, keys: Sequence[str] = (),
                     n_edges: int | None = None, weight: str | None = None) -> DataFrame | None:
    """Dispatch on the baseline prediction type; unknown or missing → None.
    ``n_edges`` (of the baseline histogram) and ``weight`` as in :func:`score_drift`."""
    if prediction_type == "binary_classification" and score_base is not None:
        return score_drift(cur, score_col, score_base, keys, n_edges, weight)
    if prediction_type == "multiclass_classification" and class_base is not None:
        return class_drift(cur, arr_col, class_base, keys)
    return None


# ---------------------------------------------------------------- E12 / E13
def drift_alerts(scores: DataFrame, keys: Sequence[str] = (), psi_threshold: float = PSI_THRESHOLD,
                 ks_threshold: float = KS_PVALUE_THRESHOLD) -> DataFrame:
    """``keys..., feature, drift_type, value, threshold``.  Strict comparisons;
    NULL and NaN never alert."""
    v = F.col("value")
    ok = v.isNotNull() & ~F.isnan(v)
    psi_rule = (F.col("metric") == "psi") & ok & (v > psi_threshold)
    ks_rule = (F.col("metric") == "ks_pvalue") & (F.col("feature") != "prediction") & ok & (v < ks_threshold)
    return scores.where(psi_rule | ks_rule).select(
        *keys, "feature",
        F.when(F.col("metric") == "psi", F.lit("psi")).otherwise(F.lit("ks_test")).alias("drift_type"),
        "value",
        F.when(F.col("metric") == "psi", F.lit(psi_threshold)).otherwise(F.lit(ks_threshold)).alias("threshold"),
    )


def drift_score_rows(scores: DataFrame, model_version: str | Column | None = None) -> DataFrame:
    """Exported gauges ``model_version, feature, metric_type, value``: only
    ``psi`` and ``ks_pvalue``, non-null, version defaulting to ``unknown``."""
    if model_version is None:
        mv = F.col("model_version") if "model_version" in scores.columns else F.lit(None).cast("string")
    elif isinstance(model_version, str):
        mv = F.lit(model_version)
    else:
        mv = model_version
    keep = F.col("metric").isin("psi", "ks_pvalue") & F.col("value").isNotNull()
    keep = keep & ((F.col("feature") != "prediction") | (F.col("metric") == "psi"))
    return scores.where(keep).select(
        F.coalesce(mv, F.lit("unknown")).alias("model_version"), "feature",
        F.col("metric").alias("metric_type"), "value",
    )
