"""P-value columns.

* Kolmogorov limiting distribution (two-sided KS), written as a Spark SQL
  higher-order expression so it stays on the JVM.
* Exact two-sided two-sample KS by lattice paths, for one row per feature.
* Chi-square upper tail for integer degrees of freedom, an Arrow-batched pandas UDF
  applied to one row per feature (Spark SQL has no ``erfc``).
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The pandas UDFs below are shipped by value, so executors need no copy of this
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Number of series terms and the switch point between the two forms.
KOLMOGOROV_TERMS = 100
KOLMOGOROV_SWITCH = 1.18


def kolmogorov_q(lam: Column) -> Column:
    """Q(lambda) = P(K > lambda) for the Kolmogorov distribution."""
    lam = lam.cast("double")
    ks = F.sequence(F.lit(1), F.lit(KOLMOGOROV_TERMS))
    # 2 * sum (-1)^(k-1) exp(-2 k^2 lam^2)   (fast for large lambda)
    alt = F.aggregate(
        ks,
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(-2.0 * k * k * lam * lam),
    ) * 2.0
    # 1 - sqrt(2 pi)/lam * sum exp(-(2k-1)^2 pi^2 / (8 lam^2))   (fast for small lambda)
    theta = F.lit(1.0) - F.lit(math.sqrt(2.0 * math.pi)) / lam * F.aggregate(
        ks,
        F.lit(0.0),
        lambda acc, k: acc
        + F.exp(-((2 * k - 1) * (2 * k - 1)) * F.lit(math.pi * math.pi) / (8.0 * lam * lam)),
    )
    q = (
        F.when(lam.isNull(), F.lit(None).cast("double"))
        .when(lam <= 0, F.lit(1.0))
        .when(lam >= KOLMOGOROV_SWITCH, alt)
        .otherwise(theta)
    )
    return F.greatest(F.least(q, F.lit(1.0)), F.lit(0.0))


def ks_pvalue(d: Column, n1: Column, n2: Column) -> Column:
    """Two-sided asymptotic p-value for the two-sample statistic ``d``."""
    en = F.sqrt(n1.cast("double") * n2.cast("double") / (n1 + n2).cast("double"))
    return kolmogorov_q(d * en)


def chi2_sf_scalar(x: float, dof: int) -> float:
    """Upper tail of chi-square with integer ``dof`` (closed form)."""
    if x is None or dof is None or dof < 1 or (isinstance(x, float) and math.isnan(x)):
        return float("nan")
    if x <= 0:
        return 1.0
    h = x / 2.0
    if math.isinf(h):
        return 0.0
    # e^-h * sum of h^a / Gamma(a + 1), a = 0, 1, .. (even dof) or 1/2, 3/2, .. (odd);
    # every term in logs, so neither the powers nor the exponential leave the range
    half = 0.5 * (dof % 2)
    terms = (math.exp((i + half) * math.log(h) - math.lgamma(i + half + 1.0) - h) for i in range(dof // 2))
    return min(1.0, math.fsum(terms) + (math.erfc(math.sqrt(h)) if dof % 2 else 0.0))


@F.pandas_udf(T.DoubleType())
def chi2_sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if (pd.isna(s) or pd.isna(k)) else chi2_sf_scalar(float(s), int(k))
            for s, k in zip(stat, dof)
        ],
        dtype="float64",
    )


def ks_exact_scalar(d: float, m: int, n: int) -> float:
    """P(D >= d) of two samples without ties from one distribution. All orders of the m + n
    values are equally likely, so the order is a walk from (0, 0) to (m, n) that at (i, j) takes
    a step in i with the share of i-steps left; the walk's chance of ever reaching
    |i n - j m| >= d m n is carried along one anti-diagonal at a time."""
    if d is None or math.isnan(d) or m < 1 or n < 1:
        return float("nan")
    reach = round(d * m * n)
    if reach <= 0:
        return 1.0
    i = np.arange(m + 1, dtype=np.int64)
    inside, out = np.zeros(m + 1), 0.0
    inside[0] = 1.0
    for k in range(m + n):
        j = k - i
        right = inside * np.where(i < m, m - i, 0) / (m + n - k)
        up = inside * np.clip(n - j, 0, None) / (m + n - k)
        inside = up
        inside[1:] += right[:-1]
        crossed = np.abs(i * n - (k + 1 - i) * m) >= reach
        out += inside[crossed].sum()
        inside[crossed] = 0.0
    return min(1.0, float(out))


@F.pandas_udf(T.DoubleType())
def ks_exact(stat: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(d) else ks_exact_scalar(float(d), int(a), int(b)) for d, a, b in zip(stat, m, n)], dtype="float64")
