"""Column-level helpers shared by every operator.

All of these build Catalyst expressions (no Python per row).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rounding applied to every float a registered query returns, so that
# Spark and DuckDB agree past last-ulp differences.
FLOAT_DIGITS = 6

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_to_null(c: str | Column) -> Column:
    """NaN is missing: fold it into SQL NULL before any aggregate."""
    c = col_of(c)
    return F.when(~F.isnan(c), c)


def is_missing(c: str | Column) -> Column:
    c = col_of(c)
    return c.isNull() | F.isnan(c)


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 (ANSI mode would raise)."""
    return F.try_divide(num, den)


def nan_div(num: Column, den: Column) -> Column:
    """num / den with NumPy semantics for a zero denominator: NaN."""
    return F.when(den == 0, F.lit(float("nan"))).otherwise(num / den)


def as_fixed(c: str | Column) -> Column:
    """A number as a decimal of six places (from its shortest form, as it is printed), NULL
    if out of range; sums of such do not depend on the order of the rows."""
    return col_of(c).try_cast("decimal(24,6)")


def r6(c: str | Column) -> Column:
    return F.round(col_of(c).cast("double"), FLOAT_DIGITS)


def round_floats(df: DataFrame, digits: int = FLOAT_DIGITS) -> DataFrame:
    """Round every float/double column of a result (final projection only)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def canonical_dtype(dt: T.DataType) -> str:
    """Canonical (pandas-style) dtype name used by the contract and its hash."""
    if isinstance(dt, INTEGRAL_TYPES):
        return "int64"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float64"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime64[ns]"
    return "object"


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in ex and is_numeric_type(f.dataType)]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if f.name not in ex and isinstance(f.dataType, (T.StringType, T.BooleanType))
    ]


def feature_columns(df: DataFrame, target: str | None = None) -> list[str]:
    """All columns except the target, in table order."""
    return [c for c in df.columns if c != target] if target else list(df.columns)


def to_long(df: DataFrame, features: list[str], ids: list[str] | None = None,
            value_type: str = "double", keep_missing: bool = False) -> DataFrame:
    """One scan, one row per (row, feature): ``ids..., feature, v``.

    NaN becomes NULL; unless ``keep_missing`` the missing values are dropped (the
    per-feature ``dropna`` of the reference).
    """
    ids = ids or []
    casted = df.select(*ids, *[F.col(c).cast(value_type).alias(c) for c in features])
    long = casted.unpivot(ids, features, "feature", "v")
    if value_type == "double":
        long = long.withColumn("v", missing_to_null("v"))
    if not keep_missing:
        long = long.where(F.col("v").isNotNull())
    return long


def to_long_ids(df: DataFrame, features: list[str], ids: list[str] | None = None,
                keep_missing: bool = False) -> DataFrame:
    """Like :func:`to_long` but the feature is a small int ``_fid`` (position in
    ``features``): shuffles keyed by feature carry 4 bytes instead of the name.
    Map back with :func:`feature_name`."""
    ids = ids or []
    pairs = ", ".join(f"{i}, CAST(`{c}` AS DOUBLE)" for i, c in enumerate(features))
    long = df.select(*ids, F.expr(f"stack({len(features)}, {pairs}) AS (_fid, v)"))
    long = long.withColumn("_fid", F.col("_fid").cast("int")).withColumn("v", missing_to_null("v"))
    if not keep_missing:
        long = long.where(F.col("v").isNotNull())
    return long


def feature_name(features: list[str], fid: str | Column = "_fid") -> Column:
    return F.element_at(F.array(*[F.lit(f) for f in features]), col_of(fid) + 1)


def ts_string(c: str | Column) -> Column:
    return F.date_format(col_of(c), "yyyy-MM-dd HH:mm:ss")


def join_small(df: DataFrame, small: DataFrame, keys: list[str] | tuple[str, ...] = (),
               how: str = "inner", broadcast: bool = True) -> DataFrame:
    """Attach a lookup table whose size is bounded by its keys.

    Callers only pass tables with one row per key where the key set is a schema
    property (features, class indexes, bins).  Without keys the table is a single
    row (a global aggregate) and is attached as a scalar subquery -- computed once,
    no join, never a cross join.
    """
    keys = list(keys)
    if keys:
        return df.join(F.broadcast(small) if broadcast else small, keys, how)
    row = small.select(F.struct(*[F.col(c) for c in small.columns]).alias("_row")).scalar()
    return df.select("*", *[row.getField(c).alias(c) for c in small.columns])
