"""Order-dependent operators that stay distributed.

A window ``PARTITION BY feature ORDER BY v`` puts a whole feature (or a whole
environment, or the whole log) into one task.  Every order-dependent operator in
the library goes through the helpers below instead:

1. range-bucket the order column per key: cells of fixed width with exact counts,
   equalised into buckets by cumulative count; a cell with more than a bucket's
   share is split over its own range, one hot value by the next order column;
2. aggregate a tiny ``(key, bucket)`` table and prefix-sum it;
3. run the real window per ``(key, bucket)`` and add the carried-in offset.

Every number used for bucketing is an exact, order-independent aggregate, so a
recomputed task or a second plan branch buckets every row identically; buckets
only steer balance, results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwatch.functions.core import join_small

_B = "_bucket"


def default_buckets(df: DataFrame) -> int:
    try:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover
        n = 200
    return max(16, 2 * n)


def _order_value(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(F.col(c)).cast("double")
    if isinstance(dt, T.StringType):
        return _text_value(F.hex(F.col(c)), F.lit(0))
    return F.col(c).cast("double")


def _text_value(hexed: Column, skip: Column) -> Column:
    """Six UTF-8 bytes after the first ``skip`` hex digits as a big-endian number:
    monotone in Spark's binary string order among texts that share those digits."""
    return F.conv(F.rpad(F.substr(hexed, skip + 1, F.lit(12)), 12, "0"), 16, 10).cast("double")


def _shared_digits(a: Column, b: Column) -> Column:
    """How many leading hex digits two texts share."""
    return F.length(F.regexp_extract(F.concat(a, F.lit("x"), b), "^([0-9A-F]*)[0-9A-F]*x\\1", 1))


def _small(df: DataFrame, small_keys: bool) -> DataFrame:
    """Per-(key, cell) side tables are bounded per key (see :func:`range_bucket`).
    With schema-bounded keys (features, environments, one global key) they are
    broadcast; a shuffle join would move the big side for a few MB.  Callers with
    high-cardinality keys pass ``small_keys=False`` (the key itself then spreads
    the rows)."""
    return F.broadcast(df) if small_keys else df


def _attach(df: DataFrame, small: DataFrame, keys: Sequence[str], small_keys: bool) -> DataFrame:
    """Join a per-key side table; without keys it is one row, attached as a
    scalar subquery (no cross join)."""
    if keys:
        return df.join(_small(small, small_keys), list(keys), "inner")
    return join_small(df, small, [])


def _win(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy()


def count_below(sorted_arr: Column, v: Column, m: int, inclusive: bool = False) -> Column:
    """Number of elements of a sorted array of length ``m`` that are ``< v``
    (``<= v`` when ``inclusive``), as a balanced CASE tree of depth log2(m):
    whole-stage codegen friendly, unlike a ``filter`` lambda over the array."""

    def below(i: int) -> Column:  # 1-based element i satisfies the predicate
        e = F.element_at(sorted_arr, i)
        return e <= v if inclusive else e < v

    def search(lo: int, hi: int) -> Column:  # answer in [lo, hi]
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(below(mid), search(mid, hi)).otherwise(search(lo, mid - 1))

    return search(0, m)


# Grid sizes, the same at every number of shuffle partitions.
MAX_BUCKETS, SUB_GRID, SUB_BUCKETS = 512, 8192, 64
CELLS_PER_LOG, CELL_HOURS = 256, 1
_INFINITE = 1 << 20  # beyond the cell of every finite number


def _is_time(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def _is_text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def _grid_value(df: DataFrame, c: str) -> Column:
    """Monotone numeric image of a number or time: signed log for plain numbers
    (heavy tails still spread), linear for times."""
    v = _order_value(df, c)
    return v if _is_time(df, c) else F.signum(v) * F.log1p(F.abs(v))


def _cell(df: DataFrame, c: str) -> Column:
    """First-level cell of an order value: fixed widths, so no range is needed first.
    NULL sorts before all; infinities and NaN have cells of their own, and the
    finite numbers keep theirs whatever else the column holds."""
    v = _order_value(df, c)
    if _is_text(df, c):
        cell = F.floor(v / float(1 << 24)).cast("long")  # three bytes
    elif isinstance(df.schema[c].dataType, T.DateType):
        cell = v.cast("long")
    elif _is_time(df, c):
        cell = F.floor(v / (3.6e9 * CELL_HOURS)).cast("long")
    else:
        far = F.isnan(v) | (F.abs(v) == float("inf"))
        cell = F.when(far, F.when(v < 0, -_INFINITE).when(F.isnan(v), _INFINITE + 1).otherwise(_INFINITE).cast("long")).otherwise(
            F.floor(_grid_value(df, c) * CELLS_PER_LOG).cast("long"))
    return F.coalesce(cell, F.lit(-(1 << 62)))


def range_bucket(df: DataFrame, keys: Sequence[str], order_col: str | Sequence[str],
                 n_buckets: int | None = None, small_keys: bool = True,
                 tie_value: Column | None = None) -> DataFrame:
    """Add ``_bucket``: a bucket id within ``keys`` that is monotone in the order
    ``order_col`` (one column or a list; the first one is gridded).

    Level 1: cells of fixed width (a share of the value's logarithm, an hour, a day,
    three bytes), equalised into at most ``MAX_BUCKETS`` buckets by cumulative exact
    counts.  Level 2: a cell holding more than a bucket's share gets a grid of
    ``SUB_GRID`` over its own exact range (for texts: over the bytes after those that
    all its texts share), equalised into ``SUB_BUCKETS``; a sub-cell that is a single
    hot value is spread over its share of them by the second order column (or
    ``tie_value``, a number monotone in the remaining order).  So a timestamp or a
    prefix carrying a third of the rows is spread over several tasks.

    Side tables per key: one row per occupied first-level cell (values over ten
    orders of magnitude occupy at most some 6000, a year of hours 8760) and at most
    ``MAX_BUCKETS * (SUB_GRID + 1)`` rows of heavy cells, at any number of rows and
    partitions.  With ``small_keys`` (schema-bounded keys) they are broadcast.
    """
    cols = [order_col] if isinstance(order_col, str) else list(order_col)
    c, text = cols[0], _is_text(df, cols[0])
    n = min(n_buckets or default_buckets(df), MAX_BUCKETS)
    sub_n = SUB_BUCKETS
    if tie_value is None and len(cols) > 1:
        tie_value = _order_value(df, cols[1])
    d = df.withColumn("_rb_gv", F.hex(c) if text else _grid_value(df, c)).withColumn("_rb_cell", _cell(df, c)).withColumn(
        "_rb_tv", tie_value if tie_value is not None else F.lit(None).cast("double"))
    cells = d.groupBy(*keys, "_rb_cell").agg(F.count(F.lit(1)).alias("_rb_n"), F.min("_rb_gv").alias("_rb_cmin"),
                                             F.max("_rb_gv").alias("_rb_cmax"))
    before = _win(keys).orderBy("_rb_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_rb_before", F.coalesce(F.sum("_rb_n").over(before), F.lit(0))).withColumn(
        "_rb_total", F.sum("_rb_n").over(_win(keys)))
    share = F.col("_rb_n").cast("double") * n > F.col("_rb_total")
    cells = cells.withColumn("_rb_cb", F.floor(F.col("_rb_before").cast("double") * n / F.col("_rb_total")).cast("long")).withColumn(
        "_rb_heavy", share & (F.coalesce(F.col("_rb_cmax") > F.col("_rb_cmin"), F.lit(False)) | F.lit(tie_value is not None)))
    if text:
        skip = _shared_digits(F.col("_rb_cmin"), F.col("_rb_cmax"))
        cells = cells.withColumn("_rb_skip", F.when(F.col("_rb_heavy"), skip)).withColumn(
            "_rb_cmin", _text_value(F.col("_rb_cmin"), F.col("_rb_skip"))).withColumn("_rb_cmax", _text_value(F.col("_rb_cmax"), F.col("_rb_skip")))
    else:
        cells = cells.withColumn("_rb_skip", F.lit(None).cast("int"))
    d = d.join(_small(cells.select(*keys, "_rb_cell", "_rb_cb", "_rb_heavy", "_rb_cmin", "_rb_cmax", "_rb_skip", F.col("_rb_n").alias("_rb_hn")),
                      small_keys), [*keys, "_rb_cell"], "inner")
    # level 2, heavy cells only
    v2 = _text_value(F.col("_rb_gv"), F.col("_rb_skip")) if text else F.col("_rb_gv")
    d = d.withColumn("_rb_v2", F.when(F.col("_rb_heavy"), v2))
    width = F.col("_rb_cmax") - F.col("_rb_cmin")
    d = d.withColumn("_rb_cell2", F.when(F.col("_rb_heavy"), F.when(F.col("_rb_v2").isNull() | (F.col("_rb_cmax") == F.col("_rb_cmin")), F.lit(0)).otherwise(
        F.least(F.floor((F.col("_rb_v2") - F.col("_rb_cmin")) / width * SUB_GRID).cast("int"), F.lit(SUB_GRID - 1)))))
    c2 = d.where(F.col("_rb_heavy")).groupBy(*keys, "_rb_cell", "_rb_cell2").agg(
        F.count(F.lit(1)).alias("_rb_n2"), F.min(c).alias("_rb_vmin"), F.max(c).alias("_rb_vmax"),
        F.min("_rb_tv").alias("_rb_tmin"), F.max("_rb_tv").alias("_rb_tmax"), F.first("_rb_hn").alias("_rb_hn"))
    b2 = Window.partitionBy(*keys, "_rb_cell").orderBy("_rb_cell2").rowsBetween(Window.unboundedPreceding, -1)
    c2 = c2.withColumn("_rb_b2", F.coalesce(F.sum("_rb_n2").over(b2), F.lit(0)))
    c2 = c2.withColumn("_rb_s0", F.floor(F.col("_rb_b2").cast("double") * sub_n / F.col("_rb_hn")).cast("long")).withColumn(
        "_rb_s1", F.floor((F.col("_rb_b2") + F.col("_rb_n2")).cast("double") * sub_n / F.col("_rb_hn")).cast("long"))
    finite = (F.abs("_rb_tmin") < float("inf")) & (F.abs("_rb_tmax") < float("inf"))
    c2 = c2.withColumn("_rb_hot", F.col("_rb_vmin").eqNullSafe(F.col("_rb_vmax")) & (F.col("_rb_tmax") > F.col("_rb_tmin")) & finite
                       & (F.col("_rb_s1") - F.col("_rb_s0") >= 2))
    d = d.join(_small(c2.select(*keys, "_rb_cell", "_rb_cell2", "_rb_s0", "_rb_s1", "_rb_hot", "_rb_tmin", "_rb_tmax"), small_keys),
               [*keys, "_rb_cell", "_rb_cell2"], "left")
    span = F.col("_rb_s1") - F.col("_rb_s0")
    spread = F.least(F.floor((F.col("_rb_tv") - F.col("_rb_tmin")) / (F.col("_rb_tmax") - F.col("_rb_tmin")) * span).cast("long"),
                     span - 1)
    sub = (F.when(~F.col("_rb_heavy"), F.lit(0))
           .when(F.col("_rb_hot") & F.col("_rb_tv").isNotNull(), F.col("_rb_s0") + spread)
           .otherwise(F.col("_rb_s0")))
    return d.withColumn(_B, F.col("_rb_cb") * sub_n + F.least(F.coalesce(sub, F.lit(0)), F.lit(sub_n - 1))).drop(
        "_rb_gv", "_rb_v2", "_rb_skip", "_rb_tv", "_rb_cell", "_rb_cb", "_rb_heavy", "_rb_cmin", "_rb_cmax", "_rb_hn", "_rb_cell2",
        "_rb_s0", "_rb_s1", "_rb_hot", "_rb_tmin", "_rb_tmax")


def running_sum(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                sum_cols: Sequence[str], n_buckets: int | None = None,
                suffix: str = "_cum", small_keys: bool = True) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` per key in ``order_cols`` order.

    ``order_cols`` must order rows totally within a key (add a tie-breaker).
    """
    keys = list(keys)
    b = range_bucket(df, keys, order_cols, n_buckets, small_keys)
    tot = b.groupBy(*keys, _B).agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    prev = _win(keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(
        *keys, _B, *[F.coalesce(F.sum(f"_t_{c}").over(prev), F.lit(0)).alias(f"_o_{c}") for c in sum_cols]
    )
    inner = Window.partitionBy(*keys, _B).orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = b.join(_small(off, small_keys), [*keys, _B], "inner")
    for c in sum_cols:
        out = out.withColumn(f"{c}{suffix}", F.col(f"_o_{c}") + F.sum(c).over(inner))
    out = out.drop(_B, *[f"_o_{c}" for c in sum_cols])
    return out


def ordered_lag(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                value_cols: Sequence[str], n_buckets: int | None = None,
                prefix: str = "prev_", small_keys: bool = True) -> DataFrame:
    """``lag(value, 1) OVER (PARTITION BY keys ORDER BY order_cols)`` without
    sending a whole key to one task."""
    keys = list(keys)
    b = range_bucket(df, keys, order_cols, n_buckets, small_keys)
    inner = Window.partitionBy(*keys, _B).orderBy(*order_cols)
    order_struct = F.struct(*[F.col(c) for c in order_cols])
    last_in_bucket = b.groupBy(*keys, _B).agg(
        F.max_by(F.struct(*[F.col(c) for c in value_cols]), order_struct).alias("_last")
    )
    bw = _win(keys).orderBy(_B)
    carry = last_in_bucket.select(*keys, _B, F.lag("_last", 1).over(bw).alias("_carry"))
    out = b.join(_small(carry, small_keys), [*keys, _B], "inner").withColumn("_rn", F.row_number().over(inner))
    for c in value_cols:
        out = out.withColumn(
            f"{prefix}{c}",
            F.when(F.col("_rn") == 1, F.col(f"_carry.{c}")).otherwise(F.lag(c, 1).over(inner)),
        )
    out = out.drop(_B, "_carry", "_rn")
    return out


def forward_fill(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                 value_col: str, out_col: str, n_buckets: int | None = None,
                 small_keys: bool = True, tie_value: Column | None = None) -> DataFrame:
    """``last(value, ignoreNulls) OVER (PARTITION BY keys ORDER BY order_cols
    ROWS UNBOUNDED PRECEDING)`` as a distributed plan (as-of lookups)."""
    keys = list(keys)
    b = range_bucket(df, keys, order_cols, n_buckets, small_keys, tie_value)
    order_struct = F.struct(*[F.col(c) for c in order_cols])
    last_nn = b.where(F.col(value_col).isNotNull()).groupBy(*keys, _B).agg(
        F.max_by(F.col(value_col), order_struct).alias("_last")
    )
    # every bucket (also those without a non-null value) carries the last value of
    # the nearest earlier bucket that has one; the table is (#keys x #buckets)
    buckets = b.select(*keys, _B).distinct().join(last_nn, [*keys, _B], "left")
    bw = _win(keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    allb = buckets.select(*keys, _B, F.last("_last", ignorenulls=True).over(bw).alias("_carry"))
    inner = Window.partitionBy(*keys, _B).orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = b.join(_small(allb, small_keys), [*keys, _B], "inner").withColumn(
        out_col, F.coalesce(F.last(value_col, ignorenulls=True).over(inner), F.col("_carry"))
    )
    out = out.drop(_B, "_carry")
    return out


def exact_quantiles(long_df: DataFrame, keys: Sequence[str], value_col: str,
                    probs: Sequence[float], n_buckets: int | None = None,
                    small_keys: bool = True) -> DataFrame:
    """Exact linear-interpolation quantiles (NumPy / pandas default) per key.

    Returns ``keys..., q, value`` with one row per (key, prob).  Works on the
    distinct values with their multiplicities, so a value repeated a billion times
    is one row, and the ordered pass is range-bucketed.  The target ranks
    (2 x #probs per key) travel as a small array; each distinct value keeps the
    ranks it covers -- no range join.
    """
    keys = list(keys)
    cnt = long_df.groupBy(*keys, value_col).agg(F.count(F.lit(1)).alias("_c"))
    return quantiles_of_counts(cnt, keys, value_col, probs, n_buckets, small_keys)


def quantiles_of_counts(cnt: DataFrame, keys: Sequence[str], value_col: str, probs: Sequence[float],
                        n_buckets: int | None = None, small_keys: bool = True) -> DataFrame:
    """:func:`exact_quantiles` from distinct values and their counts ``_c``."""
    keys = list(keys)
    cum = running_sum(cnt, keys, [value_col], ["_c"], n_buckets, small_keys=small_keys)
    tot = cnt.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    qs = F.array(*[F.lit(float(p)) for p in probs])
    targets = (
        tot.select(*keys, "_n", F.explode(qs).alias("q"))
        .withColumn("_pos", F.col("q") * (F.col("_n") - 1))
        .withColumn("_lo", F.floor("_pos"))
        .withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n") - 1))
        .withColumn("_frac", F.col("_pos") - F.col("_lo"))
    )
    ranks = targets.select(
        *keys,
        F.array(
            F.struct(F.col("q"), F.col("_frac"), F.lit(0).alias("which"), F.col("_lo").alias("r")),
            F.struct(F.col("q"), F.col("_frac"), F.lit(1).alias("which"), F.col("_hi").alias("r")),
        ).alias("_t"),
    ).groupBy(*keys).agg(F.flatten(F.collect_list("_t")).alias("_ranks"))  # 2 x #probs per key
    hit = _attach(cum, ranks, keys, small_keys).select(
        *keys, F.col(value_col).alias("_v"),
        F.explode(F.filter("_ranks", lambda t: ((F.col("_c_cum") - F.col("_c")) <= t["r"]) & (t["r"] < F.col("_c_cum"))))
        .alias("_t"),
    ).select(*keys, "_v", "_t.q", "_t._frac", "_t.which")
    return hit.groupBy(*keys, "q", "_frac").agg(
        F.max(F.when(F.col("which") == 0, F.col("_v"))).alias("_vlo"),
        F.max(F.when(F.col("which") == 1, F.col("_v"))).alias("_vhi"),
    ).select(
        *keys, "q",
        F.when(F.col("_frac") == 0, F.col("_vlo"))
        .otherwise(F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac"))
        .alias("value"),
    )


def quantile_columns(long_df: DataFrame, keys: Sequence[str], value_col: str,
                     probs: dict[str, float], n_buckets: int | None = None) -> DataFrame:
    """Wide form of :func:`exact_quantiles`: one column per named prob."""
    q = exact_quantiles(long_df, keys, value_col, list(probs.values()), n_buckets)
    aggs = [F.max(F.when(F.col("q") == float(p), F.col("value"))).alias(name) for name, p in probs.items()]
    if keys:
        return q.groupBy(*keys).agg(*aggs)
    return q.agg(*aggs)
