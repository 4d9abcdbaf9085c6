"""Dataset contract (C1-C7) and the projections / casts around it.

The structural part of a contract is schema metadata (a handful of rows per
table); everything that looks at values -- descriptive statistics, record checks,
scoring validity -- is a distributed aggregation or a per-row expression.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwatch.functions.core import canonical_dtype, feature_columns, is_numeric_type, nan_div

# Record limits, batch bounds, version patterns.
MAX_FEATURES = 100
MAX_FEATURE_NAME = 256
MIN_BATCH = 1
MAX_BATCH = 1000
VERSION_PATTERN = r"^v\d{8}_\d{6}_[a-f0-9]{6}\z"
FLOAT32_MAX = 3.4028234663852886e38

STRUCTURAL_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("position", T.IntegerType(), False),
    T.StructField("dtype", T.StringType(), False),
])


# ------------------------------------------------------------------- C1 / C2
def structural_rows(df: DataFrame, target: str | None = None) -> list[dict]:
    """C1 as plain rows (schema metadata): ordered name / position / dtype."""
    feats = feature_columns(df, target)
    return [{"name": c, "position": i, "dtype": canonical_dtype(df.schema[c].dataType)} for i, c in enumerate(feats)]


def structural_schema(df: DataFrame, target: str | None = None) -> DataFrame:
    """``name, position, dtype`` with the target excluded before numbering."""
    spark: SparkSession = df.sparkSession
    return spark.createDataFrame(structural_rows(df, target), STRUCTURAL_SCHEMA)


def schema_json(rows: Sequence[dict]) -> str:
    """Canonical JSON of the structural schema (keys sorted, default separators)."""
    return json.dumps([{"name": r["name"], "position": r["position"], "dtype": r["dtype"]} for r in rows],
                      sort_keys=True)


def schema_hash(df: DataFrame, target: str | None = None) -> str:
    """First 32 hex chars of sha256 of the canonical JSON; statistics never
    enter the hash."""
    return hashlib.sha256(schema_json(structural_rows(df, target)).encode()).hexdigest()[:32]


def schema_hash_column(df: DataFrame, target: str | None = None) -> Column:
    """C2 as a Spark column (``sha2`` on the canonical JSON literal)."""
    return F.substring(F.sha2(F.lit(schema_json(structural_rows(df, target))), 256), 1, 32)


# ------------------------------------------------------------------------- C3
def describe_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    """``name, position, dtype, type, num_unique, num_missing, missing_rate,
    min, max, mean, std`` (numeric stats NULL for categorical columns).

    Distinct counts come from ``groupBy(feature, value)`` then ``groupBy(feature)``,
    one shuffle with map-side partial aggregation, instead of one distinct
    aggregate per column.
    """
    feats = feature_columns(df, target)
    num = [c for c in feats if is_numeric_type(df.schema[c].dataType)]
    cat = [c for c in feats if c not in num]
    parts = []
    if num:
        ln = df.select(*[F.col(c).cast("double").alias(c) for c in num]).unpivot([], num, "name", "v")
        ln = ln.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
        stats = ln.groupBy("name").agg(
            F.count(F.lit(1)).alias("_rows"), F.count("v").alias("_n"),
            F.min("v").alias("min"), F.max("v").alias("max"),
            F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        )
        # distinct values on the native type: doubles merge integers above 2**53
        exact = [c for c in num if df.schema[c].dataType.typeName() not in ("double", "float")]
        lossy = [c for c in num if c not in exact]
        values = []
        if lossy:
            values.append(ln.where(F.col("name").isin(lossy)).select("name", (F.col("v") + 0.0).cast("string").alias("v")))
        if exact:
            values.append(df.select(*[F.col(c).cast("string").alias(c) for c in exact]).unpivot([], exact, "name", "v"))
        every = values[0] if len(values) == 1 else values[0].unionByName(values[1])
        uniq = every.where(F.col("v").isNotNull()).groupBy("name", "v").agg(F.lit(1).alias("_x")).groupBy("name").agg(
            F.count(F.lit(1)).alias("num_unique"))
        parts.append(stats.join(uniq, "name", "left").withColumn("type", F.lit("numeric")))
    if cat:
        lc = df.select(*[F.col(c).cast("string").alias(c) for c in cat]).unpivot([], cat, "name", "v")
        stats = lc.groupBy("name").agg(F.count(F.lit(1)).alias("_rows"), F.count("v").alias("_n"))
        uniq = lc.where(F.col("v").isNotNull()).groupBy("name", "v").agg(F.lit(1).alias("_x")).groupBy("name").agg(
            F.count(F.lit(1)).alias("num_unique"))
        nulls = [F.lit(None).cast("double").alias(c) for c in ("min", "max", "mean", "std")]
        parts.append(stats.join(uniq, "name", "left").select("name", "_rows", "_n", *nulls, "num_unique")
                     .withColumn("type", F.lit("categorical")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    meta = structural_schema(df, target)
    # meta has one row per column: broadcast bounded by the schema width
    return out.join(F.broadcast(meta), "name").select(
        "name", "position", "dtype", "type",
        F.coalesce(F.col("num_unique"), F.lit(0)).cast("long").alias("num_unique"),
        (F.col("_rows") - F.col("_n")).cast("long").alias("num_missing"),
        nan_div((F.col("_rows") - F.col("_n")).cast("double"), F.col("_rows").cast("double")).alias("missing_rate"),
        "min", "max", "mean", "std",
    )


# ------------------------------------------------------------------------- C4
def validate_contract(df: DataFrame, contract: DataFrame, target: str | None = None,
                      n_features: int | None = None, check_names: bool = True,
                      check_dtypes: bool = True) -> DataFrame:
    """C4: ``error_type, column, expected, actual`` -- all three error kinds are
    collected independently; an empty result means compatible.

    ``contract`` is a C1 table.  Kinds: ``feature_count``, ``feature_names``
    (names or order differ), ``dtype`` (per contract column present in ``df``).
    """
    spark = df.sparkSession
    actual = structural_schema(df, target)
    act_all = spark.createDataFrame(
        [{"name": c, "dtype": canonical_dtype(df.schema[c].dataType)} for c in df.columns],
        "name string, dtype string")
    errs = []
    n_act = actual.agg(F.count(F.lit(1)).alias("n"))
    if n_features is not None:
        errs.append(n_act.where(F.col("n") != n_features).select(
            F.lit("feature_count").alias("error_type"), F.lit(None).cast("string").alias("column"),
            F.lit(str(n_features)).alias("expected"), F.col("n").cast("string").alias("actual")))
    if check_names:
        # both schemas in one aggregation (rows bounded by the schema width)
        both = actual.select(F.lit("a").alias("_s"), "position", "name").unionByName(
            contract.select(F.lit("e").alias("_s"), "position", "name"))
        names = both.agg(
            F.sort_array(F.collect_list(F.when(F.col("_s") == "a", F.struct("position", "name")))).alias("a"),
            F.sort_array(F.collect_list(F.when(F.col("_s") == "e", F.struct("position", "name")))).alias("e"),
        ).select(F.transform("a", lambda x: x["name"]).alias("a"), F.transform("e", lambda x: x["name"]).alias("e"))
        errs.append(names.where(F.col("a") != F.col("e")).select(
            F.lit("feature_names").alias("error_type"), F.lit(None).cast("string").alias("column"),
            F.array_join("e", ",").alias("expected"), F.array_join("a", ",").alias("actual")))
    if check_dtypes:
        j = contract.select("name", F.col("dtype").alias("_exp")).join(act_all, "name")
        errs.append(j.where(F.col("_exp") != F.col("dtype")).select(
            F.lit("dtype").alias("error_type"), F.col("name").alias("column"),
            F.col("_exp").alias("expected"), F.col("dtype").alias("actual")))
    out = errs[0]
    for e in errs[1:]:
        out = out.unionByName(e)
    return out


# ------------------------------------------------------------------------- C5
def check_records(df: DataFrame, features_col: str = "features") -> DataFrame:
    """Adds ``n_features`` and ``error`` (first failing rule or NULL).

    ``features_col`` is a map (or JSON-parsed map) of feature name to value."""
    keys = F.map_keys(F.col(features_col))
    n = F.size(F.col(features_col))
    err = (
        F.when(F.col(features_col).isNull() | (n == 0), F.lit("empty_features"))
        .when(n > MAX_FEATURES, F.lit("too_many_features"))
        .when(F.exists(keys, lambda k: F.length(k) > MAX_FEATURE_NAME), F.lit("feature_name_too_long"))
    )
    return df.withColumn("n_features", F.coalesce(n, F.lit(0)).cast("int")).withColumn("error", err)


# ------------------------------------------------------------------------- C6
def check_batches(df: DataFrame, batch_col: str) -> DataFrame:
    """``batch, n_instances, status`` with bounds 1..1000 per batch."""
    c = df.groupBy(F.col(batch_col).alias("batch")).agg(F.count(F.lit(1)).alias("n_instances"))
    return c.withColumn(
        "status",
        F.when(F.col("n_instances") < MIN_BATCH, F.lit("empty"))
        .when(F.col("n_instances") > MAX_BATCH, F.lit("too_large")).otherwise(F.lit("ok")),
    )


def check_batch_arrays(df: DataFrame, instances_col: str) -> DataFrame:
    """C6 on whole requests, one row with its array of instances: adds ``n_instances``
    and ``status``; a null or empty array is ``empty``."""
    n = F.coalesce(F.size(instances_col), F.lit(0))
    n = F.when(F.col(instances_col).isNull(), F.lit(0)).otherwise(n).cast("long")
    return df.withColumn("n_instances", n).withColumn(
        "status", F.when(n < MIN_BATCH, F.lit("empty")).when(n > MAX_BATCH, F.lit("too_large")).otherwise(F.lit("ok")))


def conforming_records(df: DataFrame, contract: DataFrame) -> DataFrame:
    """C4 on the data: ``name, dtype, n_records, n_conforming`` per contract column:
    records that hold a value castable to the contract's type (0 if there is no such
    column). One pass over ``df``; ``contract`` is a C1 table of schema size."""
    casts = {"int64": "bigint", "float64": "double", "bool": "boolean", "datetime64[ns]": "timestamp"}
    want = [(r["name"], r["dtype"]) for r in contract.collect()]
    have = {c.lower(): c for c in df.columns}

    def conforming(name, dtype):
        if name.lower() not in have:
            return F.lit(0).cast("long")
        value = F.col(have[name.lower()]).cast("string")
        return F.count(value.try_cast(casts[dtype]) if dtype in casts else value)

    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[conforming(n, t).alias(n) for n, t in want])
    long = wide.unpivot(["_n"], [n for n, _ in want], "name", "n_conforming")
    return long.join(F.broadcast(contract.select("name", "dtype")), "name").select("name", "dtype", F.col("_n").alias("n_records"), "n_conforming")


# ----------------------------------------------------------------- B1 / B4 / B5
def select_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """B1: features in contract order."""
    return df.select(*names)


def cast_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """float32 cast; adds ``_cast_failed`` (names that could not be cast)."""
    casted = [F.col(c).try_cast("float").alias(c) for c in names]
    failed = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull() & F.col(c).try_cast("float").isNull(), F.lit(c)) for c in names]))
    return df.select("*", failed.alias("_cast_failed")).select(
        *[c for c in df.columns if c not in names], *casted, "_cast_failed")


def non_finite(names: Sequence[str]) -> Column:
    """Names of columns that are NaN/inf (after the float32 cast)."""
    return F.array_compact(F.array(*[
        F.when(F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf"))), F.lit(c)) for c in names]))


def clip(c: Column, lo: Column, hi: Column) -> Column:
    """NumPy ``clip`` (min applied first, then max)."""
    return F.least(F.greatest(c, lo), hi)


def valid_version(c: Column, strict: bool = False) -> Column:
    """``v`` prefix, or the full ``vYYYYMMDD_HHMMSS_hex6`` pattern."""
    return c.rlike(VERSION_PATTERN) if strict else c.startswith("v")


def shared_features(df: DataFrame, profile_features: Sequence[str]) -> list[str]:
    """B6 (plan time): baseline features that exist in ``df``; the non-empty part
    is decided by the aggregates of each operator."""
    return [f for f in profile_features if f in df.columns]


# ------------------------------------------------------------------------- C7
def validate_for_scoring(df: DataFrame, features_col: str, names: Sequence[str], strict: bool = False) -> DataFrame:
    """Per record the first failure of contract -> cast -> finite. With ``strict``
    the features must also come in the contract's order, else the error is ``schema``
    and the record's own order is named.

    ``features_col`` is a ``map<string, string|double>``; adds ``error_type``
    (``schema`` / ``invalid_value`` / ``non_finite`` / NULL) and
    ``invalid_features``.
    """
    m = F.col(features_col)
    keys = F.array_sort(F.map_keys(m))
    expected = F.array_sort(F.array(*[F.lit(n) for n in names]))
    schema_bad = m.isNull() | (keys != expected)
    vals = {n: m.getItem(n) for n in names}
    cast_bad = F.array_compact(F.array(*[
        F.when(vals[n].isNotNull() & vals[n].cast("string").try_cast("float").isNull(), F.lit(n)) for n in names]))
    f32 = {n: vals[n].cast("string").try_cast("float") for n in names}
    finite_bad = F.array_compact(F.array(*[
        F.when(f32[n].isNull() | F.isnan(f32[n]) | (F.abs(f32[n]) == F.lit(float("inf"))), F.lit(n)) for n in names]))
    given = F.map_keys(m)
    misplaced = (given != F.array(*[F.lit(n) for n in names])) & ~schema_bad if strict else F.lit(False)
    err = (
        F.when(schema_bad | misplaced, F.lit("schema"))
        .when(F.size(cast_bad) > 0, F.lit("invalid_value"))
        .when(F.size(finite_bad) > 0, F.lit("non_finite"))
    )
    bad_list = (
        F.when(schema_bad, F.array_join(F.array_sort(F.array_except(F.array_union(F.coalesce(keys, F.array().cast("array<string>")), expected), F.coalesce(F.array_intersect(keys, expected), F.array().cast("array<string>")))), ","))
        .when(misplaced, F.array_join(given, ","))
        .when(F.size(cast_bad) > 0, F.array_join(cast_bad, ","))
        .when(F.size(finite_bad) > 0, F.array_join(finite_bad, ","))
    )
    return df.withColumn("error_type", err).withColumn("invalid_features", bad_list)


# ------------------------------------------------------------------ C7, batch
#: Column types of a batch, narrowest first: a column is as wide as its widest value.
TYPE_LATTICE = ("int64", "float64", "object")


def _value_type(v: Column) -> Column:
    """Place of a record's value in ``TYPE_LATTICE``; a missing one is a float."""
    text = F.trim(v.cast("string"))
    return (F.when(text.isNull() | (F.lower(text) == "nan"), F.lit(1)).when(text.rlike(r"^[+-]?[0-9]+$"), F.lit(0))
            .when(text.try_cast("double").isNotNull(), F.lit(1)).otherwise(F.lit(2)))


def validate_batches(df: DataFrame, group: str, features_col: str, contract: Sequence[tuple[str, str]], strict: bool = True,
                     type_errors: bool = True) -> DataFrame:
    """C7 for whole requests: records of one ``group`` are scored as one table, so what is
    wrong with one of them fails all. ``contract`` lists (name, dtype) in order. Adds
    ``batch_error`` (NULL if the group may be scored) and ``batch_features`` to every record:

    * ``schema``: the union of the group's keys differs from the contract (named: what no
      record has, and the first foreign key), or, with ``strict``, some record has the
      contract's keys in another ``order``;
    * ``dtype``, with ``type_errors``: a column's type, the widest of its values' (whole
      numbers < floats < text; a missing value makes a float), is wider than the contract's;
    * ``invalid_value`` / ``non_finite``: some value does not cast to a 32-bit float, or is
      missing, NaN or beyond its range.

    One aggregate per group (combined before the shuffle; a group holds any number of records)
    and a join of its one row back to the records, split by AQE where a group is hot."""
    names = [n for n, _ in contract]
    wide = {n: TYPE_LATTICE.index(t) if t in TYPE_LATTICE else 0 for n, t in contract}
    m = F.col(features_col)
    casts = {n: m.getItem(n).cast("string").try_cast("float") for n in names}
    aggs = [F.bool_or(m.isNull()).alias("_null")]
    for i, n in enumerate(names):
        v, f = m.getItem(n), casts[n]
        aggs += [
            F.max(_value_type(v)).alias(f"_t{i}"), F.bool_and(~F.coalesce(F.map_contains_key(m, n), F.lit(False))).alias(f"_absent{i}"),
            F.bool_or(v.isNotNull() & f.isNull()).alias(f"_cast{i}"), F.bool_or(f.isNull() | F.isnan(f) | (F.abs(f) == float("inf"))).alias(f"_finite{i}")]
    known = F.array(*[F.lit(n) for n in names])
    foreign = F.array_except(F.coalesce(F.map_keys(m), F.array().cast("array<string>")), known)
    # keys outside the contract: only whether there are any, and the first by name, so a group's row stays small
    aggs += [F.min(F.array_min(foreign)).alias("_foreign"), F.bool_or((F.size(foreign) == 0) & (F.map_keys(m) != known) & (F.size(F.map_keys(m)) == len(names))).alias("_order")]
    per = df.groupBy(group).agg(*aggs)

    def listed(flag: str, extra: Column | None = None) -> Column:
        found = [F.when(F.col(f"{flag}{i}"), F.lit(n)) for i, n in enumerate(names)]
        return F.array_join(F.array_compact(F.array(*found, *([extra] if extra is not None else []))), ",")

    typed = F.array_join(F.array_compact(F.array(*[
        F.when(F.col(f"_t{i}") > wide[n], F.concat(F.lit(f"{n}:"), F.element_at(F.array(*map(F.lit, TYPE_LATTICE)), F.col(f"_t{i}") + 1))) for i, n in enumerate(names)])), ",")
    schema = listed("_absent", F.col("_foreign"))
    error = F.when(F.col("_null") | (schema != ""), F.lit("schema"))
    detail = F.when(F.col("_null") | (schema != ""), schema)
    if strict:
        error, detail = error.when(F.col("_order"), F.lit("schema")), detail.when(F.col("_order"), F.lit("order"))
    if type_errors:
        error, detail = error.when(typed != "", F.lit("dtype")), detail.when(typed != "", typed)
    for flag, name in (("_cast", "invalid_value"), ("_finite", "non_finite")):
        error, detail = error.when(listed(flag) != "", F.lit(name)), detail.when(listed(flag) != "", listed(flag))
    told = per.select(F.col(group).alias("_group"), error.alias("batch_error"), detail.alias("batch_features"))
    return df.join(told, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
