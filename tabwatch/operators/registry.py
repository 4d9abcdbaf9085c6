"""Registry analytics over an append-only promotion log.

``promotions``: ``environment, model_version, promoted_at, promotion_seq,
promoted_by, promotion_reason``.  ``models``: metadata rows.  ``artifacts``:
object listing ``path``.  Every per-environment ordering uses the distributed
helpers, so an environment holding most promotions is not one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.operators.contract import valid_version
from tabwatch.plans.ordered import forward_fill, ordered_lag, running_sum

# Artifact layout and history length.
MODEL_KEY = "models/{v}.onnx"
METADATA_KEY = "metadata/{v}.json"
BASELINE_KEY = "baselines/{v}_baseline.json"
HISTORY_LIMIT = 10
PROMOTION_ORDER = ("promoted_at", "promotion_seq")


def list_versions(models: DataFrame) -> DataFrame:
    """Distinct versions newest first (lexical desc = chronological):
    ``model_version, rank`` (rank 1 = latest)."""
    v = models.select("model_version").distinct()
    # rank by a descending running count: the order key is the version string
    # itself, range-bucketed, so the ranking is not a single-task window
    ranked = running_sum(v.withColumn("_one", F.lit(1)), [], ["model_version"], ["_one"])
    n = v.agg(F.count(F.lit(1)).alias("_n"))
    from tabwatch.functions.core import join_small
    return join_small(ranked, n).select("model_version", (F.col("_n") - F.col("_one_cum") + 1).alias("rank"))


def current_pointer(promotions: DataFrame) -> DataFrame:
    """The latest promotion per environment."""
    cols = [c for c in promotions.columns if c != "environment"]
    latest = promotions.groupBy("environment").agg(
        F.max_by(F.struct(*cols), F.struct(*PROMOTION_ORDER)).alias("_p"))
    return latest.select("environment", "_p.*")


def promotion_history(promotions: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Superseded pointers (the current one excluded), newest first,
    ``limit`` per environment, with ``rank``."""
    w = Window.partitionBy("environment").orderBy(*[F.col(c).desc() for c in PROMOTION_ORDER])
    # rn <= limit + 1 lets Spark cut each map partition to limit+1 rows per
    # environment before the shuffle (WindowGroupLimit)
    r = promotions.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit + 1)
    return r.where(F.col("_rn") >= 2).withColumn("rank", (F.col("_rn") - 1).cast("int")).drop("_rn")


def expected_paths(df: DataFrame, bucket: str | None = None) -> DataFrame:
    """The three artifact keys of each pointer: ``..., kind, path``."""
    prefix = f"s3://{bucket}/" if bucket else ""
    kinds = F.array(
        F.struct(F.lit("model").alias("kind"), F.concat(F.lit(prefix + "models/"), F.col("model_version"), F.lit(".onnx")).alias("path")),
        F.struct(F.lit("metadata").alias("kind"), F.concat(F.lit(prefix + "metadata/"), F.col("model_version"), F.lit(".json")).alias("path")),
        F.struct(F.lit("baseline").alias("kind"), F.concat(F.lit(prefix + "baselines/"), F.col("model_version"), F.lit("_baseline.json")).alias("path")),
    )
    return df.select("*", F.explode(kinds).alias("_k")).select(*df.columns, "_k.kind", "_k.path")


def pointer_check(pointers: DataFrame, artifacts: DataFrame, bucket: str | None = None) -> DataFrame:
    """I4: missing artifacts of each pointer: ``environment, model_version, kind,
    path`` (empty = complete).  With ``bucket`` the stored paths must carry the
    bucket's URI prefix; otherwise they are bare keys."""
    exp = expected_paths(pointers.select("environment", "model_version"), bucket)
    return exp.join(artifacts.select("path").distinct(), "path", "left_anti").select(
        "environment", "model_version", "kind", "path")


#: The paths that a pointer stores, in the order they are checked.
POINTER_PATHS = {"model": "model_path", "metadata": "metadata_path", "baseline": "baseline_path"}


def validate_pointers(pointers: DataFrame, artifacts: DataFrame, bucket: str) -> DataFrame:
    """I4 by what the pointers themselves store: every row with ``valid`` and, for the first
    path that fails, ``reason`` (``missing_key`` not stored, ``invalid_uri`` not in the bucket,
    ``missing_object`` not there) and ``failed_path``. ``artifacts.path`` are keys in the bucket;
    rows may repeat. Each stored path is looked up once, however many pointers share it."""
    prefix = f"s3://{bucket}/"
    key = lambda c: F.when(F.col(c).startswith(prefix), F.substring(F.col(c), F.lit(len(prefix) + 1), F.length(c)))
    wanted = pointers.select(F.explode(F.array(*[key(c) for c in POINTER_PATHS.values()])).alias("_key")).where("_key is not null").distinct()
    there = wanted.join(artifacts.select(F.col("path").alias("_key")), "_key", "left_semi")
    out = pointers
    for kind, c in POINTER_PATHS.items():
        hit = there.select(F.col("_key").alias(f"_{kind}"), F.lit(True).alias(f"_has_{kind}"))
        out = out.withColumn("_k", key(c)).join(hit, F.col("_k") == F.col(f"_{kind}"), "left").drop("_k", f"_{kind}")
    faults = [(F.when(F.col(c).isNull(), "missing_key").when(key(c).isNull(), "invalid_uri").when(F.col(f"_has_{kind}").isNull(), "missing_object"), F.col(c))
              for kind, c in POINTER_PATHS.items()]
    reason, path = F.coalesce(*[r for r, _ in faults]), None
    for r, c in faults:
        path = F.when(r.isNotNull(), c) if path is None else path.when(r.isNotNull(), c)
    return out.select(*pointers.columns, reason.isNull().alias("valid"), reason.alias("reason"), path.alias("failed_path"))


def artifact_flags(artifacts: DataFrame) -> DataFrame:
    """Per version which of the three artifacts exist (parsed from the keys)."""
    p = F.col("path")
    v = (F.when(p.startswith("models/") & p.endswith(".onnx"), F.regexp_extract(p, r"^models/(.*)\.onnx$", 1))
         .when(p.startswith("metadata/") & p.endswith(".json"), F.regexp_extract(p, r"^metadata/(.*)\.json$", 1))
         .when(p.startswith("baselines/") & p.endswith("_baseline.json"),
               F.regexp_extract(p, r"^baselines/(.*)_baseline\.json$", 1)))
    kind = (F.when(p.startswith("models/"), "model").when(p.startswith("metadata/"), "metadata")
            .when(p.startswith("baselines/"), "baseline"))
    return artifacts.select(v.alias("model_version"), kind.alias("kind")).where(F.col("model_version").isNotNull()).groupBy(
        "model_version").agg(*[F.max((F.col("kind") == k).cast("int")).cast("boolean").alias(f"has_{k}")
                               for k in ("model", "metadata", "baseline")])


def eligibility(candidates: DataFrame, models: DataFrame, artifacts: DataFrame) -> DataFrame:
    """First failing reason per candidate version (``eligible`` if none):
    format (``v`` prefix only), model, metadata, baseline, metadata fields."""
    flags = artifact_flags(artifacts)
    meta = models.groupBy("model_version").agg(
        F.max((F.col("has_schema") & F.col("has_metrics") & F.col("model_type").isNotNull()).cast("int")).alias("_complete"))
    j = candidates.select("model_version").distinct().join(flags, "model_version", "left").join(meta, "model_version", "left")
    reason = (F.when(~valid_version(F.col("model_version")), "invalid_format")
              .when(~F.coalesce(F.col("has_model"), F.lit(False)), "model_missing")
              .when(~F.coalesce(F.col("has_metadata"), F.lit(False)), "metadata_missing")
              .when(~F.coalesce(F.col("has_baseline"), F.lit(False)), "baseline_missing")
              .when(F.coalesce(F.col("_complete"), F.lit(0)) == 0, "metadata_incomplete")
              .otherwise("eligible"))
    return j.select("model_version", reason.alias("reason"))


def rollback_target(promotions: DataFrame) -> DataFrame:
    """``previous_version`` of every promotion in its environment (NULL =
    no rollback possible); the current pointer's value is the rollback target."""
    return ordered_lag(promotions, ["environment"], list(PROMOTION_ORDER), ["model_version"],
                       prefix="previous_").withColumnRenamed("previous_model_version", "previous_version")


def model_info(pointers: DataFrame, models: DataFrame) -> DataFrame:
    """Pointer left-joined with its metadata. The models are first cut to those a
    pointer names, so only a handful of them meets the join."""
    named = models.join(pointers.select("model_version").distinct(), "model_version", "left_semi")
    return pointers.join(named, "model_version", "left")


def version_in_force(log: DataFrame, promotions: DataFrame, ts: str = "ts",
                     keys: Sequence[str] = ()) -> DataFrame:
    """I8: as-of join -- the version promoted last at or before each log row.
    A promotion at the same instant applies to that row."""
    keys = list(keys)
    # the log row rides along as a struct, so no row id is needed to join back
    # (ids from monotonically_increasing_id are not stable under task retries)
    row = F.struct(*[F.col(c) for c in log.columns])
    p = promotions.select(*keys, F.col("promoted_at").cast("timestamp").alias("_t"), F.lit(0).alias("_kind"),
                          F.col("promotion_seq").cast("long").alias("_seq"), F.col("model_version").alias("_v"),
                          F.lit(None).cast(log.select(row.alias("r")).schema["r"].dataType).alias("_r"),
                          F.lit(None).cast("long").alias("_h"))
    lg = log.select(*keys, F.col(ts).cast("timestamp").alias("_t"), F.lit(1).alias("_kind"),
                    F.lit(None).cast("long").alias("_seq"), F.lit(None).cast("string").alias("_v"), row.alias("_r"),
                    F.xxhash64(row).alias("_h"))
    u = p.unionByName(lg)
    # log rows sharing a timestamp are split by their hash; promotions at that
    # instant sort first (-inf), so the order (_t, _kind, _seq, _h) is kept
    tie = F.when(F.col("_kind") == 0, F.lit(float("-inf"))).otherwise(F.col("_h").cast("double"))
    filled = forward_fill(u, keys, ["_t", "_kind", "_seq", "_h"], "_v", "version_in_force", tie_value=tie)
    return filled.where(F.col("_kind") == 1).select("_r.*", "version_in_force")
