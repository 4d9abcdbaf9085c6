"""Readers for the driver tables and CSV/JSON/parquet sinks.

All readers return lazy DataFrames; column pruning and filters reach the parquet
scan because nothing here forces a projection or an action.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ts_lit(s: str):
    """A timestamp literal of the driver tables' type (``timestamp_ntz``)."""
    return F.to_timestamp_ntz(F.lit(s))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A1: CSV with header; an explicit schema is preferred over inference."""
    r = spark.read.option("header", True)
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)


def split_target(df: DataFrame, target: str = "target") -> tuple[DataFrame, DataFrame]:
    """A2: features (all but ``target``, order kept) and the target column."""
    return df.drop(target), df.select(target)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A8."""
    df.write.mode(mode).option("header", True).csv(path)


def write_profile(df: DataFrame, path: str, partition_by: Sequence[str] = ("model_version",),
                  mode: str = "overwrite") -> None:
    """Persist a profile or metadata table partitioned by version, so a
    lookup by version prunes partitions."""
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def read_profile(spark: SparkSession, path: str, model_version: str | None = None) -> DataFrame:
    """Load a stored profile; the version filter is a partition filter."""
    df = spark.read.parquet(path)
    return df.where(F.col("model_version") == model_version) if model_version else df


def write_metadata(metadata: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested metadata, one document per version (the other columns as JSON text, nulls
    kept), so versions of different shape share a table; partitioned by version."""
    rest = [c for c in metadata.columns if c != "model_version"]
    document = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    write_profile(metadata.select("model_version", document.alias("document")), path, mode=mode)


def read_metadata(spark: SparkSession, path: str, model_version: str | None = None,
                  schema: T.StructType | None = None) -> DataFrame:
    """``model_version, meta``: the document as a VARIANT (``variant_get`` reads any part
    of it), or with ``schema`` as typed columns."""
    df = read_profile(spark, path, model_version)
    if schema is None:
        return df.select("model_version", F.parse_json("document").alias("meta"))
    return df.select("model_version", F.from_json("document", schema).alias("_m")).select("model_version", "_m.*")
