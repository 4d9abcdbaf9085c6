"""Session helpers.

The library never creates its own cluster settings beyond what a job needs to be
correct (UTC session time, AQE on).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "tabwatch") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TABWATCH_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings every operator relies on (idempotent)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, from ``spark.checkpoint.dir``.

    Where it is unset, a scratch folder is made for a local master, whose driver and
    executors are one process; on a cluster that would not be shared, so there it is
    an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tabwatch-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


#: Folders written since the outermost open ``scratch`` began, innermost last.
_open_scratch: list[list[str]] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own under ``spark.checkpoint.dir``, dropped with the open ``scratch``."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tabwatch-{kind}/{uuid.uuid4().hex}"
    if _open_scratch:
        _open_scratch[-1].append(path)
    return path


def materialize(df, compression: str | None = None):
    """Compute an intermediate once: write it as a parquet table under
    ``spark.checkpoint.dir`` and read it back. Later plans scan the table, its lineage
    is cut, and a lost executor costs no recomputation. Inside ``scratch`` the table is
    dropped when that ends."""
    path = new_folder(df.sparkSession, "tables")
    writer = df.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it, if there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch(spark: SparkSession):
    """Intermediates written inside are dropped at the end, so only use it around work whose
    result is stored elsewhere. Yields the list of their folders; one that is taken out of
    it stays."""
    made: list[str] = []
    _open_scratch.append(made)
    try:
        yield made
    finally:
        _open_scratch.pop()
        for path in made:
            drop_folder(spark, path)
