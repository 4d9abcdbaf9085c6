"""Baseline artifacts for the registered drift plans.

The reference builds a baseline once (at training) and every drift check loads
it.  Here a baseline is built by a Spark job and written as a parquet table under
``spark.checkpoint.dir``; drift plans read it.  The artifact is keyed by its spec
name and by the identity of the input files (path, size, modification time from
the Hadoop FileSystem, so it works on any cluster storage) -- a changed input
builds a new artifact.  Profile queries (D1-D9) always compute afresh.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tabwatch.session import checkpoint_dir

_BUILT: dict[str, str] = {}
#: What building each baseline took in this process.
BUILD_SECONDS: dict[str, float] = {}


def _file_identity(spark: SparkSession, paths: Sequence[str]) -> list[tuple]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        it = fs.listFiles(hp, True)
        files = []
        while it.hasNext():
            st = it.next()
            files.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
        out.append((p, tuple(sorted(files))))
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    return bool(hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp))


def stored_baseline(spark: SparkSession, name: str, inputs: Sequence[str],
                    build: Callable[[], DataFrame], spec: object = ()) -> DataFrame:
    """Read the baseline artifact ``name`` built from ``inputs`` under ``spec`` (split,
    features); build it once. Each build writes a folder of its own and is known only
    once complete, so concurrent jobs never overwrite what another one reads."""
    key = hashlib.sha256(repr((name, spec, checkpoint_dir(spark), _file_identity(spark, inputs))).encode()).hexdigest()[:24]
    path = _BUILT.get(key)
    if path is not None and not _exists(spark, f"{path}/_SUCCESS"):
        path = None  # the folder was cleaned: build again
    if path is None:
        path = f"{checkpoint_dir(spark).rstrip('/')}/tabwatch-baselines/{name}-{key}-{uuid.uuid4().hex}"
        began = time.perf_counter()
        build().write.parquet(path)
        BUILD_SECONDS[name] = round(time.perf_counter() - began, 3)
        _BUILT[key] = path
    return spark.read.parquet(path)
