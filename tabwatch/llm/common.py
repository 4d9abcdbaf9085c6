"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts are worked through in slices of about this many bytes, so a task's Python
# memory is bounded by this and its longest single text.
SLICE_BYTES = 4 << 20


def doc_columns(docs: DataFrame) -> DataFrame:
    """Only what a per-document operator reads, so scans are pruned and extra
    columns (also those that clash with an operator's own) do not matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column of ``taken`` has it in any letter case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive [i, j) of ``texts`` holding about ``limit`` units each."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > limit:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


#: Lower-cases A-Z and turns every other ASCII character but a-z and 0-9 into a space; bytes of non-ASCII characters stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all non-ASCII characters, A-Z in lower case."""
    return text.translate(WORD_BYTES).split()


#: Lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def worker_memo(name: str | None) -> dict:
    """A dict that lives on in the Python worker, which Spark reuses for many tasks.
    Only one is kept: asking for another one, or for none, frees the last. Memory that
    earlier tasks freed goes back to the system, so idle workers do not hold it."""
    pa.default_memory_pool().release_unused()
    held = sys.modules.setdefault("tabwatch_worker_memo", types.ModuleType("tabwatch_worker_memo")).__dict__
    if "memo" not in held or held["name"] != name:
        held["name"], held["memo"] = name, {}
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
    return held["memo"]


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def text_slices(batch: pa.RecordBatch, key: str | None, name: str, limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Keys (none without a ``key`` column) and UTF-8 texts (null: empty) of consecutive rows that hold about ``limit`` bytes;
    only these become Python objects."""
    column = batch.column(name).cast(pa.binary()).fill_null(b"")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield batch.column(key).slice(i, j - i).to_pylist() if key else [], column.slice(i, j - i).to_pylist()
        i = j


def text_strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """Strings of a column; null is empty."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def annotate(df: DataFrame, text: str, fields: list[T.StructField], work: Callable[[], Callable[[pa.RecordBatch], list]], as_names: list[str] | None = None) -> DataFrame:
    """Every row and column of ``df`` plus columns computed from its text, in one
    pass without a shuffle. ``work()`` is called once per task and returns the
    function from a batch to one list or Arrow array per field. ``as_names`` renames
    the new columns where the plain names would clash."""
    names = as_names or [f.name for f in fields]
    new = [T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True)]
    kinds = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memo(None)
        on_batch = work()
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(on_batch(b), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new]))


def map_batches(df: DataFrame, fields: list[T.StructField], work: Callable[[], Callable[[pa.RecordBatch], Iterator[list]]], memo: str | None = None) -> DataFrame:
    """Any number of output batches (lists of columns) for each input batch. ``memo``
    names the worker memo that the work uses, if any."""
    names, kinds = [f.name for f in fields], [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memo(memo)
        on_batch = work()
        for b in batches:
            if b.num_rows:
                for out in on_batch(b):
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return df.mapInArrow(run, T.StructType(fields))


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}[kind.simpleString()]


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind))


#: Most rows of one narrow table (ids and numbers) that are broadcast.
BROADCAST_ROWS = 1_000_000


def join_narrow(df: DataFrame, narrow: DataFrame, on: str, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a stored table of ids: broadcast where a count shows it is small,
    so wide rows stay where they are, else by shuffle."""
    return df.join(F.broadcast(narrow) if narrow.count() <= limit else narrow, on, how)
