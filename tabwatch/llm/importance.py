"""Quality by importance resampling of hashed n-grams.

Two bag models over hashed words and word pairs: raw text, counted over all
documents, and target text, counted over documents labelled as good. A document's
importance is the log of target over raw probability of its n-grams. Adding Gumbel
noise to it and keeping the largest keys draws documents without replacement in
proportion to their importance (Gumbel top-k). The noise comes from a hash of the
document's id, so a recomputed task draws the same.

The n-gram buckets are fixed in number, so each task hands on one row a bucket and
the models are broadcast whatever the corpus holds. Target rows are at most
``MAX_LABELLED`` (those with the smallest hash of their id). The key of the last
document kept is found by counting in ever narrower ranges; nothing is sorted and no
document's row comes to the driver but for at most ``FEW`` keys.

Defined results: a null or empty text has importance 0; ``share`` of all rows is
kept, rounded up, and ties with the last key kept are kept as well, so repeated rows
share their fate; without target rows all importances are 0; a null id gets noise of
its own, fixed value.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.llm.common import annotate, doc_columns, field, slices, text_bytes, words_of, worker_memo
from tabwatch.session import materialize

BUCKETS = 1 << 14
MAX_LABELLED = 20_000
#: Documents drawn, as a share of all.
SHARE = 0.75
SEED = 20240229
HELD_WORDS, LONGEST = 400_000, 64
BINS, FEW = 4096, 4096


def build_hasher(buckets: int = BUCKETS):
    """texts -> (bucket numbers of all their words and word pairs, how many each text has)."""
    known: dict[bytes, int] = {}

    class Words(dict):
        def __missing__(self, word):
            h = xxhash.xxh3_64_intdigest(word) >> 1
            if len(word) <= LONGEST:
                self[word] = h
            return h

    known = Words()

    def mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ h >> np.uint64(29)) % np.uint64(buckets)).astype(np.int64)

    def of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts, size = [], []
        for t in texts:
            words = words_of(t)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            pairs = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]
            parts += [mix(h), mix(pairs)]
            size.append(len(h) + len(pairs))
        if len(known) > HELD_WORDS:
            known.clear()
        return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.array(size, np.int64)

    return of


def models(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log target / raw probability of each bucket, with one added to every count."""
    rows = doc_columns(docs).join(F.broadcast(target_ids.withColumn("good", F.lit(1))), "doc_id", "left").select("text", "good")

    def run(batches):
        import pyarrow as pa

        worker_memo(None)
        hashed, count = build_hasher(buckets), np.zeros((2, buckets), np.int64)
        for batch in batches:
            texts, good = text_bytes(batch, "text"), np.array([bool(x) for x in batch.column("good").to_pylist()], bool)
            for i, j in slices(texts):
                bucket, size = hashed(texts[i:j])
                count[0] += np.bincount(bucket, minlength=buckets)
                count[1] += np.bincount(bucket[np.repeat(good[i:j], size)], minlength=buckets)
        on = np.flatnonzero(count[0])
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(count[0][on]), pa.array(count[1][on])], names=["bucket", "raw", "target"])

    got = rows.mapInArrow(run, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    count = np.ones((2, buckets))
    for k, c in enumerate(("raw", "target")):
        count[k][got.column("bucket").to_numpy()] += got.column(c).to_numpy()
    if count[1].sum() == buckets:
        return np.zeros(buckets)
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, gumbel_key) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def work():
        table = shared.value
        hashed = build_hasher(len(table))

        def on_batch(batch):
            texts, out = text_bytes(batch, "text"), []
            for i, j in slices(texts):
                bucket, size = hashed(texts[i:j])
                total = np.concatenate([[0.0], np.cumsum(table[bucket])])
                end = np.cumsum(size)
                out.append(np.round(total[end] - total[end - size], 9))
            return [np.concatenate(out)]

        return on_batch

    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return annotate(doc_columns(docs), "text", [field("log_weight", "double")], work).select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log(u))).alias("gumbel_key"))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = BINS, few: int = FEW) -> float:
    """The k-th largest value, by counts in ranges that narrow around it."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    above, value = 0, F.col(column)
    while low < high:
        inside = df.where((value >= low) & (value <= high))
        step = (high - low) / bins
        if step <= 0 or low + step == low:
            break
        at = F.least(F.floor((value - low) / step), F.lit(bins - 1))
        rows = sorted(((r["bin"], r["n"], r["lo"], r["hi"]) for r in inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()), reverse=True)
        for _, n, lo, hi in rows:
            if above + n >= k:
                low, high = lo, hi
                break
            above += n
        if n <= few:
            return sorted((r[0] for r in df.where((value >= low) & (value <= high)).select(column).collect()), reverse=True)[k - above - 1]
    return high


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, max_labelled: int = MAX_LABELLED, seed: int = SEED) -> DataFrame:
    """One row per document: importance, key and whether the draw keeps it."""
    good = labels.where("quality > 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    target = materialize(good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    keyed = materialize(weigh(docs, models(docs, target), seed))
    n = keyed.count()
    if not n:
        return keyed.withColumn("kept", F.lit(True))
    last = kth_largest(keyed, "gumbel_key", max(1, math.ceil(share * n)))
    return keyed.withColumn("kept", F.col("gumbel_key") >= F.lit(last))
