"""Sampling toward a target distribution: array-scored weights, a quantile sketch
brackets the cutoff, exact counts prove the bracket, and only the bracket is sorted.

Weights. Words and pairs of neighbouring words fall into a fixed number of buckets.
Two counts of every bucket, over all documents and over all target texts, give an array
of gains; a document's weight is the mean of its features' gains, looked up in that
array. Noise from a hash of the document's id turns the weights into keys whose largest
are a draw without replacement.

Cutoff. The k-th best row is wanted, scores falling and ids rising. A mergeable quantile
sketch names two scores that should enclose its score. Exact counts of the rows above
and inside the bracket prove that they do; if not, the bracket is widened and counted
again, at last to all scores. Only the bracket's rows are sorted, in many tasks, and
each task's count tells in which one the k-th row lies. Drawn rows get their ranks in
the same way, so no group of equal scores has to be in one task.

What is broadcast or sent to the driver is fixed in number: one count a bucket, one
gain a bucket, one count a sorted partition.

Defined results: a null or empty text has no words, no features, weight 0, and is never
drawn; a document of fewer than ``min_words`` words gets a score but is never drawn;
equal scores and ids (repeated rows) are drawn in any order among themselves, and nulls
come after all ids; without target texts or documents all rules hold with counts of 0.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.llm.common import annotate, doc_columns, field, text_bytes, words_of
from tabwatch.session import materialize

BUCKETS = 10_000
MIN_WORDS = 20
#: Rows drawn, of a hundred that are long enough.
PERCENT = 25
SEED = 7
#: Accuracy of the quantile sketch (its rank error is at most one in that many rows) and
#: half the bracket's width as a share of the rows.
ACCURACY, HALF_WIDTH = 10_000, 0.0005
#: Bytes of a text that are cut into words at a time.
STEP = 1 << 20
#: Rows of a partition are numbered below this many bits by Spark.
ROW_BITS = 33


def word_lists(text: bytes, step: int = STEP):
    """A text's words in lists of about ``step`` bytes, each but the first begun by the last
    word of the one before, so every pair of neighbours is in one list."""
    at, last = 0, []
    while at < len(text):
        end = min(at + step, len(text))
        while end < len(text) and (text[end] >= 128 or chr(text[end]).isalnum()):
            end += 1  # not within a word
        words = words_of(text[at:end])
        if words:
            yield last + words, len(last)
            last = words[-1:]
        at = end


def features(text: bytes, buckets: int = BUCKETS):
    """Bucket numbers of a text's words and pairs, in arrays, and how many words each has."""
    for words, old in word_lists(text):
        single = list(map(zlib.crc32, words))
        pairs = map(zlib.crc32, words[1:], map(zlib.crc32, itertools.repeat(b" "), single))
        n = len(words)
        yield np.fromiter(itertools.chain(single[old:], pairs), np.int64, n - old + n - 1) % buckets, n - old


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        count = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in text_bytes(batch, "text"):
                for on, _ in features(text, buckets):
                    if len(on) > 64:
                        count += np.bincount(on, minlength=buckets)
                    else:
                        np.add.at(count, on, 1)
        on = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(count[on])], names=["bucket", "n"])

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(buckets, np.int64)
    count[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return count


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of target over raw share of each bucket, one added to every count."""
    size, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel number that the id decides."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, table: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def work():
        gain = shared.value

        def on_batch(batch: pa.RecordBatch):
            rows = []
            for text, doc in zip(text_bytes(batch, "text"), batch.column("doc_id").to_pylist(), strict=True):
                n_words = n = total = 0
                for on, some in features(text, len(gain)):
                    n_words, n, total = n_words + some, n + len(on), total + int(gain[on].sum())
                weight = total // n if n else 0
                rows.append((n_words, n, weight, weight + noise(doc, seed)))
            return list(zip(*rows, strict=True))

        return on_batch

    fields = [field(n, "bigint") for n in ("n_words", "n_features", "weight", "score")]
    return annotate(doc_columns(docs), "text", fields, work).drop("text")


def numbered(df: DataFrame, order: list) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The rows sorted over many tasks and stored with a number that rises in that order, and
    (first number, rows before) of each task's part, one a partition."""
    stored = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    parts = sorted((r["part"], r["n"]) for r in stored.groupBy(F.shiftright("_at", ROW_BITS).alias("part")).agg(F.count("*").alias("n")).collect())
    before = itertools.accumulate((n for _, n in parts), initial=0)
    return stored, [(part << ROW_BITS, b) for (part, _), b in zip(parts, before)]


def best_first() -> list:
    """Scores fall, ids rise, no id last."""
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]


def bracket(df: DataFrame, k: int, n: int, half: float = HALF_WIDTH, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """Two scores that enclose that of the k-th best of ``n`` rows, and how many rows are
    above them, by a sketch whose proposal exact counts have proved."""
    score, spread = F.col("score"), half
    while True:
        share = 1 - (k - 0.5) / n
        wanted = [max(0.0, share - spread), min(1.0, share + spread)]
        low, high = df.agg(F.percentile_approx(score, wanted, accuracy).alias("q")).first()["q"]
        if wanted == [0.0, 1.0]:
            low, high = df.agg(F.min(score), F.max(score)).first()
        above, inside = df.agg(F.count_if(score > high), F.count_if((score >= low) & (score <= high))).first()
        if above < k <= above + inside:
            return low, high, above
        spread = 8 * spread + 0.001


def cutoff(df: DataFrame, k: int, n: int, half: float = HALF_WIDTH, accuracy: int = ACCURACY):
    """The rows of the best bracket, numbered, and the number of the k-th best row; with the
    bracket's scores."""
    low, high, above = bracket(df, k, n, half, accuracy)
    inside, parts = numbered(df.where(F.col("score").between(low, high)), best_first())
    first, before = max((p for p in parts if p[1] < k - above), key=lambda p: p[1])
    return low, high, inside, first + (k - above - before - 1)


def draw(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, half: float = HALF_WIDTH, accuracy: int = ACCURACY) -> DataFrame:
    """All rows with ``rank``, null where a row is not drawn. ``weighed`` must be stored."""
    long_enough = weighed.where(F.col("n_words") >= min_words)
    n = long_enough.count()
    k = percent * n // 100
    if not k:
        return weighed.withColumn("rank", F.lit(None).cast("long"))
    low, high, inside, last = cutoff(long_enough, k, n, half, accuracy)
    drawn, parts = numbered(long_enough.where(F.col("score") > high).unionByName(inside.where(F.col("_at") <= last).drop("_at")), best_first())
    spark = weighed.sparkSession
    offsets = spark.createDataFrame([(first >> ROW_BITS, before) for first, before in parts], "part long, before long")
    ranked = drawn.withColumn("part", F.shiftright("_at", ROW_BITS)).join(F.broadcast(offsets), "part")  # one row a sorted partition
    ranked = ranked.withColumn("rank", F.col("before") + F.col("_at").bitwiseAND((1 << ROW_BITS) - 1) + 1).select(*weighed.columns, "rank")
    rest = weighed.where((F.col("n_words") < min_words) | (F.col("score") < low)).unionByName(inside.where(F.col("_at") > last).drop("_at"))
    return ranked.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def sample(docs: DataFrame, targets: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Every document with n_words, n_features, weight, score and, if drawn, rank."""
    table = gains(bucket_counts(docs), bucket_counts(targets))
    return draw(materialize(weigh(docs, table, seed)), percent, min_words)
