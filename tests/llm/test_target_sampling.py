import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, empty, words
from pyspark.sql import functions as F
from tabwatch.llm import target_sampling as X
from tabwatch.llm.queries import QUERIES
from tabwatch.session import materialize

SF = "/root/testdata/sf0.001"


def plain_features(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plainly(docs, targets, buckets=10_000, percent=25, min_words=20, seed=7):
    """The contract with dictionaries and one sort; rank None where not drawn."""
    def count(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in plain_features(t))

    raw, target = count(t for _, t in docs), count(targets)
    big_s, big_t = sum(raw.values()), sum(target.values())
    rows = []
    for i, text in docs:
        on = [zlib.crc32(f.encode()) % buckets for f in plain_features(text)]
        gain = [math.floor(1000 * math.log((target[b] + 1) * (big_s + buckets) / ((raw[b] + 1) * (big_t + buckets)))) for b in on]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(on), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    long_enough = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(long_enough[: percent * len(long_enough) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def corpus(spark):
    rng = random.Random(11)
    vocab = ["alpha", "Beta", "ÉTÉ", "été", "x1", "zig", "zag", "naïve", "Z"]
    return awkward(spark, [(100 + i, " ".join(rng.choices(vocab, k=rng.randrange(60)))) for i in range(300)])


def test_equals_plain_counting(spark):
    docs = corpus(spark).where("not (doc_id = 5)")  # of two equal rows either may be drawn first
    targets = spark.createDataFrame([("alpha zig zag alpha",), (None,), ("",), ("ÉTÉ x1 " * 40,)], "text string")
    got = X.sample(docs, targets).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == plainly([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in targets.collect()])


def test_query_equals_plain_counting(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = QUERIES["op12_target_sampling"](spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == plainly([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])


@pytest.mark.parametrize("step", [1, 7, 50, 1 << 20])
def test_long_texts_are_cut_between_words(step):
    rng = random.Random(step)
    for _ in range(50):
        text = "".join(rng.choice(["a", "Bc", " ", "\n", "é", "9", "-", "longer"]) for _ in range(rng.randrange(80)))
        lists = list(X.word_lists(text.encode(), step))
        assert [w.decode() for words_, old in lists for w in words_[old:]] == words(text)
        assert [tuple(p) for words_, _ in lists for p in zip(words_, words_[1:])] == [tuple(x.encode() for x in p) for p in zip(words(text), words(text)[1:])]


def weighed(spark, scores):
    rows = [(i, 50, 1, 0, s) for i, s in enumerate(scores)]
    return materialize(spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(7))


@pytest.mark.parametrize("half, accuracy", [(0.0005, 10_000), (0.0, 2), (1e-9, 1), (0.4, 100)])
def test_any_sketch_gives_the_exact_draw(spark, half, accuracy):
    rng = random.Random(1)
    scores = [rng.choice([5, 5, 5, rng.randrange(-50, 50), rng.randrange(10**9)]) for _ in range(3000)]
    got = X.draw(weighed(spark, scores), percent=25, half=half, accuracy=accuracy).collect()
    order = sorted(range(3000), key=lambda i: (-scores[i], i))
    assert {r.doc_id: r.rank for r in got} == {i: (k + 1 if k < 750 else None) for k, i in enumerate(order)}


def test_bracket_is_widened_until_counts_prove_it(spark):
    df = weighed(spark, [*range(1000)])
    for k in (1, 2, 500, 999, 1000):
        low, high, above = X.bracket(df, k, 1000, half=0.0, accuracy=1)
        assert low <= 1000 - k <= high and above == 999 - high < k


@pytest.mark.parametrize("percent", [0, 1, 100])
def test_equal_scores_over_many_tasks(spark, percent):
    got = X.draw(weighed(spark, [7] * 2000), percent=percent).where(F.col("rank").isNotNull()).collect()
    assert {r.doc_id: r.rank for r in got} == {i: i + 1 for i in range(20 * percent)}


def test_repeated_rows_fill_ranks_once_each(spark):
    docs = spark.createDataFrame([(1, "w " * 30)] * 8 + [(2, "w " * 30)] * 8, "doc_id long, text string")
    got = X.sample(docs, docs.limit(0).select("text")).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3, 4] and len({r.score for r in got if r.rank}) == 1


def test_no_documents(spark):
    assert X.sample(empty(spark), spark.createDataFrame([], "text string")).count() == 0


def test_gains_are_floored(spark):
    raw, target = np.zeros(10_000, np.int64), np.zeros(10_000, np.int64)
    raw[3], target[4] = 10, 5
    g = X.gains(raw, target)
    assert g[3] == math.floor(1000 * math.log(10010 / (11 * 10005))) and g[4] == math.floor(1000 * math.log(6 * 10010 / 10005)) and g[0] == math.floor(1000 * math.log(10010 / 10005))
