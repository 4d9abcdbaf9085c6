import math
import random

import numpy as np
from helpers import awkward, empty
from tabwatch.llm import importance as R


def test_target_like_documents_are_kept(spark):
    rng = random.Random(1)
    say = lambda vocab: " ".join(rng.choice(vocab) for _ in range(60))
    rows = [(100 + i, say(["alpha", "beta", "gamma", "delta"] if i % 4 else ["zig", "zag", "zog"])) for i in range(400)]
    labels = spark.createDataFrame([(100 + i, 1 if i % 4 else 0, 0) for i in range(0, 400, 3)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = awkward(spark, rows)
    got = R.resample(docs, labels, share=0.75).collect()
    assert len(got) == len(rows) + 9
    kept = {r.doc_id for r in got if r.kept}
    assert {i for i, _ in rows if (i - 100) % 4} <= kept and len(kept & {i for i, _ in rows if not (i - 100) % 4}) <= 15
    assert math.ceil(0.75 * len(got)) <= sum(r.kept for r in got) <= math.ceil(0.75 * len(got)) + 1  # a repeated row may tie
    assert {r.log_weight for r in got if r.doc_id in (1, 2, 3)} == {0.0}


def test_keys_are_gumbel_and_repeatable(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'' as text")
    a, b = (np.array([r.gumbel_key for r in R.weigh(docs.repartition(n), np.zeros(64)).orderBy("doc_id").collect()]) for n in (2, 5))
    assert (a == b).all()
    assert abs(a.mean() - 0.5772) < 0.03 and abs(a.std() - math.pi / 6**0.5) < 0.03


def test_kth_largest(spark):
    values = [random.Random(2).choice([1.5, 2.5, -3.0, 1e9, 7.25]) for _ in range(500)] + [float(i) for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    for k in (1, 2, 50, 400, 800):
        assert R.kth_largest(df, "v", k, bins=7, few=10) == sorted(values, reverse=True)[k - 1]


def test_no_documents_and_no_target(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert R.resample(empty(spark), none).count() == 0
    got = R.resample(awkward(spark), none).collect()
    assert {r.log_weight for r in got} == {0.0}


def test_log_weights_equal_plain_counting(spark):
    """Every weight from dictionaries over the same hashed words and pairs."""
    from collections import Counter

    import xxhash
    from helpers import words

    rng = random.Random(6)
    docs = awkward(spark, [(100 + i, " ".join(rng.choices(["alpha", "Beta", "été", "x1", "zig"], k=rng.randrange(40)))) for i in range(80)])
    good = {100 + i for i in range(0, 80, 3)} | {5, 6}
    target = spark.createDataFrame([(i,) for i in good], "doc_id long")
    buckets, full = 512, (1 << 64) - 1

    def mixed(h):
        h = (h ^ h >> 31) * 0x9E3779B97F4A7C15 & full
        return (h ^ h >> 29) % buckets

    def features(text):
        h = [xxhash.xxh3_64_intdigest(w.encode()) >> 1 for w in words(text)]
        return [mixed(x) for x in h] + [mixed((a * 0xD6E8FEB86659FD93 + b) & full) for a, b in zip(h, h[1:])]

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    raw = Counter(f for _, t in rows for f in features(t))
    wanted = Counter(f for i, t in rows if i in good for f in features(t))
    total = [sum(c.values()) + buckets for c in (wanted, raw)]
    ratio = R.models(docs, target, buckets)
    got = sorted((str(r.doc_id), r.log_weight) for r in R.weigh(docs, ratio).collect())
    want = sorted((str(i), sum(math.log((wanted[f] + 1) / total[0]) - math.log((raw[f] + 1) / total[1]) for f in features(t))) for i, t in rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert max(abs(a - b) for (_, a), (_, b) in zip(got, want)) < 1e-6
