import hashlib
import random

import pytest
from helpers import awkward, empty, words
from tabwatch.llm import decontaminate as D


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(window, len(v))
        for p in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[p : p + n]:
                    hit.update(range(i, i + n))
                    found.add(str(name) if name is not None else "")
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    vocab = ["ab", "cd", "Éf", "x1", "zz"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, say(14)), (2, say(10)), (3, "only three Words"), (3, say(12)), (4, ""), (5, None), (6, "..."), (None, say(11)), (10, say(25))]
    texts = [say(rng.randint(0, 60)) for _ in range(120)]
    for k in range(0, 120, 3):
        texts[k] += ", " + items[k % 4][1]
    texts.append("ONLY three words! " * 3)
    docs = awkward(spark, [(100 + i, t) for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    return docs, bench, items


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 250])
def test_equals_brute_force(spark, corpus, block):
    docs, bench, items = corpus
    rows = D.contamination(docs, bench, block_bytes=block).collect()
    want = []
    for d in docs.collect():
        n, hit, found = brute(d.text, items)
        want.append((str(d.doc_id), n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == sorted(want)
    assert sum(r.contaminated for r in rows) > 30


def test_removal_keeps_columns_and_clean_rows(spark, corpus):
    docs, bench, items = corpus
    out = D.remove_contaminated(docs, bench)
    assert out.schema == docs.schema
    assert [r.doc_id for r in out.collect()] == [d.doc_id for d in docs.collect() if not brute(d.text, items)[1]]


def test_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x " + item + " y"), (2, " ".join(f"w{i}" for i in range(3, 15))), (3, "w1 w2")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = sorted(tuple(r) for r in D.longest_matches(docs, bench).collect())
    assert got == [(1, 1, "7", 0, 20), (2, 0, "7", 3, 12)]


def test_empty_tables(spark, corpus):
    docs, bench, _ = corpus
    assert D.contamination(empty(spark), bench).count() == 0
    none = D.contamination(docs, bench.limit(0)).collect()
    assert not any(r.contaminated for r in none) and len(none) == docs.count()
