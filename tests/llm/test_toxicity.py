import random

import numpy as np
import pytest
from helpers import awkward, empty, fold
from tabwatch.llm import toxicity as X


def corpus(rng, n=900):
    """Documents of made-up words; a toxic one has a few forms of nasty stems."""
    syllables = ["an", "the", "ti", "on", "re", "sha", "bel", "ou", "len", "is"]
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(2, 5)):
                w[rng.randrange(len(w))] = rng.choice(["gromp", "zwick"]) + rng.choice(["", "ed", "an", "len", "is"])
        rows.append((i, " ".join(w).capitalize()))
        if rng.random() < 0.8:
            labels.append((i, 1, toxic))
    return rows, labels, {i: any("gromp" in t.lower() or "zwick" in t.lower() for t in [x]) for i, x in rows}


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels, truth = corpus(random.Random(1))
    docs = awkward(spark, [(1000 + i, t) for i, t in rows])
    table = spark.createDataFrame([(1000 + i, q, t) for i, q, t in labels] + [(None, 1, 1), (1000, 1, None)], "doc_id long, quality int, toxic int")
    return docs, table, {1000 + i: t for i, t in truth.items()}, X.classify(docs, table).collect()


def test_held_out_documents_are_told_apart(scored):
    _, _, truth, rows = scored
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 200
    assert sum((r.predicted == 1) == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_rows_and_ranges(scored):
    docs, _, _, rows = scored
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and fold(r.doc_id) == 1)
    assert all(r.predicted == 0 for r in rows if r.doc_id in (1, 2, 3))


def test_labels_of_held_out_rows_do_not_matter(spark, scored):
    docs, table, _, rows = scored
    flipped = spark.createDataFrame([(r.doc_id, r.quality, r.toxic if r.doc_id is None or r.toxic is None or fold(r.doc_id) != 1 else 1 - r.toxic) for r in table.collect()], table.schema)
    again = X.classify(docs, flipped).collect()
    assert [(r.doc_id, round(r.score, 9)) for r in again] == [(r.doc_id, round(r.score, 9)) for r in rows]


def test_evidence_equals_the_formula(spark):
    """Both classes and the shared chain, computed by hand on a tiny corpus."""
    from collections import Counter, defaultdict

    docs = [(0, "abba abab"), (1, "abc"), (3, "bad bab"), (4, "cab")]
    toxic = {0: 1, 3: 0, 4: None}
    ids = [i for i in range(40) if fold(i) == 0][:3] + [i for i in range(40) if fold(i) == 1][:1]
    rows = list(zip(ids, [t for _, t in docs]))
    labels = spark.createDataFrame([(ids[0], 1), (ids[2], 0)], "doc_id long, toxic int")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    own, contexts = X.evidence_tables(X.gram_table(frame, X.labelled_sample(labels)))
    got = {r.code: r.evidence for r in own.collect()}
    grams, by_class = set(), {1: Counter(), 0: Counter()}
    code = lambda g: int("".join(f"{ord(c) % X.ALPHABET + 1 if c != chr(0) else 0:03x}" for c in g), 16)
    for (i, t), y in zip(rows, (1, None, 0, None)):
        for w in t.split():
            s = "\0" * 4 + w + "\0"
            for k in range(len(w) + 1):
                grams.add(s[k : k + 5])
                if y is not None:
                    by_class[y][s[k : k + 5]] += 1
    conts, longer = {}, grams
    for k in (4, 3, 2, 1):
        conts[k] = Counter(g[1:] for g in longer)
        longer = set(conts[k])

    def shared(g):
        n = conts[len(g)]
        ctx = {x: c for x, c in n.items() if x[:-1] == g[:-1]}
        low = 1 / (X.ALPHABET + 1) if len(g) == 1 else shared(g[1:])
        return (max(n[g] - 0.75, 0) + 0.75 * len(ctx) * low) / sum(ctx.values())

    def p(y, g):
        ctx = {x: c for x, c in by_class[y].items() if x[:-1] == g[:-1]}
        if not ctx:
            return shared(g[1:])
        return (max(by_class[y][g] - 0.75, 0) + 0.75 * len(ctx) * shared(g[1:])) / sum(ctx.values())

    want = {code(g): np.log(p(1, g) / p(0, g)) for g in {*by_class[0], *by_class[1]}}
    assert set(got) == set(want) and all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_without_labels_or_documents(spark, scored):
    docs, table, _, _ = scored
    assert X.classify(empty(spark), table).count() == 0
    assert {r.score for r in X.classify(docs.limit(5), table.limit(0)).collect()} == {0.0}


def test_removal_keeps_clean_rows(spark, scored):
    docs, table, _, rows = scored
    out = X.remove_toxic(docs, table)
    assert out.schema == docs.schema
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in rows if not r.predicted)


def test_lookup_is_exact():
    rng = np.random.default_rng(1)
    codes = rng.choice(1 << 40, 5000, replace=False).astype(np.int64)
    table = X.Lookup(codes[:4000], np.arange(4000, dtype=np.float32))
    value, known = table.get(codes)
    assert known[:4000].all() and not known[4000:].any() and (value[:4000] == np.arange(4000)).all()


def test_workers_do_not_need_the_package(tmp_path):
    """The query from another working directory, where the workers cannot import this package."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = (
        "import sys\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '4').getOrCreate()\n"
        "assert s.range(1).rdd.map(lambda x: __import__('importlib.util').util.find_spec('tabwatch') is None).first()\n"
        "sys.path.insert(0, %r)\n"
        "from tabwatch.llm.queries import QUERIES\n"
        "print('ROWS', QUERIES['op7_toxicity'](s, '/root/testdata/sf0.001').count())\n" % repo
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=str(tmp_path), env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 200" in out.stdout, out.stderr[-3000:]


def test_counting_words_holds_little_besides_them():
    """Half a full memory of words: the same sums as word by word, at the cost of few arrays."""
    import tracemalloc
    from collections import Counter

    rng = random.Random(5)
    words = Counter()
    while len(words) < 200_000:
        words["".join(rng.choices("abcdefgh\u00e9", k=rng.randint(1, 9))).encode()] += rng.randint(1, 3)
    tracemalloc.start()
    code, n = X._count(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6
    assert len(set(code.tolist())) == len(code)
    assert int(n.sum()) == sum(c * (len(w.decode()) + 1) for w, c in words.items())
    some = dict(list(words.items())[:50])
    want = Counter()
    for w, c in some.items():
        for g in X.grams([w])[0].tolist():
            want[g] += c
    assert dict(zip(*(x.tolist() for x in X._count(Counter(some))), strict=True)) == want
    assert [len(x) for x in X._count(Counter())] == [0, 0]
