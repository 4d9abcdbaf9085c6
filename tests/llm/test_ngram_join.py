import random

import pytest
from helpers import awkward, empty, shingles
from tabwatch.llm import ngram_join as J


def brute(rows):
    """(doc_id, set size, smallest id of the component) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                label[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    least = {k: min([d for d in v if d is not None], default=None) for k, v in groups.items()}
    return sorted((str(d), len(sets[i]), str(least[root(i)])) for i, (d, _) in enumerate(rows))


def corpus(rng, bases=12, copies=14):
    """Chains of copies that drift apart, exact copies, and a passage that many share."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(bases):
        text = [word() for _ in range(rng.randint(4, 120))]
        if rng.random() < 0.5:
            text += passage
        for _ in range(copies):
            out.append(" ".join(text))
            if rng.random() < 0.8:
                text = list(text)
                for _ in range(rng.randint(1, max(1, len(text) // 40))):
                    text[rng.randrange(len(text))] = word()
                if rng.random() < 0.3:
                    text = rng.sample([text], 1)[0] + [word()]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed, block", [(1, J.BLOCK), (2, 3), (3, 2)])
def test_components_equal_all_pairs(spark, seed, block):
    docs = awkward(spark, [(100 + i, t) for i, t in enumerate(corpus(random.Random(seed)))])
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.classes(docs, block=block).collect())
    want = brute([(d.doc_id, d.text) for d in docs.collect()])
    assert got == want
    assert len({c for _, _, c in got}) < len(got)


def test_filters_keep_every_link():
    rng = random.Random(4)
    for _ in range(3000):
        a = rng.randint(1, 60)
        b = rng.randint(1, 60)
        for same in range(min(a, b) + 1):
            if 100 * same >= 80 * (a + b - same):
                need = -(-80 * (a + b) // 180)
                assert same >= need and 100 * min(a, b) >= 80 * max(a, b)
                assert J.prefix_size(a) >= a - same + 1 and J.prefix_size(b) >= b - same + 1


def test_one_of_each_group_stays(spark):
    texts = corpus(random.Random(5), bases=6, copies=8)
    docs = awkward(spark, [(100 + i, t) for i, t in enumerate(texts)])
    out = J.remove_near_duplicates(docs)
    assert out.schema == docs.schema
    kept = sorted(str(r.doc_id) for r in out.collect())
    want = brute([(d.doc_id, d.text) for d in docs.collect()])
    assert kept == sorted({d for d, _, c in want if d == c and d != "None"} | {"None"})


def test_no_documents_and_no_links(spark):
    assert J.classes(empty(spark)).count() == 0
    assert [tuple(r) for r in J.classes(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 0, 2)]
