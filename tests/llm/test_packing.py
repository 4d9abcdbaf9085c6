import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import zlib
from helpers import TOKENIZER, awkward, empty, ids_of
from tabwatch.llm import packing as P


def layout(plan):
    bins, seen = defaultdict(list), Counter()
    for size, low, high, each, first, offset in plan.segments:
        assert seen[size] == low
        seen[size] = high
        for r in range(low, high):
            bins[first + (r - low) // each].append((offset + (r - low) % each * size, size))
    for pieces in bins.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
    return bins, seen


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_a_layout(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 30, 100, 2048])
    counts = Counter(rng.randint(1, cap) for _ in range(rng.randint(0, 80)))
    bins, seen = layout(P.solve(dict(counts), cap))
    assert seen == counts and all(sum(s for _, s in b) <= cap for b in bins.values())
    assert len(bins) <= math.ceil(1.25 * sum(s * n for s, n in counts.items()) / cap) + 1 or min(counts) > cap // 3


def fewest(sizes, cap):
    """Least number of sequences, by trying all."""
    best = [len(sizes)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values():
            go(k + 1, rooms[:i] + [rooms[i] - sizes[k]] + rooms[i + 1 :])
        go(k + 1, [*rooms, cap - sizes[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(3, 20) for _ in range(rng.randint(3, 9))), reverse=True)
    plan, left = P.Plan(), dict(Counter(sizes))
    P.reduce_by_dominance(left, 20, plan)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert plan.sequences + fewest(sorted(rest, reverse=True), 20) == fewest(sizes, 20)


def test_best_fit_example():
    plan = P.Plan()
    P.best_fit({6: 1, 5: 1, 4: 1, 3: 1}, 10, plan)
    bins, _ = layout(plan)
    assert sorted(sorted(s for _, s in b) for b in bins.values()) == [[3, 5], [4, 6]]
    assert not list(combinations([], 2))


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    rng, letters = random.Random(5), "aAbBzZ Iİı̇́ΣσςÅKé\xa0\x85 \x1c\n\t'sStTreRE.,!<|endoftext|>0½²中가\U0001f600\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a<|endoftext|>B", "<|ENDOFTEXT|>", "DON'T x" * 9, "w" * 5000]
    tok, encode = Tokenizer.from_file(TOKENIZER), P.build_encoder(TOKENIZER)
    assert encode([t.encode() for t in texts]) == [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_pack_documents(spark):
    docs = awkward(spark, [(20 + k, "some more words " * k) for k in range(30)])
    rows = P.pack(docs, TOKENIZER, with_ids=True).collect()
    want = Counter()
    for d in docs.collect():
        ids = ids_of(d.text)
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(d.doc_id, p, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert all(zlib.crc32(np.array(r.ids, np.int32).astype("<u4").tobytes()) == r.ids_crc32 for r in rows)
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) <= math.ceil(sum(r.length for r in rows) / 2048) + 2


def test_small_buckets_give_distinct_places(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 20)
    docs = spark.range(300).selectExpr("id as doc_id", "if(id % 3 = 0, 'one hot length', repeat('x ', cast(id as int))) as text")
    rows = P.pack(docs, TOKENIZER).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) == 300


def test_empty_table(spark):
    out = P.pack(empty(spark), TOKENIZER)
    assert out.count() == 0 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
