import hashlib
import random
import re

import numpy as np
import pytest
from helpers import awkward, empty
from tabwatch.llm import fim as X

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(text, doc_id):
    """The contract, token by token."""
    text = text or ""
    tokens = TOKEN.findall(text)
    n, digest = len(tokens), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 50:
        return text, "plain", None, None, n
    if h[3] % 100 < 80:
        return f"<S>{s}<P>{p}<M>{m}", "spm", len(p), len(m), n
    return f"<P>{p}<S>{s}<M>{m}", "psm", len(p), len(m), n


@pytest.mark.parametrize("size", [0, 1, 2, 17, 400, 6000])
def test_every_rank_is_reached_by_widths(size):
    rng = random.Random(size)
    text = "".join(rng.choice(" a\t\n\x0bbé😀\x1c\x85") for _ in range(size))
    ends = [m.end() for m in TOKEN.finditer(text)]
    assert X.token_ends(text).tolist() == ends
    tokens = X.SkipList(X.token_ends(text))
    assert [tokens.seek(r) for r in range(len(ends) + 1)] == [0, *ends]
    for units, points, _ in tokens.lanes:  # every lane up to its last node agrees with lane 0
        assert np.isin(np.cumsum(points), ends).all() and units.sum() <= len(ends)
    assert len(tokens.lanes) > 1 or len(ends) < 2 * X.SHORT


def test_lanes_get_thin():
    lanes = [len(units) for units, _, _ in X.SkipList(np.arange(1, 200_001)).lanes]
    assert lanes[-1] == 200_000 and len(lanes) >= 5
    assert all(5 < low / high < 13 for high, low in zip(lanes[1:], lanes[2:]))


def test_outputs_equal_plain_cutting_and_are_reversible(spark):
    rng = random.Random(3)
    texts = [(100 + i, "".join(rng.choice(["a", "é ", " \n", "😀", "<", "P>", "<P", "word\t", "\\", "$1"]) for _ in range(rng.randrange(60)))) for i in range(400)]
    docs = awkward(spark, [*texts, (900, "has <M> inside"), (901, "<<S>"), (902, "x" * 50_000), (903, " " * 50_000)])
    rows = X.transform(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.output, r.form, r.prefix_chars, r.middle_chars, r.n) == plainly(r.text, r.doc_id)
        assert r.lang == "en" and r.masked == "m"
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    for r, text in zip(X.digests(X.transform(docs)).collect(), [x.text or "" for x in rows]):
        assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_rates_and_clashing_names(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('a b c ', id) as text", "1 as n", "'f' as form", "'o' as OUTPUT")
    rows = X.transform(docs, rate=100, spm_rate=0).select("n", "form", "OUTPUT", "form_", "n_").collect()
    assert {(r.n, r.form, r.OUTPUT, r.form_, r.n_) for r in rows} == {(1, "f", "o", "psm", 4)}
    share = X.transform(docs.drop("form")).where("form <> 'plain'").count() / 2000
    assert 0.45 < share < 0.55


def test_empty_table(spark):
    assert X.digests(X.transform(empty(spark).select("doc_id", "text"))).count() == 0
