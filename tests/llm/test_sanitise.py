import hashlib
import random
import re

import pytest
from helpers import awkward, empty
from tabwatch.llm import sanitise as S


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def written(spans):
    return ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in spans)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)

    def card(n):
        body = "".join(rng.choice("0123456789") for _ in range(n - 1))
        return next(body + c for c in "0123456789" if luhn(body + c))

    bits = ["a", "@", ".", "b-c", "1", "12", "255", "256", ".", "-", " ", "+", "(", ")", "é", "😀", "x@y.z", "1.2.3.4", "+1 (555) 123-4567", "_", "%", "\n", "0", "00"]
    texts = ["".join(rng.choice([*bits, card(rng.randint(13, 20))]) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ["a" * 3000 + "@" + "b." * 2000 + "c", "1" * 5000, "1 2" * 3000, "+" + "1 " * 4000]
    return awkward(spark, [(100 + i, t) for i, t in enumerate(texts)])


def test_base_spans_equal_plain_scans(corpus):
    got = {}
    for r in S.digests(S.find(corpus)).collect():
        got.setdefault(r.doc_id, []).append(r)
    rows = corpus.collect()
    assert sum(map(len, got.values())) == len(rows)
    for d in rows:
        want, r = brute(d.text), got[d.doc_id][0]
        base = ",".join(p for p in r.spans.split(",") if p and p.split(":")[0] in S.KINDS[: S.BASE_KINDS])
        assert base == written(want), d.text
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]


def test_terms_that_give_an_entity_away(spark):
    """zorbax stands only beside one address, mostly is half elsewhere, the is everywhere."""
    texts = [f"the note {i} of the plain kind" for i in range(40)]
    texts += [f"the zorbax mostly wrote to ann@x.org on day {i}" for i in range(4)]
    texts += ["the mostly harmless"] * 1 + ["nothing mostly"] * 0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, [s.kind for s in r.spans]) for r in S.sanitise(docs, support=3, generalise=0.75, remove=0.95).collect()}
    remove, general = S.KINDS.index("remove"), S.KINDS.index("generalise")
    assert got[0] == (texts[0], [])
    text, kinds = got[41]
    assert "zorbax" not in text and "ann@x.org" not in text and "[EMAIL]" in text and text.startswith("the ")
    assert remove in kinds and general in kinds and "[TERM]" in text
    again = {r.doc_id: r.text for r in S.sanitise(docs, support=5).collect()}
    assert again[41] == texts[41].replace("ann@x.org", "[EMAIL]")


def test_disclosure_equals_the_formula(spark):
    import math

    near = spark.createDataFrame([(r, t, "e") for r in range(3) for t in ("x", "y")], "row long, term string, entity string")
    entities = spark.createDataFrame([(r, "e") for r in (0, 1, 2, 3, 3)], "row long, entity string")
    frequency = spark.createDataFrame([("x", 3), ("y", 30)], "term string, df long")
    got = {r.term: r.disclosure for r in S.disclosing(near, entities, frequency, 100, 2, -9.0).collect()}
    want = {t: math.log(3 * 100 / (df * 4)) / math.log(100 / 4) for t, df in (("x", 3), ("y", 30))}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-12 for t in want)


def test_entities_of_one_or_two_documents_are_judged(spark):
    texts = [f"the plain note {i}" for i in range(4000)] + ["the zorbax wrote to ann@x.org"] + ["the quimble saw 10.9.8.7"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in S.sanitise(docs).collect()}
    assert got[4000] == "the [TERM] [TERM] [TERM] [EMAIL]" and got[4001] == got[4002] == "the [TERM] [TERM] [IP]"
    assert got[7] == texts[7]


def test_a_short_count_lowers_the_estimate(spark):
    import math

    near = spark.createDataFrame([(r, "x", e) for e, rows in (("a", 1), ("b", 2), ("c", 3)) for r in range(rows)], "row long, term string, entity string")
    frequency = spark.createDataFrame([("x", 3)], "term string, df long")
    got = {r.entity: r.disclosure for r in S.disclosing(near, near.select("row", "entity"), frequency, 1000, 3, -9.0).collect()}
    want = {e: (math.log(1000 / 3) - (3 - k) * math.log(2)) / math.log(1000 / k) for e, k in (("a", 1), ("b", 2), ("c", 3))}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-12 for e in want)


def test_terms_far_from_an_entity_and_without_it(spark):
    """A disclosing term goes wherever it stands: far off in the text, and where the entity is not written."""
    far = "the plain note " * 40
    texts = [f"the plain note {i}" for i in range(4000)] + [f"ann@x.org {far}Zorbax {i}" for i in range(9)] + [f"zorbax {far}zorbax"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in S.sanitise(docs).collect()}
    assert all("Zorbax" not in got[4000 + i].text and far in got[4000 + i].text for i in range(9))
    assert [(s.start, s.end) for s in got[4009].spans] == [(0, 6), (len(texts[-1]) - 6, len(texts[-1]))] and "zorbax" not in got[4009].text
    assert got[5].text == texts[5]


def test_words_of_any_text(spark):
    rng = random.Random(5)
    bits = ["a", "Bc", "é", "😀", "𝒜", "İ", "Σ", "1", " ", "\n", ".", "_", "w" * 300, " " * 300]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["", "ab " * 3000, "x" * 5000]
    spans = [[(a, 0, a + 7, "e") for a in range(0, len(t), 11)] if i % 2 else [] for i, t in enumerate(texts)]
    rows = spark.createDataFrame(list(zip(range(len(texts)), texts, spans, strict=True)), f"i int, text string, spans {S.SPAN}")
    for r in rows.select("i", S._words(S.F.col("text"), S.F.col("spans")).alias("w")).collect():
        t = texts[r.i]
        want = [m.span() for m in re.finditer(r"[^\W_]+", t) if not any(a < m.end() and b > m.start() for a, _, b, _ in spans[r.i])]
        assert [(w.start, w.end) for w in r.w] == want
        assert all(w.term == t[w.start : w.end].lower() for w in r.w if not set("İΣ") & set(t[w.start : w.end]))


def test_many_disclosing_terms_in_parts(spark, monkeypatch):
    texts = [f"the plain note {i}" for i in range(400)] + [f"ann@x.org quimble zorbax wrote here day {i}" for i in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(tuple, S.digests(S.find(docs)).collect()))
    monkeypatch.setattr(S, "TERMS", 2)
    assert sorted(map(tuple, S.digests(S.find(docs)).collect())) == whole


def test_left_out_pairs_change_nothing(spark, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join([f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(12)] + [f"z{k} u{k}@x.org"] * (rng.random() < 0.2)) for k in (rng.randint(0, 30) for _ in range(600))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = []
    for frequent in (100_000, 40, 0):
        monkeypatch.setattr(S, "FREQUENT", frequent)
        got.append(sorted(map(tuple, S.digests(S.find(docs)).collect())))
    assert got[0] == got[1] == got[2] and any("generalise" in r[-1] for r in got[0])


def test_no_python_on_the_main_path(corpus):
    plan = S.digests(S.find(corpus))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert S.digests(S.find(empty(spark))).count() == 0
