"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Entities are found by pattern. Then the corpus says how strongly words give an entity
away: with N documents, df(t) of them holding term t, df(e) entity e, and n(t, e) both,
anywhere in the text and t outside of all entities,

    disclosure(t, e) = ln(n(t, e) N / (df(t) df(e))) / ln(N / df(e)),

the pointwise mutual information as a share of the entity's information: 1 if t
occurs in no document without e, 0 if t is as common elsewhere. From ``GENERALISE`` on
a term is replaced by its word class, from ``REMOVE`` on it goes, wherever it stands, also
in documents that do not write the entity out. Every pair is judged:
each document that n(t, e) falls short of ``SUPPORT`` halves the estimate of P(e | t),
so a term that one text alone gives is generalised if the corpus is large enough to
make it rare, and is hardly ever removed.

Counts cover all documents. Document frequencies are pre-aggregated before the
shuffle, pairs are counted per (term, entity) before they are joined, and no term's
or entity's rows are ever gathered in one place. The disclosing terms meet the words
of all documents in broadcasts of at most about ``TERMS`` of them, one after the other.

Matching is leftmost and non-overlapping per kind. The patterns are the contract's,
with possessive loops and start conditions that change no match but keep the regular
expression engine linear on long runs; positions come from the lengths of the pieces
between matches.

Defined results: a null text is empty and has no span; positions are code points, ends
exclusive; kinds may overlap; repeated rows count as documents of their own.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwatch.session import materialize

# The kinds in order and their patterns.
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
BASE_KINDS = 4
PATTERNS = {
    # a start inside a run of name characters never matches where the run's own start does not
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole chain of digits, each after at most one space or hyphen, with 14 to 19 digits
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "phone": "+"}
OCTET = r"^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
WORD = r"[\p{L}\p{N}]+"
#: About so many characters of a text, up to the end of a word, are cut into words at a time.
CHUNK = r"(?s).{1,256}+[\p{L}\p{N}]*+"
#: Disclosing terms in one broadcast; frequent terms, and entities, in the one that leaves out pairs.
TERMS, FREQUENT = 1_000_000, 100_000
SUPPORT, GENERALISE, REMOVE = 3, 0.75, 0.95
SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def _good(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(OCTET))
    if kind == "card":
        return _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    """One name for all ways to write an entity."""
    if kind == "email":
        return F.concat(F.lit("email "), F.lower(value))
    if kind == "ip":
        return F.concat(F.lit("ip "), value)
    return F.concat(F.lit(f"{kind} "), F.regexp_replace(value, "[^0-9]", ""))


def _located(text: Column, pattern: str, matches: Column) -> Column:
    """Array of (start, value) of non-empty matches, from the pieces between them."""
    pieces = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(F.length(p).cast("bigint").alias("gap"), m.alias("value")))
    empty = F.array().cast("array<struct<start:bigint,value:string>>")
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("found"))

    def step(acc, s):
        return F.struct((acc.at + s.gap + F.length(s.value)).alias("at"), F.concat(acc.found, F.array(F.struct((acc.at + s.gap).alias("start"), s.value.alias("value")))).alias("found"))

    return F.aggregate(steps, begin, step, lambda acc: acc.found)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with a non-null ``text``) plus ``spans``, sorted by start and kind."""
    raw = docs
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        none = F.array().cast("array<string>")
        raw = raw.withColumn(f"_{kind}", F.when(F.contains("text", F.lit(HINTS[kind])), found).otherwise(none) if kind in HINTS else found)
    parts = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        parts.append(F.when(F.size(f"_{kind}") > 0, _spans(F.col("text"), F.col(f"_{kind}"), kind, pattern, number)).otherwise(F.array().cast(SPAN)))
    return raw.withColumn("spans", F.array_sort(F.concat(*parts))).drop(*[f"_{k}" for k in PATTERNS])


def _spans(text: Column, matches: Column, kind: str, pattern: str, number: int) -> Column:
    good = F.filter(_located(text, pattern, matches), lambda x: _good(kind, x.value))
    return F.transform(good, lambda x: F.struct(x.start.alias("start"), F.lit(number).alias("kind"), (x.start + F.length(x.value)).alias("end"), _entity(kind, x.value).alias("value")))


def _words(text: Column, spans: Column) -> Column:
    """(term, start, end) of every word of the text that overlaps none of ``spans``."""
    chunks = F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))
    begin = F.array(F.lit(0).cast("bigint"))
    starts = F.aggregate(chunks, begin, lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(c))))

    def step(acc, s):
        end = acc.at + s.gap + F.length(s.word)
        return F.struct(end.alias("at"), F.concat(acc.found, F.array(F.struct(F.lower(s.word).alias("term"), (acc.at + s.gap).alias("start"), end.alias("end")))).alias("found"))

    def words(c: Column) -> Column:
        # the piece after the last word has no word beside it
        steps = F.zip_with(F.split(c.text, WORD, -1), F.regexp_extract_all(c.text, F.lit(WORD), F.lit(0)), lambda p, w: F.struct(F.length(p).alias("gap"), w.alias("word")))
        found = F.aggregate(F.filter(steps, lambda s: s.word.isNotNull()), F.struct(c.at.alias("at"), F.array().cast("array<struct<term:string,start:bigint,end:bigint>>").alias("found")), step, lambda acc: acc.found)
        return F.when(F.size(c.spans) > 0, F.filter(found, lambda w: ~F.exists(c.spans, lambda s: (s.start < w.end) & (s.end > w.start)))).otherwise(found)

    def within(c: Column, at: Column) -> Column:
        return F.struct(at.alias("at"), c.alias("text"), F.filter(spans, lambda s: (s.start < at + F.length(c)) & (s.end > at)).alias("spans"))

    whole = F.zip_with(chunks, starts, within)
    return F.flatten(F.transform(F.filter(whole, lambda c: c.text.isNotNull()), words))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) over all words of all documents."""
    terms = F.array_distinct(F.transform(F.split("text", r"[^\p{L}\p{N}]+"), F.lower))
    return docs.select(F.explode_outer(terms).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))


def disclosing(near: DataFrame, entities: DataFrame, frequencies: DataFrame, n: int, support: int, generalise: float) -> DataFrame:
    """(term, entity, disclosure) from ``generalise`` on. ``near``: (row, term, entity), each once, ``entities``: (row, entity)."""
    pairs = near.groupBy("term", "entity").agg(F.count("*").alias("n"))
    known = entities.distinct().groupBy("entity").agg(F.count("*").alias("entity_df")).where(F.col("entity_df") < n)
    both = pairs.join(known, "entity").join(frequencies, "term")
    short = F.greatest(F.lit(support) - F.col("n"), F.lit(0))
    pmi = F.log(F.col("n") * F.lit(float(n)) / (F.col("df") * F.col("entity_df"))) - short * math.log(2)
    return both.select("term", "entity", (pmi / F.log(F.lit(float(n)) / F.col("entity_df"))).alias("disclosure")).where(F.col("disclosure") >= generalise)


def _frequent(counts: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The rows of largest count, at most ``FREQUENT``, and a bound on the count of the others."""
    bits = F.length(F.bin(column))
    total = 0
    for r in sorted(counts.groupBy(bits.alias("bits")).agg(F.count("*").alias("k")).collect(), reverse=True):
        total += r.k
        if total > FREQUENT:
            return counts.where(bits > r.bits), 2**r.bits - 1
    return counts, 0


def possible(near: DataFrame, entities: DataFrame, frequencies: DataFrame, n: int, generalise: float) -> DataFrame:
    """``near`` without pairs that can't reach ``generalise``: n(t, e) is df(e) at most, so
    their ln(N / df(t)) is too small. Most pairs are of a few frequent terms and end here."""
    terms, _ = _frequent(frequencies, "df")
    known, others = _frequent(entities.distinct().groupBy("entity").agg(F.count("*").alias("most")), "most")
    both = near.join(F.broadcast(terms), "term", "left").join(F.broadcast(known), "entity", "left")
    most = F.coalesce("most", F.lit(others)).cast("double")
    # a little slack, so that rounding leaves out no pair at the limit
    able = F.log(F.lit(float(max(n, 1))) / F.col("df")) >= generalise * F.log(F.lit(float(max(n, 1))) / most) - 1e-9
    return both.where(F.col("df").isNull() | able).select("row", "term", "entity")


def find(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, with_text: bool = False) -> DataFrame:
    """(doc_id, spans) of every document, all kinds sorted by start, kind and end."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    stored = materialize(base_spans(base).select("doc_id", "text", "spans", F.monotonically_increasing_id().alias("row")))
    n = stored.count()
    entities = stored.select("row", F.explode("spans").alias("s")).select("row", F.col("s.value").alias("entity"))
    held = stored.where(F.size("spans") > 0).select("row", F.array_distinct("spans.value").alias("entities"), F.array_distinct(_words(F.col("text"), F.col("spans"))["term"]).alias("terms"))
    near = held.select("row", "entities", F.explode_outer("terms").alias("term")).where("term is not null").select("row", "term", F.explode("entities").alias("entity"))
    frequencies = materialize(document_frequencies(stored))
    near = possible(near, entities, frequencies, n, generalise)
    kind = F.when(F.col("disclosure") >= remove, KINDS.index("remove")).otherwise(KINDS.index("generalise"))
    told = materialize(disclosing(near, entities, frequencies, n, support, generalise).groupBy("term").agg(F.max(kind).alias("kind")))
    parts = max(1, math.ceil(told.count() / TERMS))
    words = stored.select("row", F.explode_outer(_words(F.col("text"), F.col("spans"))).alias("w")).select("row", "w.*")  # outer: explode would cut the words once more to ask for their number
    hits = []
    for k in range(parts):
        some = told.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k)
        found = words.join(F.broadcast(some), "term").select("row", "start", "end", "kind", F.col("term").alias("value"))
        hits.append(found if parts == 1 else materialize(found))
    hit = reduce(DataFrame.unionByName, hits)
    more = hit.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end", "value")).cast(SPAN).alias("more"))
    out = (stored if with_text else stored.drop("text")).join(more, "row", "left")
    return out.withColumn("spans", F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(SPAN))))).drop("more", "row")


def _written(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s.kind + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat(name(s), F.lit(":"), s.start.cast("string"), F.lit(":"), s.end.cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """What the contract asks for, from ``find``."""
    def count(k):
        return F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(BASE_KINDS)]
    base = _written(F.filter("spans", lambda s: s.kind < BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, text, spans): texts with entities and generalised terms replaced by their
    kind's name in brackets and removed terms cut out. Of overlapping spans the first counts."""
    found = find(docs, with_text=True, **parameters)
    name = lambda s: F.element_at(F.array(*[F.lit("" if k == "remove" else "[TERM]" if k == "generalise" else f"[{k.upper()}]") for k in KINDS]), s.kind + 1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        return F.when(s.start < acc.at, acc).otherwise(F.struct(s.end.alias("at"), F.concat(acc.out, F.array(F.substr("text", acc.at + 1, s.start - acc.at), name(s))).alias("out")))

    text = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc.out, ""), F.substr("text", acc.at + 1, F.length("text"))))
    return found.select("doc_id", F.when(F.size("spans") > 0, text).otherwise(F.col("text")).alias("text"), "spans")
