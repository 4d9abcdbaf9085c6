"""Toxicity by class-conditional Kneser-Ney models.

Both classes are modelled as character 5-grams inside words. A class has its own
counts at the highest order only; below it, both share one chain of Kneser-Ney
continuation counts (orders 4 to 1) gathered from the words of all documents. So an
expression that is rare or inflected keeps the evidence of its stem, and what neither
class has seen cancels out:

    p(x | h, class) = max(c(hx) - D, 0) / c(h) + D n(h) / c(h) * shared(x | h')

with c, n a class's counts and distinct continuations, D the discount; where a class
never saw h, the shared chain alone. A word's evidence is the difference of the two
log-likelihoods divided by its length. A document's score is a logistic function of
the length-normalised difference over all its words and of its strongest word, fitted
on labelled rows that the counts did not use.

Labels come only from rows whose crc32(doc_id as text) mod 3 is not ``HELD_OUT``:
remainder 0 feeds the counts, 2 the logistic function, each from at most
``MAX_LABELLED`` rows of a class (those with the smallest hash of their id). This
sample bounds what is broadcast (ids and the class's n-grams); the shared counts
cover every document and never leave Spark.

Defined results: a null or empty text has no evidence and gets the score of zero
evidence; if a class has no labelled row, every score is the toxic share of the
sample (0 if there is no sample); several labels of a document count as toxic if one
does; null labels and ids are no labels; repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.llm.common import annotate, field, fresh, map_batches, text_slices, words_of, worker_memo
from tabwatch.session import materialize

ORDER, BITS = 5, 12
DISCOUNT = 0.75
#: Characters fold into so many codes; 0 marks the edge of a word.
ALPHABET = 4093
FOLDS, HELD_OUT = 3, 1
MAX_LABELLED = 20_000
THRESHOLD = 0.7
#: Distinct words a task holds before it hands on their n-grams or forgets them; a longer word is forgotten at once.
HELD_WORDS, LONGEST = 400_000, 1000
#: Words whose n-grams are worked on at a time.
AT_A_TIME = 20_000
#: Bytes of text scored at a time.
SCORED_BYTES = 1 << 20
LOWEST, HIGHEST = -8.0, 8.0


def fold_of(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words' 5-grams in order, and each word's number of them
    (its characters and its end)."""
    decoded = [w.decode("utf-8", "replace").lower() for w in words]
    size = np.fromiter(map(len, decoded), np.int64, len(decoded)) + 1
    edge = "\0" * (ORDER - 1)
    c = np.frombuffer((edge + edge.join(decoded) + edge).encode("utf-32-le"), np.uint32).astype(np.int64)
    c = np.where(c > 0, c % ALPHABET + 1, 0)
    n = len(c) - ORDER + 1
    code = np.zeros(n, np.int64)
    for k in range(ORDER):
        code = code << BITS | c[k : k + n]
    last, before = c[ORDER - 1 :], c[ORDER - 2 : -1]
    return code[(last > 0) | (before > 0)], size


def _sum_by_code(code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the sums of their weights."""
    if not len(code):
        return code, weight
    order = np.argsort(code, kind="stable")
    code, weight = code[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(weight, first)


def _count(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 5-grams of counted words and how often they occur; ``AT_A_TIME`` words after
    the other, so that what is held besides them are distinct 5-grams."""
    total = np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = iter(words.items())
    while part := list(islice(left, AT_A_TIME)):
        code, size = grams([w for w, _ in part])
        weight = np.repeat(np.fromiter((n for _, n in part), np.int64, len(part)), size)
        total = _sum_by_code(*map(np.concatenate, zip(total, _sum_by_code(code, weight), strict=True)))
    return total


def labelled_sample(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """At most ``max_labelled`` rows (doc_id, toxic) of each class and fold."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    one = one.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")).withColumn("fold", fold_of(F.col("doc_id")))
    parts = [one.where((F.col("toxic") == y) & (F.col("fold") == k)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled) for y in (0, 1) for k in range(FOLDS) if k != HELD_OUT]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gram_table(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(code, toxic, ordinary): every distinct 5-gram of the documents' words, with its
    counts in the classes' labelled rows of fold 0. Pre-aggregated in each task."""
    train = sample.where("fold = 0").select("doc_id", "toxic")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(train), "doc_id", "left").select("text", "toxic")

    def run(batches):
        worker_memo(None)
        seen, by_class = Counter(), {0: Counter(), 1: Counter()}

        def hand_on():
            for c, words in ((None, seen), *by_class.items()):
                code, n = _count(words)
                zero = np.zeros(len(code), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n if c == 1 else zero), pa.array(n if c == 0 else zero)], names=["code", "toxic", "ordinary"])
                words.clear()

        for batch in batches:
            for kinds, texts in text_slices(batch, "toxic", "text"):
                for text, kind in zip(texts, kinds, strict=True):
                    words = words_of(text)
                    (seen if kind is None else by_class[kind]).update(words)
                    if len(seen) + len(by_class[0]) + len(by_class[1]) > HELD_WORDS:
                        yield from hand_on()
        yield from hand_on()

    return rows.mapInArrow(run, "code bigint, toxic bigint, ordinary bigint").groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def evidence_tables(table: DataFrame, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """From the 5-grams: log-likelihood differences (code, evidence) of those a class
    has seen, and (code, evidence) of contexts for continuations neither has seen."""
    low = lambda c, k: c.bitwiseAND(F.lit((1 << BITS * k) - 1))  # noqa: E731  its last k characters
    head = lambda c: F.shiftright(c, BITS)  # noqa: E731  all but its last character
    # continuation counts: distinct one-longer n-grams that end in this one
    conts, longer = {}, table.select("code")
    for k in range(ORDER - 1, 0, -1):
        longer = longer.groupBy(low(F.col("code"), k).alias("code")).agg(F.count("*").alias("n"))
        conts[k] = longer
    total = conts[1].agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    everything, kinds = total.select("all").scalar(), total.select("kinds").scalar()
    shared = conts[1].select("code", ((F.greatest(F.col("n") - discount, F.lit(0.0)) + discount * kinds / (ALPHABET + 1)) / everything).alias("p"))
    for k in range(2, ORDER):
        context = conts[k].groupBy(head(F.col("code")).alias("context")).agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        grown = conts[k].withColumn("context", head(F.col("code"))).withColumn("tail", low(F.col("code"), k - 1)).join(context, "context")
        shared = grown.join(shared.select(F.col("code").alias("tail"), F.col("p").alias("shorter")), "tail").select("code", ((F.greatest(F.col("n") - discount, F.lit(0.0)) + discount * F.col("kinds") * F.col("shorter")) / F.col("all")).alias("p"))
    own = table.where("toxic + ordinary > 0").withColumn("context", head(F.col("code"))).withColumn("tail", low(F.col("code"), ORDER - 1))
    sums = [F.sum(c).alias(f"{c}_all") for c in ("toxic", "ordinary")] + [F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).alias(f"{c}_kinds") for c in ("toxic", "ordinary")]
    contexts = own.groupBy("context").agg(*sums)
    both = own.join(contexts, "context").join(shared.select(F.col("code").alias("tail"), "p"), "tail")

    def likelihood(c):
        return F.when(F.col(f"{c}_all") > 0, (F.greatest(F.col(c) - discount, F.lit(0.0)) + discount * F.col(f"{c}_kinds") * F.col("p")) / F.col(f"{c}_all")).otherwise(F.col("p"))

    def left_over(c):
        return F.when(F.col(f"{c}_all") > 0, discount * F.col(f"{c}_kinds") / F.col(f"{c}_all")).otherwise(F.lit(1.0))

    return both.select("code", F.log(likelihood("toxic") / likelihood("ordinary")).alias("evidence")), contexts.select(F.col("context").alias("code"), F.log(left_over("toxic") / left_over("ordinary")).alias("evidence"))


class Lookup:
    """Exact map from codes to numbers in flat arrays: open addressing, read by vectors."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(codes) * 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.codes, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        todo, slot = np.arange(len(codes)), self._slot(codes)
        while len(todo):
            free = todo[self.codes[slot] == -1]
            self.codes[slot[self.codes[slot] == -1]] = codes[free]  # of several for one slot, the last stays
            done = self.codes[slot] == codes[todo]
            self.values[slot[done]] = values[todo[done]]
            todo, slot = todo[~done], (slot[~done] + 1) % len(self.codes)

    def arrays(self) -> tuple:
        """All that it holds, for a broadcast: executors need not know this class to read it."""
        return self.shift, self.codes, self.values

    @classmethod
    def of(cls, arrays: tuple) -> Lookup:
        made = cls.__new__(cls)
        made.shift, made.codes, made.values = arrays
        return made

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 if absent) and whether each code is there."""
        out, known = np.zeros(len(codes), np.float32), np.zeros(len(codes), bool)
        todo, slot = np.arange(len(codes)), self._slot(codes)
        while len(todo):
            there = self.codes[slot]
            hit = there == codes[todo]
            out[todo[hit]], known[todo[hit]] = self.values[slot[hit]], True
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) % len(self.codes)
        return out, known


def build_measure(own: Lookup, contexts: Lookup):
    """texts -> array of two measures each: the length-normalised difference of the
    text's log-likelihoods and that of its strongest word."""
    known: dict[bytes, int] = {}
    total, size = np.zeros(0), np.zeros(0)  # of the words known, by their numbers

    def learn(words: list[bytes]) -> None:
        nonlocal total, size
        totals, sizes = [total], [size]
        known.update(zip(words, range(len(total), len(total) + len(words)), strict=True))
        for i in range(0, len(words), AT_A_TIME):
            code, n = grams(words[i : i + AT_A_TIME])
            v, there = own.get(code)
            v[~there] = contexts.get(code[~there] >> BITS)[0]
            totals.append(np.add.reduceat(v.astype(np.float64), np.concatenate([[0], np.cumsum(n)[:-1]])))
            sizes.append(n)
        total, size = np.concatenate(totals), np.concatenate(sizes)

    def measure(texts: list[bytes]) -> np.ndarray:
        nonlocal total, size
        split = [words_of(t) for t in texts]
        every = set().union(*split)
        new = every.difference(known)
        if len(known) + len(new) > HELD_WORDS:
            known.clear()
            total, size, new = np.zeros(0), np.zeros(0), every
        if new:
            learn(list(new))
        out = np.zeros((len(texts), 2))
        for k, words in enumerate(split):
            if words:
                at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                t, n = total[at], size[at]
                out[k] = t.sum() / n.sum(), (t / (n + 1)).max()
        for w in [w for w in new if len(w) > LONGEST]:
            del known[w]
        return np.clip(out, LOWEST, HIGHEST)

    return measure


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (constant first) of a logistic function with classes of equal weight, by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w, penalty = np.zeros(a.shape[1]), ridge * np.array([0.0] + [1.0] * x.shape[1]) * 1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty) + 1e-9 * np.eye(len(w)), a.T @ (weight * (y - p)) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """What scoring needs: two lookups and the logistic function."""

    def __init__(self, own, contexts, weights, share):
        self.own, self.contexts, self.weights, self.share = own, contexts, weights, share

    def arrays(self) -> tuple:
        """The model as numbers and arrays, for a broadcast."""
        return None if self.weights is None else (self.own.arrays(), self.contexts.arrays(), self.weights), self.share


def build_score(arrays: tuple):
    """texts -> scores, from a model's arrays."""
    held, share = arrays
    if held is None:
        return lambda texts: np.full(len(texts), share)
    own, contexts, w = held
    measure = build_measure(Lookup.of(own), Lookup.of(contexts))
    return lambda texts: 1 / (1 + np.exp(-np.clip(w[0] + measure(texts) @ w[1:], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, discount: float = DISCOUNT) -> Model:
    """Fit both models and the logistic function."""
    spark = docs.sparkSession
    sample = materialize(labelled_sample(labels, max_labelled))
    n = {(r["toxic"], r["fold"]): r["n"] for r in sample.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    share = sum(v for (y, _), v in n.items() if y) / max(1, sum(n.values()))
    if not all(n.get((y, k)) for y in (0, 1) for k in range(FOLDS) if k != HELD_OUT):
        return Model(None, None, None, share)
    own, contexts = evidence_tables(materialize(gram_table(docs, sample)), discount)
    lookups = []
    for t in (own, contexts):
        arrow = t.toArrow()
        lookups.append(Lookup(arrow.column("code").to_numpy().astype(np.int64), arrow.column("evidence").to_numpy().astype(np.float32)))
    shared = spark.sparkContext.broadcast([x.arrays() for x in lookups])
    rest = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample.where(f"fold = {FOLDS - 1}").select("doc_id", "toxic")), "doc_id")

    def work():
        measure = build_measure(*map(Lookup.of, shared.value))

        def on_batch(batch):
            for y, texts in text_slices(batch, "toxic", "text", SCORED_BYTES):
                m = measure(texts)
                yield [m[:, 0], m[:, 1], y]

        return on_batch

    got = map_batches(rest, [field("whole", "double"), field("peak", "double"), field("toxic", "int")], work).toArrow()
    x = np.column_stack([got.column("whole").to_numpy(), got.column("peak").to_numpy()]).astype(float)
    y = got.column("toxic").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model(None, None, None, share)
    return Model(*lookups, fit_logistic(x, y), share)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in column ``name``, higher where toxic is likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(model.arrays())

    def work():
        of = build_score(shared.value)

        def on_batch(batch):
            return [np.concatenate([of(texts) for _, texts in text_slices(batch, None, "text", SCORED_BYTES)])]

        return on_batch

    return annotate(docs, "text", [field("score", "double")], work, [name])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(base, train(base, labels)).select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those scored ``threshold`` or more; same columns."""
    name = fresh("score", docs.columns)
    return score(docs, train(docs, labels), name).where(F.col(name) < threshold).select(*docs.columns)
