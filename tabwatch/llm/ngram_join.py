"""Jaccard self-join on word n-grams: rare-first prefixes with length, positional
and suffix filters, each surviving pair verified once, then connected components.

Order: an n-gram's rarity is the corpus count of its rarest word, an upper bound of
the n-gram's own count; ties go by hash. Word counts cover all documents and sit in
``2**WORD_BITS`` hashed cells, a table of fixed size. Any common order is exact for
prefix filtering; a good one keeps the groups small.

1. One pass over the texts gives each document its n-gram set's key (texts with
   equal sets are one node from here on), size, prefix and a parity sketch.
2. Prefix n-grams that only one node has are dropped.
3. Star round: in each n-gram's group, everybody is paired with one pivot (the node
   with most copies). A group of two is done; in a family of near copies most nodes
   now share a component, without all pairs having been formed.
4. Rest round: in each group, pairs of non-pivots in different components. Groups
   are cut into blocks, so a group of any size is met block by block.
5. Both rounds filter: length; position (what can still overlap after the shared
   n-gram); suffix: nodes' n-grams are dealt into ``SKETCH_BITS`` cells by hash, and
   the cells of odd difference bound the sets' distance from below (large sets have a
   second, wider sketch). Pairs left are
   verified on the whole sets, from the texts of the nodes in question only.

N-grams and sets are compared by 64-bit hashes. Nothing is capped.

Defined results: null, empty or all-space text has an empty set and links with
nothing; fewer than n words make one n-gram of the whole; a row without doc_id takes
part in links but cannot name a component; repeated rows are copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.llm.common import LOWER, field, fresh, join_narrow, map_batches, slices, text_bytes, worker_memo
from tabwatch.session import materialize

N, PERCENT = 5, 80
WORD_BITS = 18
#: Cells of a node's parity sketch, and of the wider one that large sets have besides.
SKETCH_BITS, WIDE_BITS, WIDE_FROM = 1024, 8192, 400
HELD_WORDS, LONGEST = 400_000, 64
#: Nodes of a group met at once.
BLOCK = 1024


class Words(dict):
    """Hashes of words, remembered. By the contract only A-Z change case and white space
    is 0x20 and 0x09-0x0D, which is what bytes.split() takes."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            self[word] = h
        return h

    def hashes(self, text: bytes) -> np.ndarray:
        words = text.translate(LOWER).split()
        out = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        if len(self) > HELD_WORDS:
            self.clear()
        return out


def _ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams in order, or of the whole if it is shorter."""
    size = min(n, len(h))
    if not size:
        return h
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def word_counts(docs: DataFrame) -> np.ndarray:
    """Corpus counts of words in hashed cells."""
    cells = 1 << WORD_BITS

    def run(batches):
        worker_memo(None)
        words, count = Words(), np.zeros(cells, np.int64)
        for b in batches:
            texts = text_bytes(b, "text")
            for i, j in slices(texts):
                h = np.concatenate([words.hashes(t) for t in texts[i:j]])
                count += np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        on = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(count[on])], names=["cell", "n"])

    got = docs.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(cells, np.int64)
    count[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return count


def describe(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row: doc_id, text hash, size and key of its set, and, from the first row of
    a key in a task, its prefix in rare-first order and its sketch."""
    counts = docs.sparkSession.sparkContext.broadcast(word_counts(docs))
    fields = [field("doc_id", "bigint"), field("text_hash", "bigint"), field("size", "bigint"), field("key", "bigint"), field("prefix", "array<bigint>"), field("sketch", "array<bigint>"), field("wide", "array<bigint>")]

    def work():
        rarity, words, seen = counts.value, Words(), set()
        mask = np.uint64(len(rarity) - 1)

        def parity(grams, bits):
            odd = np.bincount((grams >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1
            return np.packbits(odd.astype(np.uint8)).view(np.int64)

        def on_batch(batch):
            texts, ids, hashes = text_bytes(batch, "text"), batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            for i, j in slices(texts):
                rows = []
                for k in range(i, j):
                    h = words.hashes(texts[k])
                    if not len(h):
                        rows.append((ids[k], hashes[k], 0, None, None, None, None))
                        continue
                    grams = _ngrams(h, n)
                    every, first = np.unique(grams, return_index=True)
                    key = xxhash.xxh3_64_intdigest(every.tobytes()) - (1 << 63)
                    if key in seen:
                        rows.append((ids[k], hashes[k], len(every), key, None, None, None))
                        continue
                    seen.add(key)
                    count = rarity[(h & mask).astype(np.int64)]
                    least = count[: len(grams)].copy()
                    for m in range(1, len(h) - len(grams) + 1):
                        np.minimum(least, count[m : m + len(grams)], out=least)
                    order = np.lexsort((every, least[first]))[: prefix_size(len(every), percent)]
                    wide = parity(every, WIDE_BITS) if len(every) >= WIDE_FROM else None
                    rows.append((ids[k], hashes[k], len(every), key, every[order].view(np.int64), parity(every, SKETCH_BITS), wide))
                if len(seen) > HELD_WORDS:
                    seen.clear()
                yield list(zip(*rows, strict=True))

        return on_batch

    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), fields, work)


def needed(a, b, percent: int):
    """Least overlap of linked sets of sizes a and b."""
    return F.ceil((a + b) * percent / F.lit(100.0 + percent) - 1e-9)


def shared_prefixes(table: DataFrame) -> DataFrame:
    """(token, key, size, pos) of prefix n-grams that more than one node has."""
    rows = table.where("prefix is not null").select("key", "size", F.posexplode("prefix").alias("pos", "token"))
    group = Window.partitionBy("token")
    rows = rows.withColumn("low", F.min("key").over(group)).withColumn("high", F.max("key").over(group)).where("low < high")
    return rows.select("token", "key", "size", "pos").distinct()


def fits(size_a, pos_a, size_b, pos_b, percent: int):
    """Length and positional filters for two sets that share the n-gram at these places."""
    length = F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * percent
    most = F.least(pos_a, pos_b) + 1 + F.least(size_a - pos_a, size_b - pos_b) - 1
    return length & (most >= needed(size_a, size_b, percent))


def close(nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Suffix filter on pairs (a, b): drops those whose sketches prove too far apart."""
    side = lambda c: nodes.select(F.col("key").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("size", "sketch", "wide")])
    total = F.col("size_a") + F.col("size_b")
    most = total - 2 * needed(F.col("size_a"), F.col("size_b"), percent)

    def far(x):
        return F.aggregate(F.zip_with(f"{x}_a", f"{x}_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, p: s + p)

    both = F.col("wide_a").isNotNull() & F.col("wide_b").isNotNull()
    return pairs.join(side("a"), "a").join(side("b"), "b").where(far("sketch") <= most).where(~both | (far("wide") <= most)).select("a", "b")


def read_texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, compressed text) of every node in ``pairs``, read again from the documents:
    a text is a third the size of its n-grams' hashes."""
    asked = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = materialize(asked.join(nodes, "key").select("key", "text_hash", "first_doc"))
    texts = join_narrow(docs.withColumn("text_hash", F.xxhash64("text")), wanted, "text_hash").where(F.col("doc_id").eqNullSafe(F.col("first_doc"))).select("key", "text")

    def work():
        import zstandard

        pack, seen = zstandard.ZstdCompressor(level=3).compress, set()

        def on_batch(batch):
            keys, texts = batch.column("key").to_pylist(), text_bytes(batch, "text")
            new = [k for k, key in enumerate(keys) if not (key in seen or seen.add(key))]
            if len(seen) > HELD_WORDS:
                seen.clear()
            yield [[keys[k] for k in new], [pack(texts[k]) for k in new]]

        return on_batch

    found = materialize(map_batches(texts, [field("key", "bigint"), field("packed", "binary")], work))
    if found.count() > wanted.count():  # a repeated row, met by several tasks
        found = materialize(found.dropDuplicates(["key"]))
    return found


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that do link."""
    texts = read_texts(docs, nodes, pairs)
    side = lambda c: texts.select(F.col("key").alias(c), F.col("packed").alias(f"packed_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def work():
        import zstandard

        unpack, words = zstandard.ZstdDecompressor().decompress, Words()

        def on_batch(batch):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            last, kept, keep = None, None, []  # rows of one node often follow each other
            for x, y, packed_x, packed_y in zip(a, b, batch.column("packed_a").to_pylist(), batch.column("packed_b").to_pylist(), strict=True):
                if y != last:
                    last, kept = y, np.unique(_ngrams(words.hashes(unpack(packed_y)), n))
                other = np.unique(_ngrams(words.hashes(unpack(packed_x)), n))
                same = len(np.intersect1d(other, kept, assume_unique=True))
                keep.append(100 * same >= percent * (len(other) + len(kept) - same))
            keep = pa.array(keep, pa.bool_())
            yield [batch.column(c).filter(keep) for c in ("a", "b")]

        return on_batch

    return map_batches(both, [field("a", "bigint"), field("b", "bigint")], work)


def components(links: DataFrame) -> DataFrame:
    """(key, label): the smallest key of each linked node's component. Labels spread
    along links and then jump to their label's label, until nothing changes."""
    links = materialize(links.union(links.select("b", "a")).toDF("a", "b").where("a <> b").distinct())
    labels = materialize(links.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("label")).withColumn("label", F.least("key", "label")))
    while True:
        told = links.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("told"))
        spread = labels.join(told, "key").select("key", F.col("label").alias("old"), F.least("label", "told").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("next"))
        new = materialize(spread.join(jump, "label", "left").select("key", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("key", "label")
        if not changed:
            return labels


def rest_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different components within each (token, part), passing all
    three filters. Input rows carry side 0/1: in a part of two blocks only pairs
    across are formed."""
    ordered = groups.repartition("token", "part").sortWithinPartitions("token", "part", "key")
    names = ["token", "part", "key", "label", "size", "pos", "side"]

    def pairs_of(cols: dict, first: np.ndarray, last: np.ndarray):
        """first/last: bounds of the complete groups."""
        step, a_all = 1, np.concatenate([np.arange(f, x) for f, x in zip(first, last, strict=True)]) if len(first) else np.zeros(0, np.int64)
        end = np.repeat(last, last - first)
        across = np.repeat([cols["side"][f:x].max() > 0 for f, x in zip(first, last, strict=True)], last - first) if len(first) else np.zeros(0, bool)
        while True:
            on = a_all + step < end
            a_all, end, across = a_all[on], end[on], across[on]
            if not len(a_all):
                return
            a, b = a_all, a_all + step
            size_a, size_b, pos_a, pos_b = cols["size"][a], cols["size"][b], cols["pos"][a], cols["pos"][b]
            need = np.ceil((size_a + size_b) * percent / (100.0 + percent) - 1e-9)
            ok = (cols["label"][a] != cols["label"][b]) & (np.minimum(size_a, size_b) * 100 >= np.maximum(size_a, size_b) * percent)
            ok &= (np.minimum(pos_a, pos_b) + np.minimum(size_a - pos_a, size_b - pos_b) >= need) & (~across | (cols["side"][a] != cols["side"][b]))
            a, b, need = a[ok], b[ok], need[ok]
            far = np.bitwise_count(cols["sketch"][a] ^ cols["sketch"][b]).sum(1, dtype=np.int64)
            ok = far <= cols["size"][a] + cols["size"][b] - 2 * need
            yield cols["key"][a[ok]], cols["key"][b[ok]]
            step += 1

    def run(batches):
        held, sent = None, set()
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            cols["sketch"] = batch.column("sketch").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(cols["key"]), -1)
            if held is not None:
                cols = {c: np.concatenate([held[c], cols[c]]) for c in cols}
            cut = np.flatnonzero((np.diff(cols["token"]) != 0) | (np.diff(cols["part"]) != 0)) + 1
            edges = np.concatenate([[0], cut])
            yield from emit(cols, edges[:-1], edges[1:], sent)
            held = {c: v[edges[-1] :] for c, v in cols.items()}  # the last group may go on
        if held is not None and len(held["key"]):
            yield from emit(held, np.array([0]), np.array([len(held["key"])]), sent)

    def emit(cols, first, last, sent):
        for a, b in pairs_of(cols, first, last):
            new = {p for p in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True) if p[0] != p[1]} - sent
            if new:
                sent |= new
                if len(sent) > HELD_WORDS:
                    sent.clear()
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows of a group dealt into blocks and repeated for each pair of blocks, so any
    two rows meet in exactly one part and no part is larger than two blocks."""
    n = F.count("*").over(Window.partitionBy("token"))
    dealt = rows.withColumn("blocks", F.ceil(n / F.lit(float(block))).cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = dealt.withColumn("other", other)
    part = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    return met.withColumn("part", part.cast("bigint")).withColumn("side", (F.col("own") > F.col("other")).cast("int")).drop("blocks", "own", "other")


def classes(docs: DataFrame, n: int = N, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = materialize(describe(docs, n, percent))
    nodes = materialize(table.where("key is not null").groupBy("key").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("_one"), F.min("size").alias("size"), F.max("sketch").alias("sketch"), F.max("wide").alias("wide")).withColumn("text_hash", F.col("_one.text_hash")).drop("_one"))
    group = Window.partitionBy("token")
    shared = materialize(shared_prefixes(table).join(nodes.select("key", "copies"), "key")
                         .withColumn("pivot", F.max(F.struct("copies", "key", "size", "pos")).over(group)).drop("copies"))
    met = materialize(nodes.join(shared.select("key").distinct(), "key", "left_semi"))  # from here on only these matter
    stars = shared.where("key <> pivot.key").where(fits(F.col("size"), F.col("pos"), F.col("pivot.size"), F.col("pivot.pos"), percent))
    pairs = materialize(close(met, stars.select(F.col("pivot.key").alias("a"), F.col("key").alias("b")).distinct(), percent))
    links = materialize(verify(docs, met, pairs, n, percent))
    labels = components(links)
    others = shared.where("key <> pivot.key").drop("pivot").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    others = others.withColumn("low", F.min("label").over(group)).withColumn("high", F.max("label").over(group)).where("low < high").drop("low", "high")
    candidates = in_blocks(others.join(met.select("key", "sketch"), "key"), block)
    more = materialize(close(met, rest_pairs(candidates, percent), percent))
    links = links.union(verify(docs, met, more, n, percent))
    labels = components(links)
    named = nodes.select("key", "first_doc").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    smallest = named.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    members = named.join(smallest, "label").select("key", "component_id")
    return table.select("doc_id", F.col("size").alias("n_shingles"), "key").join(members, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def remove_near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id, once.
    Documents without words or without doc_id stay. Same columns."""
    found = materialize(classes(docs, n, percent).where("doc_id is not null"))
    gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct())
    twice = fresh("repeated", docs.columns)
    repeated = materialize(found.where("n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias(twice)))
    kept = join_narrow(docs, gone, "doc_id", "left_anti")
    if not repeated.limit(1).count():
        return kept.select(*docs.columns)
    some = join_narrow(kept, repeated, "doc_id", "left")
    once = some.where(F.col(twice)).dropDuplicates(["doc_id"])
    return some.where(F.col(twice).isNull()).unionByName(once).select(*docs.columns)
