"""Benchmark decontamination with training suffix arrays.

The documents are the training side. Each task cuts its documents into shards,
turns words into ids that keep the words' order, and sorts the shard's suffixes:
the suffix array. Every test suffix (a benchmark window start) is binary-searched
in every shard; the range it finds gives all verbatim matches and their places,
and neighbouring matches on one diagonal join into the longest matches.

A suffix that meets a word no benchmark item has within the compared length can
match nothing, so it is left out of the array before sorting; nothing is lost.

The benchmark is split into blocks of at most ``BLOCK_BYTES`` of text (one, for the
usual benchmark); only a block at a time is broadcast, and the blocks' hits add up
per document. Documents are never shuffled.

Defined results: null or empty text has no words and no hit; an empty benchmark
hits nothing; an item without words has no window; repeated document rows are
judged each; repeated item ids count once; a null item id counts as ''.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwatch.llm.common import annotate, field, fresh, map_batches, slices, text_bytes, words_of
from tabwatch.session import materialize

#: Words of a window.
WINDOW = 10
#: Most benchmark text broadcast at once.
BLOCK_BYTES = 16 << 20


def build_index(items: list[tuple[str, bytes]], window: int = WINDOW) -> dict:
    """Test side of one block: word ids and, for each window length, the sorted
    distinct windows with the items and places they come from."""
    split = [(name, words_of(text)) for name, text in items]
    vocab = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in split for w in ws}))}
    by_length: dict[int, list] = {}
    for k, (_, ws) in enumerate(split):
        if not ws:
            continue
        n = min(window, len(ws))
        ids = np.array([vocab[w] for w in ws], dtype=">i4")
        rows = np.lib.stride_tricks.sliding_window_view(ids, n)
        by_length.setdefault(n, []).append((np.ascontiguousarray(rows).view(f"S{4 * n}").ravel(), k))
    groups = []
    for n, parts in sorted(by_length.items()):
        keys = np.concatenate([p for p, _ in parts])
        item = np.concatenate([np.full(len(p), k) for p, k in parts])
        place = np.concatenate([np.arange(len(p)) for p, _ in parts])
        order = np.argsort(keys, kind="stable")
        distinct, first = np.unique(keys[order], return_index=True)
        groups.append((n, distinct, np.append(first, len(keys)), item[order], place[order]))
    return {"vocab": vocab, "groups": groups, "names": [name for name, _ in split]}


def shard_hits(index: dict, texts: list[bytes]):
    """Suffix-array search of one shard. Yields, for each window length n:
    (n, word position in the shard, window number, group) of every occurrence; first
    yields the documents' word offsets."""
    vocab, ids, counts = index["vocab"], [], []
    for t in texts:
        ws = words_of(t)
        counts.append(len(ws))
        ids.append(np.fromiter(map(vocab.get, ws, repeat(0)), np.int32, len(ws)))
        ids.append(np.zeros(1, np.int32))  # a match never spans two documents
    starts = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
    yield counts, starts
    seq = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    foreign = np.concatenate([[0], np.cumsum(seq == 0)])
    for group in index["groups"]:
        n, windows = group[0], group[1]
        if len(seq) < n:
            continue
        alive = np.flatnonzero(foreign[n:] == foreign[:-n])
        if not len(alive):
            continue
        heads = np.lib.stride_tricks.sliding_window_view(seq, n)[alive].astype(">i4")
        heads = np.ascontiguousarray(heads).view(f"S{4 * n}").ravel()
        order = np.argsort(heads, kind="stable")
        suffixes, ranked = alive[order], heads[order]  # the shard's suffix array
        lo = np.searchsorted(ranked, windows, "left")
        hi = np.searchsorted(ranked, windows, "right")
        found = np.flatnonzero(hi > lo)
        size = (hi - lo)[found]
        at = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        yield n, suffixes[at], np.repeat(found, size), group


def _expand(group: tuple, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For window numbers: (which of them, entry in the group's item list) for every item having the window."""
    first = group[2]
    size = first[window + 1] - first[window]
    which = np.repeat(np.arange(len(window)), size)
    entry = np.repeat(first[window] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return which, entry


def shard_matches(index: dict, texts: list[bytes]):
    """The longest verbatim matches of one shard: words of each document, the documents' word
    offsets, and for every match its first word in the shard, its item's number, its first
    word in the item and its words. Windows found one after the other, in the documents and
    in the item alike, are one match."""
    run = shard_hits(index, texts)
    counts, starts = next(run)
    parts = [np.zeros((4, 0), np.int64)]
    for n, place, win, group in run:
        which, entry = _expand(group, win)
        p, item, q = place[which], group[3][entry], group[4][entry]
        order = np.lexsort((p, p - q, item))
        p, item, q = p[order], item[order], q[order]
        first = np.flatnonzero(np.concatenate([[len(p) > 0], (np.diff(item) != 0) | (np.diff(p - q) != 0) | (np.diff(p) != 1)]))
        parts.append(np.stack([p[first], item[first], q[first], np.diff(np.append(first, len(p))) + n - 1]))
    return counts, starts, np.concatenate(parts, 1)


def _blocks(spark: SparkSession, bench: DataFrame, block_bytes: int) -> list[list[tuple[str, bytes]]]:
    """The benchmark in blocks: lazily collected, each of bounded size."""
    b = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-2 * int(total) // block_bytes)) if total > block_bytes else 1
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        rows = part.select("name", F.col("text").cast("binary").alias("text")).collect()
        yield [(r["name"], bytes(r["text"])) for r in rows]


def hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with three more columns from the longest matches: words, hit word spans (starts
    and ends alternating) and ids of items found. Returns the frame and the columns' names."""
    spark = docs.sparkSession
    name = {k: fresh(k, docs.columns) for k in ("n_words", "hit_spans", "hit_items")}
    fields = [field("n_words", "bigint"), field("hit_spans", "array<int>"), field("hit_items", "array<string>")]
    out, done = docs, False
    for items in _blocks(spark, bench, block_bytes):
        shared = spark.sparkContext.broadcast(build_index(items, window))
        if done:
            out = materialize(out)
        out = _pass(out, shared, fields, name, done)
        done = True
    return out, name


def _pass(docs, shared, fields, name, again):
    def work():
        index = shared.value

        def on_batch(batch: pa.RecordBatch):
            texts = text_bytes(batch, "text")
            old = batch.column(name["hit_spans"]).to_pylist() if again else [[]] * len(texts)
            had = batch.column(name["hit_items"]).to_pylist() if again else [[]] * len(texts)
            n_words, spans, found = [], [], []
            for i, j in slices(texts):
                counts, starts, (place, item, _, size) = shard_matches(index, texts[i:j])
                n_words += counts
                edge = np.zeros(starts[-1] + 1, np.int32)
                np.add.at(edge, place, 1)
                np.add.at(edge, place + size, -1)
                pairs = np.unique(np.stack([np.searchsorted(starts, place, "right") - 1, item], 1), axis=0)
                for k in range(j - i):
                    for s, e in zip(old[i + k][::2], old[i + k][1::2], strict=True):
                        edge[starts[k] + s] += 1
                        edge[starts[k] + e] -= 1
                on = np.concatenate([[0], np.cumsum(edge) > 0, [0]])
                begin, end = np.flatnonzero(np.diff(on) > 0), np.flatnonzero(np.diff(on) < 0)
                doc = np.searchsorted(starts, begin, "right") - 1
                own, items = [[] for _ in range(j - i)], [set(x) for x in had[i:j]]
                for d, s, e in zip(doc.tolist(), (begin - starts[doc]).tolist(), (end - starts[doc]).tolist(), strict=True):
                    own[d] += [s, e]
                for d, k in pairs.tolist():
                    items[d].add(index["names"][k])
                spans += own
                found += [sorted(x) for x in items]
            return [n_words, spans, found]

        return on_batch

    if not again:
        return annotate(docs, "text", fields, work, list(name.values()))
    base = [c for c in docs.columns if c not in name.values()]
    kept = docs.withColumnsRenamed({v: f"{v}_before" for v in name.values()})

    def work_again():
        inner = work()
        return lambda batch: inner(batch.rename_columns([c.removesuffix("_before") if c.removesuffix("_before") in name.values() else c for c in batch.schema.names]))

    return annotate(kept, "text", fields, work_again, list(name.values())).select(*base, *name.values())


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, hit words, items found and the verdict."""
    out, name = hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), bench, window, block_bytes)
    spans, items = F.col(name["hit_spans"]), F.col(name["hit_items"])
    n_hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(
        "doc_id", F.col(name["n_words"]).alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"), (F.size(spans) > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; same columns."""
    out, name = hits(docs, bench, window, block_bytes)
    return out.where(F.size(name["hit_spans"]) == 0).select(*docs.columns)


def longest_matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every longest verbatim match of at least a window: doc_id, its first word in
    the document, item_id, its first word in the item, and its words."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = [field("doc_id", "bigint"), field("doc_word", "bigint"), field("item_id", "string"), field("item_word", "bigint"), field("n_words", "bigint")]
    out = None
    for items in _blocks(spark, bench, block_bytes):
        shared = spark.sparkContext.broadcast(build_index(items, window))

        def work(shared=shared):
            index = shared.value

            def on_batch(batch: pa.RecordBatch):
                texts, ids = text_bytes(batch, "text"), batch.column("doc_id").to_pylist()
                for i, j in slices(texts):
                    _, starts, (place, item, at, size) = shard_matches(index, texts[i:j])
                    doc = np.searchsorted(starts, place, "right") - 1
                    yield [[ids[i + d] for d in doc.tolist()], (place - starts[doc]).tolist(), [index["names"][x] for x in item.tolist()], at.tolist(), size.tolist()]

            return on_batch

        part = map_batches(base, fields, work)
        out = part if out is None else out.unionByName(part)
    return out
