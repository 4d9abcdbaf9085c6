"""Best-fit packing with Martello-Toth dominance reduction.

Lengths are whole numbers up to the sequence length, so the instance is a
histogram with at most ``capacity`` entries whatever the corpus holds. Only that
histogram comes to the driver. There the reduction permanently fixes sets that
dominate every other set with the same largest piece (alone, or a pair), shrinks
the instance and repeats; best fit in falling length packs the remainder. Equal
lengths are handled together, so the plan is a short list of segments: "pieces of
length s with rank r1..r2 go k to a sequence, from sequence b, at offset o".

Pieces get their rank within a length from counts per (length, bucket) and a
window per (length, bucket); buckets are dealt by hash, so a length that a third
of all pieces share is spread over many tasks.

Defined results: a null or empty text is the single id 0; repeated rows are packed
each; an empty table gives no rows; the longest piece fills a sequence alone.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.llm.common import LOWER, SLICE_BYTES, doc_columns, field, map_batches, text_slices, worker_memo
from tabwatch.session import materialize

CAPACITY = 2048
#: Words of a generation whose ids a worker remembers (memory against time: some 150 bytes each,
#: two generations), the longest of them, and words encoded at a time.
REMEMBERED, LONGEST, BLOCK = 800_000, 64, 1024
#: Pieces dealt to one bucket, and ids where pieces carry them, about.
BUCKET_ROWS, BUCKET_IDS = 50_000, 8_000_000
#: ASCII punctuation but the apostrophe, which the tokenizer joins to letters after it.
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)


def build_encoder(tokenizer_path: str, remembered: int = REMEMBERED):
    """UTF-8 texts -> list of little-endian unsigned 32-bit ids. This tokenizer ignores
    letter case and white space never enters a token, so texts are encoded word by
    word, A-Z in lower case, and words remembered. A word that ends in an ASCII letter
    and punctuation is the two one after the other, so only its parts are encoded. A
    text that may hold a special token's string keeps its case, and such a word is
    encoded whole.

    Words are remembered in two generations of at most ``remembered`` and one slice:
    when the newer is full it becomes the older, whose words are kept if they come again."""
    import os
    from array import array
    from operator import itemgetter

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok, memo = Tokenizer.from_file(tokenizer_path), worker_memo(tokenizer_path)
    memo.setdefault("new", {})
    memo.setdefault("old", {})

    def learn(words: list[bytes], known: dict[bytes, bytes]) -> None:
        """Encode words some at a time, one after the other in a text, and tell their ids apart by
        where they start; what may be a special token is encoded alone."""
        for i in range(0, len(words), BLOCK):
            part = [w.decode() for w in words[i : i + BLOCK]]
            text = " ".join(part)
            if "<|" in text:
                known.update(zip(words[i : i + BLOCK], (array("I", e.ids).tobytes() for e in tok.encode_batch_fast(part, add_special_tokens=False)), strict=True))
                continue
            e = tok.encode(text, add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            first = np.fromiter(map(itemgetter(0), e.offsets), np.int64)
            cut = (4 * np.searchsorted(first, ends)).tolist()
            ids = array("I", e.ids).tobytes()
            known.update(zip(words[i : i + BLOCK], map(ids.__getitem__, map(slice, [0, *cut[:-1]], cut)), strict=True))

    def encode(texts: list[bytes]) -> list[bytes]:
        known, old = memo["new"], memo["old"]
        split = [(t if b"<|" in t else t.translate(LOWER)).split() for t in texts]
        missing = set().union(*split).difference(known)
        again = missing.intersection(old)
        known.update(zip(again, map(old.__getitem__, again)))
        missing = missing.difference(again)
        ended = [w for w in missing if w[-1] in PUNCTUATION and b"<|" not in w]
        joined = [(w, stem, w[len(stem) :]) for w in ended if (stem := w.rstrip(PUNCTUATION))[-1:].islower()]
        wanted = missing.difference([w for w, _, _ in joined])
        for _, stem, tail in joined:
            wanted.add(stem)
            wanted.add(tail)
        wanted = wanted.difference(known)
        again = wanted.intersection(old)
        known.update(zip(again, map(old.__getitem__, again)))
        learn(list(wanted.difference(again)), known)
        for w, stem, tail in joined:
            known[w] = known[stem] + known[tail]
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in [w for w in missing | wanted if len(w) > LONGEST]:
            known.pop(w, None)
        if len(known) > remembered:
            memo["new"], memo["old"] = {}, known
        return out

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False, remembered: int = REMEMBERED, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Tokenized documents cut into pieces of at most ``capacity`` ids. ``remembered`` words
    and ``slice_bytes`` of text at a time trade a worker's memory for time."""
    fields = [field("doc_id", "bigint"), field("piece", "int"), field("start", "bigint"), field("length", "bigint"), field("ids_crc32", "bigint")] + [field("ids", "array<int>")] * with_ids

    def work():
        encode = build_encoder(tokenizer_path, remembered)

        def on_batch(batch: pa.RecordBatch):
            for ids, texts in text_slices(batch, "doc_id", "text", slice_bytes):
                rows = []
                for doc, data in zip(ids, encode(texts), strict=True):
                    data += b"\0\0\0\0"
                    for p, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        rows.append((doc, p, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] * with_ids)))
                yield list(zip(*rows, strict=True))

        return on_batch

    return map_batches(doc_columns(docs), fields, work, memo=tokenizer_path)


class Plan:
    """Sequences laid out so far, as segments, and how many pieces of a length are placed."""

    def __init__(self):
        self.segments, self.placed, self.sequences = [], {}, 0

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, size: int, n: int, each: int, first: int, offset: int) -> None:
        """n pieces of a length, each to a sequence, from sequence ``first``."""
        rank = self.placed.get(size, 0)
        self.segments.append((size, rank, rank + n, each, first, offset))
        self.placed[size] = rank + n


def reduce_by_dominance(left: dict[int, int], capacity: int, plan: Plan) -> None:
    """Fix every dominating set of one or two pieces; takes them out of ``left``.

    For the largest unfixed piece a and room r = capacity - a, with a* the largest
    other piece that fits: {a} dominates if nothing fits; {a, a*} dominates if it fills
    the sequence, if no two other pieces fit into r, or if no three fit and a* is at
    least the best pair that fits.
    """
    changed = True
    while changed:
        changed = False
        for a in sorted(left, reverse=True):
            while left.get(a):
                rest = sorted(s for s, n in left.items() if n > (s == a))
                room = capacity - a
                k = bisect.bisect_right(rest, room)
                if not k:
                    n = left[a] if a > room else 1
                    plan.put(a, n, 1, plan.open(n), 0)
                    _take(left, a, n)
                    changed = True
                    continue
                mate = rest[k - 1]
                small = _smallest(left, a, rest, 3)
                alone = len(small) < 2 or sum(small[:2]) > room
                if not (a + mate == capacity or alone or ((len(small) < 3 or sum(small) > room) and mate >= _best_pair(left, a, rest, room))):
                    break
                # as many at once as stay valid: a pair that fills always is; else the rest may change with every pair
                n = (left[a] // 2 if a == mate else min(left[a], left[mate])) if a + mate == capacity or alone else 1
                first = plan.open(n)
                if a == mate:
                    plan.put(a, 2 * n, 2, first, 0)
                    _take(left, a, 2 * n)
                else:
                    plan.put(a, n, 1, first, 0)
                    plan.put(mate, n, 1, first, a)
                    _take(left, a, n)
                    _take(left, mate, n)
                changed = True


def _take(left: dict[int, int], size: int, n: int) -> None:
    left[size] -= n
    if not left[size]:
        del left[size]


def _smallest(left, a, rest, n):
    out = []
    for s in rest:
        out += [s] * min(n - len(out), left[s] - (s == a))
        if len(out) == n:
            break
    return out


def _best_pair(left, a, rest, room):
    i, j, best = 0, len(rest) - 1, 0
    while i <= j:
        total = rest[i] + rest[j]
        if total > room or (i == j and left[rest[i]] - (rest[i] == a) < 2):
            j -= 1
        else:
            best = max(best, total)
            i += 1
    return best


def best_fit(left: dict[int, int], capacity: int, plan: Plan) -> None:
    """Best fit in falling length; pieces of a length and sequences with the same
    room and layout are handled together."""
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, sequences)
    for size in sorted(left, reverse=True):
        n = left[size]
        for room in sorted(r for r in rooms if r >= size):
            each, groups = room // size, rooms.pop(room)
            while groups and n:
                first, bins = groups.pop()
                full = min(bins, n // each)
                if full:
                    plan.put(size, full * each, each, first, capacity - room)
                    rooms.setdefault(room - each * size, []).append((first, full))
                    n -= full * each
                if full < bins:
                    used = 0
                    if n:  # the last few, into one sequence
                        plan.put(size, n, n, first + full, capacity - room)
                        rooms.setdefault(room - n * size, []).append((first + full, 1))
                        used, n = 1, 0
                    if full + used < bins:
                        groups.append((first + full + used, bins - full - used))
            if groups:
                rooms.setdefault(room, []).extend(groups)
            if not n:
                break
        if n:
            each = capacity // size
            for some, per in ((n // each, each), (1, n % each)):
                if some and per:
                    first = plan.open(some)
                    plan.put(size, some * per, per, first, 0)
                    rooms.setdefault(capacity - per * size, []).append((first, some))
    left.clear()


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A layout for ``counts`` pieces of each length."""
    left, plan = {s: n for s, n in counts.items() if n}, Plan()
    reduce_by_dominance(left, capacity, plan)
    best_fit(left, capacity, plan)
    return plan


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False, remembered: int = REMEMBERED, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """All pieces with their sequence and place in it."""
    cut = materialize(pieces(docs, tokenizer_path, capacity, with_ids, remembered, slice_bytes).withColumn("row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = solve(counts, capacity)
    table = np.array(sorted(plan.segments), np.int64).reshape(-1, 6)
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS, with_ids * sum(s * n for s, n in counts.items()) // BUCKET_IDS)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    ranked = dealt.withColumn("rank", rank.cast("long")).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    fields = [cut.schema[c] for c in keep] + [field("sequence_id", "bigint"), field("offset", "bigint")]

    def work():
        def on_batch(batch: pa.RecordBatch):
            size, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            keys = table[:, 0] << 44 | table[:, 1]
            s = table[np.searchsorted(keys, size << 44 | place, "right") - 1]
            j = place - s[:, 1]
            yield [*(batch.column(c) for c in keep), pa.array(s[:, 4] + j // s[:, 3]), pa.array(s[:, 5] + j % s[:, 3] * size)]

        return on_batch

    return map_batches(ranked.select(*keep, "rank"), fields, work)
