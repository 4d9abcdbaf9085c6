"""Fill-in-middle by an indexable skip list over a document's tokens.

A document is cut into tokens, and its tokens are held in a skip list whose lanes are
flat arrays: lane 0 has every token, a token rises to the next lane with a chance of
one in 2^``RISE`` (by a hash of its position, so a recomputed task builds the same list).
Every link carries two widths: the units (tokens) it passes over and their code points.
A cut rank is reached by going right as long as the units passed do not exceed it and
down otherwise; the code points summed on the way are the place of the cut in the text.

The two ranks, the form and the order of the parts come from a hash of the document's
id, so an executor that is lost and replaced writes the same output.

Defined results: a null text is empty; an empty text, one that holds a marker and one
that the hash leaves alone stay as they are (``plain``); white space after the last
token's characters is a token of its own; equal ranks give an empty middle; a null id
is hashed as an empty string; repeated rows are each transformed alike; extra columns
stay, and new columns get another name where theirs would clash; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwatch.llm.common import annotate, field, fresh, text_strings

# The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents transformed and, of these, written suffix first, of 100.
RATE, SPM_RATE = 50, 80
SEED = 42
#: One token in 2^RISE is in the next lane; the longest lane without one above.
RISE, SHORT = 3, 16


def token_ends(text: str) -> np.ndarray:
    """The code point at which each token ends: after a run of other characters that
    white space follows, and at the end of the text."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space = (points == 32) | ((points >= 9) & (points <= 13))
    return np.append(np.flatnonzero(~space[:-1] & space[1:]) + 1, len(points))


class SkipList:
    """Tokens by rank. ``lanes`` goes from the sparsest lane to lane 0; link i of a lane
    starts at its i-th node (node 0 is the head, before the first token), passes over
    ``units[i]`` tokens that hold ``points[i]`` code points, and node i of a lane is
    node ``down[i]`` of the lane below."""

    def __init__(self, ends: np.ndarray):
        at = np.arange(len(ends) + 1)  # ranks of the nodes of the lane; node r stands after r tokens
        place = np.concatenate([[0], ends])
        self.lanes = [(np.diff(at), np.diff(place), at)]
        while len(at) > SHORT:
            left = 64 - RISE * len(self.lanes)
            if left <= 0:
                break
            up = np.flatnonzero(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(left) == 0)  # the head always rises
            at, place = at[up], place[up]
            self.lanes.append((np.diff(at), np.diff(place), up))
        self.lanes.reverse()

    def seek(self, rank: int) -> int:
        """Code points before the token of that rank, by widths alone."""
        node = units = points = 0
        for k, (unit_width, point_width, down) in enumerate(self.lanes):
            while node < len(unit_width) and units + unit_width[node] <= rank:
                units += int(unit_width[node])
                points += int(point_width[node])
                node += 1
            if k + 1 < len(self.lanes):
                node = int(down[node])
        return points


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers below 2^32 of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def rearrange(text: str, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[str, str, int | None, int | None, int]:
    """(output, form, code points of the prefix, of the middle, tokens) of one text."""
    ends = token_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return text, "plain", None, None, n
    tokens = SkipList(ends)
    first, second = (tokens.seek(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm_rate:
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", "spm", first, second - first, n
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", "psm", first, second - first, n


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """All rows and columns, plus ``output``, ``form``, ``prefix_chars``, ``middle_chars`` and ``n``
    (tokens)."""
    fields = [field("output", "string"), field("form", "string"), field("prefix_chars", "bigint"), field("middle_chars", "bigint"), field("n", "bigint")]
    names = []
    for f in fields:
        names.append(fresh(f.name, [*docs.columns, *names]))
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})

    def work():
        def on_batch(batch: pa.RecordBatch):
            return list(zip(*map(lambda t, i: rearrange(t, i, seed, rate, spm_rate), text_strings(batch, "text"), batch.column("doc_id").to_pylist()), strict=True))

        return on_batch

    return annotate(docs, "text", fields, work, names)


def restore(output: Column, form: Column) -> Column:
    """The text before the transformation, from an output and its form. No part holds a
    marker, so the first of each is the one that was written."""
    def between(start: str, end: str) -> Column:
        at = F.instr(output, start) + len(start)
        return F.substring(output, at, F.instr(output, end) - at)

    middle = F.substring(output, F.instr(output, MIDDLE) + len(MIDDLE), F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(transformed: DataFrame) -> DataFrame:
    """Hashes of the outputs and of the texts rebuilt from them."""
    rebuilt = restore(F.col("output"), F.col("form"))
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))
