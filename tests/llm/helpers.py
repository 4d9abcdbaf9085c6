"""Awkward documents that every operator must take, and small brute-force versions."""

import re
import zlib

import numpy as np
import public_tokenizers

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, score double, piece string, spans string, n_words int, hit_spans string, masked string, _repeated int"


def awkward(spark, more=()):
    """Nulls, empty and blank texts, a long one, repeated rows, a repeated id, a null id,
    and extra columns named like the operators' own."""
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "word " * 30_000), (5, "a b c"), (5, "a b c"), (6, "same text here for two ids"), (7, "same text here for two ids"), (None, "text without an id"), *more]
    return spark.createDataFrame([(i, t, "en", 0.5, "p", "s", 7, "h", "m", 1) for i, t in texts], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def ids_of(text):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids, 0], "<u4")
