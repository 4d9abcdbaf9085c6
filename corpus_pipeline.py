"""Corpus pipeline: toxic documents go, one document of each near-duplicate group
stays, documents with benchmark passages go, secrets are masked, the rest is packed into
sequences of token ids.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of
``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabwatch.llm import decontaminate, ngram_join, packing, secret_scan, toxicity
from tabwatch.session import materialize, scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Words that packing remembers in a worker, which also holds memory of the stages before, and
#: bytes of text that it works on at a time.
REMEMBERED, SLICE_BYTES = 120_000, 1 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.remove_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER, with_ids=True, remembered=REMEMBERED, slice_bytes=SLICE_BYTES)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: The model and the tokenizer have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. What a stage wrote for itself is dropped once its result is
    stored, and that result once the next one is."""
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with scratch(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir))
            result = made.pop()
            if stored:
                made.append(stored)
        stored = result
    return docs
