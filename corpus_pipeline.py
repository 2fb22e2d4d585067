"""Corpus pipeline: from raw documents to packed token sequences.

Five stages, each on all that its predecessor kept: language identification, exact deduplication, near-duplicate
removal (five-word shingles at a Jaccard similarity of 0.8 or more, by SimHash and an exact join; one document of each
group stays), masking of personal data, and best-fit packing, whose rows hold the token ids of every piece and its
place in its sequence. Between stages the documents are a written table in the folder that driver and executors share,
which also cuts the lineage; each is removed when its successor is written, the last one stays for the rows returned.

What the first stage rejects are null texts, texts without a letter, and all texts if none is labelled: naive Bayes
names a learned language for any other, and ``lang`` tells it where a row had no label; no threshold on the score drops
further texts. Empty texts go with these. Of equal texts one row stays, of near copies one
row, repeated rows and null ids included: the least id, null after all others; the docstrings of the operators tell
how ties fall. Very long texts are taken whole, columns beyond ``doc_id, text, lang`` are kept as they are up to the
packing, and empty tables give empty ones.

SQL cannot express fingerprints, the language model or the tokenizer, so there is no oracle; ``tests/llm`` compares
the whole pipeline with a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, langid, near_copies, packing, pii
from tidemark.sources.shared import remove, shared_folder

ORACLE_SQL = None


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.distinct_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.representatives(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mask_pii", mask_personal_data),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove(spark, before)
        before = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
