"""A training-data pipeline over `documents`: language ID, exact and near deduplication, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Every
stage's result is written as Parquet to the shared folder and read again as the next one's docs, so a lost executor
costs the stage at hand at most.

Null, empty and letterless texts go in the first stage. Texts of any length are read whole. Rows that share a doc_id are
documents of their own; equal rows are equal texts, of which one stays. Further columns of any name are carried through
all stages but the last. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm import bpe, exact_dedup, jaccard, langid, mixing
from pointweave.llm.common import written
from pointweave.llm.queries import BYTE_BPE, tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which language ID sees no language: no text, no letter, or no clear winner. Without any
    labelled row to learn from all go."""
    return langid.accepted(docs, langid.train(docs))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays; of equal rows one, null doc_ids last."""
    return exact_dedup.deduplicate(docs)


def distinct_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.75 or more of their five-word shingles, the smallest doc_id stays."""
    return jaccard.deduplicate(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that all sources weigh the same, as many copies as there are documents, shuffled."""
    return mixing.mix(docs).select(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (little-endian unsigned 32-bit), n_tokens, and whether decoding gives the text again."""
    return bpe.round_trip(docs, tokenizer_path(BYTE_BPE), ["doc_id", "lang", "source"])


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", distinct_texts),
    ("ngram_jaccard", distinct_shingles),
    ("mix_sources", mixed_sources),
    ("bpe", token_ids),
]

#: The language model, the shingle sets and the encoder have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
