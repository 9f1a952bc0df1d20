"""From raw documents to token ids, in five stages.

Each stage takes the documents that the one before has kept, written as Parquet
and read again, and returns documents with the same columns; the last returns
token ids. A stage's decisions take effect: rejected, duplicate and unsampled
documents are gone for all later stages, and a document that the mix takes twice
is encoded twice.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import bpe, exact_dedup, language_id, mixing, similar
from lexispark.llm.common import release, settled, table


#: Words and chunks that an encoder remembers here, beside what the other stages' workers hold.
WORDS_KEPT = 60_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified: those without a letter, or that no codeword fits, go."""
    return language_id.keep_identified(docs, language_id.fit_on_training_rows(docs))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps the row with the largest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents of similarity 0.8 or more (five-word shingles) keeps the row with the smallest doc_id."""
    return similar.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian unsigned 32-bit) of each row, with digests of them and of the decoded text."""
    return bpe.bpe_encode(docs, bpe.vocabulary(), WORDS_KEPT, keep=False).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_duplicates),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("BPE encoding", encode),
]

#: Neither the classifier nor the search for near copies can be put in SQL: tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Each result but the last is written; what its stage stored on the way, and the result before, is deleted."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for k, (_, stage) in enumerate(first):
        before, docs = docs, settled(partial(stage, spark, docs, sf_dir), spark, f"stage{k}")
        if k:
            release(before)
    return last(spark, docs, sf_dir)
