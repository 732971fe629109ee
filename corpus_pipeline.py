"""A corpus pipeline of five operators; stages take and return tables of documents.

Quality rules drop rejected documents, the n-gram Jaccard join leaves the first document of every
class, suffix-array dedup cuts repeated strings out of the texts, mixing repeats and drops documents
for the sources' target weights, and byte-level BPE encodes what is left. Every stage works on all
rows of the one before; run() writes what a stage returns and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import byte_bpe, mixing, near_duplicates, quality, suffix_dedup
from netloom.llm.shared import discard, scratch, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the cascade."""
    return quality.accepted(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates."""
    return near_duplicates.representatives(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 200 bytes that occur more than once."""
    return suffix_dedup.deduplicated(docs, replace=True).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them."""
    return mixing.mixture(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the bytes decoded from them."""
    import public_tokenizers

    return byte_bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing_sources", mixing_sources),
    ("byte_level_bpe", byte_level_bpe),
]
#: No SQL expresses the suffix and BPE stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on the way goes once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(docs.written_path)
        if before is not None:
            discard(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
