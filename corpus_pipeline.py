"""The corpus pipeline: five stages from raw documents to token counts and digests.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again
before the next one.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, minhash, mixing, quality_rules, secrets
from gridloom.llm.common import handed_on, table
from gridloom.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the others go."""
    return quality_rules.passed(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return minhash.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked."""
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every copy that the mix takes."""
    return bpe.encoded(docs, tokenizer_path(), keep=["doc_id", "source"])


STAGES = [
    ("quality rules", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: Similarity groups, trained scanners, Newton steps and byte pairs have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's rows written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = handed_on(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
