"""The queries of this subpackage and, where SQL can express them, their statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, importance, lm_score, minhash, mixing, quality_rules, secrets, sketch, urls, wrapper
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary lies; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.rounded(lm_score.lm_scores(table(spark, sf_dir, "documents")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edit_fingerprints(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract_main_text(table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = [
        op1_minhash_near_dedup, op2_lm_score, op3_quality_rules, op4_importance_resampling, op5_document_fingerprints,
        op6_html_extraction, op7_bpe, op8_secret_scan, op9_url_filter, op10_mix_sources,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_lm_score": lm_score.SQL, "op3_quality_rules": quality_rules.SQL}
