"""Registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_verdicts
    return quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .eliasfano import token_table
    return token_table(_table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .covertree import near_duplicates
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return pack(_table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls
    return filter_urls(_table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import languages
    return languages(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import main_text
    return main_text(_table(spark, sf_dir, "pages"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace_entities
    return replace_entities(_table(spark, sf_dir, "documents"), count_into="n_entities")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_table
    return mix_table(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_classes
    return simhash_classes(_table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bytebpe import bpe_table
    return bpe_table(_table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import alignment_table
    return alignment_table(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten
    return whiten(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = [op1_quality_rules, op2_token_files, op3_embedding_near_dedup, op4_best_fit_packing, op5_url_filters, op6_language_id,
           op7_html_extraction, op8_pii_surrogates, op9_mix_sources, op10_simhash,
           op11_byte_bpe, op12_tokenizer_alignment, op13_embedding_whitening, pipeline]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    from . import mixing
    return {"op9_mix_sources": mixing.ORACLE.format(docs="documents")}
