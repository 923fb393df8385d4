"""Training-data pipeline: quality rules, SimHash near-duplicates, PII surrogates, source mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before kept; ``run`` writes each result as
Parquet in the shared folder and reads it back as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabscope.llm.common import materialize
from tabscope.llm.mixing import mixed_documents
from tabscope.llm.packing import pack
from tabscope.llm.pii import replace_entities
from tabscope.llm.quality import keep_good
from tabscope.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects by the base rules and by the decision list learned from ``labels``; the columns of ``docs``."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each near-duplicate class; the columns of ``docs``."""
    return keep_one(docs)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every detected entity; all rows stay, with the columns of ``docs``."""
    return replace_entities(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum's mix, sorted by training position: a document stands in it as often as it is taken."""
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of 4096 ids: one row per piece (a document taken twice is placed twice)."""
    return pack(docs)


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", simhash_near_dedup), ("pii surrogates", pii_surrogates),
          ("mix sources", mix_sources), ("best-fit packing", best_fit_packing)]

#: The learned rules, the fingerprints and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
