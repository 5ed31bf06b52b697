"""A corpus pipeline: language, quality, near-duplicates, source mix, packing.

Each stage takes the documents that its predecessor kept and returns documents
with all their columns; the last one returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from signalmill.llm import langid, mixing, ngramjoin, packing, quality
from signalmill.llm.queries import WORDS
from signalmill.session import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognised language."""
    return langid.keep_known(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are too short or repeat themselves."""
    return quality.keep_good(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays; of rows equal in id and text, one."""
    groups = ngramjoin.join(docs, n=5, threshold=0.8)
    others = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti").withColumn("_same", F.xxhash64("text"))
    return kept.dropDuplicates(["doc_id", "_same"]).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(WORDS), capacity=2048)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("ngram_join", ngram_join),
          ("source_mix", source_mix), ("best_fit_packing", best_fit_packing)]

#: Suffix arrays, a trained network and a tokenizer have no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
