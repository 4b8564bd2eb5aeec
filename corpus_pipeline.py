"""A corpus pipeline of operators from lectern.llm: from documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import language, mixing, packing, quality, similar
from lectern.llm.common import new_folder, table
from lectern.llm.queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, vocabulary("piece_bpe_32k.model"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies by SimHash as in op3, and by MinHash bands where more bits differ; both are held to 0.8 likeness of five-word shingles (see README)."""
    return similar.deduplicated(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language id", language_id),
    ("simhash near-dedup", simhash_near_dedup),
    ("mixing sources", mixing_sources),
    ("best-fit packing", best_fit_packing),
]
#: Tokenizer ids and trained models aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs.write.parquet(folder := new_folder(spark, "stage"))
            docs = spark.read.parquet(folder)
    return docs
