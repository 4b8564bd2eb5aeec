"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann, fingerprints, idfiles, language, mixing, oracle, packing, quality, resampling, sharding, simhash, url_filters, vectorcodes, warc
from lectern.llm.common import table

#: The rules of op1.
RULES = [
    {"host": "com", "path": "/", "verdict": "allow"},
    {"host": "example.com", "path": "/en/", "verdict": "block"},
    {"host": "www.example.com", "path": "/en/", "verdict": "allow"},
    {"host": "net", "path": "/es/", "verdict": "block"},
    {"host": "net", "path": "/fr/", "verdict": "block"},
]


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(table(spark, sf_dir, "pages"), RULES).drop("class_url")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(table(spark, sf_dir, "documents"))
    text_crc32 = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return found.select("doc_id", "size", text_crc32.alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vectorcodes.compressed(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(vectorcodes.digest(books)).alias("codebooks_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ALL = (
    op1_url_filters, op2_best_fit_packing, op3_simhash_near_dedup, op4_mixing_sources, op5_document_fingerprints,
    op6_quality_classifier, op7_language_id, op8_token_id_output, op9_warc, op10_nearest_neighbours,
    op11_sharding, op12_vector_codes, op13_importance_resampling,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {"op1_url_filters": oracle.url_filters(RULES), "op9_warc": oracle.WARC, "op12_vector_codes": oracle.vector_codes(), "op13_importance_resampling": oracle.RESAMPLING}
