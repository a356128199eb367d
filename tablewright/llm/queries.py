"""The queries of this subpackage, for __spark_entry__.py: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import (
    exact_dedup,
    filter_audit,
    html_extract,
    language_id,
    line_dedup,
    merkle,
    mixing,
    nearest,
    ngram_jaccard,
    packing,
    quality,
    sharding,
    url_filters,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def remainder(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = docs.filter(remainder(4) != 2).select("doc_id", "text", "lang")
    out = language_id.identify(docs.select("doc_id", "text"), learned)
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parque[t]")  # a stream reads a folder or a pattern; this one fits one name only


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = quality.classify(docs, labels, train_on=remainder(5) != 0)
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "text", "n_lines", "n_dropped")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", merkle.UPPER, merkle.LOWER)
    changed = F.when(remainder(3) == 0, lowered).otherwise(F.col("text"))
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"), changed).drop("lang")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_language_id": op2_language_id,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_packing": op4_packing,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_html_extraction": op7_html_extraction,
        "op8_line_dedup": op8_line_dedup,
        "op9_mixing": op9_mixing,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_filter_audit": op12_filter_audit,
        "op13_url_filters": op13_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": exact_dedup.ORACLE_SQL,
        "op8_line_dedup": line_dedup.ORACLE_SQL,
        "op11_merkle_manifest": merkle.oracle_sql(),
        "op12_filter_audit": filter_audit.ORACLE_SQL,
        "op13_url_filters": url_filters.ORACLE_SQL,
    }
