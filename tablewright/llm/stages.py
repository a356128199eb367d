"""The stages of corpus_pipeline.py: each applies one operator to what the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import language_id as languages
from tablewright.llm import line_dedup as lines
from tablewright.llm import mixing as mix
from tablewright.llm import ngram_jaccard, packing as packs


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; lang is the predicted language. It learns from docs' own labels.

    A null text, or one without letters, is rejected; a null lang teaches nothing. Repeated rows stay each. Without any
    label all documents are rejected, and an empty table stays empty. Columns besides those of documents are dropped, here
    and in every stage, whatever their names.
    """
    out = languages.identify(docs, docs).filter("NOT language.rejected")
    return out.withColumn("lang", F.col("language.lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines, equal texts counted as one page; n_chars follows the text.

    A null source is a host of its own. A null text stays null with a null n_chars; a text of boilerplate only becomes
    empty and stays. Repeated rows lose the same lines; an empty table stays empty.
    """
    out = lines.drop_boilerplate_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the least id; one row of a repeated id.

    Documents with an empty set or without an id are in no group and stay.
    """
    found = ngram_jaccard.jaccard_components(docs, width=5, percent=80)
    go = found.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.filter("doc_id IS NOT NULL").join(go, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter("doc_id IS NULL")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the copy that a source takes in part ends with its last taken word.

    A document without words has nothing to weigh and stays once. A null source is a source of its own, the last. Repeated
    rows are drawn each by itself; an empty table stays empty.
    """
    out = mix.mix_sources(docs, keep=["text", "lang", "n_chars"])
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("__cut", F.explode(copies))
    text = F.when(F.col("__cut") > 0, mix.first_words(F.col("text"), F.col("__cut"))).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that hold all documents.

    A null text is empty: one piece with the id that ends a document. Repeated rows and rows without doc_id are packed each;
    an empty table gives no pieces.
    """
    return packs.pack_documents(docs, public_tokenizers.path(TOKENIZER))
