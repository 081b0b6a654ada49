"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    alignment, bpe, fingerprints, near_duplicates, packing, periodic, pieces, quality, quotations, rules, token_counts, toxicity,
    urls)
from .common import table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(WORD_BPE))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(WORD_BPE))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents", "doc_id", "text")).select(*rules.OUTPUT)


def op6_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link_quotations(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op7_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score_toxicity(docs, toxicity.fit_lexicon(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(BYTE_BPE))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=2)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages", "page_id", "url")).drop("patterns")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_digests(table(spark, sf_dir, "documents", "doc_id", "text"),
                                     public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(PIECES))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (
    op1_quality_neighbours, op2_fingerprints, op3_bpe_encode, op4_best_fit_packing, op5_quality_rules,
    op6_quotation_links, op7_toxicity_lexicon, op8_token_counts, op9_near_duplicates, op10_url_filters,
    op11_token_alignment, op12_sentencepiece, op13_periodic_runs)}

SQL = {"op5_quality_rules": rules.SQL, "op10_url_filters": urls.SQL}
