"""The corpus pipeline: from raw documents to packed sequences, in four stages.

Each stage is written as Parquet and read again by the next one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import near_duplicates, packing, quality, rules
from tessera.llm.common import table
from tessera.llm.queries import WORD_BPE
from tessera.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours vote for; learned from `documents` and `labels`."""
    known = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.fit_quality(known, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.keep_quality(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the threshold table; their columns go on as they are."""
    return docs.where(rules.passes_rules(F.col("text")))


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Of rows with the same id and text, one stays; other texts of an id stay or
    go by themselves. Rows without an id stay.
    """
    groups = near_duplicates.near_duplicates(docs, shingle=5, percent=80, with_hash=True)
    dropped = groups.where(~F.col("kept")).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    known = docs.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"])
    same = (F.col("doc.doc_id") == F.col("gone.id")) & (F.xxhash64("doc.text") == F.col("gone.hash"))
    kept = known.alias("doc").join(dropped.alias("gone"), same, "left_anti")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near-duplicate removal", near_duplicate_removal),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = stage(docs, name.replace(" ", "-"))
    return docs


# Neighbour votes, merges and genetic search are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
