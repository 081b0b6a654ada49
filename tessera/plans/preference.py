"""Preference data from generated answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import text as tx
from ..operators.hooks import Embedder
from ..operators.selection import (
    attach_pairs, score_codes, select_bootstrap, select_pairs)
from ..session import stage, temporary_stages
from ..sources.readers import read_code_references, read_directory, read_records
from ..sources.writers import write_jsonl
from .codes import map_codes

_CODES = {"label": "label_code", "pred": "pred_code"}


def preference_dataset(originals: DataFrame, coded: DataFrame, scores: DataFrame,
                       seed: int = 42, validate: bool = True) -> DataFrame:
    """Originals with an `accepted` and a `rejected` answer each.

    `coded` holds the generations with `label_code` and `pred_code`.
    """
    pairs = select_pairs(score_codes(coded), scores, seed)
    return attach_pairs(originals, pairs, validate)


def bootstrapped_dataset(unhinted: DataFrame, hinted: DataFrame, seed: int = 42) -> DataFrame:
    """The best answer per question, put into its conversation's last turn."""
    best = select_bootstrap(unhinted, hinted, seed)
    return best.withColumn(
        "text", tx.replace_last_segment(F.col("text"), F.coalesce("response", F.lit(""))))


def add_codes(generations: DataFrame, references: DataFrame, embedder: Embedder | None = None,
              written: bool = False, **search: object) -> DataFrame:
    """Extract the diagnosis of each answer and code it and the label.

    The answers are read twice, for their distinct texts and to add the codes. With `written`, what was
    extracted is written out in between, for answers that joins or other costly steps make.
    """
    extracted = generations.withColumn("pred", tx.extract_diagnosis(F.col("response")))
    if written:
        extracted = stage(extracted, "extracted")
    return map_codes(extracted, _CODES, references, embedder, **search)


def finished(generations: DataFrame) -> DataFrame:
    """Without the rows of prompts that failed; a resumed run answers those again."""
    if "finish_reason" not in generations.columns:
        return generations
    return generations.where(~F.col("finish_reason").eqNullSafe(F.lit("error")))


def _references(spark: SparkSession, references: DataFrame | str) -> DataFrame:
    return read_code_references(spark, references) if isinstance(references, str) else references


def run_preference_dataset(spark: SparkSession, originals: str, generated_dir: str,
                           score_dir: str, output: str, references: DataFrame | str,
                           embedder: Embedder | None = None, seed: int = 42,
                           rows_per_file: int | None = None, compression: str | None = None) -> None:
    """The whole job from files to files; `references` may be CSV files to read."""
    with temporary_stages(spark):
        coded = add_codes(
            finished(read_directory(spark, generated_dir, schema=schemas.GENERATION)).select(
                "qid", "i", "response", "label", "response_token_len"),
            _references(spark, references), embedder)
        result = preference_dataset(
            read_records(spark, originals, fmt="jsonl"), coded,
            read_directory(spark, score_dir, schema=schemas.SCORE), seed)
        write_jsonl(result, output, "overwrite", rows_per_file, compression)


def run_bootstrapped_dataset(spark: SparkSession, generated_dir: str, hinted_dir: str,
                             output: str, references: DataFrame | str,
                             embedder: Embedder | None = None, seed: int = 42) -> None:
    """The whole job from files to files; `references` may be CSV files to read."""
    unhinted = finished(read_directory(spark, generated_dir)).withColumn("_hinted", F.lit(False))
    hinted = finished(read_directory(spark, hinted_dir)).withColumn("_hinted", F.lit(True))
    with temporary_stages(spark):
        coded = add_codes(
            unhinted.unionByName(hinted, allowMissingColumns=True), _references(spark, references), embedder)
        result = bootstrapped_dataset(
            coded.where(~F.col("_hinted")), coded.where(F.col("_hinted")), seed).drop("_hinted")
        write_jsonl(result, output, mode="overwrite")
