"""Mapping free-text diagnoses to reference codes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..operators.hooks import Embedder, TrigramEmbedder
from ..operators.nearest import nearest_reference
from ..session import stage


def code_table(texts: DataFrame, references: DataFrame, embedder: Embedder | None = None,
               **search: object) -> DataFrame:
    """(diag_text, code) for each row of `texts`, whose `diag_text` is unique.

    `references` has (ref_id, diag, diag_code). The nearest reference by L1
    distance between embeddings gives the code; ties go to the smaller id.
    """
    embedder = embedder or TrigramEmbedder()
    queries = texts.where(F.col("diag_text").isNotNull()).select("diag_text", embedder.vectors(F.col("diag_text")).alias("embedding"))
    refs = references.where(F.col("diag").isNotNull()).select(
        "ref_id", embedder.vectors(F.col("diag")).alias("embedding"))
    nearest = nearest_reference(queries, refs, "diag_text", **search)
    codes = references.select("ref_id", F.col("diag_code").alias("code"))
    # Both sides reach this join straight from their own shuffle, so adaptive
    # execution can split a code that very many texts map to. Counting first,
    # as `lookup_join` does, would run the search twice.
    return nearest.join(codes, "ref_id", "left").select("diag_text", "code")


def map_codes(df: DataFrame, columns: Mapping[str, str], references: DataFrame,
              embedder: Embedder | None = None, **search: object) -> DataFrame:
    """Add a code column for each text column: {text column: code column}.

    Every distinct text is embedded and searched once, over all columns
    together. The texts, the vectors and the finished codes are written out,
    so none is computed twice, not even when an executor is lost. Each column
    has a table of its own with the codes of its texts: one that fits
    Spark's own limit for broadcasts (sorted, its files are smaller) goes to the rows of `df`, which then do
    not move, however many texts other columns have; otherwise both sides of the column's join come straight from
    their shuffles, where adaptive execution splits a text that very many rows
    hold. Null texts get null codes.
    """
    named = [F.struct(F.lit(at).alias("at"), F.col(column).alias("diag_text")) for at, column in enumerate(columns)]
    held = stage(
        df.select(F.inline(F.array(*named))).where(F.col("diag_text").isNotNull()).distinct(), "texts")
    codes = stage(code_table(held.select("diag_text").distinct(), references, embedder, **search), "codes")
    for at, (column, out) in enumerate(columns.items()):
        own = stage(held.where(F.col("at") == at).join(codes, "diag_text").select(
            F.col("diag_text").alias(column), F.col("code").alias(out)).sortWithinPartitions(out, column), "column-codes")
        df = df.join(own, column, "left")
    return df
