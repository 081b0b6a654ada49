"""Projections and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx


def select_known(df: DataFrame, known: Sequence[str]) -> DataFrame:
    """The known columns that exist, in the order they are listed."""
    return df.select(*[c for c in known if c in df.columns])


def drop_null_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def drop_empty_answers(df: DataFrame, column: str = "text") -> DataFrame:
    """Drop conversations in which an assistant segment is empty."""
    return df.where(~tx.has_empty_answer(tx.segments(F.col(column))))


def drop_zero_length(df: DataFrame, column: str = "response_token_len") -> DataFrame:
    """Drop rows with length 0; an unknown length stays."""
    return df.where(~F.col(column).eqNullSafe(F.lit(0)))
