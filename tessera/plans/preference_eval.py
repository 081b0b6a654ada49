"""Preference evaluation from token logits of both models and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import metrics

# The four sequences of a pair, by model and answer.
SEQUENCES = ("policy_chosen", "policy_rejected", "ref_chosen", "ref_rejected")


def pair_logps(tokens: DataFrame, average: bool = False) -> DataFrame:
    """One row per pair with the log-probability of each of its sequences.

    `tokens` has (pair_id, batch_id, sequence, pos, next_id, next_label,
    logits), where `sequence` is one of SEQUENCES. Pairs that lack one drop
    out; `incomplete_pairs` counts them.
    """
    scored = metrics.score_tokens(_keyed(tokens))
    logps = metrics.sequence_logps(scored, average)
    columns = [F.max(F.when(F.col("seq_id.sequence") == name, F.col("logps"))).alias(name)
               for name in SEQUENCES]
    return (
        logps.groupBy("seq_id.pair_id", "seq_id.batch_id").agg(*columns)
        .dropna(subset=list(SEQUENCES))
    )


def incomplete_pairs(tokens: DataFrame) -> DataFrame:
    """How many pairs `pair_logps` leaves out, one row per batch that has any."""
    present = tokens.groupBy("batch_id", "pair_id").agg(F.collect_set("sequence").alias("present"))
    missing = F.size(F.array_except(F.array(*[F.lit(name) for name in SEQUENCES]), "present")) > 0
    return present.where(missing).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_incomplete"))


def batch_entropies(tokens: DataFrame) -> DataFrame:
    """Mean token entropy per batch and sequence over the unmasked positions."""
    scored = metrics.score_tokens(_keyed(tokens))
    mean = metrics.masked_mean(F.col("entropy"), F.col("mask"))
    return scored.groupBy("seq_id.batch_id", "seq_id.sequence").agg(mean.alias("entropy"))


def evaluate(tokens: DataFrame, loss_type: str = "sigmoid", beta: float = 1.0,
             average: bool = False, split: str = "eval", **loss_args: object) -> DataFrame:
    """From logits to the per-batch metric table."""
    return metrics.batch_metrics(
        pair_logps(tokens, average), loss_type, beta, split, **loss_args)


def _keyed(tokens: DataFrame) -> DataFrame:
    return tokens.select(
        F.struct("pair_id", "batch_id", "sequence").alias("seq_id"),
        "pos", "next_id", "next_label", "logits")
