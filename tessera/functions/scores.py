"""Math over logit arrays and log-probability columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import let

LOSS_TYPES = ("sigmoid", "hinge", "ipo", "kto_pair")


def _as_doubles(values: Column) -> Column:
    return values.cast("array<double>")


def log_normalizer(logits: Column) -> Column:
    """max + ln(sum(exp(x - max))): the denominator of log-softmax."""
    def normalizer(values: Column) -> Column:
        return let(F.array_max(values), lambda top: top + F.log(F.aggregate(
            values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))))

    return let(_as_doubles(logits), normalizer)


def softmax(logits: Column) -> Column:
    return let(log_normalizer(logits), lambda z: F.transform(
        _as_doubles(logits), lambda x: F.exp(x - z)))


def argmax(values: Column) -> Column:
    """0-based position of the largest value, the first one on ties."""
    return let(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def token_log_prob(logits: Column, token_id: Column, normalizer: Column) -> Column:
    """Log-softmax at `token_id`; null for an id outside the vocabulary."""
    return F.get(_as_doubles(logits), token_id.cast("int")) - normalizer


def entropy(logits: Column, normalizer: Column) -> Column:
    """-sum(p * ln p) of the softmax over `logits`."""
    return let(normalizer, lambda z: -F.aggregate(
        _as_doubles(logits), F.lit(0.0), lambda acc, x: acc + F.exp(x - z) * (x - z)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def log_sigmoid(x: Column) -> Column:
    """Stable for large positive and negative `x`."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def preference_logit(policy_chosen: Column, policy_rejected: Column, ref_chosen: Column,
                     ref_rejected: Column, reference_free: bool = False) -> Column:
    """Policy log-ratio minus reference log-ratio of a pair."""
    policy = policy_chosen - policy_rejected
    return policy if reference_free else policy - (ref_chosen - ref_rejected)


def pair_loss(loss_type: str, logit: Column, beta: float = 1.0,
              label_smoothing: float = 0.0) -> Column:
    """Loss of one pair; `kto_pair` needs batch statistics and is a plan."""
    scaled = F.lit(float(beta)) * logit
    if loss_type == "sigmoid":
        return (-log_sigmoid(scaled) * F.lit(1.0 - label_smoothing)
                - log_sigmoid(-scaled) * F.lit(float(label_smoothing)))
    if loss_type == "hinge":
        return F.greatest(F.lit(0.0), F.lit(1.0) - scaled)
    if loss_type == "ipo":
        return F.pow(logit - F.lit(1.0 / (2.0 * beta)), F.lit(2.0))
    raise ValueError(f"unknown loss type: {loss_type}; expected one of {LOSS_TYPES}")
