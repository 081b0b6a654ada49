"""Aggregates over token scores, pairs and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as ar, scores as sc
from .skew import lookup_join

# Fixed value: keeps a mean over no tokens finite.
MEAN_EPS = 1e-8

# Metric names and the column each one averages.
PAIR_METRICS = {
    "rewards/chosen": "reward_chosen",
    "rewards/rejected": "reward_rejected",
    "rewards/accuracies": "reward_accuracy",
    "rewards/margins": "reward_margin",
    "logps/rejected": "policy_rejected",
    "logps/chosen": "policy_chosen",
}


def masked_mean(value: Column, mask: Column) -> Column:
    """sum(value * mask) / (sum(mask) + eps), as an aggregate."""
    weight = mask.cast("double")
    return F.sum(value * weight) / (F.sum(weight) + F.lit(MEAN_EPS))


def accuracy(df: DataFrame, predicted: str = "pred", label: str = "label",
             by: Sequence[str] = ()) -> DataFrame:
    hit = (F.col(predicted) == F.col(label)).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("acc"))


def shift_tokens(tokens: DataFrame) -> DataFrame:
    """(seq_id, pos, next_id, next_label): the token that each position is to predict.

    `tokens` has (seq_id, pos, token_id, label) and no logits; the last
    position of a sequence predicts nothing. The join key (seq_id, pos)
    spreads even one very long sequence.
    """
    following = tokens.select(
        "seq_id", (F.col("pos") - 1).alias("pos"),
        F.col("token_id").alias("next_id"), F.col("label").alias("next_label"))
    return tokens.select("seq_id", "pos").join(following, ["seq_id", "pos"])


def score_tokens(tokens: DataFrame) -> DataFrame:
    """Per position the log-probability of the next token, entropy and mask.

    `tokens` has (seq_id, pos, next_id, next_label, logits), as a model run
    writes them that knows its sequences (`shift_tokens`). Everything is
    computed where the logits are; only numbers go on.
    """
    scored = tokens.withColumn("_normalizer", sc.log_normalizer(F.col("logits")))
    return scored.select(
        "seq_id", "pos",
        sc.token_log_prob(F.col("logits"), F.col("next_id"), F.col("_normalizer")).alias("log_prob"),
        sc.entropy(F.col("logits"), F.col("_normalizer")).alias("entropy"),
        (F.col("next_label") != ar.IGNORE_INDEX).cast("int").alias("mask"),
    )


def sequence_logps(scored: DataFrame, average: bool = False) -> DataFrame:
    """Sum, or masked mean, of token log-probabilities per sequence."""
    value = masked_mean(F.col("log_prob"), F.col("mask")) if average else F.sum(
        F.col("log_prob") * F.col("mask"))
    return scored.groupBy("seq_id").agg(value.alias("logps"))


def add_rewards(pairs: DataFrame, beta: float = 1.0) -> DataFrame:
    """Rewards of both answers, whether the chosen one wins, by how much."""
    chosen = F.lit(float(beta)) * (F.col("policy_chosen") - F.col("ref_chosen"))
    rejected = F.lit(float(beta)) * (F.col("policy_rejected") - F.col("ref_rejected"))
    return pairs.withColumns({"reward_chosen": chosen, "reward_rejected": rejected}).withColumns({
        "reward_accuracy": (F.col("reward_chosen") > F.col("reward_rejected")).cast("double"),
        "reward_margin": F.col("reward_chosen") - F.col("reward_rejected"),
    })


def preference_loss(pairs: DataFrame, loss_type: str = "sigmoid", beta: float = 1.0,
                    label_smoothing: float = 0.0, reference_free: bool = False) -> DataFrame:
    """Pairs with a `loss` column; `kto_pair` gives two rows per pair."""
    if loss_type == "kto_pair":
        return _kto_loss(pairs, beta)
    logit = sc.preference_logit(
        F.col("policy_chosen"), F.col("policy_rejected"),
        F.col("ref_chosen"), F.col("ref_rejected"), reference_free)
    return pairs.withColumn("loss", sc.pair_loss(loss_type, logit, beta, label_smoothing))


def _kto_loss(pairs: DataFrame, beta: float) -> DataFrame:
    """Each half is measured against the batch mean of the other, at least 0."""
    chosen = F.col("policy_chosen") - F.col("ref_chosen")
    rejected = F.col("policy_rejected") - F.col("ref_rejected")
    batches = pairs.groupBy("batch_id").agg(
        F.greatest(F.avg(chosen), F.lit(0.0)).alias("kl_chosen"),
        F.greatest(F.avg(rejected), F.lit(0.0)).alias("kl_rejected"))
    scale = F.lit(float(beta))

    def half(name: str, gap: Column) -> Column:
        loss = F.lit(1.0) - sc.sigmoid(scale * gap)
        return F.struct(F.lit(name).alias("half"), loss.alias("loss"))

    halves = F.array(
        half("chosen", chosen - F.col("kl_rejected")),
        half("rejected", F.col("kl_chosen") - rejected))
    joined = lookup_join(pairs, batches, ["batch_id"])
    return joined.select(*pairs.columns, F.inline(halves))


def batch_metrics(pairs: DataFrame, loss_type: str = "sigmoid", beta: float = 1.0,
                  split: str = "train", **loss_args: object) -> DataFrame:
    """Long table (split, batch_id, key, value) of per-batch means.

    Evaluation metrics carry the `eval_` prefix; the loss has key `loss`.
    """
    prefix = "eval_" if split == "eval" else ""
    rewarded = add_rewards(preference_loss(pairs, loss_type, beta, **loss_args), beta)
    wide = rewarded.groupBy("batch_id").agg(
        F.avg("loss").alias("loss"),
        *[F.avg(column).alias(key) for key, column in PAIR_METRICS.items()])
    entries = [F.struct(F.lit("loss").alias("key"), F.col("loss").alias("value"))] + [
        F.struct(F.lit(prefix + key).alias("key"), F.col(f"`{key}`").alias("value"))
        for key in PAIR_METRICS]
    return wide.select(F.lit(split).alias("split"), "batch_id", F.inline(F.array(*entries)))


def metric_log(metrics: DataFrame) -> DataFrame:
    """Mean of the stored batch values per split and key."""
    return metrics.groupBy("split", "key").agg(F.avg("value").alias("value"))
