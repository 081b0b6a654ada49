import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scores as sc
from tessera.operators import metrics
from tessera.plans import preference_eval

PAIRS = "pair_id string, batch_id long, policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double"


def log_softmax(x):
    x = np.asarray(x, float)
    return x - x.max() - math.log(np.exp(x - x.max()).sum())


def test_softmax_argmax_entropy(spark):
    logits = [[1.0, 3.0, 3.0], [1000.0, 0.0, -1000.0], [0.0]]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(logits)], "n int, x array<double>").select(
        "n", sc.softmax(F.col("x")).alias("p"), sc.argmax(F.col("x")).alias("a"),
        sc.entropy(F.col("x"), sc.log_normalizer(F.col("x"))).alias("h"))
    for r in df.collect():
        p = np.exp(log_softmax(logits[r.n]))
        assert np.allclose(r.p, p) and r.a == int(np.argmax(logits[r.n]))
        assert math.isclose(r.h, -sum(q * math.log(q) for q in p if q > 0), abs_tol=1e-9)


def test_losses(spark):
    rows = [("a", 0, 50.0, -900.0, 0.0, 0.0), ("b", 0, -900.0, 50.0, 0.0, 0.0), ("c", 0, 1.0, 1.0, 0.5, 0.5),
            ("d", 0, -3.0, -4.0, -1.0, -2.5)]
    df = spark.createDataFrame(rows, PAIRS)
    z = {r[0]: (r[2] - r[3]) - (r[4] - r[5]) for r in rows}
    softplus = lambda x: max(x, 0.0) + math.log1p(math.exp(-abs(x)))
    cases = {
        ("sigmoid", 1.0, 0.0): lambda v: softplus(-v),
        ("sigmoid", 0.5, 0.1): lambda v: softplus(-0.5 * v) * 0.9 + softplus(0.5 * v) * 0.1,
        ("hinge", 2.0, 0.0): lambda v: max(0.0, 1 - 2 * v),
        ("ipo", 0.5, 0.0): lambda v: (v - 1.0) ** 2,
    }
    for (kind, beta, smoothing), want in cases.items():
        got = {r.pair_id: r.loss for r in metrics.preference_loss(df, kind, beta, smoothing).collect()}
        for pair, loss in got.items():
            assert math.isclose(loss, want(z[pair]), rel_tol=1e-12, abs_tol=1e-12), (kind, pair)
    free = {r.pair_id: r.loss for r in metrics.preference_loss(df, "hinge", reference_free=True).collect()}
    assert free["d"] == 0.0 and free["c"] == 1.0
    with pytest.raises(ValueError):
        metrics.preference_loss(df, "other")


def test_kto_clamps_and_splits_by_batch(spark):
    rows = [("a", 0, -3.0, -1.0, -1.0, -2.0), ("b", 0, -4.0, -2.0, -1.0, -1.5), ("c", 1, 1.0, 2.0, 0.0, 0.0)]
    got = {(r.pair_id, r.half): r.loss for r in metrics.preference_loss(
        spark.createDataFrame(rows, PAIRS), "kto_pair").collect()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    kl_chosen, kl_rejected = 0.0, 0.25  # means -2.5 and 0.25
    assert math.isclose(got["a", "chosen"], 1 - sigmoid(-2.0 - kl_rejected))
    assert math.isclose(got["a", "rejected"], 1 - sigmoid(kl_chosen - 1.0))
    assert math.isclose(got["c", "chosen"], 1 - sigmoid(1.0 - 2.0))
    assert len(got) == 6


def test_batch_metrics_and_log(spark):
    rows = [("a", 0, 2.0, 1.0, 0.0, 0.0), ("b", 0, 1.0, 2.0, 0.0, 0.0), ("c", 1, 5.0, 1.0, 0.0, 0.0)]
    table = metrics.batch_metrics(spark.createDataFrame(rows, PAIRS), "hinge", 0.5, split="eval")
    got = {(r.batch_id, r.key): r.value for r in table.collect()}
    assert got[0, "eval_rewards/accuracies"] == 0.5 and got[1, "eval_rewards/margins"] == 2.0
    assert got[0, "eval_logps/chosen"] == 1.5 and got[1, "loss"] == 0.0
    log = {r.key: r.value for r in metrics.metric_log(table).collect()}
    assert log["eval_rewards/accuracies"] == 0.75  # mean of batch means, not of rows


def test_token_scores_follow_the_shift(spark):
    draw = np.random.default_rng(3)
    rows, want = [], {}
    for pair in range(3):
        for role in preference_eval.SEQUENCES:
            length = 4 + pair
            logits = draw.normal(size=(length, 5))
            ids, labels = draw.integers(0, 5, length), None
            labels = [-100 if t < 2 else int(ids[t]) for t in range(length)]
            rows += [(pair, 0, role, t, int(ids[t]), labels[t], logits[t].tolist()) for t in range(length)]
            scored = [log_softmax(logits[t])[ids[t + 1]] for t in range(length - 1) if labels[t + 1] != -100]
            want[pair, role] = (sum(scored), sum(scored) / (len(scored) + 1e-8))
    tokens = spark.createDataFrame(rows, "pair_id long, batch_id long, sequence string, pos int, "
                                         "token_id int, label int, logits array<double>").repartition(5)
    sequence = F.struct("pair_id", "sequence").alias("seq_id")
    following = metrics.shift_tokens(tokens.select(sequence, "pos", "token_id", "label")).select(
        "seq_id.*", "pos", "next_id", "next_label")
    tokens = tokens.join(following, ["pair_id", "sequence", "pos"])
    for average in (False, True):
        for r in preference_eval.pair_logps(tokens, average).collect():
            for role in preference_eval.SEQUENCES:
                assert math.isclose(r[role], want[r.pair_id, role][average], rel_tol=1e-9)
    assert preference_eval.evaluate(tokens).count() == 7
    lacking = tokens.where("NOT (pair_id = 1 AND sequence = 'ref_chosen')")
    assert [tuple(r) for r in preference_eval.incomplete_pairs(lacking).collect()] == [(0, 1)]
    assert preference_eval.incomplete_pairs(tokens).count() == 0


def test_logits_are_not_shuffled(spark):
    tokens = spark.range(8).select(
        F.lit(0).alias("pair_id"), F.lit(0).alias("batch_id"), F.lit("ref_chosen").alias("sequence"),
        F.col("id").alias("pos"), F.lit(1).alias("next_id"), F.lit(1).alias("next_label"),
        F.array(F.lit(0.5), F.lit(1.5)).alias("logits"))
    for frame in (preference_eval.evaluate(tokens), preference_eval.batch_entropies(tokens),
                  metrics.sequence_logps(metrics.score_tokens(tokens.withColumnRenamed("pair_id", "seq_id")))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        below = [line for line in plan.splitlines() if "Exchange" in line]
        assert below and not any("logits" in line for line in below)
        assert "Join" not in plan


def test_accuracy_by_group(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("b", 2, 2)], "g string, pred int, label int")
    assert {r.g: r.acc for r in metrics.accuracy(df, by=["g"]).collect()} == {"a": 0.5, "b": 1.0}
    assert math.isclose(metrics.accuracy(df).first().acc, 2 / 3)
