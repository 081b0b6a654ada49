"""Classification, token scores, preference losses, and generation runs."""

from pyspark.sql import functions as F

from ..functions import scores as sc
from ..operators import metrics
from ..operators.tokenizers import UNLIMITED
from ..plans import inference, preference_eval, training
from ..session import fresh_path
from ..sources.writers import write_jsonl
from ..streaming.incremental import stream_generation
from . import views
from .views import ids_sql, with_views, words_sql

BLOCK = 512


def clf_infer(spark, sf_dir):
    """Vectors as logits; the score of the predicted class is shown."""
    rows = views.embeddings(spark, sf_dir).select(
        "vec_id", "label", *inference.predictions(F.col("embedding")))
    return rows.select("vec_id", "label", "pred", F.size("score").alias("n_classes"),
                       F.round(F.get("score", F.col("pred")), 6).alias("top_score"))


def clf_accuracy(spark, sf_dir):
    rows = views.embeddings(spark, sf_dir).select("label", sc.argmax(F.col("embedding")).alias("pred"))
    return metrics.accuracy(rows).select(F.round("acc", 6).alias("acc"))


def clf_batch(spark, sf_dir):
    """Documents through the whole classification job."""
    table = training.prepare_classification(views.clf_input(spark, sf_dir), block_size=UNLIMITED)
    rows = inference.classify(table)
    return rows.select("qid", "label", "pred", "model_name",
                       F.round(F.get("score", F.lit(0)), 6).alias("score_0"),
                       F.round(F.get("score", F.lit(1)), 6).alias("score_1"))


def _scored_tokens(spark, sf_dir):
    return metrics.score_tokens(views.scoring_input(spark, sf_dir))


def seq_logps(spark, sf_dir):
    scored = _scored_tokens(spark, sf_dir)
    return metrics.sequence_logps(scored).select("seq_id", F.round("logps", 6).alias("logps"))


def masked_mean(spark, sf_dir):
    """Average log-probability per sequence over its unmasked positions."""
    scored = _scored_tokens(spark, sf_dir)
    return metrics.sequence_logps(scored, average=True).select("seq_id", F.round("logps", 6).alias("logps"))


def masked_entropy(spark, sf_dir):
    mean = metrics.masked_mean(F.col("entropy"), F.col("mask"))
    return _scored_tokens(spark, sf_dir).agg(F.round(mean, 6).alias("entropy"))


def _pair_tokens(spark, sf_dir):
    """Four consecutive sequences make a pair, two pairs a batch."""
    order = F.array(*[F.lit(name) for name in preference_eval.SEQUENCES])
    return views.scoring_input(spark, sf_dir).select(
        F.floor(F.col("seq_id") / 4).alias("pair_id"), F.floor(F.col("seq_id") / 8).alias("batch_id"),
        F.get(order, (F.col("seq_id") % 4).cast("int")).alias("sequence"),
        "pos", "next_id", "next_label", "logits")


def preference_logps(spark, sf_dir):
    rows = preference_eval.pair_logps(_pair_tokens(spark, sf_dir))
    return rows.select("pair_id", "batch_id", *[
        F.round(name, 6).alias(name) for name in preference_eval.SEQUENCES])


def preference_evaluation(spark, sf_dir):
    """From token logits of both models to the metrics of each batch."""
    rows = preference_eval.evaluate(_pair_tokens(spark, sf_dir))
    return rows.select("split", "batch_id", "key", F.round("value", 6).alias("value"))


def preference_incomplete(spark, sf_dir):
    """Pairs that the evaluation leaves out, for a sequence that they lack."""
    tokens = _pair_tokens(spark, sf_dir)
    cut = (F.col("pair_id") % 5 == 2) & (F.col("sequence") == "ref_chosen")
    return preference_eval.incomplete_pairs(tokens.where(~cut))


def preference_entropy(spark, sf_dir):
    rows = preference_eval.batch_entropies(_pair_tokens(spark, sf_dir))
    return rows.select("batch_id", "sequence", F.round("entropy", 6).alias("entropy"))


def _loss(loss_type, **options):
    def query(spark, sf_dir):
        rows = metrics.preference_loss(views.pair_logps(spark, sf_dir), loss_type, **options)
        return rows.select("pair_id", "policy_chosen", "policy_rejected",
                           F.round("loss", 6).alias("loss"))
    return query


def dpo_kto(spark, sf_dir):
    rows = metrics.preference_loss(views.pair_logps(spark, sf_dir), "kto_pair")
    return rows.select("pair_id", "policy_chosen", "policy_rejected", "half",
                       F.round("loss", 6).alias("loss"))


def dpo_metrics(spark, sf_dir):
    rows = metrics.batch_metrics(views.pair_logps(spark, sf_dir), split="eval")
    return rows.select("split", "batch_id", "key", F.round("value", 6).alias("value"))


def dpo_metric_log(spark, sf_dir):
    rows = views.pair_logps(spark, sf_dir)
    stored = metrics.batch_metrics(rows, label_smoothing=0.1).unionByName(
        metrics.batch_metrics(rows, "hinge", beta=0.5, split="eval"))
    return metrics.metric_log(stored).select("split", "key", F.round("value", 6).alias("value"))


_SHOWN = ("qid", "i", "prompt", "reference", "finish_reason", "response", "response_token_len",
          "prompt_token_len", "model_name", "policy_name")


def generate_batch(spark, sf_dir):
    """Two answers per conversation from the built-in generator."""
    settings = inference.policy_settings("contrastive", num_return_sequences=2)
    rows = inference.generate(
        views.sft_input(spark, sf_dir).dropna(subset=["text"]), policy="contrastive", settings=settings)
    return rows.select(*_SHOWN, "n", "top_p", "temperature", "presence_penalty", "top_k")


def generate_resume(spark, sf_dir):
    """Half the work done first, the rest on resuming, read back from the output."""
    rows = views.sft_input(spark, sf_dir).dropna(subset=["text"])
    output = fresh_path(spark, "resume") + "/answers.jsonl"
    inference.run_generation(rows.where(F.col("trainable_round") == -1), output, "qid")
    inference.run_generation(rows, output, "qid", resume=True)
    inference.run_generation(rows, output, "qid", resume=True)
    return spark.read.json(output).select("qid", "i", "response", "response_token_len")


def _classified(spark, output):
    return spark.read.json(output).select("qid", *[F.col(c).cast("int").alias(c) for c in ("label", "pred")])


def classify_resume(spark, sf_dir):
    """A third of the work done first, the rest on resuming, read back from the output."""
    table = training.prepare_classification(views.clf_input(spark, sf_dir), block_size=UNLIMITED)
    output = fresh_path(spark, "classify")
    inference.run_classification(table.where("qid % 3 = 0"), output)
    for _ in range(2):
        target = inference.run_classification(table, output, resume=True)
    return _classified(spark, target)


def classify_shards(spark, sf_dir):
    """Two of three shares, then the rest of all rows, skipping what any share holds."""
    table = training.prepare_classification(views.clf_input(spark, sf_dir), block_size=UNLIMITED)
    table = table.withColumn("row_id", F.col("qid"))
    output = fresh_path(spark, "classify")
    for rank in (0, 2):
        inference.run_classification(table, output, resume=True, rank=rank, world=3)
    inference.run_classification(table, output, resume=True, all_files=True, rank=0, world=1)
    return _classified(spark, f"{output}/*.jsonl")


def generate_stream(spark, sf_dir):
    """The same answers from a stream over landed files."""
    base = fresh_path(spark, "stream")
    write_jsonl(views.sft_input(spark, sf_dir), f"{base}/in")
    for _ in range(2):
        stream_generation(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.json(f"{base}/out").select("qid", "i", "response", "response_token_len")


QUERIES = {f.__name__: f for f in (
    clf_infer, clf_accuracy, clf_batch, seq_logps, masked_mean, masked_entropy, preference_logps,
    preference_evaluation, preference_entropy, preference_incomplete, dpo_kto, dpo_metrics,
    dpo_metric_log, generate_batch, generate_resume, classify_resume,
    classify_shards, generate_stream)}
QUERIES.update({
    "dpo_sigmoid": _loss("sigmoid", label_smoothing=0.1),
    "dpo_hinge": _loss("hinge"),
    "dpo_ipo": _loss("ipo"),
    "dpo_reference_free": _loss("sigmoid", reference_free=True),
})

_NORMALIZER = "list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))"
_TOKENS = {
    "shifted": f"""
        SELECT *, {_NORMALIZER} AS z, lead(token_id) OVER w AS next_id, lead(label) OVER w AS next_label
        FROM token_logits WINDOW w AS (PARTITION BY seq_id ORDER BY pos)""",
    "scored_tokens": """
        SELECT seq_id, logits[next_id + 1] - z AS log_prob,
          -list_sum(list_transform(logits, lambda x: exp(x - z) * (x - z))) AS entropy,
          CASE WHEN next_label <> -100 THEN 1 ELSE 0 END AS mask
        FROM shifted WHERE next_id IS NOT NULL""",
}
_ROLES = "['policy_chosen', 'policy_rejected', 'ref_chosen', 'ref_rejected']"
_PAIR_LOGPS = """
    SELECT seq_id // 4 AS pair_id, any_value(seq_id // 8) AS batch_id, {columns}
    FROM (SELECT seq_id, sum(log_prob * mask) AS logps FROM scored_tokens GROUP BY seq_id)
    GROUP BY seq_id // 4 HAVING count(*) = 4""".format(columns=", ".join(
        f"max(logps) FILTER (WHERE seq_id % 4 = {n}) AS {name}"
        for n, name in enumerate(preference_eval.SEQUENCES)))
_Z = "((policy_chosen - policy_rejected) - (ref_chosen - ref_rejected))"
_CHOSEN, _REJECTED = "(policy_chosen - ref_chosen)", "(policy_rejected - ref_rejected)"


def _log_sigmoid(x: str) -> str:
    return f"(least({x}, 0) - ln(1 + exp(-abs({x}))))"


def _loss_sql(loss: str) -> str:
    return with_views("pair_logps", f"""
        SELECT pair_id, policy_chosen, policy_rejected, round({loss}, 6) AS loss FROM pair_logps""")


def _batch_sql(split: str, loss: str, beta: float, source: str = "pair_logps") -> str:
    prefix = "eval_" if split == "eval" else ""
    values = {
        "loss": f"avg({loss})",
        f"{prefix}rewards/chosen": f"avg({beta} * {_CHOSEN})",
        f"{prefix}rewards/rejected": f"avg({beta} * {_REJECTED})",
        f"{prefix}rewards/accuracies":
            f"avg(CASE WHEN {beta} * {_CHOSEN} > {beta} * {_REJECTED} THEN 1.0 ELSE 0.0 END)",
        f"{prefix}rewards/margins": f"avg({beta} * {_CHOSEN} - {beta} * {_REJECTED})",
        f"{prefix}logps/rejected": "avg(policy_rejected)",
        f"{prefix}logps/chosen": "avg(policy_chosen)",
    }
    return " UNION ALL ".join(
        f"SELECT '{split}' AS split, batch_id, '{key}' AS key, {value} AS value "
        f"FROM {source} GROUP BY batch_id" for key, value in values.items())


_SIGMOID = f"-{_log_sigmoid(_Z)}"
_SMOOTH = f"-{_log_sigmoid(_Z)} * 0.9 - {_log_sigmoid(f'(-{_Z})')} * 0.1"
_HINGE = f"greatest(0, 1 - 0.5 * {_Z})"
_EVEN = """
    SELECT *, CASE WHEN len(segs) % 2 = 1 THEN list_append(segs, '') ELSE segs END AS full_segs FROM (
      SELECT qid, string_split(text, '[[SEP]]') AS segs FROM sft_input WHERE text IS NOT NULL)"""
_PROMPTED = """
    SELECT qid, full_segs[-1] AS reference, array_to_string(list_transform(
      list_append(full_segs[:-2], ''), lambda s, k: CASE WHEN k % 2 = 1 THEN '### User: '
      ELSE '### Assistant: ' END || s), chr(10) || chr(10)) AS prompt FROM full_turns"""
_ONE_ANSWER = with_views("sft_input", f"""
    SELECT qid, CAST(0 AS BIGINT) AS i, '[0] ' || prompt AS response,
      CAST(len({words_sql("'[0] ' || prompt")}) AS BIGINT) AS response_token_len FROM prompted""",
    full_turns=_EVEN, prompted=_PROMPTED)
_SHARE = "CAST(len(list_filter(ids, lambda x: x % 2 = {k})) AS DOUBLE) / greatest(len(ids), 1)"

SQL = {
    "clf_infer": """
        SELECT vec_id, label, pred, CAST(len(logits) AS INTEGER) AS n_classes,
          round(1 / list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))), 6) AS top_score
        FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS logits,
          CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred FROM embeddings)""",
    "clf_accuracy": """
        SELECT round(avg(CASE WHEN list_position(embedding, list_max(embedding)) - 1 = label
          THEN 1.0 ELSE 0.0 END), 6) AS acc FROM embeddings""",
    "clf_batch": with_views("clf_input", """
        SELECT qid, label, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS pred, 'buckets' AS model_name,
          round(exp(l0) / (exp(l0) + exp(l1)), 6) AS score_0,
          round(exp(l1) / (exp(l0) + exp(l1)), 6) AS score_1 FROM shares""",
        encoded=f"SELECT qid, coalesce(label, -100) AS label, {ids_sql('text')} AS ids FROM clf_input",
        shares=f"SELECT qid, label, {_SHARE.format(k=0)} AS l0, {_SHARE.format(k=1)} AS l1 FROM encoded"),
    "seq_logps": with_views("token_logits", """
        SELECT seq_id, round(sum(log_prob * mask), 6) AS logps FROM scored_tokens GROUP BY seq_id""",
        **_TOKENS),
    "masked_mean": with_views("token_logits", """
        SELECT seq_id, round(sum(log_prob * mask) / (sum(mask) + 1e-8), 6) AS logps
        FROM scored_tokens GROUP BY seq_id""", **_TOKENS),
    "masked_entropy": with_views("token_logits", """
        SELECT round(sum(entropy * mask) / (sum(mask) + 1e-8), 6) AS entropy FROM scored_tokens""",
        **_TOKENS),
    "preference_logps": with_views("token_logits", """
        SELECT pair_id, batch_id, round(policy_chosen, 6) AS policy_chosen,
          round(policy_rejected, 6) AS policy_rejected, round(ref_chosen, 6) AS ref_chosen,
          round(ref_rejected, 6) AS ref_rejected FROM token_pairs""",
        **_TOKENS, token_pairs=_PAIR_LOGPS),
    "preference_evaluation": with_views(
        "token_logits", "SELECT split, batch_id, key, round(value, 6) AS value FROM stored",
        **_TOKENS, token_pairs=_PAIR_LOGPS, stored=_batch_sql("eval", _SIGMOID, 1, "token_pairs")),
    "preference_incomplete": with_views("token_logits", """
        SELECT batch_id, count(*) AS n_incomplete FROM (
          SELECT seq_id // 4 AS pair_id, any_value(seq_id // 8) AS batch_id, count(DISTINCT seq_id) AS n
          FROM token_logits WHERE pos < 9 AND NOT (seq_id // 4 % 5 = 2 AND seq_id % 4 = 2) GROUP BY 1)
        WHERE n < 4 GROUP BY batch_id"""),
    "preference_entropy": with_views("token_logits", f"""
        SELECT seq_id // 8 AS batch_id, {_ROLES}[seq_id % 4 + 1] AS sequence,
          round(sum(entropy * mask) / (sum(mask) + 1e-8), 6) AS entropy
        FROM scored_tokens GROUP BY ALL""", **_TOKENS),
    "dpo_sigmoid": _loss_sql(_SMOOTH),
    "dpo_hinge": _loss_sql(f"greatest(0, 1 - {_Z})"),
    "dpo_ipo": _loss_sql(f"({_Z} - 0.5) * ({_Z} - 0.5)"),
    "dpo_reference_free": _loss_sql(f"-{_log_sigmoid('(policy_chosen - policy_rejected)')}"),
    "dpo_kto": with_views("pair_logps", f"""
        SELECT pair_id, policy_chosen, policy_rejected, 'chosen' AS half,
          round(1 - 1 / (1 + exp(-({_CHOSEN} - kl_rejected))), 6) AS loss FROM means
        UNION ALL SELECT pair_id, policy_chosen, policy_rejected, 'rejected',
          round(1 - 1 / (1 + exp(-(kl_chosen - {_REJECTED}))), 6) FROM means""",
        means=f"""SELECT *, greatest(avg({_CHOSEN}) OVER b, 0) AS kl_chosen,
          greatest(avg({_REJECTED}) OVER b, 0) AS kl_rejected
          FROM pair_logps WINDOW b AS (PARTITION BY batch_id)"""),
    "dpo_metrics": with_views(
        "pair_logps", "SELECT split, batch_id, key, round(value, 6) AS value FROM stored",
        stored=_batch_sql("eval", _SIGMOID, 1)),
    "dpo_metric_log": with_views("pair_logps", """
        SELECT split, key, round(avg(value), 6) AS value FROM (
          SELECT * FROM train UNION ALL SELECT * FROM eval) GROUP BY split, key""",
        train=_batch_sql("train", _SMOOTH, 1), eval=_batch_sql("eval", _HINGE, 0.5)),
    "generate_batch": with_views("sft_input", f"""
        SELECT qid, i, prompt, reference, 'stop' AS finish_reason,
          '[' || i || '] ' || prompt AS response,
          CAST(len({words_sql("prompt")}) + 1 AS INTEGER) AS response_token_len,
          CAST(len({words_sql('prompt')}) AS INTEGER) AS prompt_token_len, 'echo' AS model_name,
          'contrastive' AS policy_name, 2 AS n, CAST(1 AS DOUBLE) AS top_p,
          CAST(0.7 AS DOUBLE) AS temperature, CAST(0.6 AS DOUBLE) AS presence_penalty, 4 AS top_k
        FROM (SELECT *, unnest([CAST(0 AS BIGINT), CAST(1 AS BIGINT)]) AS i FROM prompted)""",
        full_turns=_EVEN, prompted=_PROMPTED),
    "generate_resume": _ONE_ANSWER,
    "generate_stream": _ONE_ANSWER,
}
SQL |= {name: f"SELECT qid, label, pred FROM ({SQL['clf_batch']})" for name in ("classify_resume", "classify_shards")}
