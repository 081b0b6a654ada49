"""Batched generation and classification over a table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from ..functions import scores as sc, text as tx
from ..operators.hooks import BucketClassifier, Classifier, EchoGenerator, Generator
from ..operators.position import take_head, take_shard, with_id
from ..operators.resume import skip_done
from ..sources.paths import matching
from ..sources.readers import read_directory
from ..sources.writers import append_results, read_results, shard_path

# Settings each decoding policy stands for, and the names they
# carry in the output.
POLICIES = {
    "default": {},
    "greedy": {"num_beams": 1, "do_sample": False},
    "sample": {"num_beams": 1, "do_sample": True},
    "contrastive": {"penalty_alpha": 0.6, "top_k": 4},
    "beam_search": {"num_beams": 5, "do_sample": False},
    "beam_sample": {"num_beams": 5, "do_sample": True},
    "group_beam_search": {"num_beams": 5, "num_beam_groups": 5},
}
OUTPUT_NAMES = {"num_return_sequences": "n", "num_beams": "best_of", "penalty_alpha": "presence_penalty"}
NOT_WRITTEN = ("do_sample", "num_beam_groups")


def policy_settings(policy: str = "default", temperature: float = 0.7, top_p: float = 1.0,
                    num_return_sequences: int = 1, **overrides: object) -> dict[str, object]:
    """The settings written next to each answer, under their output names."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    settings = dict(POLICIES[policy])
    settings.update({k: v for k, v in overrides.items() if k in settings and v is not None})
    settings.update(temperature=temperature, top_p=top_p, num_return_sequences=num_return_sequences)
    return {OUTPUT_NAMES.get(k, k): v for k, v in settings.items() if k not in NOT_WRITTEN}


def with_prompts(rows: DataFrame, template_name: str | None = None) -> DataFrame:
    """Add `prompt` (final answer blanked) and `reference` (that answer)."""
    return rows.withColumns({
        "prompt": tx.generation_prompt(F.col("text"), template_name),
        "reference": tx.reference_answer(F.col("text")),
    })


def select_work(rows: DataFrame, key: str, done: DataFrame | None = None, head: int | None = None,
                rank: int | None = None, world: int | None = None) -> DataFrame:
    """The rows this run has to do: own shard, not done yet, the first few."""
    if world and world > 1:
        rows = take_shard(rows, rank or 0, world)
    if done is not None:
        rows = skip_done(rows, done, key)
    return take_head(rows, head)


def generate(rows: DataFrame, generator: Generator | None = None, policy: str = "default",
             settings: Mapping[str, object] | None = None,
             template_name: str | None = None) -> DataFrame:
    """One row per input and returned sequence.

    An input for which the model does not return as many sequences as asked
    for keeps its rows, with an empty response and null lengths.
    """
    generator = generator or EchoGenerator()
    settings = dict(settings) if settings is not None else policy_settings(policy)
    n = int(settings.get("n", 1))
    answered = with_prompts(rows, template_name).withColumn(
        "_answers", generator.answers(F.col("prompt"), n))
    complete = F.size("_answers") == n
    per_sequence = answered.withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    ).withColumn("_answer", F.when(complete, F.get("_answers", F.col("i").cast("int"))))
    written = {k: F.lit(v) for k, v in settings.items() if not isinstance(v, (list, tuple))}
    return per_sequence.withColumns({
        "finish_reason": F.col("_answer.finish_reason"),
        "response": F.coalesce("_answer.response", F.lit("")),
        "response_token_len": F.col("_answer.response_token_len"),
        "prompt_token_len": F.when(F.col("_answer").isNotNull(),
                                   generator.prompt_length(F.col("prompt"))),
        "model_name": F.lit(generator.name),
        "policy_name": F.lit(policy),
        **written,
    }).drop("_answers", "_answer")


def _finished(rows: DataFrame, output: str, key: str) -> DataFrame | None:
    """Ids that `output` already holds, with how they ended."""
    return read_results(rows.sparkSession, output, T.StructField(key, rows.schema[key].dataType))


def run_generation(rows: DataFrame, output: str, key: str, generator: Generator | None = None,
                   resume: bool = False, head: int | None = None, rank: int | None = None,
                   world: int | None = None, rows_per_file: int | None = None,
                   most_errors: float = 0.5, compression: str | None = None, **options: object) -> str:
    """Generate and append; with `resume`, only what `output` does not hold yet.

    A finished task commits its file as a whole, so small files are not
    needed for safety; `rows_per_file` caps them where a reader wants that.
    `head` and shards go by a `row_id` column. Rows without the `key` column
    are keyed by their position in the files they were read from. A run in
    which more than `most_errors` of the answers are errors fails when it
    has written them.
    """
    rows = with_id(rows, key)
    work = select_work(rows, key, _finished(rows, output, key) if resume else None, head, rank, world)
    seen = Observation()
    answered = generate(work, generator, **options).observe(
        seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("finish_reason") == "error").alias("errors"))
    target = append_results(answered, output, rows_per_file, resume, compression)
    if seen.get["errors"] > most_errors * seen.get["n"]:
        raise RuntimeError(f"{seen.get['errors']} of {seen.get['n']} answers in {target} are errors")
    return target


def classify(table: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """Scores and prediction for each row of a prepared classification table."""
    classifier = classifier or BucketClassifier()
    tags = [c for c in ("qid", "data_group") if c in table.columns]
    scored = table.withColumn("_logits", classifier.logits(F.col("input_ids")))
    return scored.select(*tags, F.col("labels").alias("label"),
                         *predictions(F.col("_logits")), F.lit(classifier.name).alias("model_name"))


def predictions(logits: Column) -> list[Column]:
    """Softmax scores and the position of the largest logit."""
    return [sc.softmax(logits).alias("score"), sc.argmax(logits).alias("pred")]


def run_classification(table: DataFrame, output: str, classifier: Classifier | None = None,
                       resume: bool = False, rows_per_file: int | None = None, head: int | None = None,
                       rank: int | None = None, world: int | None = None, all_files: bool = False) -> str:
    """Classify and append, keyed on `qid` when resuming.

    With `rank` and `world` only that share of the rows, by their `row_id`,
    is done, and `output` is a folder that gets one file per share. With
    `all_files`, resuming skips what any share in the folder holds.
    """
    spark = table.sparkSession
    target = shard_path(output, rank, world, "inference") if world else output
    done = None
    if resume and all_files:
        key = T.StructType([T.StructField("qid", table.schema["qid"].dataType)])
        if matching(spark, output, "*.jsonl"):
            done = read_directory(spark, output, schema=key)
    elif resume:
        done = _finished(table, target, "qid")
    work = select_work(table, "qid", done, head, rank, world)
    return append_results(classify(work, classifier), target, rows_per_file, resume)
