import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.operators.hooks import FunctionClassifier, FunctionEmbedder, FunctionGenerator
from tessera.plans import inference, training
from tessera.sources.readers import read_records
from tessera.sources.writers import shard_path
from tessera.streaming.incremental import stream_generation

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rows_of(spark, n=10):
    return spark.range(n).select(
        F.col("id").alias("qid"), F.col("id").alias("row_id"),
        F.concat(F.lit("case "), F.col("id").cast("string"), F.lit("[[SEP]]known")).alias("text"))


def shouting():
    return lambda prompts, n: [[(p.upper(), "stop", len(p))] * n for p in prompts]


def fussy():
    def answer(prompts, n):
        if any("case 3" in p for p in prompts):
            raise RuntimeError("cannot do this one")
        return [[("ok", "stop", 1)] * (1 if "case 5" in p else n) for p in prompts]
    return answer


def test_policy_settings():
    assert inference.policy_settings() == {"temperature": 0.7, "top_p": 1.0, "n": 1}
    assert inference.policy_settings("beam_sample", num_return_sequences=2, num_beams=3) == {
        "best_of": 3, "temperature": 0.7, "top_p": 1.0, "n": 2}
    assert inference.policy_settings("contrastive")["presence_penalty"] == 0.6
    with pytest.raises(ValueError):
        inference.policy_settings("other")


def test_generate_columns(spark):
    settings = inference.policy_settings("greedy", num_return_sequences=2)
    out = inference.generate(rows_of(spark, 2), FunctionGenerator(shouting, "loud"), "greedy",
                             {**settings, "stop_token_ids": [1]}).collect()
    assert len(out) == 4 and {r.i for r in out} == {0, 1}
    assert out[0].response.startswith("### USER: CASE") and out[0].reference == "known"
    assert out[0].model_name == "loud" and out[0].best_of == 1 and "stop_token_ids" not in out[0]


def test_failed_and_short_answers(spark):
    settings = inference.policy_settings(num_return_sequences=2)
    out = inference.generate(rows_of(spark), FunctionGenerator(fussy), settings=settings).collect()
    by = {}
    for r in out:
        by.setdefault(r.qid, []).append((r.response, r.finish_reason, r.response_token_len))
    assert by[3] == [("", "error", 0)] * 2
    assert by[5] == [("", None, None)] * 2
    assert by[1] == [("ok", "stop", 1)] * 2 and len(out) == 20


def test_resume_adds_nothing_twice_and_retries_errors(spark, tmp_path):
    output = str(tmp_path / "out.jsonl")
    inference.run_generation(rows_of(spark), output, "qid", FunctionGenerator(fussy), head=4)
    read = lambda: sorted((r.qid, r.finish_reason) for r in spark.read.json(output).collect())
    assert read() == [(0, "stop"), (1, "stop"), (2, "stop"), (3, "error")]
    inference.run_generation(rows_of(spark), output, "qid", FunctionGenerator(shouting), resume=True)
    once = read()
    assert [q for q, _ in once] == [0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9] and (3, "stop") in once
    inference.run_generation(rows_of(spark), output, "qid", FunctionGenerator(shouting), resume=True)
    assert read() == once


@pytest.mark.parametrize("name", ["answers.jsonl", "answers.csv", "answers"])
def test_resume_for_every_target(spark, tmp_path, name):
    output = str(tmp_path / name)
    for _ in range(2):
        target = inference.run_generation(rows_of(spark, 4), output, "qid", FunctionGenerator(shouting), resume=True)
    read = spark.read.option("header", True).option("multiLine", True).csv(target) if name.endswith("csv") else spark.read.json(target)
    assert sorted(int(r.qid) for r in read.collect()) == [0, 1, 2, 3]


def broken():
    def answer(prompts, n):
        raise RuntimeError("never works")
    return answer


def test_a_model_that_never_works_fails_the_run(spark, tmp_path):
    with pytest.raises(RuntimeError, match="10 of 10"):
        inference.run_generation(rows_of(spark), str(tmp_path / "out.jsonl"), "qid", FunctionGenerator(broken))


def test_shares_of_a_classification_skip_what_any_share_holds(spark, tmp_path):
    table = spark.range(12).select(
        F.col("id").alias("qid"), F.col("id").alias("row_id"), F.lit(0).alias("labels"),
        F.array(F.lit(3), F.lit(4)).alias("input_ids"))
    folder = str(tmp_path / "out")
    for _ in range(2):
        for rank in range(3):
            inference.run_classification(table, folder, resume=True, rank=rank, world=3)
    inference.run_classification(table, folder, resume=True, all_files=True, rank=0, world=2, head=4)
    assert sorted(r.qid for r in spark.read.json(f"{folder}/*.jsonl").collect()) == list(range(12))


def test_shards_together_cover_the_rows(spark, tmp_path):
    output = str(tmp_path / "out.jsonl")
    for rank in range(3):
        inference.run_generation(rows_of(spark), output, "qid", resume=True, rank=rank, world=3)
    assert sorted(r.qid for r in spark.read.json(output).collect()) == list(range(10))


def test_rows_without_ids_are_keyed_by_position(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"text": f"case {n}"}) + "\n" for n in range(6)))
    rows = read_records(spark, tmp_path / "in.jsonl", order_columns=True)
    output = shard_path(str(tmp_path), stem="out")
    assert output.endswith("/out.0.1.jsonl") and shard_path("d", 2, 4) == "d/generate.2.4.jsonl"
    for _ in range(2):
        inference.run_generation(rows, output, "index", resume=True)
    got = sorted((r["index"], r.text) for r in spark.read.json(output).collect())
    assert got == [(n, f"case {n}") for n in range(6)]
    with pytest.raises(ValueError):
        inference.run_generation(rows.drop("_line"), output, "index")


def parity():
    return lambda ids: [[1.0, 2.0] if len(x) % 2 else [2.0, 1.0] for x in ids]


def test_classification_run(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b", 0), (2, "a", 1), (3, "a b c", None)], "qid long, text string, label int")
    table = training.prepare_classification(rows)
    output = str(tmp_path / "inference.jsonl")
    inference.run_classification(table.where("qid < 3"), output, FunctionClassifier(parity, "p"))
    inference.run_classification(table, output, FunctionClassifier(parity, "p"), resume=True)
    got = spark.read.json(output).collect()
    assert sorted((r.qid, r.label, r.pred, r.model_name) for r in got) == [
        (1, 0, 0, "p"), (2, 1, 1, "p"), (3, -100, 1, "p")]
    assert all(abs(sum(r.score) - 1) < 1e-12 for r in got)


def test_embedder_hook(spark):
    embedder = FunctionEmbedder(lambda: lambda texts: [[float(len(t))] for t in texts])
    df = spark.createDataFrame([(1, "abc"), (2, None)], "n int, t string").select("n", embedder.vectors(F.col("t")).alias("v"))
    assert {r.n: r.v for r in df.collect()} == {1: [3.0], 2: None}


def test_stream_takes_each_file_once(spark, tmp_path):
    source, out, state = (tmp_path / n for n in ("in", "out", "state"))
    source.mkdir()

    def land(name, ids):
        (source / name).write_text("".join(json.dumps({"qid": i, "text": f"case {i}"}) + "\n" for i in ids))

    def work():
        stream_generation(spark, str(source), str(out), str(state)).awaitTermination()
        return sorted(r.qid for r in spark.read.json(str(out)).collect())

    land("a.jsonl", [1, 2])
    assert work() == [1, 2]
    assert work() == [1, 2]
    land("b.jsonl", [3])
    assert work() == [1, 2, 3]
