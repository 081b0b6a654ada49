import random
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.functions import arrays as ar
from tessera.operators import tokenizers
from tessera.operators.packing import pack_blocks, pad_batches
from tessera.operators.tokenizers import EOS_ID, FIRST_WORD_ID, FunctionTokenizer, HashTokenizer
from tessera.plans import training

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def one(spark, build, **values):
    df = spark.createDataFrame([tuple(v for v, _ in values.values())],
                               ", ".join(f"{k} {kind}" for k, (_, kind) in values.items()))
    return df.select(build).first()[0]


def test_truncation(spark):
    for values, last, first in (([1], [1], [1]), ([1, 2, 3], [1, 2, 3], [1, 2, 3]),
                                ([1, 2, 3, 4], [2, 3, 4], [1, 2, 3]), ([], [], [])):
        assert one(spark, ar.keep_last(F.col("x"), 3), x=(values, "array<int>")) == last
        assert one(spark, ar.keep_first(F.col("x"), 3), x=(values, "array<int>")) == first


def test_labels_and_masks(spark):
    ids = ([5, 6, 0, 7, 8], "array<int>")
    for n, want in ((2, [-100, -100, -100, 7, 8]), (4, [-100, 6, -100, 7, 8]), (9, [5, 6, -100, 7, 8]),
                    (0, [5, 6, -100, 7, 8])):
        assert one(spark, ar.target_labels(F.col("x"), F.lit(n), 0), x=ids) == want
    assert one(spark, ar.ignore_pads(F.col("x"), 0), x=ids) == [5, 6, -100, 7, 8]
    assert one(spark, ar.not_pad(F.col("x"), 0), x=ids) == [True, True, False, True, True]
    assert one(spark, ar.count_tokens(F.col("x"), 0), x=ids) == 4


def test_padding(spark):
    for side, want in (("right", [1, 2, 0, 0]), ("left", [0, 0, 1, 2])):
        assert one(spark, ar.pad_to(F.col("x"), F.lit(4), F.lit(0), side), x=([1, 2], "array<int>")) == want
        assert one(spark, ar.pad_to(F.col("x"), F.lit(2), F.lit(0), side), x=([], "array<int>")) == [0, 0]
    with pytest.raises(ValueError):
        ar.pad_to(F.col("x"), F.lit(2), F.lit(0), "top")


def test_block_size():
    assert ar.resolve_block_size(None, 100_000) == 4096
    assert ar.resolve_block_size(None, 512) == 512
    assert ar.resolve_block_size(2048, 512) == 512
    assert ar.resolve_block_size(128, 512) == 128


def test_hash_tokenizer(spark):
    tokenizer = HashTokenizer()
    text = ("a  b\ta</s>\n", "string")
    ids = one(spark, tokenizer.encode(F.col("x")), x=text)
    assert len(ids) == 4 and ids[0] == ids[2] != ids[1] and ids[3] == EOS_ID
    assert all(FIRST_WORD_ID <= i < FIRST_WORD_ID + 50_000 for i in ids[:3])
    assert one(spark, tokenizer.encode(F.col("x"), 2, add_eos=True), x=text) == ids[:2] + [EOS_ID]
    assert one(spark, tokenizer.encode(F.col("x"), 3, add_special=True), x=text) == ids[:3]
    assert one(spark, tokenizer.encode(F.col("x")), x=("", "string")) == []


def word_lengths():
    return lambda texts: [[len(w) for w in t.split()] for t in texts]


def test_function_tokenizer_in_every_job(spark):
    tokenizer = FunctionTokenizer(word_lengths, 0, 99, " eosword", 4096)
    rows = spark.createDataFrame(
        [(1, "aa b[[SEP]]ccc", "x[[SEP]]good one", "bad")],
        "qid long, text string, accepted string, rejected string")
    table = training.prepare_sft(rows, tokenizer, template_name="plain").collect()
    assert [(r.input_ids, r.labels) for r in table] == [([2, 1, 3, 7], [-100, -100, 3, 7])]
    encdec = training.prepare_sft(rows, tokenizer, lm_type="encdec", template_name="plain").first()
    assert (encdec.input_ids, encdec.labels) == ([2, 1], [3, 7])
    pair = training.prepare_preference(rows, tokenizer, template_name="plain").first()
    assert pair.input_ids_accepted == [2, 1, 4, 3, 7] and pair.labels_rejected == [-100, -100, 3, 7]
    assert pair.attention_mask == [True] * 4
    assert training.prepare_classification(rows, tokenizer).first().input_ids == [2, 1]


def test_sft_rules(spark):
    rows = spark.createDataFrame([
        (1, "q[[SEP]]a[[SEP]]r[[SEP]]b[[SEP]]open", -1),
        (2, "q[[SEP]]a[[SEP]]r[[SEP]]", -1),  # empty answer
        (3, "only a question", -1),
        (4, None, -1),
        (5, "w " * 30 + "[[SEP]]long", -1),
    ], "qid long, text string, trainable_round int")
    got = training.conversation_pairs(rows).collect()
    assert {(r.qid, r.source[:70], r.target) for r in got if r.qid == 1} == {
        (1, "### User: q### Assistant: a### User: r", "### Assistant: b")}
    assert sorted(r.qid for r in got) == [1, 5]
    assert {r.reason: r.n for r in training.unusable_conversations(rows).collect()} == {
        "empty answer": 1, "no complete turn": 1, "no text": 1}
    lengths = {r.qid: len(r.input_ids) for r in training.prepare_sft(rows, block_size=36).collect()}
    assert set(lengths) == {1}  # 35 of 36 would pass, row 5 has 36
    assert set(r.qid for r in training.prepare_sft(rows, block_size=37).collect()) == {1, 5}


def test_turn_choice_reaches_every_turn(spark):
    text = "[[SEP]]".join(f"{'q' if n % 2 == 0 else 'a'}{n}" for n in range(6))
    rows = spark.range(200).select(F.col("id").alias("qid"), F.lit(text).alias("text"))
    targets = {r.target for r in training.conversation_pairs(rows, "plain").collect()}
    assert targets == {"a1", "a3", "a5"}
    last = rows.withColumn("trainable_round", F.lit(-1))
    assert {r.target for r in training.conversation_pairs(last, "plain").collect()} == {"a5"}


def test_classification_label_defaults(spark):
    rows = spark.createDataFrame([(1, "a b[[SEP]]c", None), (2, None, 1), (3, "a", 1)],
                                 "qid long, text string, label int")
    got = {r.qid: (len(r.input_ids), r.labels) for r in training.prepare_classification(rows).collect()}
    assert got == {1: (2, -100), 3: (1, 1)}
    assert training.prepare_classification(rows.drop("label")).first().labels == -100


def test_preference_truncates_from_the_left_and_drops_incomplete(spark):
    rows = spark.createDataFrame(
        [(1, "q[[SEP]]g", "a b c d e", "r"), (2, "q", None, "r")],
        "qid long, text string, accepted string, rejected string")
    table = training.prepare_preference(rows, block_size=6).collect()
    assert [r.qid for r in table] == [1] and len(table[0].input_ids_accepted) == 6
    assert table[0].input_ids_accepted[-1] == EOS_ID
    # What lies beyond two blocks is cut off before the last block is taken.
    short = training.prepare_preference(rows, block_size=4).first()
    assert short.input_ids_accepted[-1] != EOS_ID and len(short.input_ids_accepted) == 4
    assert training.incomplete_pairs(rows).first().n_incomplete == 1


def brute_blocks(rows, block, group, keep_tail):
    """Blocks per group of consecutive rows, by plain concatenation."""
    out = {}
    groups = {}
    for row_id, ids in sorted(rows):
        groups.setdefault(row_id // group, []).extend(ids)
    for g, ids in groups.items():
        for b in range(0, len(ids), block):
            if keep_tail or b + block <= len(ids):
                out[(g, b // block)] = ids[b:b + block]
    return out


@pytest.mark.parametrize("partitions", [1, 4, 16])
@pytest.mark.parametrize("keep_tail", [False, True])
def test_packing(spark, partitions, keep_tail):
    draw = random.Random(partitions)
    rows = [(n, list(range(n * 100, n * 100 + draw.choice([0, 0, 1, 3, 7, 8, 40])))) for n in range(200)]
    df = spark.createDataFrame(rows, "row_id long, input_ids array<int>").repartition(partitions)
    blocks = pack_blocks(df, 8, group_rows=30, keep_tail=keep_tail).collect()
    assert {(r.pack_group, r.block): r.input_ids for r in blocks} == brute_blocks(rows, 8, 30, keep_tail)
    assert all(r.labels == r.input_ids for r in blocks)


def test_packing_shuffles_once(spark):
    df = spark.createDataFrame([(1, [1])], "row_id long, input_ids array<int>").repartition(2)
    plan = pack_blocks(df, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_packing_from_files(spark, tmp_path):
    lines = [" ".join(f"w{n}" for n in range(k % 7)) for k in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines[:1700]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(lines[1700:]) + "\n")
    paths = f"{tmp_path}/a.txt,{tmp_path}/b.txt"
    whole = training.pretraining_from_files(spark, paths, block_size=64, keep_tail=True, group_rows=500)
    rows = whole.collect()
    assert sum(len(r.input_ids) for r in rows) == sum(k % 7 + 1 for k in range(3000))
    full = training.pretraining_from_files(spark, paths, block_size=64, group_rows=500).collect()
    assert all(len(r.input_ids) == 64 for r in full) and 0 < len(full) < len(rows)


def test_packing_from_files_does_not_depend_on_splits(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("\n".join(f"{name}{k} " * (k % 9) for k in range(2500)) + "\n")
    before, found = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("134217728", "3000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            blocks = training.pretraining_from_files(spark, str(tmp_path), block_size=64)
            found.append(sorted((r._path, r.pack_group, r.block, r.input_ids) for r in blocks.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] and len(found[0]) > 100


def test_padded_batches(spark):
    rows = [(n, [1] * n, [True] * n) for n in range(10)]
    df = spark.createDataFrame(rows, "row_id long, input_ids array<int>, attention_mask array<boolean>")
    for side in ("left", "right"):
        for r in training.training_batches(df, 4, side=side).collect():
            width = {0: 3, 1: 7, 2: 9}[r.batch_id]
            fill = [0] * (width - r.row_id)
            ones = [1] * r.row_id
            assert r.input_ids == (ones + fill if side == "right" else fill + ones)
            assert sum(r.attention_mask) == r.row_id and len(r.attention_mask) == width
    fixed = pad_batches(df.drop("attention_mask"), 4, {"input_ids": 0}, max_length=12).collect()
    assert {len(r.input_ids) for r in fixed} == {12}


def test_vocabulary_look_up(spark):
    texts = [(1, "the cat the dog"), (2, "the </s> cow"), (3, ""), (4, None), (5, "unknown the")]
    df = spark.createDataFrame(texts, "k long, text string")
    vocabulary = tokenizers.build_vocabulary(df.where("k <= 2"), "text")
    entries = {r.token: r.id for r in vocabulary.collect()}
    assert entries == {"the": 3, "cat": 4, "cow": 5, "dog": 6}
    want = {1: [3, 4, 3, 6], 2: [3, 2, 5], 3: [], 4: None, 5: [1, 3]}
    encoded = tokenizers.encode_with_vocabulary(df, "text", vocabulary)
    assert {r.k: r.input_ids for r in encoded.collect()} == want
    keyed = spark.createDataFrame([(1, "the"), (1, "cat"), (None, "cow"), (None, "cow")], "k long, text string")
    encoded = tokenizers.encode_with_vocabulary(keyed, "text", vocabulary).collect()
    assert sorted((str(r.k), r.input_ids) for r in encoded) == [("1", [3]), ("1", [4]), ("None", [5]), ("None", [5])]
    assert tokenizers.build_vocabulary(df.where("k <= 2"), "text", max_size=2).count() == 2


def test_padding_then_stripping_gives_the_rows_back(spark):
    table = spark.createDataFrame([(n, [n + 1] * (n % 5)) for n in range(23)], "row_id long, input_ids array<int>")
    padded = training.training_batches(table, 6)
    stripped = padded.select("row_id", F.filter("input_ids", lambda x: x != 0).alias("input_ids"))
    assert sorted(stripped.collect()) == sorted(table.collect())


def test_long_preference_texts_stay_whole(spark, monkeypatch):
    """Nothing is cut off by dpo_truncate, in its SQL either."""
    from tessera.registry import token_queries

    answers = [" ".join(f"{name}{n}" for n in range(length)) for name, length in (("a", 40), ("b", 3), ("c", 9000))]
    rows = spark.createDataFrame(
        [(1, "Case 1[[SEP]]" + answers[0], answers[1], answers[2])], "qid long, text string, accepted string, rejected string")
    monkeypatch.setattr(token_queries.preference_queries, "preference_dataset", lambda spark, sf_dir: rows)
    row = token_queries.dpo_truncate(spark, None).first()
    around = len("### User: Case 1 ### Assistant: </s>".split())
    for suffix, length in (("", 40), ("_accepted", 3), ("_rejected", 9000)):
        for name in ("input_ids", "labels", "attention_mask"):
            assert len(row[name + suffix].split()) == around + length
    assert not re.search(r"\[-?\d*:-?\d*\]", token_queries.SQL["dpo_truncate"])


def test_labels_and_masks_of_odd_ids(spark):
    """Rows with padding, with nulls and without either agree with a plain loop."""
    lists = [[], [5], [5, 6, 7], [0], [5, 0, 7], [5, None, 7], [None, 0], list(range(1, 9)), None]
    rows = [(k, ids, n) for k, ids in enumerate(lists) for n in (0, 1, 2, 8, 20, None)]
    df = spark.createDataFrame(rows, "k int, x array<int>, n int").select(
        "x", "n", ar.target_labels(F.col("x"), F.col("n"), 0).alias("labels"), ar.not_pad(F.col("x"), 0).alias("mask"),
        ar.keep_last(F.col("x"), 2).alias("kept"))
    for row in df.collect():
        if row.x is None:
            assert row.labels is None and row.mask is None and row.kept is None
            continue
        hidden = 0 if not row.n else len(row.x) - row.n
        assert row.labels == [-100 if i < hidden or x == 0 else x for i, x in enumerate(row.x)]
        assert row.mask == [None if x is None else x != 0 for x in row.x]
        assert row.kept == row.x[-2:]


def test_preference_answers_take_each_step_together(spark):
    rows = spark.createDataFrame([(1, "q[[SEP]]g", "a b", "r")], "qid long, text string, accepted string, rejected string")
    plan = training.prepare_preference(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project [") <= 5
    # Label by label only for rows with padding: one function for the labels and one for the mask of each answer.
    assert plan.count("ELSE transform(") == 6
