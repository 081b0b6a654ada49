import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import filters


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r[0] for r in df.orderBy("n").select(build(F.col("v"))).collect()]


def test_segments_keep_empty_parts(spark):
    values = ["a", "a[[SEP]]b", "a[[SEP]]", "", "[[SEP]][[SEP]]", None]
    assert column(spark, values, tx.segments) == [
        ["a"], ["a", "b"], ["a", ""], [""], ["", "", ""], None]
    assert column(spark, values, tx.first_segment) == ["a", "a", "a", "", "", None]
    assert column(spark, values, tx.last_segment) == ["a", "b", "", "", "", None]


def test_replace_last_segment(spark):
    build = lambda v: tx.replace_last_segment(v, F.lit("new"))
    assert column(spark, ["a", "a[[SEP]]b", "a[[SEP]]b[[SEP]]"], build) == [
        "new", "a[[SEP]]new", "a[[SEP]]b[[SEP]]new"]


def test_prompts(spark):
    one, three = "q", "q[[SEP]]a[[SEP]]r"
    assert column(spark, [one, "q[[SEP]]a", three], tx.generation_prompt) == [
        "### User: q\n\n### Assistant: ", "### User: q\n\n### Assistant: ",
        "### User: q\n\n### Assistant: a\n\n### User: r\n\n### Assistant: "]
    assert column(spark, [one, "q[[SEP]]a", three], tx.reference_answer) == ["", "a", ""]
    full = lambda v: tx.generation_prompt(v, with_last=True)
    assert column(spark, ["q[[SEP]]a"], full) == ["### User: q\n\n### Assistant: a"]
    plain = lambda v: F.array_join(tx.add_role_prefix(tx.segments(v), "plain"), "")
    assert column(spark, [three], plain) == ["qar"]
    assert column(spark, ["x### Assistant: y### Assistant: z", "none"], tx.answer_from_output) == ["z", "none"]
    with pytest.raises(ValueError):
        tx.answer_from_output(F.col("v"), "plain")
    with pytest.raises(ValueError):
        tx.template("unknown")


def test_empty_answers(spark):
    rows = spark.createDataFrame(
        [("q[[SEP]]a",), ("q[[SEP]]",), ("[[SEP]]a",), ("q",), ("q[[SEP]]a[[SEP]]r[[SEP]]",)], "text string")
    kept = [r[0] for r in filters.drop_empty_answers(rows).collect()]
    assert sorted(kept) == ["[[SEP]]a", "q", "q[[SEP]]a"]


DIAGNOSES = [
    "The most likely diagnosis is acute flu, specifically type A flu. More.",
    "The most likely diagnosis is x, specifically ends here",
    "The most likely diagnosis is: gout, maybe",
    "The probable diagnosis is gout. x",
    "So gout is the most likely diagnosis here",
    "Diagnosis is: mumps, yes",
    "Diagnosis shows mumps\nand more. x",
    "Diagnosis may be: rash, x",
    "Likely suffering from: cough. x",
    "Diagnosis shows b. The probable diagnosis is a.",
    "gout is bad",
    " gout",
    ", gout",
    "",
    "gout x",
    "gout\x1cx",
    " x",
]


def python_extract(text):
    for pattern, _ in tx.DIAGNOSIS_PATTERNS:
        hits = re.findall(pattern, text, re.DOTALL)
        if hits:
            return hits[0]
    return None


def test_extraction_follows_python(spark):
    assert column(spark, DIAGNOSES, tx.extract_diagnosis) == [python_extract(t) for t in DIAGNOSES]
    assert column(spark, [None], tx.extract_diagnosis) == [None]


def test_code_agreement(spark):
    pairs = [("A00.000", "A00.000"), ("A00.000", "A00.111"), ("A00.000", "A00.011"), ("A00.000", "B00.000"),
             ("I10", "I10"), ("I10", "I11"), (None, "A"), ("A", None), (None, None), ("A00.0", "A00.01")]
    df = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "n int, a string, b string")
    got = [r[0] for r in df.orderBy("n").select(tx.code_agreement(F.col("a"), F.col("b"))).collect()]
    want = [sum(a is not None and b is not None and a[:k] == b[:k] for k in (1, 3, 5, 7)) for a, b in pairs]
    assert got == want


def test_seeded_values(spark):
    def drawn(partitions):
        df = spark.range(1000).repartition(partitions).select(
            "id", tx.seeded_uniform_int(7, F.lit(3), F.col("id")).alias("a"),
            tx.seeded_uniform_int(8, F.lit(3), F.col("id")).alias("b"))
        return df.orderBy("id").collect()

    rows = drawn(1)
    assert {r.a for r in rows} == {1, 2, 3}
    assert any(r.a != r.b for r in rows)
    assert rows == drawn(7)


def test_unknown_length_is_kept(spark):
    rows = spark.createDataFrame([(1, 0), (2, None), (3, 5)], "qid int, response_token_len int")
    assert sorted(r.qid for r in filters.drop_zero_length(rows).collect()) == [2, 3]


def test_chat_message(spark):
    got = column(spark, ["case"], lambda v: tx.chat_message(v, "Explain."))
    assert [(m.role, m.content) for m in got[0]] == [("user", "case\n\nExplain.\n")]
