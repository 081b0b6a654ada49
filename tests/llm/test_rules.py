import re
from collections import Counter

import corpus_pipeline
import pytest
from frames import WILD, WILD_IDS, documents, empty, ids, labels, wild
from pyspark.sql import functions as F
from tessera.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), failed)


def base(row):
    return tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


def test_counts_of_the_table_and_of_odd_rows(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    for row in rules.quality_rules(documents(spark)).collect():
        assert base(row) == expected(texts[row.doc_id])
        assert not (row.kept and row.base_failed)
    rows = rules.quality_rules(wild(spark)).collect()
    assert ids(rows) == WILD_IDS
    texts = {row[0]: row[1] for row in WILD if row[0] is not None}
    for row in rows:
        if row.doc_id is not None:
            assert base(row) == expected(texts[row.doc_id])
    assert rules.quality_rules(empty(spark)).count() == 0


@pytest.mark.parametrize("text", [
    "a b c a b c", "a b a b a b", "a a a a", "a b", "a b c", "x a b c y a b c z", "a\x0bb\x0cc\rd a b", "\n\nx\nx\n",
    "a\x85b\u00a0c a\x85b\u00a0c", "#$ %& | <> *", "a b c d a b c d b c d"])
def test_small_texts(spark, text):
    row = rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert base(row) == expected(text)


def test_good_documents_are_kept(spark):
    judged = rules.quality_rules(documents(spark)).join(labels(spark), "doc_id").where("NOT base_failed AND quality = 1")
    assert judged.where("kept").count() >= 0.97 * judged.count()


def test_plan_has_no_python_and_no_exchange(spark):
    plan = rules.quality_rules(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan



def test_verdict_as_one_expression(spark):
    for docs in (documents(spark), wild(spark)):
        rows = rules.quality_rules(docs.withColumn("verdict", rules.passes_rules(F.col("text")))).collect()
        assert [r.verdict for r in rows] == [r.kept for r in rows]


def test_pipeline_stage_computes_measures_once(spark):
    kept = corpus_pipeline.quality_rules(spark, documents(spark), "")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 1 and kept.columns == documents(spark).columns
