import corpus_pipeline
import pytest
from frames import SF_DIR, documents, labels, wild
from pyspark.sql import functions as F
from tessera.llm import near_duplicates, quality, rules


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's result on all that its predecessor kept."""
    docs, found = documents(spark).cache(), []
    for _, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, SF_DIR).cache()
        found.append(docs)
    return found


def ids(frame):
    return {r.doc_id for r in frame.select("doc_id").collect()}


def test_stages_keep_the_columns(spark, stages):
    assert [len(corpus_pipeline.STAGES), *(f.columns for f in stages[:-1])] == [4] + [documents(spark).columns] * 3


def test_each_stage_takes_effect_as_its_operator_says(spark, stages):
    classified, ruled, single, packed = stages
    model = quality.fit_quality(documents(spark), labels(spark))
    scores = quality.score_quality(documents(spark), model)
    assert ids(classified) == ids(scores.where("predicted = 1"))
    assert ids(ruled) == ids(rules.quality_rules(classified).where("kept"))
    assert ids(single) == ids(near_duplicates.near_duplicates(ruled).where("kept"))
    assert ids(packed) == ids(single) and 0 < single.count() < documents(spark).count()


def test_run_is_the_stages_in_turn(spark, stages):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in rows.collect()} == {
        (r.doc_id, r.piece, r.ids_crc32) for r in stages[-1].collect()}


def test_odd_rows(spark):
    docs = wild(spark)
    for _, apply in corpus_pipeline.STAGES[:-1]:
        assert apply(spark, docs, SF_DIR).columns == docs.columns
    single = corpus_pipeline.near_duplicate_removal(spark, docs, SF_DIR)
    assert sorted((r.doc_id for r in single.collect()), key=str) == sorted([1, 2, 3, 4, 5, None, None, 7, 8, 9], key=str)
    assert corpus_pipeline.best_fit_packing(spark, single, SF_DIR).count() >= 10


def test_texts_of_one_id_go_by_themselves(spark):
    copied = "the cat sat on the mat with the dog and the bird of the house"
    unique = "nothing else in this table says what is said in this one text"
    docs = spark.createDataFrame([(1, copied), (5, copied), (5, unique), (5, None)], "doc_id long, text string")
    single = corpus_pipeline.near_duplicate_removal(spark, docs, SF_DIR)
    assert {tuple(r) for r in single.collect()} == {(1, copied), (5, unique), (5, None)}


def test_columns_named_like_measures_keep_their_values(spark):
    own = ["n_words", "kept", "n_lines", "failed_rules", "_text_hash", "text_hash", "id", "hash", "document", "doc"]
    docs = documents(spark).withColumns({name: F.concat(F.lit(f"own {name} "), "doc_id") for name in own})
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_duplicate_removal):
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == docs.columns and kept.count() > 0
        assert all(row[name] == f"own {name} {row.doc_id}" for row in kept.collect() for name in own)
