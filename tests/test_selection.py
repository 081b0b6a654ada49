import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import selection
from tessera.operators.skew import grid_join, grid_shape
from tessera.plans import preference
from tessera.registry import views
from tessera.session import settings

GENERATIONS = ("qid long, i long, response string, response_token_len int, "
               "label_code string, pred_code string")
EXACT, NEAR, FAR = "A00.000", "A00.111", "B11.111"


def pairs(spark, generations, scores, originals):
    gen = spark.createDataFrame(generations, GENERATIONS)
    sco = spark.createDataFrame(scores, "qid long, i long, score double")
    ori = spark.createDataFrame(originals, "qid long, text string, response string")
    out = preference.preference_dataset(ori, gen, sco)
    return {r.qid: (r.accepted, r.rejected) for r in out.collect()}


def row(qid, i, response, predicted, length=5):
    return (qid, i, response, length, EXACT, predicted)


def test_each_case(spark):
    generations = [
        row(1, 0, "far", FAR), row(1, 1, "near", NEAR), row(1, 2, "exact", EXACT),  # three levels
        row(2, 0, "a", EXACT), row(2, 1, "b", EXACT), row(2, 2, "c", EXACT),  # helpful b
        row(3, 0, "only", EXACT),
        row(4, 0, "x", FAR), row(4, 1, "y", FAR),
        row(5, 0, "gone", EXACT, 0),
        row(6, 0, None, EXACT), row(6, 1, "bad", FAR),  # a null answer wins
        row(7, 0, "a", EXACT), row(7, 1, "b", EXACT),  # null score is the lowest
        row(8, 0, "a", EXACT), row(8, 1, "b", EXACT),  # two scores for the first
        row(None, 0, "lost", EXACT),
    ]
    scores = [(2, 0, 0.1), (2, 1, 0.9), (2, 2, 5.0), (7, 1, -3.0), (8, 0, 0.5), (8, 0, 0.4),
              (8, 1, 9.0), (None, 0, 1.0)]
    originals = [(q, f"t{q}", f"gold{q}") for q in range(1, 10)]
    assert pairs(spark, generations, scores, originals) == {
        1: ("exact", "near"), 2: ("b", "a"), 3: ("only", "only"), 4: ("gold4", "x"),
        5: (None, None), 6: (None, "bad"), 7: ("b", "a"), 8: ("a", "a"), 9: (None, None)}


def test_unknown_length_takes_part(spark):
    got = pairs(spark, [row(1, 0, "a", EXACT, None), row(1, 1, "b", FAR)], [], [(1, "t", "g")])
    assert got == {1: ("a", "b")}


def test_repeated_original_is_an_error(spark):
    with pytest.raises(ValueError):
        pairs(spark, [row(1, 0, "a", EXACT)], [], [(1, "t", "g"), (1, "u", "h")])


def step_by_step(generations, scores, originals, seed=42):
    """The selection as a sequence of list operations."""
    import hashlib

    def agreement(a, b):
        return sum(a[:k] == b[:k] for k in (1, 3, 5, 7))

    rows = []
    for qid, i, response, length, truth, predicted in sorted(generations, key=lambda r: (r[0], r[1])):
        matches = sorted((s for q, j, s in scores if (q, j) == (qid, i)), reverse=True) or [None]
        if length != 0:
            for score in matches:
                tie = hashlib.md5(f"{seed}|{qid}|{i}".encode()).hexdigest()
                rows.append((qid, agreement(truth, predicted), score, response, tie, len(rows)))
    result = {}
    for qid, _, gold in originals:
        mine = [r for r in rows if r[0] == qid]
        levels = sorted({r[1] for r in mine}, reverse=True)
        if not mine:
            chosen = []
        elif len(levels) > 1:
            chosen = [next(r for r in mine if r[1] == level) for level in levels[:2]]
        elif levels[0] == 4:
            chosen = mine[:2]
        else:
            chosen = [mine[0], (qid, 5, 1.0, gold, "", 0)]
        low = float("-inf")
        chosen.sort(key=lambda r: (-r[1], -(low if r[2] is None else r[2]), r[4], r[5]))
        result[qid] = (chosen[0][3], chosen[-1][3]) if chosen else (None, None)
    return result


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_against_step_by_step_selection(spark, partitions):
    draw = random.Random(partitions)
    generations = []
    for qid in range(60):
        for i in range(draw.randint(0, 6) if qid else 3000):  # question 0 is hot
            generations.append(row(qid, i, f"r{qid}-{i}", draw.choice([EXACT, NEAR, FAR] if qid % 3 else [EXACT]),
                                   draw.choice([0, None, 3, 4])))
    scores = [(g[0], g[1], draw.choice([0.5, 1.0])) for g in generations for _ in range(draw.choice([0, 1, 1, 2]))]
    originals = [(q, f"t{q}", f"gold{q}") for q in range(62)]
    draw.shuffle(generations)
    gen = spark.createDataFrame(generations, GENERATIONS).repartition(partitions)
    sco = spark.createDataFrame(scores, "qid long, i long, score double").repartition(partitions)
    ori = spark.createDataFrame(originals, "qid long, text string, response string")
    out = {r.qid: (r.accepted, r.rejected) for r in preference.preference_dataset(ori, gen, sco).collect()}
    small = [s for s in scores if s[0] or s[1] < 50]
    assert out == step_by_step([g for g in generations if g[0] or g[1] < 50], small, originals)


def test_pruning_comes_before_the_shuffle(spark):
    gen = spark.createDataFrame([row(1, 0, "a", EXACT)], GENERATIONS)
    sco = spark.createDataFrame([(1, 0, 1.0)], "qid long, i long, score double")
    plan = selection.select_pairs(
        selection.score_codes(gen), sco)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "CartesianProduct" not in plan
    assert plan.index("Final") < plan.index("Partial")


def test_score_join_matches_null_keys_and_fans_out(spark):
    gen = spark.createDataFrame([(1, 0), (None, None), (2, 0), (None, 1)], "qid long, i long")
    sco = spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0), (None, None, 3.0)], "qid long, i long, score double")
    got = sorted(((r.qid, r.i, r.help_score) for r in selection.attach_scores(gen, sco).collect()), key=str)
    assert got == sorted([(1, 0, 1.0), (1, 0, 2.0), (None, None, 3.0), (2, 0, None), (None, 1, None)], key=str)
    assert [(r.qid, r.n) for r in selection.duplicate_keys(sco, ["qid", "i"]).collect()] == [(1, 2)]


def test_level_classes(spark):
    gen = spark.createDataFrame(
        [row(1, 0, "a", EXACT), row(1, 1, "b", EXACT), row(2, 0, "a", FAR), row(3, 0, "a", EXACT),
         row(3, 1, "a", NEAR), row(None, 0, "a", FAR)], GENERATIONS)
    got = {r.qid: (r.n_levels, r.top_score, r.selection_case)
           for r in selection.level_classes(selection.score_codes(gen)).collect()}
    assert got == {1: (1, 4, "exact"), 2: (1, 0, "inexact"), 3: (2, 4, "ranked")}


def test_bootstrap_prefers_codes_then_unhinted(spark):
    plain = [row(1, 0, "p", NEAR), row(2, 0, "p", NEAR), row(3, 0, "p", EXACT, 0)]
    hinted = [row(1, 0, "h", EXACT), row(2, 0, "h", NEAR), row(3, 0, None, FAR)]
    text = F.concat(F.lit("case "), F.col("qid").cast("string"), F.lit("[[SEP]]old"))
    frames = [spark.createDataFrame(r, GENERATIONS).withColumn("text", text) for r in (plain, hinted)]
    got = {r.qid: (r.text, r.score_response, r.code_score)
           for r in preference.bootstrapped_dataset(*frames).collect()}
    assert got == {1: ("case 1[[SEP]]h", 0, 4), 2: ("case 2[[SEP]]p", 1, 2), 3: ("case 3[[SEP]]", 0, 0)}


def test_files_to_files(spark, tmp_path):
    import json

    def write(path, records):
        path.parent.mkdir(exist_ok=True)
        path.write_text("\n".join(json.dumps(r) for r in records) + "\n")

    write(tmp_path / "ori.jsonl", [{"qid": 1, "text": "t", "response": "gold"}])
    write(tmp_path / "gen" / "a.jsonl", [
        {"qid": 1, "i": 0, "response": "Diagnosis is: red gear, x", "label": "red gear",
         "response_token_len": 4, "text": "c[[SEP]]d"}])
    write(tmp_path / "gen" / "b.jsonl", [
        {"qid": 1, "i": 1, "response": "Diagnosis is: blue bolt, x", "label": "red gear",
         "response_token_len": 4, "text": "c[[SEP]]d"}])
    write(tmp_path / "hint" / "a.jsonl", [
        {"qid": 1, "i": 0, "response": "Diagnosis is: red gear, hinted", "label": "red gear",
         "response_token_len": 4, "text": "c[[SEP]]d"}])
    write(tmp_path / "score" / "a.jsonl", [{"qid": 1, "i": 0, "score": 0.5}])
    references = spark.createDataFrame(
        [(1, "red gear", "A00.000"), (2, "blue bolt", "B00.000")], "ref_id long, diag string, diag_code string")
    preference.run_preference_dataset(
        spark, str(tmp_path / "ori.jsonl"), str(tmp_path / "gen"), str(tmp_path / "score"),
        str(tmp_path / "out"), references)
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert [(r.accepted, r.rejected) for r in got] == [
        ("Diagnosis is: red gear, x", "Diagnosis is: blue bolt, x")]
    preference.run_bootstrapped_dataset(
        spark, str(tmp_path / "gen"), str(tmp_path / "hint"), str(tmp_path / "boot"), references)
    got = spark.read.json(str(tmp_path / "boot")).collect()
    assert [(r.text, r.score_response, r.pred_code) for r in got] == [
        ("c[[SEP]]Diagnosis is: red gear, x", 1, "A00.000")]


def heavy_sides(spark, size):
    """A third of both sides on one key, repeated rows, null keys on both sides, keys of one side only."""
    left = spark.range(size).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, F.col("id") % 997).cast("bigint").alias("qid"),
        F.when(F.col("id") % 5 != 0, 0).cast("bigint").alias("i"), (F.col("id") % 11).alias("v"))
    right = spark.range(size // 20).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, F.col("id") % 1200).cast("bigint").alias("qid"),
        F.when(F.col("id") % 5 != 0, 0).cast("bigint").alias("i"), (F.col("id") % 7).alias("w"))
    return left, right


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("parts", [1, 7, 1000])
def test_grid_join_equals_plain_join(spark, how, parts):
    left, right = heavy_sides(spark, 2_000)
    found = grid_join(left, right, ["qid", "i"], how, parts).groupBy("qid", "i", "v", "w").count().collect()
    a, b = left.alias("a"), right.alias("b")
    same = F.col("a.qid").eqNullSafe(F.col("b.qid")) & F.col("a.i").eqNullSafe(F.col("b.i"))
    plain = a.join(b, same, how).groupBy("a.qid", "a.i", "v", "w").count().collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, map(tuple, plain)))


def test_grid_join_spreads_the_heavy_key(spark):
    """No partition makes over twice the rows of the median one."""
    left, right = heavy_sides(spark, 60_000)
    with settings(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1"):
        sizes = [r[1] for r in grid_join(left, right, ["qid", "i"]).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[4]


def test_grid_repeats_few_rows(spark):
    counts = spark.createDataFrame(
        [("both", 12_000_000, 20_000), ("left", 3_000_000, 0), ("right", 0, 9_000), ("one", 500_000, 1)],
        "qid string, _l long, _r long")
    lefts, rights, pairs = counts.selectExpr("sum(_l)", "sum(_r)", "sum(_l * double(_r))").first()
    rows, columns = grid_shape(lefts, rights, pairs, 1000)
    for r in counts.select("qid", "_l", "_r", rows.alias("rows"), columns.alias("columns")).collect():
        assert r._l * r.columns + r._r * r.rows <= 4 * lefts
        assert r._l / r.rows <= lefts / 500 and (r._r / r.columns) * (r._l / r.rows) <= pairs / 400
        assert r.columns <= max(r._r, 1)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_grid_join_of_few_rows_without_partners(spark, how):
    left = spark.createDataFrame([(1, 0, n) for n in range(10)] + [(2, 0, n) for n in range(3)] + [(None, 0, 7)], "qid long, i long, v long")
    right = spark.createDataFrame([(2, 0, "a"), (2, 0, "b"), (3, 0, "c")], "qid long, i long, w string")
    found = [tuple(r) for r in grid_join(left, right, ["qid", "i"], how).collect()]
    plain = [(2, 0, n, w) for n in range(3) for w in "ab"]
    if how == "left":
        plain += [(1, 0, n, None) for n in range(10)] + [(None, 0, 7, None)]
    assert sorted(found, key=str) == sorted(plain, key=str)


def test_questions_are_dealt_into_tasks_in_number_with_the_answers(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_ROWS", 300)
    rows = views.generations(spark, "/root/testdata/sf0.001")
    shares = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == rows.count() > 5000 and max(shares) < 900
    assert rows.select("qid", F.spark_partition_id().alias("task")).distinct().groupBy("qid").count().where(
        "count > 1").isEmpty()


def test_one_row_of_texts_for_each_question_meets_the_scores(spark):
    scored = spark.createDataFrame(
        [(q, i, f"r{i}", i % 5) for q in range(20) for i in range(30)], "qid long, i long, response string, code_score int")
    scores = spark.createDataFrame([(q, i, 0.5) for q in range(20) for i in range(30)], "qid long, i long, score double")
    pairs = selection.select_pairs(scored, scores)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    left = plan[plan.index("Join LeftOuter"):]
    assert "Aggregate [qid" in left[:left.index("Window")]
    assert {(r.accepted, r.rejected) for r in pairs.collect()} == {("r4", "r3")} and pairs.count() == 20


def test_the_job_from_files_takes_and_writes_compressed_files(spark, tmp_path):
    from tessera.sources import readers, writers
    rows = spark.createDataFrame([(q, f"t{q}", "a") for q in range(50)], "qid long, text string, response string")
    plain, packed = f"{tmp_path}/plain.jsonl", f"{tmp_path}/packed.jsonl"
    writers.write_jsonl(rows, plain)
    writers.append_results(rows.coalesce(1), packed, 20, False, "gzip")
    assert len(list((tmp_path / "packed.jsonl").glob("part-*.json.gz"))) == 3
    found = readers.read_records(spark, packed, fmt="jsonl")
    assert sorted(found.collect()) == sorted(readers.read_records(spark, plain, fmt="jsonl").collect())


def test_costly_answers_are_extracted_once_and_few_texts_of_a_column_are_broadcast(spark, monkeypatch):
    from tessera.plans import codes
    made = spark.sparkContext.accumulator(0)
    extract = preference.tx.extract_diagnosis

    @F.udf("string")
    def counted(text):
        made.add(1)
        return text

    monkeypatch.setattr(preference.tx, "extract_diagnosis", lambda c: counted(extract(c)))
    references = spark.createDataFrame([(n, f"kind {n}", f"A0{n}.000") for n in range(4)], "ref_id long, diag string, diag_code string")
    answers = spark.range(400).select(
        F.col("id").alias("qid"), F.concat(F.lit("Diagnosis is kind "), (F.col("id") % 4).cast("string")).alias("response"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("kind "), (F.col("id") % 2).cast("string"))).alias("label"))
    got = preference.add_codes(answers, references, written=True).collect()
    assert made.value == 400
    assert {(r.qid, r.label_code, r.pred_code) for r in got} == {
        (n, f"A0{n % 2}.000" if n % 3 else None, f"A0{n % 4}.000") for n in range(400)}
    # One column has few texts, the other very many: only the latter's rows move.
    wide = spark.range(20000).select(
        F.concat(F.lit("kind "), (F.col("id") % 2).cast("string")).alias("few"), F.concat(F.lit("kind 2 "), F.md5(F.col("id").cast("string"))).alias("many"))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="100k"):
        coded = codes.map_codes(wide, {"few": "a", "many": "b"}, references)
        plan = coded._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1
        assert coded.where("a = 'A01.000' AND b IS NOT NULL").count() == 10000
