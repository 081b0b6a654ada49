"""Scoring, selecting and coding generated answers."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import nearest, selection
from ..operators.filters import drop_zero_length
from ..plans import codes, inference, preference
from ..schemas import struct
from ..session import fresh_path
from ..sources import writers
from ..sources.readers import read_records
from . import views
from .text_queries import extract_sql
from .views import agreement_sql, with_views

_FILES = {"rows_per_file": 1_000_000, "compression": "gzip"}


def pref_score_join(spark, sf_dir):
    rows = views.generations(spark, sf_dir).select("qid", "i", "response_token_len")
    return selection.attach_scores(rows, views.scores(spark, sf_dir))


def pref_score_join_hot(spark, sf_dir):
    """A third of the answers and of the scores are of one question, and some of either of none."""
    return selection.attach_scores(views.hot_generations(spark, sf_dir), views.hot_scores(spark, sf_dir))


def filter_nonzero_len(spark, sf_dir):
    rows = views.generations(spark, sf_dir).select("qid", "i", "response_token_len")
    return drop_zero_length(rows)


def code_score(spark, sf_dir):
    scored = selection.score_codes(views.generations(spark, sf_dir), with_matches=True)
    return scored.select("qid", "i", "match_0", "match_1", "match_2", "match_3", "code_score")


def pref_levels(spark, sf_dir):
    scored = selection.score_codes(views.generations(spark, sf_dir))
    return selection.first_per_level(scored).select("qid", "code_score", "i", "response")


def pref_classes(spark, sf_dir):
    return selection.level_classes(selection.score_codes(views.generations(spark, sf_dir)))


def pref_pairs(spark, sf_dir):
    scored = selection.score_codes(views.generations(spark, sf_dir))
    return selection.select_pairs(scored, views.scores(spark, sf_dir))


def topk_per_group(spark, sf_dir):
    """The first two and the last answer of each question."""
    rows = views.generations(spark, sf_dir).select("qid", "i", "response", "response_token_len")
    length = "response_token_len"
    head = selection.top_per_group(
        rows, ["qid"], [*selection.input_order(), F.asc_nulls_last(length)], k=2, rank="place")
    tail = selection.top_per_group(
        rows, ["qid"], [F.desc("i"), F.desc("response"), F.desc_nulls_last(length)])
    return head.withColumn("which", F.lit("head")).unionByName(
        tail.withColumns({"place": F.lit(1), "which": F.lit("tail")}))


def _hinted(spark, sf_dir):
    rows = views.generations(spark, sf_dir)
    return (rows.where(F.col("status") == "F").drop("status"),
            rows.where(F.col("status") == "O").drop("status"))


def bootstrap_select(spark, sf_dir):
    best = selection.select_bootstrap(*_hinted(spark, sf_dir))
    return best.select("qid", "i", "score_response", "code_score", "response", "response_token_len")


def bootstrapping(spark, sf_dir):
    return preference.bootstrapped_dataset(*_hinted(spark, sf_dir))


def preference_dataset(spark, sf_dir):
    return preference.preference_dataset(
        views.originals(spark, sf_dir), views.generations(spark, sf_dir), views.scores(spark, sf_dir))


def preference_from_text(spark, sf_dir):
    """The whole job: diagnoses are extracted and coded before selection."""
    raw = views.generations(spark, sf_dir).select("qid", "i", "response", "label", "response_token_len")
    coded = preference.add_codes(raw, views.code_references(spark, sf_dir), written=True)
    return preference.preference_dataset(
        views.originals(spark, sf_dir), coded, views.scores(spark, sf_dir))


def generate_to_preference(spark, sf_dir):
    """From questions to preference data through files: generation in two shares, scores, references.

    Files are compressed, since answers repeat their prompts, and hold a bounded number of rows, since one task reads one.
    """
    base = fresh_path(spark, "chain")
    rows = views.diagnosis_questions(spark, sf_dir)
    settings = inference.policy_settings(num_return_sequences=2)
    for rank in range(2):
        inference.run_generation(
            rows.withColumn("row_id", F.col("qid")), writers.shard_path(f"{base}/generated", rank, 2), "qid",
            rank=rank, world=2, settings=settings, **_FILES)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("i")
    scores = rows.select("qid", numbers).withColumn("score", (F.col("qid") + F.col("i")) % 3 / 2)
    writers.write_jsonl(scores, f"{base}/scores/scores.jsonl", **_FILES)
    writers.write_jsonl(views.originals(spark, sf_dir), f"{base}/originals.jsonl", **_FILES)
    references = views.code_references(spark, sf_dir).repartitionByRange(2, "ref_id").sortWithinPartitions("ref_id")
    writers.write_csv(references.select("diag", "diag_code"), f"{base}/references.csv")
    preference.run_preference_dataset(
        spark, f"{base}/originals.jsonl", f"{base}/generated", f"{base}/scores", f"{base}/out.jsonl",
        f"{base}/references.csv", **_FILES)
    return read_records(spark, f"{base}/out.jsonl", schema=struct(
        "qid bigint, text string, response string, accepted string, rejected string"))


def code_mapping(spark, sf_dir):
    extracted = views.responses(spark, sf_dir).withColumn("pred", tx.extract_diagnosis(F.col("response")))
    mapped = codes.map_codes(extracted, {"pred": "pred_code"}, views.code_references(spark, sf_dir))
    return mapped.select("rid", "pred", "pred_code")


def knn_l1(spark, sf_dir):
    found = nearest.nearest_reference(
        views.vector_queries(spark, sf_dir), views.vector_references(spark, sf_dir), "query_id")
    return found.select("query_id", "ref_id")


def knn_l1_cells(spark, sf_dir):
    """The same search with smaller leaves and blocks."""
    found = nearest.nearest_reference(
        views.vector_queries(spark, sf_dir), views.vector_references(spark, sf_dir), "query_id",
        leaf_rows=64, block_rows=256)
    return found.select("query_id", "ref_id")


def knn_l1_five(spark, sf_dir):
    """The five nearest references of every query."""
    found = nearest.nearest_references(
        views.vector_queries(spark, sf_dir), views.vector_references(spark, sf_dir), "query_id", k=5)
    return found.select("query_id", "place", "ref_id")


def knn_code_map(spark, sf_dir):
    found = knn_l1(spark, sf_dir)
    refs = views.vector_references(spark, sf_dir).select(
        "ref_id", views.code(F.col("ref_id")).alias("code"))
    return found.join(refs, "ref_id").select("query_id", "code")


QUERIES = {f.__name__: f for f in (
    pref_score_join, pref_score_join_hot, filter_nonzero_len, code_score, pref_levels, pref_classes, pref_pairs,
    topk_per_group, bootstrap_select, bootstrapping, preference_dataset, preference_from_text,
    generate_to_preference, code_mapping, knn_l1, knn_l1_cells, knn_l1_five, knn_code_map)}

_LEVELS = """
    SELECT qid, count(DISTINCT code_score) AS n_levels, max(code_score) AS top_score
    FROM scored GROUP BY qid"""
_NUMBERED = """
    SELECT *, row_number() OVER (PARTITION BY qid, code_score
      ORDER BY i NULLS LAST, response NULLS LAST) AS place FROM scored"""
# The first two rows of an exact question, after the scores fanned them out.
_FIRST_TWO = """
    SELECT * FROM (
      SELECT s.qid, s.response, c.score AS help, md5('42|' || s.qid || '|' || s.i) AS tie,
        row_number() OVER (PARTITION BY s.qid ORDER BY s.i NULLS LAST, s.response NULLS LAST,
          s.place, c.score DESC NULLS LAST) AS joined_place
      FROM numbered s JOIN levels l ON s.qid = l.qid AND l.n_levels = 1 AND l.top_score = 4
      LEFT JOIN scores c ON s.qid = c.qid AND s.i IS NOT DISTINCT FROM c.i)
    WHERE joined_place <= 2"""
_CANDIDATES = """
    SELECT s.qid, s.response, s.code_score, CAST(NULL AS DOUBLE) AS help, '' AS tie, 1 AS joined_place,
      dense_rank() OVER (PARTITION BY s.qid ORDER BY s.code_score DESC) AS depth, 'ranked' AS selection_case
    FROM numbered s JOIN levels l ON s.qid = l.qid AND l.n_levels > 1 WHERE place = 1
    UNION ALL SELECT qid, response, 4, help, tie, joined_place, 1, 'exact' FROM first_two
    UNION ALL SELECT s.qid, s.response, s.code_score, NULL, '', 1, 1, 'inexact'
      FROM numbered s JOIN levels l ON s.qid = l.qid AND l.n_levels = 1 AND l.top_score < 4
      WHERE place = 1
    UNION ALL SELECT l.qid, o.response, 5, 1, '', 1, 1, 'inexact'
      FROM levels l JOIN originals o ON l.qid = o.qid WHERE l.n_levels = 1 AND l.top_score < 4"""
_ORDERED = """
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY code_score DESC, help DESC NULLS LAST,
        tie, joined_place) AS first,
      row_number() OVER (PARTITION BY qid ORDER BY code_score, help NULLS FIRST,
        tie DESC, joined_place DESC) AS last
    FROM candidates WHERE depth <= 2"""
_PAIRS = """
    SELECT qid, selection_case, max(response) FILTER (WHERE first = 1) AS accepted,
      max(response) FILTER (WHERE last = 1) AS rejected
    FROM ordered GROUP BY qid, selection_case"""
_SELECTION = {
    "levels": _LEVELS, "numbered": _NUMBERED, "first_two": _FIRST_TWO, "candidates": _CANDIDATES,
    "ordered": _ORDERED, "pairs": _PAIRS}

_BOOTSTRAP = f"""
    SELECT *, coalesce(substr(label_code, 1, 1) = substr(pred_code, 1, 1), false) AS match_0,
      coalesce(substr(label_code, 1, 3) = substr(pred_code, 1, 3), false) AS match_1,
      coalesce(substr(label_code, 1, 5) = substr(pred_code, 1, 5), false) AS match_2,
      coalesce(substr(label_code, 1, 7) = substr(pred_code, 1, 7), false) AS match_3
    FROM (SELECT *, CASE WHEN status = 'F' THEN 1 ELSE 0 END AS score_response FROM scored)
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY code_score DESC, score_response DESC,
      md5('42|' || qid || '|' || i), i, response, response_token_len NULLS LAST) = 1"""


def _distance(a: str, b: str) -> str:
    return (f"list_sum(list_transform(list_zip({a}, {b}), "
            f"lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))")


_GRAM = views.crc_sql("substr(padded, i, 3)")
_SLOTS = """
    SELECT {key}, slot, count(*) AS n FROM (
      SELECT {key}, {crc} % 64 AS slot
      FROM (SELECT {key}, padded, unnest(range(1, length(padded) - 1)) AS i
        FROM (SELECT {key}, '  ' || lower({text}) || '  ' AS padded FROM {source})))
    GROUP BY {key}, slot"""
_CODE_TABLE = {
    # L1 distance of two counts = both sums - 2 * sum of the smaller counts.
    "text_slots": _SLOTS.format(key="diag_text", text="diag_text", source="diag_texts", crc=_GRAM),
    "ref_slots": _SLOTS.format(key="ref_id", text="diag", source="code_references", crc=_GRAM),
    "distances": """
        SELECT t.diag_text, r.ref_id, any_value(length(t.diag_text) + length(f.diag)) + 4
          - 2 * sum(least(s.n, coalesce(q.n, 0))) AS distance
        FROM diag_texts t CROSS JOIN code_references f JOIN (SELECT DISTINCT ref_id FROM ref_slots) r
          ON f.ref_id = r.ref_id
        LEFT JOIN text_slots s ON s.diag_text = t.diag_text
        LEFT JOIN ref_slots q ON q.ref_id = r.ref_id AND q.slot = s.slot
        GROUP BY t.diag_text, r.ref_id""",
    "code_table": """
        SELECT d.diag_text, f.diag_code AS code FROM (
          SELECT diag_text, ref_id FROM distances
          QUALIFY row_number() OVER (PARTITION BY diag_text ORDER BY distance, ref_id) = 1) d
        JOIN code_references f ON d.ref_id = f.ref_id""",
}
_NEAREST_FIVE = f"""
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS INTEGER) AS place, ref_id
    FROM (
      SELECT q.query_id, r.ref_id, {_distance('q.embedding', 'r.embedding')} AS distance
      FROM vector_queries q CROSS JOIN vector_references r)
    QUALIFY place <= 5"""
_NEAREST = f"SELECT query_id, ref_id FROM ({_NEAREST_FIVE}) WHERE place = 1"



def _from_text_sql(names: str, extracted: str, **more: str) -> str:
    return with_views(names + " code_references originals", """
        SELECT o.qid, o.text, o.response, p.accepted, p.rejected
        FROM originals o LEFT JOIN pairs p ON o.qid = p.qid""",
        **more, extracted=extracted,
        diag_texts="SELECT label AS diag_text FROM extracted WHERE label IS NOT NULL UNION "
                   "SELECT pred FROM extracted WHERE pred IS NOT NULL",
        **_CODE_TABLE,
        coded="""SELECT e.*, a.code AS label_code, b.code AS pred_code FROM extracted e
                 LEFT JOIN code_table a ON e.label = a.diag_text
                 LEFT JOIN code_table b ON e.pred = b.diag_text""",
        scored=f"SELECT *, {agreement_sql()} AS code_score FROM coded "
               "WHERE response_token_len IS DISTINCT FROM 0",
        **_SELECTION)


SQL = {
    "pref_score_join": with_views("generations scores", """
        SELECT g.qid, g.i, g.response_token_len, s.score AS help_score FROM generations g
        LEFT JOIN scores s ON g.qid IS NOT DISTINCT FROM s.qid AND g.i IS NOT DISTINCT FROM s.i"""),
    "pref_score_join_hot": with_views("hot_generations hot_scores", """
        SELECT g.qid, g.i, g.line, s.score AS help_score FROM hot_generations g
        LEFT JOIN hot_scores s ON g.qid IS NOT DISTINCT FROM s.qid AND g.i IS NOT DISTINCT FROM s.i"""),
    "filter_nonzero_len": with_views("generations", """
        SELECT qid, i, response_token_len FROM generations
        WHERE response_token_len <> 0 OR response_token_len IS NULL"""),
    "code_score": with_views("scored", """
        SELECT qid, i, substr(label_code, 1, 1) = substr(pred_code, 1, 1) AS match_0,
          substr(label_code, 1, 3) = substr(pred_code, 1, 3) AS match_1,
          substr(label_code, 1, 5) = substr(pred_code, 1, 5) AS match_2,
          substr(label_code, 1, 7) = substr(pred_code, 1, 7) AS match_3, code_score FROM scored"""),
    "pref_levels": with_views("scored", """
        SELECT qid, code_score, i, response FROM numbered WHERE place = 1""", numbered=_NUMBERED),
    "pref_classes": with_views("scored", """
        SELECT qid, CAST(n_levels AS INTEGER) AS n_levels, top_score,
          CASE WHEN n_levels > 1 THEN 'ranked' WHEN top_score = 4 THEN 'exact' ELSE 'inexact' END
            AS selection_case FROM levels""", levels=_LEVELS),
    "pref_pairs": with_views("scored scores originals", """
        SELECT qid, selection_case, CASE WHEN selection_case <> 'inexact' THEN accepted END AS accepted,
          rejected FROM pairs""", **_SELECTION),
    "topk_per_group": with_views("generations", """
        SELECT qid, i, response, response_token_len, CAST(place AS INTEGER) AS place, 'head' AS which FROM (
          SELECT *, row_number() OVER (PARTITION BY qid ORDER BY i, response,
            response_token_len NULLS LAST) AS place FROM generations) WHERE place <= 2
        UNION ALL
        SELECT qid, i, response, response_token_len, 1, 'tail' FROM (
          SELECT *, row_number() OVER (PARTITION BY qid ORDER BY i DESC, response DESC,
            response_token_len DESC NULLS LAST) AS place FROM generations) WHERE place = 1"""),
    "bootstrap_select": with_views("scored", """
        SELECT qid, i, score_response, code_score, response, response_token_len FROM best""",
        best=_BOOTSTRAP),
    "bootstrapping": with_views("scored", """
        SELECT qid, i, response, response_token_len, label, label_code, pred_code,
          'Case ' || qid || '[[SEP]]' || response AS text, score_response,
          match_0, match_1, match_2, match_3, code_score FROM best""", best=_BOOTSTRAP),
    "preference_dataset": with_views("scored scores originals", """
        SELECT o.qid, o.text, o.response, p.accepted, p.rejected
        FROM originals o LEFT JOIN pairs p ON o.qid = p.qid""", **_SELECTION),
    "preference_from_text": _from_text_sql(
        "generations scores", f"SELECT qid, i, response, label, response_token_len, {extract_sql('response')} AS pred "
        "FROM generations"),
    "generate_to_preference": _from_text_sql(
        "diagnosis_questions", f"SELECT *, {extract_sql('response')} AS pred FROM answered",
        answered="""
            SELECT qid, i, label, 1 AS response_token_len, '[' || i || '] ### User: ' || question || chr(10) || chr(10) || '### Assistant: '
              AS response FROM diagnosis_questions, (SELECT unnest([0, 1]) AS i)""",
        scores="SELECT qid, i, (qid + i) % 3 / 2 AS score FROM answered"),
    "code_mapping": with_views("responses code_references", """
        SELECT e.rid, e.pred, t.code AS pred_code
        FROM extracted e LEFT JOIN code_table t ON e.pred = t.diag_text""",
        extracted=f"SELECT rid, {extract_sql('response')} AS pred FROM responses",
        diag_texts="SELECT DISTINCT pred AS diag_text FROM extracted WHERE pred IS NOT NULL",
        **_CODE_TABLE),
    "knn_l1": with_views("vector_queries vector_references", _NEAREST),
    "knn_l1_cells": with_views("vector_queries vector_references", _NEAREST),
    "knn_l1_five": with_views("vector_queries vector_references", _NEAREST_FIVE),
    "knn_code_map": with_views("vector_queries vector_references", f"""
        SELECT query_id, {views.code_sql('ref_id')} AS code FROM nearest""", nearest=_NEAREST),
}
