"""Conversations, prompts and extraction."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import filters
from ..plans import training
from . import views
from .views import with_views

# Fixed value: the instruction that follows a record in a chat prompt.
CHAT_INSTRUCTION = (
    "Please provide a detailed and comprehensive diagnostic analysis of this medical record, "
    "and give the diagnostic results.")


def extract_diag(spark, sf_dir):
    rows = views.responses(spark, sf_dir)
    return rows.select("rid", tx.extract_diagnosis(F.col("response")).alias("pred"))


def sft_segments(spark, sf_dir):
    rows = filters.drop_null_text(views.sft_input(spark, sf_dir))
    return rows.select("qid", F.posexplode(tx.segments(F.col("text"))).alias("pos", "segment"))


def drop_empty_answer(spark, sf_dir):
    return filters.drop_empty_answers(views.answers(spark, sf_dir))


def turn_endpoint(spark, sf_dir):
    rows = views.sft_input(spark, sf_dir).withColumn("segs", tx.segments(F.col("text")))
    rows = rows.where(F.size("segs") >= 2)
    turn = training.chosen_turn(F.col("segs"), 42, F.col("qid"), F.col("trainable_round"))
    return rows.select("qid", F.floor(F.size("segs") / 2).cast("int").alias("n_turn"),
                       turn.alias("turn"))


def prompt_prefix(spark, sf_dir):
    prefixed = tx.add_role_prefix(tx.segments(F.col("text")))
    return views.sft_input(spark, sf_dir).select("qid", F.array_join(prefixed, "").alias("text"))


def prompt_generate(spark, sf_dir):
    return views.sft_input(spark, sf_dir).select(
        "qid", tx.generation_prompt(F.col("text")).alias("prompt"),
        tx.reference_answer(F.col("text")).alias("reference"))


def prompt_response(spark, sf_dir):
    output = tx.generation_prompt(F.col("text"), with_last=True)
    return views.sft_input(spark, sf_dir).select(
        "qid", tx.answer_from_output(output).alias("response"))


def prompt_chat(spark, sf_dir):
    messages = tx.chat_message(F.col("text"), CHAT_INSTRUCTION)
    return views.documents(spark, sf_dir).select("doc_id", F.inline(messages))


def project_optional(spark, sf_dir):
    return filters.select_known(
        views.clf_input(spark, sf_dir), ["text", "qid", "trainable_round", "label"])


def bootstrap_rewrite(spark, sf_dir):
    text = tx.replace_last_segment(F.col("text"), F.concat(F.lit("Now: "), F.col("response")))
    return views.originals(spark, sf_dir).select("qid", text.alias("text"))


QUERIES = {f.__name__: f for f in (
    extract_diag, sft_segments, drop_empty_answer, turn_endpoint, prompt_prefix, prompt_generate,
    prompt_response, prompt_chat, project_optional, bootstrap_rewrite)}

_PREFIXED = """
  SELECT qid, list_transform(segs, lambda s, i:
    CASE WHEN i % 2 = 1 THEN '### User: ' ELSE '### Assistant: ' END || s) AS texts, segs
  FROM (SELECT qid, string_split(text, '[[SEP]]') AS segs FROM sft_input)"""
_EVEN = """
  SELECT qid, CASE WHEN len(segs) % 2 = 1 THEN list_append(segs, '') ELSE segs END AS segs
  FROM (SELECT qid, string_split(text, '[[SEP]]') AS segs FROM sft_input)"""
_HEADED = "CASE WHEN i % 2 = 1 THEN '### User: ' ELSE '### Assistant: ' END"

# The patterns, in the order in which they are tried.
_PATTERNS = [
    "The most likely diagnosis is [^,]+, specifically ([^,\\.]+).",
    "The most likely diagnosis is[:]?([^,\\.]+)",
    "The probable diagnosis is([^,\\.]+)",
    "([^,\\.]+) is the most likely diagnosis",
    "Diagnosis is[:]?([^,\\.]+)",
    "Diagnosis shows([^,\\.]+)",
    "Diagnosis may be[:]?([^,\\.]+)",
    "Likely suffering from[:]?([^,\\.]+)",
    "^([^,\\.\\s]+)",
]


def extract_sql(text: str) -> str:
    hits = [f"nullif(regexp_extract({text}, '{p}', 1, 's'), '')" for p in _PATTERNS]
    return f"coalesce({', '.join(hits)})"


SQL = {
    "extract_diag": with_views("responses", f"SELECT rid, {extract_sql('response')} AS pred FROM responses"),
    "sft_segments": with_views("sft_input", """
        SELECT qid, CAST(pos - 1 AS INTEGER) AS pos, segs[pos] AS segment FROM (
          SELECT qid, segs, unnest(range(1, len(segs) + 1)) AS pos FROM (
            SELECT qid, string_split(text, '[[SEP]]') AS segs FROM sft_input WHERE text IS NOT NULL))"""),
    "drop_empty_answer": with_views("answers", """
        SELECT qid, text FROM answers WHERE NOT list_contains(list_filter(
          string_split(text, '[[SEP]]'), lambda s, i: i % 2 = 0), '')"""),
    "turn_endpoint": with_views("sft_input", """
        SELECT qid, n_turn, CASE WHEN trainable_round = -1 THEN n_turn ELSE CAST(
          CAST('0x' || substr(md5('42|' || qid), 1, 8) AS BIGINT) % n_turn + 1 AS INTEGER) END AS turn
        FROM (SELECT *, CAST(len(string_split(text, '[[SEP]]')) // 2 AS INTEGER) AS n_turn FROM sft_input)
        WHERE n_turn >= 1"""),
    "prompt_prefix": with_views(
        "sft_input", "SELECT qid, list_aggregate(texts, 'string_agg', '') AS text FROM prefixed",
        prefixed=_PREFIXED),
    "prompt_generate": with_views("sft_input", f"""
        SELECT qid, array_to_string(list_transform(list_append(segs[:-2], ''),
          lambda s, i: {_HEADED} || s), chr(10) || chr(10)) AS prompt, segs[-1] AS reference FROM even""",
        even=_EVEN),
    "prompt_response": with_views(
        "sft_input", "SELECT qid, segs[-1] AS response FROM even", even=_EVEN),
    "prompt_chat": f"""
        SELECT doc_id, 'user' AS role,
          text || chr(10) || chr(10) || '{CHAT_INSTRUCTION}' || chr(10) AS content FROM documents""",
    "project_optional": with_views("clf_input", "SELECT text, qid, label FROM clf_input"),
    "bootstrap_rewrite": with_views("originals", """
        SELECT qid, regexp_replace(text, '\\[\\[SEP\\]\\][^\\[]*$', '[[SEP]]Now: ') || response AS text
        FROM originals"""),
}
