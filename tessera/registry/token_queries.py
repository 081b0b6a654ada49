"""Tokenising, vocabularies, training tables, packing and padding.

Token lists are compared as text: ids joined with blanks.
"""

from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..operators import tokenizers
from ..operators.packing import pack_blocks as pack
from ..operators.position import with_row_id
from ..plans import training
from ..session import fresh_path
from . import preference_queries, views
from .views import ids_sql, with_views, words_sql

BLOCK = 512
DEFAULT_BLOCK = 4096


def _text(*names):
    return [F.array_join(F.col(n).cast("array<string>"), " ").alias(n) for n in names]


def tokenize_ws(spark, sf_dir):
    ids = tokenizers.HashTokenizer().encode(F.col("text"))
    rows = views.documents(spark, sf_dir).select("doc_id", ids.alias("input_ids"))
    return rows.select("doc_id", F.size("input_ids").alias("n_tokens"), *_text("input_ids"))


def token_lengths(spark, sf_dir):
    tokenizer = tokenizers.HashTokenizer()
    ids = tokenizer.encode(F.col("text"), add_eos=True)
    return views.documents(spark, sf_dir).select(
        "doc_id", ar.count_tokens(ids, tokenizer.pad_id).alias("n_tokens"))


def build_vocab(spark, sf_dir):
    return tokenizers.build_vocabulary(views.documents(spark, sf_dir), "text")


def _vocabulary(spark, sf_dir):
    """Ids of the words of all conversations."""
    rows = views.sft_input(spark, sf_dir).dropna(subset=["text"])
    return rows, tokenizers.build_vocabulary(rows, "text")


def vocab_encode(spark, sf_dir):
    rows, vocabulary = _vocabulary(spark, sf_dir)
    encoded = tokenizers.encode_with_vocabulary(rows, "text", vocabulary)
    return encoded.select("qid", *_text("input_ids"))


def vocab_encode_joined(spark, sf_dir):
    """The same ids for rows whose keys are missing or repeated."""
    rows, vocabulary = _vocabulary(spark, sf_dir)
    keyed = rows.withColumn("qid", F.when(F.col("qid") % 5 != 0, F.col("qid") % 7))
    encoded = tokenizers.encode_with_vocabulary(keyed, "text", vocabulary)
    return encoded.select("qid", *_text("input_ids"))


def sft_dec(spark, sf_dir):
    table = training.prepare_sft(views.sft_input(spark, sf_dir))
    return table.select("qid", *_text("input_ids", "labels"))


def sft_length_filter(spark, sf_dir):
    """Conversations shorter than a small block."""
    table = training.prepare_sft(views.sft_input(spark, sf_dir), block_size=BLOCK)
    return table.select("qid", *_text("input_ids", "labels"))


def sft_encdec(spark, sf_dir):
    table = training.prepare_sft(views.sft_input(spark, sf_dir), lm_type="encdec")
    return table.select("qid", *_text("input_ids", "labels"))


def sft_prepare(spark, sf_dir):
    rows = views.sft_input(spark, sf_dir).withColumn("data_group", F.lit("conversations"))
    table = training.prepare_sft(rows, template_name="plain")
    return table.select("qid", "data_group", *_text("input_ids", "labels", "attention_mask"))


def clf_prepare(spark, sf_dir):
    table = training.prepare_classification(views.clf_input(spark, sf_dir))
    return table.select("qid", "labels", *_text("input_ids"))


def clf_truncate(spark, sf_dir):
    """Texts cut on the right at a small block."""
    table = training.prepare_classification(views.clf_input(spark, sf_dir), block_size=BLOCK)
    return table.select("qid", "labels", *_text("input_ids"))


def dpo_prepare(spark, sf_dir):
    """Preference rows as the selection job leaves them."""
    return _preference_table(spark, sf_dir, None)


def dpo_truncate(spark, sf_dir):
    """The same through a block without a limit: texts of any length stay whole."""
    return _preference_table(spark, sf_dir, tokenizers.UNLIMITED)


def _preference_table(spark, sf_dir, block_size):
    rows = preference_queries.preference_dataset(spark, sf_dir)
    table = training.prepare_preference(rows, block_size=block_size)
    return table.select("qid", *_text(
        "input_ids", "labels", "attention_mask", "input_ids_accepted", "labels_accepted",
        "attention_mask_accepted", "input_ids_rejected", "labels_rejected",
        "attention_mask_rejected"))


def pack_blocks(spark, sf_dir):
    """Documents packed whole, the last short block of each group kept."""
    rows = with_row_id(views.documents(spark, sf_dir), ["doc_id"], replayable=True)
    ids = tokenizers.HashTokenizer().encode(F.col("text"))
    blocks = pack(rows.select("row_id", ids.alias("input_ids")), BLOCK, group_rows=100, keep_tail=True)
    return blocks.select("pack_group", "block", *_text("input_ids"))


def pretrain_prepare(spark, sf_dir):
    """Lines of all documents, each closed by the end token, in full blocks."""
    rows = with_row_id(views.pretrain_lines(spark, sf_dir), ["doc_id", "line"], replayable=True)
    blocks = training.prepare_pretraining(rows, block_size=BLOCK)
    return blocks.select("pack_group", "block", *_text("input_ids", "labels"))


def pretrain_from_files(spark, sf_dir):
    """A folder of text files per language, each folder packed on its own, in small splits."""
    path = fresh_path(spark, "pretrain")
    rows = views.table(spark, sf_dir, "documents")
    lines = rows.select("lang", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    order = ["lang", "doc_id", "line"]
    files = views.file_count(views.text_bytes(rows))
    lines.repartitionByRange(files, *order).sortWithinPartitions(*order).select("lang", "text").write.partitionBy(
        "lang").text(path)
    blocks = training.pretraining_from_files(spark, f"{path}/*/*", by_folder=True, block_size=BLOCK)
    return blocks.select(
        F.regexp_extract("_folder", "lang=([^/]*)", 1).alias("lang"), "pack_group", "block", *_text("input_ids"))


def _padded(spark, sf_dir, side):
    table = training.prepare_sft(views.sft_input(spark, sf_dir))
    batches = training.training_batches(with_row_id(table, ["qid"]), 8, side=side)
    return batches.select("qid", "batch_id", *_text("input_ids", "labels", "attention_mask"))


def pad_batches(spark, sf_dir):
    return _padded(spark, sf_dir, "right")


def pad_batches_left(spark, sf_dir):
    return _padded(spark, sf_dir, "left")


QUERIES = {f.__name__: f for f in (
    tokenize_ws, token_lengths, build_vocab, vocab_encode, vocab_encode_joined, sft_dec, sft_encdec,
    sft_length_filter, sft_prepare, clf_prepare, clf_truncate, dpo_prepare, dpo_truncate, pack_blocks,
    pretrain_prepare, pretrain_from_files, pad_batches, pad_batches_left)}


def _join(values: str) -> str:
    return f"array_to_string({values}, ' ')"


def _label_ids(ids: str, target_ids: str) -> str:
    return (f"list_transform({ids}, lambda x, i: CASE WHEN len({target_ids}) > 0 "
            f"AND i <= len({ids}) - len({target_ids}) THEN -100 ELSE x END)")


def _sft_views(user: str, assistant: str, block: int) -> dict[str, str]:
    prefix = f"CASE WHEN i % 2 = 1 THEN '{user}' ELSE '{assistant}' END"
    return {
        "turns": """
            SELECT qid, segs, CASE WHEN trainable_round = -1 THEN n_turn ELSE
              CAST('0x' || substr(md5('42|' || qid), 1, 8) AS BIGINT) % n_turn + 1 END AS turn
            FROM (SELECT qid, trainable_round, string_split(text, '[[SEP]]') AS segs,
              len(string_split(text, '[[SEP]]')) // 2 AS n_turn FROM sft_input WHERE text IS NOT NULL)
            WHERE n_turn >= 1 AND NOT list_contains(list_filter(segs, lambda s, i: i % 2 = 0), '')""",
        "pairs": f"""
            SELECT qid, array_to_string(texts[:-2], '') AS source, texts[-1] || '</s>' AS target FROM (
              SELECT qid, list_transform(segs[:2 * turn], lambda s, i: {prefix} || s) AS texts
              FROM turns)""",
        "encoded": f"""
            SELECT qid, {ids_sql("source || ' ' || target")}[:{2 * block}] AS ids,
              {ids_sql('source')}[:{2 * block}] AS source_ids,
              {ids_sql('target')}[:{2 * block}] AS target_ids FROM pairs""",
        "kept": f"SELECT qid, ids, {_label_ids('ids', 'target_ids')} AS labels FROM encoded "
                f"WHERE len(ids) < {block}",
    }


_HEADED = _sft_views("### User: ", "### Assistant: ", DEFAULT_BLOCK)
_SHORT = _sft_views("### User: ", "### Assistant: ", BLOCK)
_PLAIN = _sft_views("", "", DEFAULT_BLOCK)
_PAD = {
    "batched": "SELECT *, (row_number() OVER (ORDER BY qid) - 1) // 8 AS batch_id FROM kept",
    "sized": "SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) - len(ids) AS gap FROM batched",
}
_CHOSEN = {k: v for k, v in preference_queries._SELECTION.items()}


def _filled(values: str, fill: str, side: str) -> str:
    gap = f"list_transform(range(gap), lambda g: {fill})"
    return _join(f"{values} || {gap}" if side == "right" else f"{gap} || {values}")


def _padded_sql(side: str) -> str:
    return with_views("sft_input", f"""
        SELECT qid, batch_id, {_filled('ids', '0', side)} AS input_ids,
          {_filled('labels', '-100', side)} AS labels,
          {_filled("list_transform(ids, lambda x: 'true')", "'false'", side)} AS attention_mask
        FROM sized""", **_HEADED, **_PAD)


def _pair_columns(block: int | None) -> tuple[str, str]:
    """Encoded and final columns of the three answers; without a block nothing is cut."""
    encoded, final = [], []
    twice, last = (f"[:{2 * block}]", f"[-{block}:]") if block else ("", "")
    for column, suffix in (("text", ""), ("accepted", "_accepted"), ("rejected", "_rejected")):
        target = f"'### Assistant: ' || string_split({column}, '[[SEP]]')[-1] || '</s>'"
        source = "'### User: ' || string_split(text, '[[SEP]]')[1]"
        row, goal = f"{source} || ' ' || {target}", target
        encoded.append(f"{ids_sql(row)}{twice} AS ids{suffix}, {ids_sql(goal)}{twice} AS goal{suffix}")
        labels = _label_ids(f"ids{suffix}", f"goal{suffix}")
        final.append(f"{_join(f'ids{suffix}{last}')} AS input_ids{suffix}")
        final.append(f"{_join(f'({labels}){last}')} AS labels{suffix}")
        mask = f"list_transform(ids{suffix}{last}, lambda x: 'true')"
        final.append(f"{_join(mask)} AS attention_mask{suffix}")
    return ", ".join(encoded), ", ".join(final)


def _packed_sql(source: str, ids: str, group: int, full: bool) -> str:
    """Blocks from one row per token, numbered within the group."""
    complete = f"WHERE block < total // {BLOCK}" if full else ""
    return f"""
        SELECT pack_group, block, string_agg(id, ' ' ORDER BY pos) AS input_ids FROM (
          SELECT pack_group, id, pos, pos // {BLOCK} AS block,
            count(*) OVER (PARTITION BY pack_group) AS total FROM (
            SELECT row_id // {group} AS pack_group, ids[k] AS id, row_number() OVER (
              PARTITION BY row_id // {group} ORDER BY row_id, k) - 1 AS pos FROM (
              SELECT row_id, ids, unnest(range(1, len(ids) + 1)) AS k FROM (
                SELECT row_id, {ids} AS ids FROM {source}))))
        {complete} GROUP BY pack_group, block"""


_CONVERSATION_VOCABULARY = f"""
    SELECT token, row_number() OVER (ORDER BY n DESC, token) + 2 AS id FROM (
      SELECT token, count(*) AS n FROM (SELECT unnest({words_sql('text')}) AS token FROM sft_input)
      GROUP BY token)"""
_VOCAB_ENCODE = with_views("sft_input", f"""
    SELECT s.qid, string_agg(coalesce(v.id, 1), ' ' ORDER BY k) AS input_ids FROM (
      SELECT qid, words[k] AS token, k FROM (
        SELECT qid, words, unnest(range(1, len(words) + 1)) AS k FROM (
          SELECT qid, {words_sql('text')} AS words FROM sft_input))) s
    LEFT JOIN vocabulary v ON s.token = v.token GROUP BY s.qid""", vocabulary=_CONVERSATION_VOCABULARY)


def _preference_sql(block: int | None) -> str:
    encoded, final = _pair_columns(block)
    return with_views(
        "scored scores originals", f"SELECT qid, {final} FROM encoded", **_CHOSEN,
        chosen="""SELECT o.qid, o.text, p.accepted, p.rejected FROM originals o JOIN pairs p
                  ON o.qid = p.qid WHERE accepted IS NOT NULL AND rejected IS NOT NULL""",
        encoded=f"SELECT qid, {encoded} FROM chosen")


def _classification_sql(block: int) -> str:
    return with_views("clf_input", f"""
        SELECT qid, coalesce(label, -100) AS labels,
          {_join(f"{ids_sql('text')}[:{block}]")} AS input_ids FROM clf_input""")

SQL = {
    "tokenize_ws": f"""
        SELECT doc_id, CAST(len({words_sql('text')}) AS INTEGER) AS n_tokens,
          {_join(ids_sql('text'))} AS input_ids FROM documents""",
    "token_lengths": f"""
        SELECT doc_id, CAST(len({words_sql('text')}) + 1 AS INTEGER) AS n_tokens FROM documents""",
    "build_vocab": f"""
        SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 2 AS INTEGER) AS id FROM (
          SELECT token, count(*) AS n FROM (SELECT unnest({words_sql('text')}) AS token FROM documents)
          WHERE token <> '</s>' GROUP BY token)""",
    "vocab_encode": _VOCAB_ENCODE,
    "vocab_encode_joined": f"""
        SELECT CASE WHEN qid % 5 <> 0 THEN qid % 7 END AS qid, input_ids FROM ({_VOCAB_ENCODE})""",
    "sft_dec": with_views("sft_input", f"""
        SELECT qid, {_join('ids')} AS input_ids, {_join('labels')} AS labels FROM kept""", **_HEADED),
    "sft_length_filter": with_views("sft_input", f"""
        SELECT qid, {_join('ids')} AS input_ids, {_join('labels')} AS labels FROM kept""", **_SHORT),
    "sft_encdec": with_views("sft_input", f"""
        SELECT qid, {_join('source_ids')} AS input_ids, {_join('target_ids')} AS labels FROM encoded
        WHERE len(source_ids) + len(target_ids) < {DEFAULT_BLOCK}""", **_HEADED),
    "sft_prepare": with_views("sft_input", f"""
        SELECT qid, 'conversations' AS data_group, {_join('ids')} AS input_ids,
          {_join('labels')} AS labels,
          {_join("list_transform(ids, lambda x: 'true')")} AS attention_mask FROM kept""", **_PLAIN),
    "clf_prepare": _classification_sql(DEFAULT_BLOCK),
    "clf_truncate": _classification_sql(BLOCK),
    "dpo_prepare": _preference_sql(DEFAULT_BLOCK),
    "dpo_truncate": _preference_sql(None),
    "pack_blocks": with_views(
        "", _packed_sql("numbered", ids_sql("text"), 100, full=False),
        numbered="SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents"),
    "pretrain_prepare": with_views(
        "numbered_lines", "SELECT *, input_ids AS labels FROM packed",
        packed=_packed_sql("numbered_lines", f"list_append({ids_sql('text')}, 2)", 1000, full=True)),
    "pretrain_from_files": f"""
        SELECT lang, pack_group, block, string_agg(id, ' ' ORDER BY pos) AS input_ids FROM (
          SELECT lang, pack_group, id, pos, pos // {BLOCK} AS block,
            count(*) OVER (PARTITION BY lang, pack_group) AS total FROM (
            SELECT lang, row_id // 1000 AS pack_group, ids[k] AS id, row_number() OVER (
              PARTITION BY lang, row_id // 1000 ORDER BY row_id, k) - 1 AS pos FROM (
              SELECT lang, row_id, ids, unnest(range(1, len(ids) + 1)) AS k FROM (
                SELECT lang, list_append({ids_sql('text')}, 2) AS ids,
                  row_number() OVER (PARTITION BY lang ORDER BY doc_id, line) - 1 AS row_id FROM (
                  SELECT lang, doc_id, line, lines[line] AS text FROM (
                    SELECT lang, doc_id, lines, unnest(range(1, len(lines) + 1)) AS line FROM (
                      SELECT lang, doc_id, string_split(text, chr(10)) AS lines FROM documents)))))))
        WHERE block < total // {BLOCK} GROUP BY lang, pack_group, block""",
    "pad_batches": _padded_sql("right"),
    "pad_batches_left": _padded_sql("left"),
}
