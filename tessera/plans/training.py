"""Tokenised training tables: pretraining, fine-tuning, classification, preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import arrays as ar, text as tx
from ..functions.binding import let
from ..operators import filters
from ..operators.packing import pack_blocks, pad_batches
from ..operators.tokenizers import HashTokenizer, Tokenizer
from ..session import stage
from ..sources.readers import read_text_lines

LM_TYPES = ("dec", "encdec")
_TAGS = ("qid", "data_group")
MOST_SHIPPED_SPLITS = 100_000  # about 20 MB with their paths


def _tokenised(df: DataFrame, texts: dict[str, tuple[Column, Column]], tokenizer: Tokenizer,
               block_size: int, lm_type: str, source_ids: str | None = None) -> DataFrame:
    """Add struct(ids, labels) for each named (source, target) pair, cut at two blocks.

    Token ids are columns of their own first: a Python tokenizer cannot be
    called inside the array functions that go on from them. All pairs take each
    step together, so that a row is written once for a step. `source_ids`
    names a column that already holds the ids of every source, of use with a
    tokenizer whose ids can be joined.
    """
    if lm_type not in LM_TYPES:
        raise ValueError(f"unexpected lm_type: {lm_type}; expected one of {LM_TYPES}")
    limit = 2 * block_size
    goals = {name + "_goal": tokenizer.encode(target, limit) for name, (_, target) in texts.items()}
    if lm_type == "dec" and source_ids and tokenizer.joinable:
        df = df.withColumns(goals).withColumns({
            name + "_ids": ar.keep_first(F.concat(source_ids, name + "_goal"), min(limit, tokenizer.model_max_length))
            for name in texts})
    else:
        df = df.withColumns(goals | {
            name + "_ids": tokenizer.encode(F.concat_ws(" ", source, target) if lm_type == "dec" else source, limit)
            for name, (source, target) in texts.items()})

    def labels(name: str) -> Column:
        if lm_type == "dec":
            return ar.target_labels(F.col(name + "_ids"), F.size(name + "_goal"), tokenizer.pad_id)
        return ar.ignore_pads(F.col(name + "_goal"), tokenizer.pad_id)

    rows = {name: F.struct(F.col(name + "_ids").alias("ids"), labels(name).alias("labels")) for name in texts}
    return df.withColumns(rows).drop(*[name + part for name in texts for part in ("_ids", "_goal")])


def _training_arrays(row: Column, tokenizer: Tokenizer, block_size: int) -> Column:
    """struct of the three arrays of a row, cut from the front to one block."""
    return let(ar.keep_last(row["ids"], block_size), lambda ids: F.struct(
        ids.alias("input_ids"),
        ar.keep_last(row["labels"], block_size).alias("labels"),
        ar.not_pad(ids, tokenizer.pad_id).alias("attention_mask")))


def chosen_turn(segs: Column, seed: int, key: Column, trainable_round: Column | None = None) -> Column:
    """The turn a conversation ends at: a seeded one, or the last if asked."""
    turns = F.floor(F.size(segs) / F.lit(2)).cast("int")
    drawn = tx.seeded_uniform_int(seed, turns, key)
    if trainable_round is None:
        return drawn
    return F.when(trainable_round.eqNullSafe(F.lit(-1)), turns).otherwise(drawn)


def conversation_pairs(rows: DataFrame, template_name: str | None = None, seed: int = 42,
                       key: str = "qid") -> DataFrame:
    """`source` and `target` text of each usable conversation.

    Null texts, conversations with an empty answer and those without a
    complete turn drop out. The turns up to the chosen one are kept; a
    question left open after it is cut.
    """
    usable = filters.drop_empty_answers(filters.drop_null_text(rows)).withColumn(
        "_segs", tx.segments(F.col("text")))
    usable = usable.where(F.size("_segs") >= 2)
    asked = F.col("trainable_round") if "trainable_round" in rows.columns else None
    drawn_by = F.col(key) if key in rows.columns else F.col("text")
    turn = chosen_turn(F.col("_segs"), seed, drawn_by, asked)
    prefixed = tx.add_role_prefix(F.slice("_segs", F.lit(1), F.col("_turn") * 2), template_name)
    return (
        usable.withColumn("_turn", turn).withColumn("_texts", prefixed)
        .withColumn("source", F.array_join(
            F.slice("_texts", F.lit(1), F.size("_texts") - 1), ""))
        .withColumn("target", F.element_at("_texts", -1))
        .drop("_segs", "_turn", "_texts")
    )


def unusable_conversations(rows: DataFrame) -> DataFrame:
    """How many rows `conversation_pairs` leaves out, by the first reason met."""
    segs = tx.segments(F.col("text"))
    reason = (
        F.when(F.col("text").isNull(), "no text")
        .when(tx.has_empty_answer(segs), "empty answer")
        .when(F.size(segs) < 2, "no complete turn")
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n")).where(
        F.col("reason").isNotNull())


def prepare_sft(rows: DataFrame, tokenizer: Tokenizer | None = None,
                block_size: int | None = None, lm_type: str = "dec",
                template_name: str | None = None, seed: int = 42) -> DataFrame:
    """Fine-tuning table: input_ids, labels, attention_mask and the row's tags."""
    tokenizer = tokenizer or HashTokenizer()
    block_size = ar.resolve_block_size(block_size, tokenizer.model_max_length)
    pairs = conversation_pairs(
        filters.select_known(rows, ["text", "qid", "trainable_round", "data_group"]),
        template_name, seed)
    target = F.concat(F.col("target"), F.lit(tokenizer.eos_token))
    encoded = _tokenised(pairs, {"_row": (F.col("source"), target)}, tokenizer, block_size, lm_type)
    # Filtering the one-row array, not the table, tokenises each text once:
    # a table filter on the length would be pushed below and repeat the work.
    short = F.filter(F.array(F.col("_row")), lambda r: _length(r, lm_type) < block_size)
    tags = [c for c in _TAGS if c in pairs.columns]
    return encoded.select(*tags, F.inline(F.transform(
        short, lambda r: _training_arrays(r, tokenizer, block_size))))


def _length(row: Column, lm_type: str) -> Column:
    """What must stay below the block size: all ids the model sees."""
    ids = F.size(row["ids"])
    return ids if lm_type == "dec" else ids + F.size(row["labels"])


def prepare_classification(rows: DataFrame, tokenizer: Tokenizer | None = None,
                           block_size: int | None = None) -> DataFrame:
    """Classification table: ids of the first segment and the label or -100."""
    tokenizer = tokenizer or HashTokenizer()
    block_size = ar.resolve_block_size(block_size, tokenizer.model_max_length)
    known = filters.drop_null_text(
        filters.select_known(rows, ["text", "qid", "label", "data_group"]))
    label = F.col("label") if "label" in known.columns else F.lit(None)
    tags = [c for c in _TAGS if c in known.columns]
    ids = tokenizer.encode(tx.first_segment(F.col("text")), block_size)
    return known.select(
        *tags, ids.alias("input_ids"),
        F.coalesce(label.cast("int"), F.lit(ar.IGNORE_INDEX)).alias("labels"))


def incomplete_pairs(rows: DataFrame) -> DataFrame:
    """How many rows `prepare_preference` leaves out for a missing text."""
    missing = F.col("text").isNull() | F.col("accepted").isNull() | F.col("rejected").isNull()
    return rows.agg(F.count_if(missing).alias("n_incomplete"))


def prepare_preference(rows: DataFrame, tokenizer: Tokenizer | None = None,
                       block_size: int | None = None, lm_type: str = "dec",
                       template_name: str | None = None) -> DataFrame:
    """Preference table: the three arrays for the text and both answers.

    The first segment of `text` is the question; the last segments of
    `text`, `accepted` and `rejected` are the answers to it.
    """
    tokenizer = tokenizer or HashTokenizer()
    block_size = ar.resolve_block_size(block_size, tokenizer.model_max_length)
    known = filters.select_known(
        rows, ["text", "qid", "trainable_round", "accepted", "rejected", "data_group"])
    complete = known.dropna(subset=["text", "accepted", "rejected"])
    roles = tx.template(template_name)
    source = F.concat(F.lit(roles["user"]), tx.first_segment(F.col("text")))
    tags = [c for c in _TAGS if c in known.columns]
    # The question is the same for all three answers.
    complete = complete.withColumn("_question", tokenizer.encode(source, 2 * block_size))
    texts = {"_" + column: (source, F.concat(F.lit(roles["assistant"]), tx.last_segment(F.col(column)),
                                             F.lit(tokenizer.eos_token)))
             for column in ("text", "accepted", "rejected")}
    encoded = _tokenised(complete, texts, tokenizer, block_size, lm_type, "_question")
    cut, arrays = {}, []
    for row, suffix in (("_text", ""), ("_accepted", "_accepted"), ("_rejected", "_rejected")):
        ids, labels = "input_ids" + suffix, "labels" + suffix
        cut |= {ids: ar.keep_last(F.col(row)["ids"], block_size), labels: ar.keep_last(F.col(row)["labels"], block_size)}
        arrays += [ids, labels, ar.not_pad(F.col(ids), tokenizer.pad_id).alias("attention_mask" + suffix)]
    return encoded.withColumns(cut).select(*tags, *arrays)


def prepare_pretraining(lines: DataFrame, tokenizer: Tokenizer | None = None,
                        block_size: int | None = None, add_special: bool = True,
                        group_rows: int = 1000, row_id: str = "row_id",
                        within: tuple[str, ...] = (), keep_tail: bool = False) -> DataFrame:
    """Packed blocks of the lines' ids, in groups of consecutive lines."""
    tokenizer = tokenizer or HashTokenizer()
    block_size = ar.resolve_block_size(block_size, tokenizer.model_max_length)
    ids = tokenizer.encode(F.col("text"), add_special=add_special)
    encoded = lines.select(*within, row_id, ids.alias("input_ids"))
    return pack_blocks(
        encoded, block_size, group_rows, row_id=row_id, within=within, keep_tail=keep_tail)


def pretraining_from_files(spark: SparkSession, paths: str, by_folder: bool = False, **options: object) -> DataFrame:
    """Packed blocks of text files, each file packed on its own; or each folder, its files in order of their names.

    Lines are numbered within their file or folder, so blocks do not depend on how a
    file is split for reading. Only the sizes of the splits are gathered
    for that; the lines are shuffled once, for the packing itself.
    """
    lines, within = read_text_lines(spark, paths, order_columns=True), "_path"
    if by_folder:
        within = "_folder"
        lines = lines.withColumn(within, F.regexp_replace("_path", "/[^/]*$", ""))
    return prepare_pretraining(number_lines(lines, within), row_id="_number", within=(within,), **options)


def number_lines(lines: DataFrame, within: str = "_path") -> DataFrame:
    """`lines` with `_number`, their place in the file they were read from, or in what `within` names of it.

    A split is read by one task from front to back, so the first line and
    the size of each split are enough. They are one row per split, and are
    shipped to the tasks while they are few.
    """
    splits = lines.groupBy(*dict.fromkeys([within, "_path", "_split"])).agg(
        F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(within).orderBy("_path", "_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(splits.select(
        "_path", "_split", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")), "splits")
    if starts.count() <= MOST_SHIPPED_SPLITS:
        starts = F.broadcast(starts)
    return lines.join(starts, ["_path", "_split"]).withColumn(
        "_number", F.col("_line") - F.col("_first") + F.col("_start")).drop("_first", "_start")


def training_batches(table: DataFrame, batch_size: int, tokenizer: Tokenizer | None = None,
                     row_id: str = "row_id", side: str = "right") -> DataFrame:
    """Padded batches of a prepared table: ids, labels and masks by their own fill."""
    pad_id = (tokenizer or HashTokenizer()).pad_id
    fills = {}
    for name, kind in table.dtypes:
        if not kind.startswith("array"):
            continue
        if name.startswith("input_ids"):
            fills[name] = pad_id
        elif name.startswith("labels"):
            fills[name] = ar.IGNORE_INDEX
        elif name.startswith("attention_mask"):
            fills[name] = False
    return pad_batches(table, batch_size, fills, row_id, side)
