"""Linking quotations: which message answers which, read off the quoted lines.

Messages may quote earlier ones, with one `>` for each level. Quoted
passages are hashed in a normal form and joined to the message of the same
conversation that said them first. Conversations are then put in reply order,
without the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.position import with_row_id
from ..session import stage
from .common import sliced

_PASSAGES = "array<struct<level:int,size:int,hash:long>>"
# Scripts written without blanks between words: Thai, Lao, Burmese, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_SENTENCE_ENDS = r"""[.!?…]+["'”’»)\]]*\s+|[。！？｡؟۔।။។]+"""


def split_quotes(text: str) -> list[tuple[int, list[str]]]:
    """Runs of lines with the same number of leading `>`, which may have blanks between them."""
    runs: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        level, rest = 0, line
        while (stripped := rest.lstrip(" \t")).startswith(">"):
            level, rest = level + 1, stripped[1:]
        if level and rest.startswith(" "):
            rest = rest[1:]
        if runs and runs[-1][0] == level:
            runs[-1][1].append(rest)
        else:
            runs.append((level, [rest]))
    return runs


def _introduces(line: str) -> bool:
    """Whether a line only says whose words follow."""
    line = line.strip().lower()
    return line.endswith(("wrote:", "schrieb:", "écrit :", "écrit:", "escribió:"))


def _normal(text: str) -> str:
    """The words alone, in lower case; in scripts without blanks, without those that wrapping puts in."""
    import re

    words = " ".join(re.findall(r"\w+", text.lower()))
    return words if words.isascii() else re.sub(f"(?<=[{_UNSPACED}]) (?=[{_UNSPACED}])", "", words)


def _hashes(lines: list[str]) -> list[tuple[int, int]]:
    """(size, hash) of a run as a whole, its paragraphs, its lines, and the sentences of both.

    The size is that of the normal form. A run without any word is hashed by
    its signs as a whole, at size 0.
    """
    import re

    import xxhash

    paragraphs: list[list[str]] = [[]]
    for line in lines:
        if line.strip():
            paragraphs[-1].append(line)
        elif paragraphs[-1]:
            paragraphs.append([])
    found: set[str] = set()
    whole = []
    for paragraph in paragraphs:
        normal = [_normal(line) for line in paragraph]
        found.update(normal)
        joined = " ".join(paragraph)
        whole.append(_normal(joined) if len(paragraph) > 1 else "".join(normal))
        for text in {joined, *paragraph}:
            parts = re.split(_SENTENCE_ENDS, text)
            if len(parts) > 1:
                found.update(map(_normal, parts))
    found.update(whole)
    found.add(_normal(" ".join(whole)))
    found.discard("")
    sized = [(len(part), part) for part in found]
    if not found and (signs := "".join("".join(lines).split())):
        sized = [(0, signs)]
    return [(size, xxhash.xxh3_64_intdigest(part) - (1 << 63)) for size, part in sized]


def _runs(text: str | None) -> tuple[str | None, list[tuple[int, list[str]]]]:
    """A message's own words, and its runs by level, own ones without the lines that introduce a quote."""
    if not text or ">" not in text:
        return text, [(0, (text or "").split("\n"))]
    runs = split_quotes(text)
    for place, (level, lines) in enumerate(runs):
        if level:
            continue
        if place:
            while lines and not lines[0].strip():
                lines = lines[1:]
        if place + 1 < len(runs):
            while lines and (not lines[-1].strip() or _introduces(lines[-1])):
                lines = lines[:-1]
        runs[place] = (0, lines)
    own = ["\n".join(lines) for level, lines in runs if not level]
    if len(runs) > 1:
        return "\n".join(part for part in own if part.strip()), runs
    return own[0] if own else "", runs


def _own_texts(batches):
    import pyarrow as pa

    for batch in sliced(batches):
        texts = [_runs(text)[0] for text in batch.column("text").to_pylist()]
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in kept] + [pa.array(texts, pa.string())], [*kept, "text"])


def _passages_function(quoted: bool):
    """The passages that messages quote, or those that they say themselves."""

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("level", pa.int32()), ("size", pa.int32()), ("hash", pa.int64())]))
        for batch in sliced(batches):
            passages = []
            for text in batch.column("text").to_pylist():
                own, runs = _runs(text)
                parts = [(level, lines) for level, lines in runs if quoted == (level > 0)]
                if not quoted and len(parts) > 1:
                    parts.append((0, own.split("\n")))
                passages.append([{"level": level, "size": n, "hash": h} for level, lines in parts
                                 for n, h in _hashes(lines)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("turn"), pa.array(passages, kind)], ["conv", "turn", "passages"])

    return run


def _conversation(conv_id: Column) -> Column:
    """A key that is never null; rows without an id are a conversation of their own."""
    return F.coalesce(F.concat(F.lit("c"), conv_id.cast("string")), F.lit("n"))


def _parents(source: DataFrame) -> DataFrame:
    """(conv, turn, parent): the message that each quoting message answers.

    Of the shallowest level that is found, the longest passage and then the
    latest message. What a passage's first message is, is one row
    for each passage of a conversation, so a passage said over and over again
    is combined before it is shuffled and joined once. Only texts with a `>`
    are read for quotes.
    """
    turn = source.schema["turn"].dataType.simpleString()

    def passages(rows: DataFrame, quoted: bool) -> DataFrame:
        return rows.select("conv", "turn", "text").mapInArrow(
            _passages_function(quoted), f"conv string, turn {turn}, passages {_PASSAGES}").select(
            "conv", "turn", F.explode("passages").alias("p")).select("conv", "turn", "p.*")

    messages = source.where("turn IS NOT NULL")
    originals = passages(messages, False).groupBy("conv", "hash").agg(F.min("turn").alias("original"))
    quoted = passages(messages.where(F.col("text").contains(">")), True).distinct()
    return (
        quoted.join(originals, ["conv", "hash"]).where("original < turn")
        .groupBy("conv", "turn").agg(F.max(F.struct(-F.col("level"), "size", "original")).alias("best"))
        .select("conv", "turn", F.col("best.original").alias("parent")))


def _roots(parents: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(conv, turn, parent, root, depth), following parents in doubling steps.

    A parent is always earlier, so there are no circles; the number of
    rounds is the logarithm of the longest chain of replies.
    """
    current = stage(parents.withColumns({"root": F.col("parent"), "depth": F.lit(1)}), "replies")
    total = None
    for _ in range(most_rounds):
        now = current.agg(F.sum(F.col("depth").cast("long"))).first()[0]
        if now == total or now is None:
            return current
        total = now
        above = current.select("conv", F.col("turn").alias("root"), F.col("root").alias("_r"), F.col("depth").alias("_d"))
        current = stage(
            current.join(above, ["conv", "root"], "left").select(
                "conv", "turn", "parent", F.coalesce("_r", "root").alias("root"),
                (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")), "replies")
    raise RuntimeError("replies are chained too deeply")


def link_quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, reply_to, thread, depth, position): one row per row of `messages`.

    `text` has no quotes and no line that introduces them. `reply_to` is the
    turn of the quoted message, null where nothing quoted was said before in
    the conversation. `thread` is the turn at the head of the chain of
    replies, `depth` the number of replies from there. `position` counts from
    0 through the conversation in reply order: threads by their heads, and
    within a thread by turn, so that no message stands before the one it
    answers. Rows alike in conversation, turn, role and text share a position.

    A quoted passage is a run of quoted lines, or a paragraph, a line or a
    sentence of one, of whatever length; its words are compared with the same
    parts of earlier messages. A piece cut out of the middle of a sentence
    that is no line of its own matches nothing. Passages without any word are
    compared by their signs, as whole runs.

    Null and empty texts quote nothing and are not quoted. A null turn comes
    first, has no links and is no head of others. Rows without a conversation
    id are one conversation. Several messages of one turn share its links.
    Quotes that match nothing are taken out all the same. Other columns are
    not read.

    Only hashes and keys are shuffled until the texts are joined to their
    places, once.
    """
    source = messages.select("conv_id", "turn", "role", "text").withColumns({
        "conv": _conversation(F.col("conv_id")),
        "mark": F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.col("text").isNull())})
    described = (f"conv_id {source.schema['conv_id'].dataType.simpleString()}, "
                 f"turn {source.schema['turn'].dataType.simpleString()}, role string, conv string, mark long, "
                 "text string")
    own = source.select("conv_id", "turn", "role", "conv", "mark", "text").mapInArrow(_own_texts, described)
    links = _roots(_parents(source))
    keys = source.groupBy("conv", "turn", "mark").agg(F.count(F.lit(1)).alias("copies"))
    placed = keys.join(links, ["conv", "turn"], "left").withColumn("thread", F.coalesce("root", "turn"))
    numbered = stage(with_row_id(
        placed.select("conv", "turn", "mark", "parent", "thread", "depth"),
        ["conv", F.asc_nulls_first("thread"), F.asc_nulls_first("turn"), "mark"], "_row"), "places")
    starts = numbered.groupBy("conv").agg(F.min("_row").alias("_start"))
    places = numbered.join(starts, "conv").select(
        F.col("conv").alias("_conv"), F.col("turn").alias("_turn"), F.col("mark").alias("_mark"), "parent", "thread",
        "depth", (F.col("_row") - F.col("_start")).alias("position"))
    return own.join(
        places, (F.col("conv") == F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn"))
        & (F.col("mark") == F.col("_mark"))).select(
        "conv_id", "turn", "role", "text", F.col("parent").alias("reply_to"), "thread",
        F.coalesce("depth", F.lit(0)).alias("depth"), "position")
