"""Tokenizers and vocabularies.

A tokenizer turns a text column into a column of ids. The built-in one is a
column expression; a pretrained one plugs in as a vectorised function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as ar
from ..session import stage
from .position import with_row_id

PAD_ID, UNK_ID, EOS_ID, FIRST_WORD_ID = 0, 1, 2, 3
PAD_TOKEN, UNK_TOKEN, EOS_TOKEN = "<pad>", "<unk>", "</s>"
UNLIMITED = 1 << 30
_BLANKS = r"[ \t\n\r\f]+"


def words(text: Column, eos_token: str = EOS_TOKEN) -> Column:
    """Words between blanks; the end-of-sequence text is a word of its own."""
    apart = F.replace(text, F.lit(eos_token), F.lit(f" {eos_token} "))
    return F.array_remove(F.split(apart, _BLANKS, -1), "")


class Tokenizer:
    """What the preparation jobs need: ids, special ids, length limit."""

    pad_id = PAD_ID
    eos_id = EOS_ID
    eos_token = EOS_TOKEN
    model_max_length = UNLIMITED
    # Whether the ids of two texts joined by a blank are those of both in turn.
    joinable = False

    def ids(self, text: Column, limit: int | None = None) -> Column:
        """All ids of `text`; those after the first `limit` may be left out."""
        raise NotImplementedError

    def encode(self, text: Column, max_length: int | None = None, add_eos: bool = False,
               add_special: bool = False) -> Column:
        """Ids cut to the shorter of `max_length` and the model's limit.

        `add_eos` puts the end id after the cut; `add_special` counts it in.
        """
        limit = min(max_length, self.model_max_length) if max_length else self.model_max_length
        end = F.array(F.lit(self.eos_id))
        encoded = self.ids(text, limit)
        if add_special:
            encoded = F.concat(encoded, end)
        encoded = ar.keep_first(encoded, limit)
        return F.concat(encoded, end) if add_eos else encoded


class HashTokenizer(Tokenizer):
    """Words hashed into a fixed id range: no vocabulary to build or ship."""

    joinable = True

    def __init__(self, n_ids: int = 50_000, model_max_length: int = UNLIMITED):
        self.n_ids = n_ids
        self.model_max_length = model_max_length

    def ids(self, text: Column, limit: int | None = None) -> Column:
        def word_id(word: Column) -> Column:
            hashed = (F.crc32(word) % self.n_ids + FIRST_WORD_ID).cast("int")
            return F.when(word == EOS_TOKEN, F.lit(EOS_ID)).otherwise(hashed)

        found = words(text)
        if limit is not None and limit < UNLIMITED:
            found = ar.keep_first(found, limit)
        return F.transform(found, word_id)


class FunctionTokenizer(Tokenizer):
    """A pretrained tokenizer: `load()` runs once per Python worker task.

    It returns a callable from a list of texts to a list of id lists.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], Sequence[Sequence[int]]]],
                 pad_id: int, eos_id: int, eos_token: str, model_max_length: int):
        self.pad_id, self.eos_id, self.eos_token = pad_id, eos_id, eos_token
        self.model_max_length = model_max_length

        @F.pandas_udf("array<int>")
        def encode_series(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for texts in batches:
                yield pd.Series([list(ids) for ids in encode(texts.tolist())], dtype=object)

        self._udf = encode_series

    def ids(self, text: Column, limit: int | None = None) -> Column:
        return F.when(text.isNotNull(), self._udf(F.coalesce(text, F.lit(""))))


def build_vocabulary(df: DataFrame, text: str, max_size: int | None = None) -> DataFrame:
    """(token, n, id) with ids by falling count, then token, after the specials.

    Counting combines before its shuffle, and words are numbered across all
    partitions. `max_size` keeps the commonest.
    """
    counts = (
        df.select(F.explode(words(F.col(text))).alias("token"))
        .where(F.col("token") != EOS_TOKEN)
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    )
    numbered = with_row_id(counts, [F.desc("n"), F.asc("token")], name="id")
    if max_size:
        numbered = numbered.where(F.col("id") < max_size)
    return numbered.withColumn("id", (F.col("id") + FIRST_WORD_ID).cast("int"))


def encode_with_vocabulary(df: DataFrame, text: str, vocabulary: DataFrame,
                           out: str = "input_ids") -> DataFrame:
    """Look up every word of `text`; unknown words get the unknown id.

    The vocabulary is joined word by word, so neither its size nor the length
    of a word matters, and the ids are put back in order for each row. Rows
    are told apart by a number of their own, given before they are written
    out; equal rows, and rows without any id, stay separate.
    """
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "texts")
    known = F.when(F.col("token") == EOS_TOKEN, F.lit(EOS_ID)).otherwise(
        F.coalesce("id", F.lit(UNK_ID)))
    # The vocabulary is unique per token, so adaptive execution may split a
    # frequent word's partition and still meet its one entry.
    found = (
        rows.select("_row", F.posexplode(words(F.col(text))).alias("_pos", "token"))
        .join(vocabulary.select("token", "id"), "token", "left")
        .select("_row", "_pos", known.alias("_id")))
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("_pos", "_id"))), lambda p: p["_id"])
    lists = found.groupBy("_row").agg(ordered.alias(out))
    empty = F.when(F.col(text).isNotNull(), F.array().cast("array<int>"))
    return rows.join(lists, "_row", "left").withColumn(out, F.coalesce(F.col(out), empty)).drop("_row")
