"""Resuming a job and lining model outputs up with their inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .selection import top_per_group
from .skew import lookup_join

_WORD_BYTES = 16


def _filter_place(key: str, words: int) -> tuple[Column, Column]:
    """Word of a Bloom filter that an id belongs to, and the two bits that it sets there."""
    quoted = "`" + key.replace("`", "``") + "`"
    one, two = (F.expr(f"shiftleft(1L, int(pmod(shiftright(xxhash64(1, {quoted}), {at}), 64)))") for at in (0, 6))
    return F.pmod(F.xxhash64(key), F.lit(words)), one.bitwiseOR(two)


def done_filter(done: DataFrame, key: str, words: int) -> DataFrame:
    """(_word, _bits): a Bloom filter over the ids of `done`, of at most `words` words of 64 bits.

    Tasks merge what they hold before words are merged between them.
    """
    word, bits = _filter_place(key, words)
    return done.where(F.col(key).isNotNull()).select(word.alias("_word"), bits.alias("_own")).groupBy("_word").agg(
        F.bit_or("_own").alias("_bits"))


def skip_done(df: DataFrame, done: DataFrame, key: str, status: str | None = "finish_reason",
              filter_words: int = 1 << 19) -> DataFrame:
    """Rows whose id is not among the finished ones.

    Finished rows that ended in an error are tried again. A null id counts
    as an id of its own: it is skipped once a null id is finished.

    A Bloom filter over the finished ids is broadcast, 64 bits in each of at
    most `filter_words` words. Rows that it rules out, most of them while the filter
    has over 16 bits for each id, stay where they are; the others meet the finished
    ids in an exact join. `df` is read once for each of the two. Where the session
    broadcasts less than such a filter may take, all rows meet in the join.
    """
    if status and status in done.columns:
        done = done.where(~F.col(status).eqNullSafe(F.lit("error")))
    ids = done.select(F.col(key)).distinct()
    known = df.where(F.col(key).isNotNull())
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if filter_words * _WORD_BYTES <= limit:
        word, bits = _filter_place(key, filter_words)
        marked = known.withColumn("_word", word).join(
            F.broadcast(done_filter(done, key, filter_words)), "_word", "left")
        maybe = F.coalesce(F.col("_bits").bitwiseAND(bits) == bits, F.lit(False))
        # Both sides of the join come straight from their shuffles: adaptive execution can split a frequent id.
        checked = marked.where(maybe).select(*df.columns).join(ids.dropna(), key, "left_anti").select(*df.columns)
        keyed = marked.where(~maybe).select(*df.columns).unionByName(checked)
    else:
        keyed = lookup_join(known, ids.dropna(), [key], "left_anti")
    # A limit of one row is enough to know that a null id is done.
    if ids.where(F.col(key).isNull()).limit(1).collect():
        return keyed
    return keyed.unionByName(df.where(F.col(key).isNull()))


def align_outputs(inputs: DataFrame, outputs: DataFrame, key: str,
                  order: Sequence[Column]) -> DataFrame:
    """Every input with its first output; a missing response becomes `''`."""
    first = top_per_group(outputs, [key], order)
    return inputs.join(first, key, "left").withColumn(
        "response", F.coalesce("response", F.lit("")))
