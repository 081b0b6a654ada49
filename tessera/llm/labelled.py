"""Labelled rows to learn from: a bounded sample, the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(text, label) of up to `per_class` labelled rows of either class, and each row's weight by class.

    Rows are chosen by a hash of their id. A weight is the number of
    labelled rows that one sampled row stands for. Rows without an id or a
    label are not used; of several labels of one id the smallest counts, and
    of several texts the one with the smallest hash, as one row. The chosen
    ids, 2 * `per_class` at most, are broadcast, and the rows found are
    written out, so that the documents are read once for all that is learned.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("label").alias("label")))
    counts = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = known.where("label = 0").orderBy(*order).limit(per_class).unionAll(
        known.where("label = 1").orderBy(*order).limit(per_class))
    weights = {k: max(1.0, n / per_class) for k, n in counts.items()}
    order = F.struct(F.col("text").isNull(), F.xxhash64("text"), "text")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(
        F.min_by("text", order).alias("text"))
    return stage(texts.select("doc_id", "text", "label"), "sample"), weights
