"""Fixed-size token blocks and padded batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import arrays as ar
from .position import batch_of


def pack_blocks(rows: DataFrame, block_size: int, group_rows: int = 1000, ids: str = "input_ids",
                row_id: str = "row_id", within: Sequence[str] = (),
                keep_tail: bool = False) -> DataFrame:
    """Concatenate token lists and cut them into blocks of `block_size`.

    Rows are packed in groups of up to `group_rows` consecutive rows, and
    never across different values of the `within` columns; what does not
    fill a block at the end of a group is dropped unless `keep_tail`. Each
    row is sent on as the slices that fall into its blocks, never as one row
    per token, and the blocks are put together under the partitioning of the
    groups, so there is one shuffle in all.
    """
    group = [*within, "pack_group"]
    size = F.lit(block_size)
    grouped = rows.select(
        *within, batch_of(F.col(row_id), group_rows).alias("pack_group"), F.col(row_id).alias("_row"),
        F.col(ids).alias("_ids"), F.size(ids).cast("bigint").alias("_len"))
    in_order = Window.partitionBy(*group).orderBy("_row")
    placed = grouped.withColumns({
        "_end": F.sum("_len").over(in_order.rowsBetween(Window.unboundedPreceding, 0)),
        "_total": F.sum("_len").over(Window.partitionBy(*group)),
    }).withColumn("_start", F.col("_end") - F.col("_len")).where(F.col("_len") > 0)

    full_blocks = F.floor(F.col("_total") / size)
    last = F.floor((F.col("_end") - 1) / size)
    if not keep_tail:
        last = F.least(last, full_blocks - 1)
    first = F.floor(F.col("_start") / size)

    def piece(block):
        begin = F.greatest(block * size, F.col("_start"))
        end = F.least((block + 1) * size, F.col("_end"))
        skip = (begin - F.col("_start") + 1).cast("int")
        return F.struct(block.alias("block"), begin.alias("at"),
                        F.slice("_ids", skip, (end - begin).cast("int")).alias("part"))

    pieces = placed.where(first <= last).select(
        *group, F.inline(F.transform(F.sequence(first, last), piece)))
    joined = F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]))
    return (
        pieces.groupBy(*group, "block").agg(joined.alias("input_ids"))
        .withColumn("labels", F.col("input_ids"))
    )


def pad_batches(rows: DataFrame, batch_size: int, fills: Mapping[str, object],
                row_id: str = "row_id", side: str = "right",
                max_length: int | None = None) -> DataFrame:
    """Pad arrays to the longest of their batch, or to `max_length`.

    `fills` names each array and its padding value. Batches are
    `batch_size` consecutive rows, so a batch never grows with the data.
    """
    batched = rows.withColumn("batch_id", batch_of(F.col(row_id), batch_size))
    types = dict(batched.dtypes)
    batch = Window.partitionBy("batch_id")
    columns = {}
    for name, fill in fills.items():
        length = F.lit(max_length) if max_length else F.max(F.size(name)).over(batch)
        element = types[name].removeprefix("array<").removesuffix(">")
        columns[name] = ar.pad_to(F.col(name), length, F.lit(fill).cast(element), side)
    return batched.withColumns(columns)
