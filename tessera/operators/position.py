"""Row positions: Spark rows have none until an order is named."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import pin_file_ranges, stage

_OFFSET_BITS = 33


def with_row_id(df: DataFrame, order_by: Sequence[str | Column], name: str = "row_id",
                replayable: bool = False) -> DataFrame:
    """Number all rows 0..n-1 in the given order, without a one-task sort.

    Rows are range-partitioned and sorted, written once to the shared folder
    together with their (partition, offset), and shifted by the sizes of the
    partitions before theirs. Only that table of sizes, one row per
    partition, is summed in a single task and broadcast.

    Equal order keys are told apart by the position they were read at, so a
    large group of ties spreads over partitions. That position must come out
    the same if a lost task runs again: `replayable` says that `df` is a file
    scan without a shuffle after it. Anything else is written out first,
    which also spares computing it twice, as range partitioning samples it.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    ranged = (
        (df if replayable else stage(df, "unnumbered"))
        .withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, F.col("_tie"))
        .sortWithinPartitions(*order, F.col("_tie"))
        .withColumn("_slot", F.monotonically_increasing_id())
        .drop("_tie")
    )
    staged = stage(ranged, "row-id").select(
        "*",
        F.shiftright("_slot", _OFFSET_BITS).alias("_part"),
        F.col("_slot").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1)).alias("_offset"),
    )
    sizes = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return (
        staged.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_offset"))
        .drop("_slot", "_part", "_offset", "_start")
    )


def with_file_position(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows read from files 0..n-1 in the order of `_path`, `_split` and `_line`, without moving them.

    The readers count the rows of a split of a file one by one. So a first
    pass counts the rows of each split, the sum over the splits before gives
    where its numbers start, and each row adds its place in the split. Only one
    row for each split is summed and broadcast. Where rows are not counted
    one by one, as after a filter or in files of long records, they are
    sorted instead, see `with_row_id`.
    """
    pin_file_ranges(df.sparkSession)
    splits = stage(df.groupBy("_path", "_split").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_line").alias("_first"), F.max("_line").alias("_last")), "splits")
    if splits.where("_last - _first + 1 <> _rows").limit(1).collect():
        return with_row_id(df, ["_path", "_split", "_line"], name)
    before = Window.orderBy("_path", "_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        "_path", "_split", "_rows", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.col("_line") - F.col("_first")
    moved = F.raise_error(F.lit("the splits of the files have changed since their rows were counted")).cast("bigint")
    return (
        df.join(F.broadcast(starts), ["_path", "_split"], "left")
        .withColumn(name, F.when(place.between(0, F.col("_rows") - 1), F.col("_start") + place).otherwise(moved))
        .select(*df.columns, name))


def with_id(df: DataFrame, key: str) -> DataFrame:
    """`df` with an id column: its own, or its position in the files read.

    The position needs the `_path`, `_split` and `_line` columns that the
    readers add on request.
    """
    order = ["_path", "_split", "_line"]
    if key in df.columns:
        return df
    if not set(order) <= set(df.columns):
        raise ValueError(f"no column {key}, and no reading order to number the rows by")
    return with_file_position(df, key).drop(*order)


def shard_of(row_id: Column, world: int) -> Column:
    """The rank that owns a row when rows are dealt out in turn."""
    return F.pmod(row_id, F.lit(world)).cast("int")


def take_shard(df: DataFrame, rank: int, world: int, row_id: str = "row_id") -> DataFrame:
    """Rows rank, rank+world, rank+2*world, …"""
    if not 0 <= rank < world:
        raise ValueError(f"rank {rank} outside 0..{world - 1}")
    return df.where(shard_of(F.col(row_id), world) == rank)


def take_head(df: DataFrame, n: int | None, order_by: Sequence[str] = ("row_id",)) -> DataFrame:
    """The first `n` rows in order; everything when `n` is not set.

    `order_by` tells rows apart. Only these columns are numbered, and the
    last of the first `n` is what the rows are compared with, so no task
    gathers `n` rows.
    """
    if not n:
        return df
    numbered = with_row_id(df.select(*order_by), order_by, name="_place")
    last = numbered.where(F.col("_place") < n).orderBy(F.desc("_place")).drop("_place").limit(1).collect()
    if not last:
        return df
    keys = df.select(*order_by).schema
    bound = F.struct(*[F.lit(last[0][f.name]).cast(f.dataType).alias(f.name) for f in keys])
    return df.where(F.struct(*order_by) <= bound)


def _quotient(value: Column, by: int) -> Column:
    """Whole-number division that stays exact for any 64-bit value."""
    return F.call_function("div", value, F.lit(by).cast("bigint"))


def chunk_of(row_id: Column, n_rows: int, chunk_size: int) -> Column:
    """Chunk number when `n_rows` are cut into near-equal chunks.

    There are ceil(n / size) chunks and the first n mod k of them hold one
    row more, so the number follows from the position alone.
    """
    if n_rows == 0 or chunk_size <= 0:
        return F.lit(0).cast("bigint")
    chunks = -(-n_rows // chunk_size)
    small, larger = divmod(n_rows, chunks)
    edge = larger * (small + 1)
    return F.when(row_id < edge, _quotient(row_id, small + 1)).otherwise(
        F.lit(larger) + _quotient(row_id - F.lit(edge), max(small, 1)))


def batch_of(row_id: Column, batch_size: int) -> Column:
    """Batch number of fixed-size consecutive batches; the last may be short."""
    return _quotient(row_id.cast("bigint"), batch_size)
