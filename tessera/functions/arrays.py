"""Token-array expressions: truncation, masking, padding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import let

# Fixed value: the label that losses ignore.
IGNORE_INDEX = -100


def keep_first(ids: Column, n: int) -> Column:
    """Right truncation: the first `n` ids."""
    return F.slice(ids, 1, n)


def keep_last(ids: Column, n: int) -> Column:
    """Left truncation: the last `n` of `ids`, a column that is there already."""
    return F.when(F.size(ids) <= n, ids).otherwise(
        F.slice(ids, F.greatest(F.size(ids) - F.lit(n), F.lit(0)) + 1, F.lit(n)))


def _no_pads(ids: Column, pad_id: int) -> Column:
    """Whether neither padding nor a null is among the ids."""
    return ~F.array_contains(ids, F.lit(pad_id))


def not_pad(ids: Column, pad_id: int) -> Column:
    """Attention mask: true where the id is not padding. `ids` is a column that is there already.

    Without padding nothing is looked at id by id, which Spark interprets.
    """
    return F.when(_no_pads(ids, pad_id), F.array_repeat(F.lit(True), F.size(ids))).otherwise(
        F.transform(ids, lambda x: x != pad_id))


def count_tokens(ids: Column, pad_id: int) -> Column:
    """Number of ids that are not padding."""
    return F.size(F.filter(ids, lambda x: x != pad_id))


def target_labels(ids: Column, target_len: Column, pad_id: int) -> Column:
    """The ids as labels, everything but the last `target_len` ignored.

    A target of no tokens leaves every label in place. `ids` and `target_len` are columns that are
    there already; without padding nothing is looked at id by id, which Spark interprets.
    """
    size, ignored = F.size(ids), F.lit(IGNORE_INDEX)
    hidden = F.when(target_len == 0, F.lit(0)).otherwise(size - target_len)
    first = F.least(F.greatest(hidden, F.lit(0)), size)
    return F.when(
        _no_pads(ids, pad_id), F.concat(F.array_repeat(ignored, first), F.slice(ids, first + 1, size)),
    ).otherwise(let(hidden, lambda first: F.transform(
        ids, lambda x, i: F.when((i < first) | (x == pad_id), ignored).otherwise(x))))


def ignore_pads(ids: Column, pad_id: int) -> Column:
    """The ids as labels with padding ignored."""
    return F.transform(ids, lambda x: F.when(x == pad_id, F.lit(IGNORE_INDEX)).otherwise(x))


def pad_to(values: Column, length: Column, fill: Column, side: str = "right") -> Column:
    """Fill up to `length` on the given side; longer arrays stay as they are."""
    if side not in ("left", "right"):
        raise ValueError(f"unknown padding side: {side}")

    def padded(x: Column) -> Column:
        missing = F.array_repeat(fill, F.greatest(length - F.size(x), F.lit(0)))
        return F.concat(x, missing) if side == "right" else F.concat(missing, x)

    return let(values, padded)


def resolve_block_size(requested: int | None, model_max: int, cap: int = 4096) -> int:
    """Without a request the model's limit up to `cap`, else the smaller one."""
    if requested is None:
        return min(model_max, cap)
    return min(requested, model_max)
