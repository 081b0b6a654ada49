"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import math
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _kept() -> dict:
    name = "_worker_state"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("kept", {})


def hand_back() -> None:
    """Gives the system the memory that allocators keep free: workers live on, idle or for the next stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def release() -> None:
    """Lets go of what `per_process` keeps in this process; for tasks that come after and need none of it."""
    state = _kept()
    if state:
        state.clear()
        gc.unfreeze()
        gc.collect()
        hand_back()


def per_process(key: Any, build: Callable[[], Any]) -> Any:
    """`build()`, once in each Python process and kept from task to task.

    Task functions travel by value, so that globals of a module are new in
    every task; a module of the worker's own is not. A worker keeps one such
    value at a time: what an earlier operator left goes first.
    """
    state = _kept()
    if key not in state:
        release()
        state[key] = build()
        gc.collect()
        gc.freeze()  # large and there to stay: not to be walked again and again
        gc.set_threshold(500_000, 20, 20)  # caches grow by what is not garbage
    return state[key]


def sliced(batches: Iterable, rows: int = SLICE) -> Iterator:
    """Arrow batches cut into pieces of at most `rows` rows; behind the last one a task hands back free memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    batch = None
    hand_back()


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class BoundedCache(dict):
    """A dictionary that computes what it lacks and starts anew when full."""

    def __init__(self, compute: Callable[[Any], Any], limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= self.limit:
            self.clear()
        if not isinstance(key, str) or len(key) <= 64:
            self[key] = value
        return value


class AgingCache(dict):
    """A dictionary that computes what it lacks and, when full, forgets what was not asked for since it was last full."""

    def __init__(self, compute: Callable[[Any], Any], limit: int):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit // 2, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if not isinstance(key, str) or len(key) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b)
