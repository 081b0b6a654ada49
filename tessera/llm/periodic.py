"""Periodic runs of words, and texts without their repetitions.

A run is a stretch of words that repeats its smallest period and that no
neighbouring word extends. Each one holds a Lyndon root: a longest Lyndon word
under the given or the reversed order of words. Suffix trees of the words and
of their reversal say, by lowest common ancestors over their Euler tours, how
far two places agree to the right and to the left, and so how far a root repeats.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import sliced

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
_RUNS = "array<struct<start:long,length:long,period:long>>"
_OPEN = 1 << 62


class SuffixTree:
    """Ukkonen's suffix tree of numbers from 0, closed by an end below them all."""

    def __init__(self, symbols: list[int]):
        self.symbols = text = [*symbols, -1]
        self.starts, self.ends, self.kids, links = [0], [0], [{}], [0]
        self.leaf_suffix: dict[int, int] = {}
        starts, ends, kids, leaves = self.starts, self.ends, self.kids, self.leaf_suffix

        def node(start: int, end: int, below: dict | None) -> int:
            starts.append(start)
            ends.append(end)
            kids.append(below)
            links.append(0)
            return len(starts) - 1

        at, edge, length, waiting = 0, 0, 0, 0
        for place, symbol in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = place
                below = kids[at].get(text[edge])
                if below is None:
                    leaf = kids[at][text[edge]] = node(place, _OPEN, None)
                    leaves[leaf] = len(leaves)
                    if unlinked:
                        links[unlinked] = at
                        unlinked = 0
                else:
                    start = starts[below]
                    size = min(ends[below], place + 1) - start
                    if length >= size:
                        at, edge, length = below, edge + size, length - size
                        continue
                    if text[start + length] == symbol:
                        if unlinked:
                            links[unlinked] = at
                        length += 1
                        break
                    split = node(start, start + length, {text[start + length]: below})
                    kids[at][text[edge]] = split
                    starts[below] = start + length
                    leaf = kids[split][symbol] = node(place, _OPEN, None)
                    leaves[leaf] = len(leaves)
                    if unlinked:
                        links[unlinked] = split
                    unlinked = split
                waiting -= 1
                if at == 0 and length:
                    length -= 1
                    edge = place - waiting + 1
                elif at:
                    at = links[at]

    def tour(self, reverse: bool = False) -> tuple[list[int], list[int]]:
        """Suffixes in the order of the Euler tour, and the depth of its lowest node before each.

        Between two leaves that node is their lowest common ancestor. Children
        come by their first symbol, or `reverse`; the end comes first in both.
        """
        starts, ends, kids, leaves = self.starts, self.ends, self.kids, self.leaf_suffix
        depths, order, lowest = [0] * len(starts), [], []
        low, stack = 0, [0]
        while stack:
            at = stack.pop()
            if at < 0:
                low = depths[~at]
            elif at in leaves:
                order.append(leaves[at])
                lowest.append(low)
            else:
                below, depth = kids[at], depths[at]
                symbols = sorted(below, reverse=not reverse)
                if reverse and symbols[0] < 0:
                    symbols.append(symbols.pop(0))
                for symbol in symbols:
                    child = below[symbol]
                    depths[child] = depth + ends[child] - starts[child]
                    stack += (child, ~at)
                stack.pop()
        return order, lowest


class CommonExtensions:
    """How far suffixes of a sequence agree: the lowest node of the tour between their leaves."""

    def __init__(self, tree: SuffixTree):
        import numpy as np

        order, lowest = tree.tour()
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        levels = [np.array(lowest, np.int32)]
        while 2 << len(levels) - 1 <= len(order):
            last, half = levels[-1], 1 << len(levels) - 1
            level = last.copy()
            level[:-half] = np.minimum(last[:-half], last[half:])
            levels.append(level)
        self.levels = np.stack(levels)

    def __call__(self, left, right):
        """Lengths of the common prefixes of two arrays of different suffixes, in constant time each."""
        import numpy as np

        a, b = self.place[left], self.place[right]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        return np.minimum(self.levels[level, low], self.levels[level, high - (1 << level) + 1]).astype(np.int64)


def _root_ends(order: list[int]) -> list[int]:
    """Where the longest Lyndon word from each place ends: at the next smaller suffix."""
    rank = [0] * len(order)
    for place, suffix in enumerate(order):
        rank[suffix] = place
    ends = [0] * (len(order) - 1)
    for at in range(len(ends) - 1, -1, -1):
        end, own = at + 1, rank[at]
        while rank[end] > own:
            end = ends[end]
        ends[at] = end
    return ends


def runs_of(symbols: list[int], least_length: int = LEAST_LENGTH,
            least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least the given length and repetition (2 or more)."""
    import numpy as np

    size = len(symbols)
    if size < max(least_length, least_exponent):
        return []
    tree = SuffixTree(symbols)
    ahead, behind = CommonExtensions(tree), CommonExtensions(SuffixTree(symbols[::-1]))
    ends = np.array([_root_ends(tree.tour(reverse)[0]) for reverse in (False, True)])
    start, end = np.tile(np.arange(size), 2), ends.ravel()
    period = end - start
    left = behind(size - start, size - end)
    length = left + period + ahead(start, end)
    found = length >= np.maximum(least_length, least_exponent * period)
    runs = np.unique(np.stack([start - left, length, period], 1)[found], axis=0)
    return [tuple(run) for run in runs[np.lexsort((runs[:, 2], runs[:, 0]))].tolist()]


def _numbers(words: list[bytes]) -> list[int]:
    numbers: dict[bytes, int] = {}
    return [numbers.setdefault(word, len(numbers)) for word in words]


def _live_stretches(numbers: list[int]) -> list[tuple[int, int]]:
    """The stretches of words that runs can lie in, each with all of every run that it meets.

    A run of 6 words and 4 periods or more holds each three of its words in a
    row three times at least. So it lies wholly among places where such
    triples begin, four of them in a row or more, and the two words after them.
    """
    import numpy as np

    if len(numbers) < LEAST_LENGTH:
        return []
    ids = np.array(numbers, np.int64)
    pairs = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)[1]
    _, triple, times = np.unique(pairs[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True)
    live = np.zeros(len(triple) + 2, np.int8)
    live[1:-1] = times[triple] >= 3
    edges = np.diff(live)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return [(s, e + 2) for s, e in zip(starts.tolist(), ends.tolist()) if e - s >= LEAST_LENGTH - 2]


def word_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words, by start and period."""
    numbers = _numbers(words)
    return [(start + at, length, period) for start, end in _live_stretches(numbers)
            for at, length, period in runs_of(_numbers(numbers[start:end]))]


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stand in no run, or only among the first period of those they stand in."""
    if not runs:
        return words
    change = [0] * (len(words) + 1)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept, depth = [], 0
    for word, step in zip(words, change):
        depth += step
        if not depth:
            kept.append(word)
    return kept


def periodic_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): one row per row of `docs`, no shuffle.

    `runs` are in order of start and period, places count words from 0;
    `collapsed` are the words without what runs repeat, joined by one blank.
    `edit` may change the words of a text before that. Null, empty and blank
    texts have no words, no runs and an empty `collapsed`. Repeated rows and
    null ids are texts like any others; other columns are not read. Memory
    grows with the longest stretch of words that recur three times in a row.
    """

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        for batch in sliced(batches):
            counts, runs, texts = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = (text or "").encode().split()
                if edit and words:
                    words = edit(doc_id, words)
                found = word_runs(words)
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(b" ".join(_kept(words, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, kind),
                 pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id long, n_words long, runs {_RUNS}, collapsed string")


def with_planted_runs(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of all ids repeat a period from some place on; a null id stays as it is."""
    mark = zlib.crc32(str(doc_id).encode())
    if doc_id is None or mark % 10:
        return words
    mark //= 10
    start = mark % len(words)
    period = 1 + (len(words) - start) // (3 + mark % 8)
    root = words[start:start + period]
    return words[:start] + (root * -(-(len(words) - start) // period))[:len(words) - start]


def _strongest(runs: Column) -> Column:
    """The run repeated most often, the first of equals; null without runs."""
    nothing = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.reduce(runs, nothing, lambda best, run: F.when(
        best.isNotNull() & (best["length"] * run["period"] >= run["length"] * best["period"]), best).otherwise(run))


def run_digests(docs: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests, a row for each row of `docs`; texts with planted runs."""
    lines = F.transform("runs", lambda r: F.concat_ws(
        ",", *[r[name].cast("string") for name in ("start", "length", "period")]))
    listed = F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    best = periodic_runs(docs, with_planted_runs).withColumn("_best", _strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
