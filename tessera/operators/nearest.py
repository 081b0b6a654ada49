"""Exact nearest references under L1 distance, by a tree of pivots.

The tree splits the space level by level around far-apart pivots. Every
reference goes down to one leaf; a node knows the range of distances from its
pivot to all references below it, so that the triangle inequality bounds how
near a leaf can be. A query first searches the leaf that promises most; its
k-th distance there rules out all leaves that cannot be nearer. Neighbouring
leaves form groups of bounded size, of references and of queries. A query goes to a
group at most once, whatever number of its leaves must be searched, and no pair of
rows is ever emitted: each group reports a query's k nearest.

Within a group, pairs are first compared on a coarse grid, in single bytes. What
rounding to the grid can add to a distance is known for each vector, so the coarse distance
less that bounds the true one from below; only pairs that may still be among the k nearest are
computed in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..schemas import struct
from ..session import stage

_QUERY_ROWS, _REFERENCE_ROWS = 256, 512
_FOUND = "ref_id bigint, distance double"
_CELLS = 1 << 22
_L1_CELLS = 1 << 15
_STEPS, _BYTE_DIMS = 62, 4  # so many dimensions of so many grid steps fit a byte
_TILE_QUERIES, _TILE_REFERENCES, _SEEDS = 4096, 64, 1024
_GRID_ROWS = 2048
_PENDING = 1 << 15
_MOST_HITS = 8
_LEAST_GROUPS, _LEAST_ROWS = 8, 1024
SAMPLE_ROWS = 8192
TREE_BYTES = 16 << 20
FAN = 8


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float32) for v in vectors]).astype(np.float64)


def _l1(queries: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Distances of all rows, one dimension at a time, for as many rows at once as a cache holds."""
    total = np.zeros((len(queries), len(references)))
    step = max(1, _L1_CELLS // max(len(references), 1))
    part = np.empty((step, len(references)))
    queries, references = np.ascontiguousarray(queries.T), np.ascontiguousarray(references.T)
    for start in range(0, len(total), step):
        sums = total[start:start + step]
        here = part[:len(sums)]
        for q, r in zip(queries, references):
            np.subtract(q[start:start + step, None], r, out=here)
            np.abs(here, out=here)
            np.add(sums, here, out=sums)
    return total


def _l1_of_pairs(queries: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Distances row by row, summed in the order of `_l1`."""
    return np.cumsum(np.abs(queries - references), axis=1)[:, -1]


def _slices(rows: int, columns: int) -> Iterator[slice]:
    """Ranges of rows of which a matrix with so many columns stays small."""
    step = max(1, _CELLS // max(columns, 1))
    return (slice(start, start + step) for start in range(0, rows, step))


def _nearest(queries: np.ndarray, references: np.ndarray, k: int, block_rows: int = _REFERENCE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of the k nearest references, nearest first, the first on ties; -1 beyond their number."""
    position = np.full((len(queries), k), -1, dtype=np.int64)
    distance = np.full((len(queries), k), np.inf)
    for q in range(0, len(queries), _QUERY_ROWS):
        rows = slice(q, q + _QUERY_ROWS)
        step = min(block_rows, _REFERENCE_ROWS)
        for r in range(0, len(references), step):
            block = _l1(queries[rows], references[r:r + step])
            at = np.broadcast_to(np.arange(r, r + block.shape[1]), block.shape)
            values, places = np.hstack([distance[rows], block]), np.hstack([position[rows], at])
            best = np.argsort(values, axis=1, kind="stable")[:, :k] if k > 1 else values.argmin(axis=1)[:, None]
            distance[rows], position[rows] = np.take_along_axis(values, best, 1), np.take_along_axis(places, best, 1)
    position[np.isinf(distance)] = -1
    return position, distance


@dataclass
class PivotTree:
    """Nodes in order of their level: pivot, parent (-1 for the root), children; leaves have none."""

    pivots: np.ndarray
    parents: np.ndarray
    children: list[list[int]]

    @property
    def leaves(self) -> np.ndarray:
        return np.array([n for n, below in enumerate(self.children) if not below])

    def path(self, node: int) -> list[int]:
        """The node and those above it but for the root."""
        found = []
        while node > 0:
            found.append(node)
            node = int(self.parents[node])
        return found or [0]

    def descend(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: down to the nearest pivot at every level."""
        at = np.zeros(len(points), dtype=np.int64)
        for node, below in enumerate(self.children):
            here = np.flatnonzero(at == node)
            if below and len(here):
                at[here] = np.array(below)[_l1(points[here], self.pivots[below]).argmin(axis=1)]
        return at


@dataclass
class Above:
    """Nodes on the way to some leaves; (lower, upper) places of them for each level; the places of the leaves."""

    nodes: np.ndarray
    levels: list[np.ndarray]
    leaves: np.ndarray


@dataclass
class Bounds:
    """A tree, its leaves that hold references, and how near and far these are from the pivot of each node above them."""

    tree: PivotTree
    leaves: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def above(self, leaves: np.ndarray) -> Above:
        """The nodes on the way to these leaves, and which of them lie below which, level by level."""
        paths = [self.tree.path(int(leaf)) for leaf in leaves]
        nodes = np.array(sorted({n for path in paths for n in path}))
        place = {int(node): at for at, node in enumerate(nodes)}
        pairs: dict[int, set[tuple[int, int]]] = {}
        for path in paths:
            for depth, (upper, lower) in enumerate(zip(path[::-1], path[-2::-1])):
                pairs.setdefault(depth, set()).add((place[lower], place[upper]))
        levels = [np.array(sorted(pairs[depth])).T for depth in sorted(pairs)]
        return Above(nodes, levels, np.array([place[int(leaf)] for leaf in leaves], dtype=np.int64))

    def least(self, points: np.ndarray, above: Above) -> tuple[np.ndarray, np.ndarray]:
        """No reference of a leaf can be nearer to a point than this; and how far the leaf's pivot is."""
        nodes = above.nodes
        away = _l1(points, self.tree.pivots[nodes])
        least = np.maximum(np.maximum(away - self.far[nodes], self.near[nodes] - away), 0)
        for lower, upper in above.levels:  # what holds for the nodes above holds too
            least[:, lower] = np.maximum(least[:, lower], least[:, upper])
        return least[:, above.leaves], away[:, above.leaves]


def _may_hold(least: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Whether something as near as the bound can be there, rounding allowed for."""
    return least <= bound * (1 + 1e-9) + 1e-9


def _layout(sizes: dict[int, int], group_rows: int) -> list[tuple[int, int, int]]:
    """(leaf, group, parts): leaves in order fill groups of `group_rows`; larger ones are dealt out over `parts` of their own."""
    rows, group, filled = [], 0, 0
    for leaf in sorted(sizes):
        parts = -(-sizes[leaf] // group_rows)
        if filled and filled + sizes[leaf] > group_rows:
            group, filled = group + 1, 0
        rows.append((leaf, group, parts))
        if parts > 1:
            group += parts
        else:
            filled += sizes[leaf]
    return rows


class _Grid:
    """Points and references rounded to one grid, whose distances need single bytes only.

    The grid spans most values of some rows of both sides; values beyond are moved to its edge, which
    brings no two vectors further apart.
    """

    def __init__(self, points: np.ndarray, references: np.ndarray):
        some = np.vstack([side[::1 + len(side) // _GRID_ROWS] for side in (points, references)])
        low, high = np.quantile(some, [0.002, 0.998], axis=0)
        if not (high - low).max() > 0:
            low, high = some.min(axis=0), some.max(axis=0)
        self.low, self.step = low, ((high - low).max() / _STEPS) or 1.0
        self.points, self.point_error = self._rounded(points)
        self.references, self.reference_error = self._rounded(references)
        self._kind = np.uint16 if _STEPS * points.shape[1] < 1 << 16 else np.uint32

    def _rounded(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps of all values, one row for each dimension, and by how much each vector was changed in all."""
        steps, error = np.empty(rows.shape[::-1], dtype=np.int8), np.zeros(len(rows))
        for d, low in enumerate(self.low):
            exact = np.clip((rows[:, d] - low) / self.step, 0, _STEPS)
            steps[d] = np.rint(exact)
            error += np.abs(exact - steps[d])
        return steps, error

    def distances(self, points: np.ndarray, references: np.ndarray) -> np.ndarray:
        """Whole steps between columns of the two sides: a row for each reference."""
        if references.shape[1] > points.shape[1]:  # numpy runs along the second side
            return self.distances(references, points).T
        shape = (references.shape[1], points.shape[1])
        total, part, one = np.empty(shape, dtype=self._kind), np.empty(shape, dtype=np.int8), np.empty(shape, dtype=np.int8)
        sums, ones = part.view(np.uint8), one.view(np.uint8)
        for d in range(0, len(points), _BYTE_DIMS):
            np.subtract(references[d][:, None], points[d], out=part)
            np.abs(part, out=part)
            for p, r in zip(points[d + 1:d + _BYTE_DIMS], references[d + 1:d + _BYTE_DIMS]):
                np.subtract(r[:, None], p, out=one)
                np.abs(one, out=one)
                np.add(sums, ones, out=sums)
            if d:
                np.add(total, sums, out=total)
            else:
                total[...] = sums
        return total

    def reach(self, bound: np.ndarray, rows: np.ndarray, references: slice) -> np.ndarray:
        """No pair of more steps can be as near as the bound, rounding of sums allowed for."""
        most = np.iinfo(self._kind).max
        steps = bound * (1 + 1e-9) / self.step + self.point_error[rows] + self.reference_error[references].max() + 1e-3
        return np.minimum(steps, most).astype(self._kind)


class _Nearest:
    """The k nearest of each point so far, by distance and id."""

    def __init__(self, k: int, points: np.ndarray, limit: np.ndarray, ids: np.ndarray, references: np.ndarray):
        self.k, self.points, self.ids, self.references = k, points, ids, references
        self.limit = np.asarray(limit, dtype=np.float64).copy()
        # Sums of single precision are enough to leave most pairs out, where they cannot overflow.
        largest, dims = max(np.abs(side).max(initial=0) for side in (points, references)), points.shape[1]
        quick = np.float32 if largest * 2 * dims < np.finfo(np.float32).max else np.float64
        self.quick, self.slack = (points.astype(quick), references.astype(quick)), 1 + 2 * (dims + 2) * float(np.finfo(quick).eps)
        self.best_id, self.best = np.full((len(points), k), -1, dtype=np.int64), np.full((len(points), k), np.inf)
        self.grid = _Grid(points, references)

    def bound(self) -> np.ndarray:
        return np.minimum(self.limit, self.best[:, -1])

    def compare(self, asking: np.ndarray, held: slice, block_rows: int, skipped: np.ndarray | None = None,
                leaf: np.ndarray | None = None) -> None:
        """Take up what is near among some references, but for those whose leaf a point is to skip."""
        for start in range(0, len(asking), _TILE_QUERIES):
            rows = asking[start:start + _TILE_QUERIES]
            points = np.ascontiguousarray(self.grid.points[:, rows])
            self._seed(rows, points, held)
            pending: list[tuple[np.ndarray, np.ndarray]] = []
            step = min(block_rows, _TILE_REFERENCES * max(1, _TILE_QUERIES // len(rows)))
            small, cells, hits = len(rows) * (held.stop - held.start) < _L1_CELLS, 0, 0
            for first in range(held.start, held.stop, step):
                tile = slice(first, min(first + step, held.stop))
                if small or hits * _MOST_HITS > cells > _L1_CELLS:  # too few pairs, or the grid rules too little out
                    near, distance = self._in_full(rows, tile)
                else:
                    near, distance = self.grid.distances(points, self.grid.references[:, tile]) <= self.grid.reach(
                        self.bound()[rows], rows, tile), None
                    cells += near.size
                reference, row = _places(near)
                if distance is None:
                    hits += len(row)
                reference, row = reference + first, rows[row]
                if skipped is not None:
                    others = leaf[reference] != skipped[row]
                    reference, row = reference[others], row[others]
                pending.append((row, reference))
                if tile.stop == held.stop or sum(len(r) for r, _ in pending) > _PENDING:
                    self._take(*(np.concatenate(side) for side in zip(*pending)))
                    pending = []

    def _in_full(self, rows: np.ndarray, tile: slice) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are near enough, a row for each reference."""
        distance = _l1(self.references[tile], self.points[rows])
        last = self.best[rows, -1]
        tied = (distance == last) & (self.ids[tile, None] < self.best_id[rows, -1])
        return (distance <= self.limit[rows]) & ((distance < last) | tied), distance

    def _seed(self, rows: np.ndarray, points: np.ndarray, held: slice) -> None:
        """A first limit for points without one: how far k references are that look near on the grid."""
        open_ = np.flatnonzero(np.isinf(self.bound()[rows]))
        some = slice(held.start, min(held.stop, held.start + max(_SEEDS, self.k)))
        if not len(open_) or some.stop - some.start < self.k:
            return
        steps = self.grid.distances(np.ascontiguousarray(points[:, open_]), self.grid.references[:, some])
        chosen = some.start + np.argpartition(steps, self.k - 1, axis=0)[:self.k]
        asked = rows[open_]
        farthest = np.zeros(len(asked))
        for places in chosen:
            farthest = np.maximum(farthest, _l1_of_pairs(self.points[asked], self.references[places]))
        self.limit[asked] = np.minimum(self.limit[asked], farthest)

    def _take(self, row: np.ndarray, reference: np.ndarray) -> None:
        """Compute these pairs and keep what is among the k nearest of its point."""
        step = max(1, _L1_CELLS * 8 // self.points.shape[1])
        for start in range(0, len(row), step):
            r, c = row[start:start + step], reference[start:start + step]
            about = np.abs(self.quick[0][r] - self.quick[1][c]).sum(axis=1)
            near = np.flatnonzero(about <= np.minimum(self.limit[r], self.best[r, -1]) * self.slack)
            r, c = r[near], c[near]
            distance, names = _l1_of_pairs(self.points[r], self.references[c]), self.ids[c]
            last, last_id = self.best[r, -1], self.best_id[r, -1]
            wanted = (distance <= self.limit[r]) & ((distance < last) | ((distance == last) & (names < last_id)))
            r, distance, names = r[wanted], distance[wanted], names[wanted]
            if not len(r):
                continue
            rows, of = np.unique(r, return_inverse=True)
            of = np.concatenate([np.repeat(np.arange(len(rows)), self.k), of])
            distance = np.concatenate([self.best[rows].ravel(), distance])
            names = np.concatenate([self.best_id[rows].ravel(), names])
            order = np.lexsort((names, distance, of))
            of = of[order]
            kept = order[np.arange(len(of)) - np.searchsorted(of, of) < self.k]  # each row has k at least
            self.best[rows], self.best_id[rows] = distance[kept].reshape(-1, self.k), names[kept].reshape(-1, self.k)


def _places(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true cells, looked for in eight cells at once."""
    flat, words = found.ravel(), found.size // 8 * 8
    eights = np.flatnonzero(flat[:words].view(np.uint64))
    inner = (eights[:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate([inner[flat[inner]], words + np.flatnonzero(flat[words:])])
    return np.divmod(at, found.shape[1])


def _search_group(bounds: Bounds, k: int, block_rows: int, points: np.ndarray, limit: np.ndarray, home: np.ndarray,
                  ids: np.ndarray, references: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids (-1 beyond their number) and distances of each point's k nearest, by distance and id, and the pairs compared.

    References are sorted by id. Each point's home leaf comes first; `limit`, or its k-th
    distance once that is less, rules leaves out, and what is farther than `limit` is left out.
    Leaves that nearly the same points ask for are compared together.
    """
    if not (np.isfinite(points).all() and np.isfinite(references).all()):
        return _search_leaves(bounds, k, block_rows, points, limit, home, ids, references, leaf)
    order = np.argsort(leaf, kind="stable")
    ids, references, leaf = ids[order], references[order], leaf[order]
    leaves, starts = np.unique(leaf, return_index=True)
    ends = np.append(starts[1:], len(leaf))
    found, compared = _Nearest(k, points, limit, ids, references), 0
    by_home = np.argsort(home, kind="stable")
    for number, start, end in zip(leaves, starts, ends):
        asking = by_home[slice(*np.searchsorted(home, [number, number + 1], sorter=by_home))]
        if len(asking):
            compared += len(asking) * int(end - start)
            found.compare(asking, slice(start, end), block_rows)
    above = bounds.above(leaves)
    least = np.vstack([bounds.least(points[rows], above)[0] for rows in _slices(len(points), 2 * len(leaves))])
    first = 0
    while first < len(leaves):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + block_rows, side="right")))
        visit = _may_hold(least[:, first:last], found.bound()[:, None]) & (home[:, None] != leaves[first:last])
        asking, held = np.flatnonzero(visit.any(axis=1)), slice(starts[first], ends[last - 1])
        sizes = ends[first:last] - starts[first:last]
        asked = int(visit.sum(axis=0) @ sizes)
        if 2 * asked > len(asking) * (held.stop - held.start):
            own = sizes @ (home[asking] == leaves[first:last, None]).sum(axis=1)
            compared += len(asking) * int(held.stop - held.start) - int(own)
            found.compare(asking, held, block_rows, home, leaf)
        else:
            for column in range(first, last):
                asking = np.flatnonzero(visit[:, column - first] & _may_hold(least[:, column], found.bound()))
                if len(asking):
                    compared += len(asking) * int(ends[column] - starts[column])
                    found.compare(asking, slice(starts[column], ends[column]), block_rows)
        first = last
    return found.best_id, found.best, compared


def _search_leaves(bounds: Bounds, k: int, block_rows: int, points: np.ndarray, limit: np.ndarray, home: np.ndarray,
                   ids: np.ndarray, references: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same leaf by leaf, all pairs in full: for vectors of which values are missing or not finite."""
    leaves = np.unique(leaf)
    above = bounds.above(leaves)
    least = np.vstack([bounds.least(points[rows], above)[0] for rows in _slices(len(points), 2 * len(leaves))])
    best_id, best = np.full((len(points), k), -1, dtype=np.int64), np.full((len(points), k), np.inf)
    compared = 0
    for own in (True, False):
        for column, number in enumerate(leaves):
            at_home = home == number
            asking = np.flatnonzero(at_home if own else ~at_home & _may_hold(least[:, column], np.minimum(limit, best[:, -1])))
            if not len(asking):
                continue
            held = np.flatnonzero(leaf == number)
            compared += len(asking) * len(held)
            position, distance = _nearest(points[asking], references[held], k, block_rows)
            found = np.where(position >= 0, ids[held][position], -1)
            values, names = np.hstack([best[asking], distance]), np.hstack([best_id[asking], found])
            order = np.lexsort((names, values), axis=1)[:, :k]
            best[asking], best_id[asking] = np.take_along_axis(values, order, 1), np.take_along_axis(names, order, 1)
    return best_id, best, compared


def build_tree(sample: np.ndarray, rows: int, leaf_rows: int, fan: int = FAN, tree_bytes: int = TREE_BYTES) -> PivotTree:
    """A tree whose leaves stand for about `leaf_rows` of `rows` references, of which `sample` is a part.

    A node's pivots are far apart: each is the point farthest from those
    before it. Nodes that hold one point only, or too little of the sample, and a tree
    of `tree_bytes` are not split further.
    """
    pivots, parents, children = [sample[0]], [-1], [[]]
    most, share = max(fan + 1, tree_bytes // (8 * sample.shape[1])), rows / len(sample)
    level = [(0, np.arange(len(sample)))]
    while level:
        below = []
        for node, points in level:
            if len(points) * share <= leaf_rows or len(points) < 2 * fan or len(pivots) + fan > most:
                continue
            chosen = [int(points[0])]
            nearest = _l1(sample[points], sample[chosen])[:, 0]
            while len(chosen) < fan and nearest.max() > 0:
                chosen.append(int(points[nearest.argmax()]))
                nearest = np.minimum(nearest, _l1(sample[points], sample[chosen[-1:]])[:, 0])
            if len(chosen) < 2:
                continue
            owner = _l1(sample[points], sample[chosen]).argmin(axis=1)
            for number, pivot in enumerate(chosen):
                children[node].append(len(pivots))
                below.append((len(pivots), points[owner == number]))
                pivots.append(sample[pivot])
                parents.append(node)
                children.append([])
        level = below
    return PivotTree(np.stack(pivots), np.array(parents), children)


def nearest_references(queries: DataFrame, references: DataFrame, query_id: str, k: int = 1,
                       query_vector: str = "embedding", ref_id: str = "ref_id", ref_vector: str = "embedding",
                       block_rows: int = 4096, leaf_rows: int = 1024, report: dict | None = None,
                       group_rows: int = 16384) -> DataFrame:
    """(query_id, place, ref_id, distance): the k nearest references, by distance and then ref_id; `place` from 1.

    Vectors are compared as float32 and summed in double precision. Queries
    with a null vector, and all when there are no references, get one row without
    a reference; `query_id` is unique. Ids and vectors of both sides are written out
    first, so that each vector is computed once. Shipped to tasks is a tree
    of at most `TREE_BYTES`, built on the driver from `SAMPLE_ROWS` references.
    A task holds two groups of at most `group_rows` at a time and compares
    `block_rows` references at once. Where distances rule nothing out, all pairs are compared, and each
    side is shuffled once for each group of the other. `report`, if given, gets the
    number of pairs compared and of all pairs.
    """
    refs = stage(references.select(
        F.col(ref_id).cast("bigint").alias("ref_id"),
        F.col(ref_vector).cast("array<float>").alias("vector")), "references").where("vector is not null")
    asked = stage(queries.select(
        F.col(query_id).alias("query_id"),
        F.col(query_vector).cast("array<float>").alias("vector")), "queries")
    searched = asked.where("vector is not null")
    sample = refs.orderBy(F.xxhash64("ref_id"), "ref_id").limit(SAMPLE_ROWS).select("vector").toPandas()
    if len(sample):
        rows = refs.count() if len(sample) == SAMPLE_ROWS else len(sample)
        tree = build_tree(_matrix(sample["vector"]), rows, leaf_rows)
        found = _search(searched, refs, tree, rows, k, block_rows, group_rows, report)
        unanswered = asked.where("vector is null")
    else:
        found, unanswered = None, asked
    nothing = unanswered.select("query_id").withColumns({
        "place": F.lit(1), "ref_id": F.lit(None).cast("bigint"), "distance": F.lit(None).cast("double")})
    return (found.unionByName(nothing) if found is not None else nothing).withColumnRenamed("query_id", query_id)


def nearest_reference(queries: DataFrame, references: DataFrame, query_id: str, **options: object) -> DataFrame:
    """(query_id, ref_id, distance): the nearest reference; see `nearest_references`."""
    return nearest_references(queries, references, query_id, 1, **options).drop("place")


def _search(queries: DataFrame, refs: DataFrame, tree: PivotTree, rows: int, k: int, block_rows: int, group_rows: int,
            report: dict | None) -> DataFrame:
    spark = queries.sparkSession
    context = spark.sparkContext
    shipped = context.broadcast(tree)
    group_rows = min(group_rows, max(_LEAST_ROWS, -(-rows // _LEAST_GROUPS)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = shipped.value
        for batch in batches:
            if len(batch):
                points = _matrix(batch["vector"])
                leaf = tree.descend(points)
                away = [np.abs(tree.pivots[tree.path(n)] - p).sum(axis=1) for n, p in zip(leaf, points)]
                yield batch.assign(leaf=leaf.astype(np.int32), away=away)

    placed = stage(refs.mapInPandas(place, T.StructType([
        *refs.schema.fields, T.StructField("leaf", T.IntegerType()), T.StructField("away", T.ArrayType(T.DoubleType()))])),
        "reference-leaves")
    # One row for each leaf and level: how many references, and how near and far they are from the pivots above them.
    stats = placed.select("leaf", F.posexplode("away").alias("level", "away")).groupBy("leaf", "level").agg(
        F.count(F.lit(1)).alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).collect()
    near, far = np.full(len(tree.pivots), np.inf), np.full(len(tree.pivots), -np.inf)
    sizes: dict[int, int] = {}
    for row in stats:
        node = tree.path(row["leaf"])[row["level"]]
        near[node], far[node] = min(near[node], row["near"]), max(far[node], row["far"])
        sizes[row["leaf"]] = row["n"]
    bounds = context.broadcast(Bounds(tree, np.array(sorted(sizes)), near, far))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The leaf that promises most to each query."""
        known = bounds.value
        above = known.above(known.leaves)
        for batch in batches:
            points, homes = _matrix(batch["vector"]) if len(batch) else np.zeros((0, 1)), []
            for at in _slices(len(points), len(known.tree.pivots)):
                least, away = known.least(points[at], above)
                order = np.where(least == least.min(axis=1)[:, None], away, np.inf)
                homes.append(known.leaves[order.argmin(axis=1)])
            if homes:
                yield batch.assign(home=np.concatenate(homes).astype(np.int32))

    settled = stage(queries.mapInPandas(settle, T.StructType([
        *queries.schema.fields, T.StructField("home", T.IntegerType())])), "query-leaves")
    loads = {r["home"]: r["count"] for r in settled.groupBy("home").count().collect()}
    found_schema = T.StructType([queries.schema["query_id"], *struct(_FOUND).fields])
    if not loads:
        return _listed(spark.createDataFrame([], found_schema), k)

    def grouped(df: DataFrame, rows_of: dict[int, int], leaf: str, row: str, name: str) -> DataFrame:
        layout = F.broadcast(spark.createDataFrame(  # one row for each leaf
            _layout(rows_of, group_rows), f"{leaf} int, _group int, _parts int"))
        part = F.pmod(F.xxhash64(row), F.col("_parts")).cast("int")
        return df.join(layout, leaf).withColumn(name, F.col("_group") + part).drop("_group", "_parts")

    held = grouped(placed.drop("away"), sizes, "leaf", "ref_id", "ref_group")
    # A query begins in the group of its home leaf, in one part of it where that is dealt out.
    asking = grouped(grouped(settled, loads, "home", "query_id", "query_group"), sizes, "home", "query_id", "ref_group")
    compared = context.accumulator(0)

    def search(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(block):
            return pd.DataFrame({"query_id": asked["query_id"][:0], "ref_id": pd.Series(dtype="int64"),
                                 "distance": pd.Series(dtype="float64")})
        block = block.sort_values("ref_id")
        found, distance, n = _search_group(
            bounds.value, k, block_rows, _matrix(asked["vector"]), asked["bound"].to_numpy(), asked["home"].to_numpy(),
            block["ref_id"].to_numpy(), _matrix(block["vector"]), block["leaf"].to_numpy())
        compared.add(n)
        row, column = np.nonzero(found >= 0)
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[row], "ref_id": found[row, column],
                             "distance": distance[row, column]})

    def probe(asked: DataFrame) -> DataFrame:
        """The k nearest references per query and group, group against group."""
        pairs = asked.select("query_group", "ref_group").distinct().collect()
        wanted = F.broadcast(spark.createDataFrame(  # one row for each pair of groups
            [(r[0], r[1]) for r in pairs], "query_group int, ref_group int"))
        key = ["query_group", "ref_group"]
        return asked.groupBy(*key).cogroup(held.join(wanted, "ref_group").groupBy(*key)).applyInPandas(search, found_schema)

    first = stage(_merged(probe(asking.withColumn("bound", F.lit(float("inf")))), k), "home-group")
    # Fewer than k there rule nothing out.
    bound = F.when(F.size("best") == k, F.element_at("best", -1)["distance"]).otherwise(F.lit(float("inf")))
    groups = {leaf: range(group, group + parts) for leaf, group, parts in _layout(sizes, group_rows)}

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All other groups that may hold something as near."""
        known = bounds.value
        whole = np.array([groups[int(leaf)][0] for leaf in known.leaves])
        split = [(column, list(groups[int(leaf)])) for column, leaf in enumerate(known.leaves) if len(groups[int(leaf)]) > 1]
        last = max(g[-1] for g in groups.values()) + 1
        above = known.above(known.leaves)
        for batch in batches:
            points, others = _matrix(batch["vector"]) if len(batch) else np.zeros((0, 1)), []
            for at in _slices(len(points), len(known.tree.pivots)):
                visit = _may_hold(known.least(points[at], above)[0], batch["bound"].to_numpy()[at, None])
                needed = np.zeros((len(visit), last), dtype=bool)
                row, column = np.nonzero(visit)
                needed[row, whole[column]] = True
                for column, parts in split:
                    needed[np.ix_(visit[:, column], parts)] = True
                needed[np.arange(len(needed)), batch["ref_group"].to_numpy()[at]] = False
                others += [np.flatnonzero(line).astype(np.int32) for line in needed]
            if others:
                yield batch.drop(columns="ref_group").assign(others=others)

    bounded = asking.join(first.select("query_id", bound.alias("bound")), "query_id")
    routed = stage(bounded.mapInPandas(route, T.StructType([
        *[f for f in bounded.schema.fields if f.name != "ref_group"], T.StructField("others", T.ArrayType(T.IntegerType()))])),
        "query-groups")
    found = first.select("query_id", F.inline("best")).select("query_id", "ref_id", "distance")
    asked = routed.withColumn("ref_group", F.explode("others")).drop("others")
    if not asked.isEmpty():
        more = probe(asked)
        found = found.unionByName(stage(more, "other-groups") if report is not None else more)
    if report is not None:
        report |= {"compared": compared.value, "pairs": rows * queries.count()}
    return _listed(found, k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, best): a query's k nearest of all groups, each of which gave no more than k."""
    return found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(
        F.struct("distance", "ref_id"))), 1, k).alias("best"))


def _listed(found: DataFrame, k: int) -> DataFrame:
    return _merged(found, k).select("query_id", F.posexplode("best").alias("place", "found")).select(
        "query_id", (F.col("place") + 1).alias("place"), "found.ref_id", "found.distance")
