import numpy as np
import pytest

from tessera.operators import nearest
from tessera.operators.hooks import FunctionEmbedder
from tessera.operators.nearest import _layout, build_tree, nearest_reference, nearest_references
from tessera.plans.codes import map_codes


def brute(queries, references):
    out = {}
    for q, x in queries:
        if x is None:
            out[q] = None
            continue
        x = np.asarray(x, np.float32).astype(float)
        distances = [(float(np.abs(x - np.asarray(v, np.float32).astype(float)).sum()), r)
                     for r, v in references if v is not None]
        out[q] = min(distances)[1]
    return out


def run(spark, queries, references, **options):
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>").repartition(3)
    r = spark.createDataFrame(references, "ref_id long, embedding array<float>").repartition(3)
    found = nearest_reference(q, r, "query_id", **options).collect()
    assert len(found) == len(queries)
    return {row.query_id: row.ref_id for row in found}


PATHS = [{}, {"leaf_rows": 4, "block_rows": 8}, {"leaf_rows": 1000, "block_rows": 1000}]


@pytest.mark.parametrize("options", PATHS)
def test_against_brute_force(spark, options):
    draw = np.random.default_rng(1)
    centers = draw.normal(size=(4, 6)) * 5
    points = lambda n: [(centers[k % 4] + draw.normal(size=6)).tolist() for k in range(n)]
    references = list(enumerate(points(60))) + [(100, None)]
    queries = list(enumerate(points(80))) + [(900, None)]
    assert run(spark, queries, references, **options) == brute(queries, references)


@pytest.mark.parametrize("options", PATHS)
def test_ties_and_copies(spark, options):
    # A third of all references, and of all queries, are copies of one vector.
    references = [(n, [0.0, 0.0]) for n in range(20, 50)] + [(n, [float(n), 1.0]) for n in range(1, 20)]
    references += [(60, [1.0, 1.0])]
    queries = [(n, [0.0, 0.0]) for n in range(40)] + [(n, [float(n % 7), 1.0]) for n in range(40, 80)]
    got = run(spark, queries, references, **options)
    assert got == brute(queries, references)
    assert got[0] == 20 and got[43] == 1


@pytest.mark.parametrize("k", [1, 5, 70])
def test_k_nearest_against_brute_force(spark, k):
    draw = np.random.default_rng(3)
    references = [(n, np.round(draw.normal(size=3), 1).tolist()) for n in range(60)] + [(100, None)]
    queries = [(n, np.round(draw.normal(size=3), 1).tolist()) for n in range(30)] + [(900, None)]
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>").repartition(3)
    r = spark.createDataFrame(references, "ref_id long, embedding array<float>").repartition(3)
    found = nearest_references(q, r, "query_id", k, leaf_rows=4, block_rows=8).collect()
    wide = lambda v: np.asarray(v, np.float32).astype(float)
    for number, x in queries:
        own = sorted((row.place, row.ref_id) for row in found if row.query_id == number)
        if x is None:
            assert own == [(1, None)]
            continue
        near = sorted((float(np.abs(wide(x) - wide(v)).sum()), n) for n, v in references if v is not None)[:k]
        assert own == [(place + 1, n) for place, (_, n) in enumerate(near)]


def test_share_of_compared_pairs_falls(spark):
    draw = np.random.default_rng(5)
    shares = []
    for size in (500, 4000):
        points = spark.createDataFrame([(n, draw.normal(size=2).tolist()) for n in range(size)],
                                       "ref_id long, embedding array<float>")
        report = {}
        queries = points.withColumnRenamed("ref_id", "query_id")
        nearest_references(queries, points, "query_id", leaf_rows=32, report=report).count()
        shares.append(report["compared"] / report["pairs"])
    assert shares[1] < 0.5 * shares[0]


def test_tree_is_bounded_and_splits_copies_no_further():
    draw = np.random.default_rng(2)
    points = draw.normal(size=(3000, 4))
    tree = build_tree(points, 3_000_000, 10, tree_bytes=8 * 4 * 100)
    assert len(tree.pivots) <= 100 and len(tree.leaves) > 50
    assert set(tree.descend(points)) <= set(tree.leaves)
    assert len(build_tree(np.ones((500, 4)), 500, 10).pivots) == 1


def test_no_references(spark):
    r = spark.createDataFrame([], "ref_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [0.0])], "query_id long, embedding array<float>")
    assert [tuple(x) for x in nearest_reference(q, r, "query_id").collect()] == [(1, None, None)]


def counting(spark):
    """An embedder that counts the texts it is given."""
    calls = spark.sparkContext.accumulator(0)

    def load():
        def embed(texts):
            calls.add(len(texts))
            return [[float(sum(map(ord, t))), float(len(t))] for t in texts]
        return embed

    return FunctionEmbedder(load), calls


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 8, "block_rows": 2}])
def test_each_text_is_embedded_once(spark, options):
    embedder, calls = counting(spark)
    refs = spark.createDataFrame([(n, f"reference {n}", str(n)) for n in range(10)],
                                 "ref_id long, diag string, diag_code string")
    df = spark.createDataFrame([(n, f"text {n % 100}", None if n % 2 else f"text {n % 50}") for n in range(300)],
                               "qid long, label string, pred string")
    coded = map_codes(df, {"label": "label_code", "pred": "pred_code"}, refs, embedder, **options)
    assert coded.count() == 300 and coded.where("label_code IS NULL").count() == 0
    assert calls.value == 110


def test_codes_of_texts(spark):
    refs = spark.createDataFrame(
        [(1, "red gear", "A"), (2, "blue bolt", "B"), (3, "red gear", "C")],
        "ref_id long, diag string, diag_code string")
    df = spark.createDataFrame(
        [(1, "red gears", "a blue bolt"), (2, "Blue Bolt", None), (3, None, "red gear")],
        "qid long, label string, pred string")
    got = {r.qid: (r.label_code, r.pred_code) for r in map_codes(
        df, {"label": "label_code", "pred": "pred_code"}, refs).collect()}
    assert got == {1: ("A", "B"), 2: ("B", None), 3: (None, "A")}


@pytest.mark.parametrize("k", [1, 5])
def test_groups_of_leaves_where_nothing_is_ruled_out(spark, k):
    # Far from all references in many dimensions, and a leaf of copies larger than a group.
    draw = np.random.default_rng(7)
    references = [(n, draw.normal(size=20).round(2).tolist()) for n in range(150)]
    references += [(n, [0.5] * 20) for n in range(150, 200)]
    queries = [(n, (draw.normal(size=20) + 3).round(2).tolist()) for n in range(90)]
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>").repartition(3)
    r = spark.createDataFrame(references, "ref_id long, embedding array<float>").repartition(3)
    report = {}
    found = nearest_references(q, r, "query_id", k, leaf_rows=8, block_rows=4, group_rows=16, report=report).collect()
    wide = lambda v: np.asarray(v, np.float32).astype(float)
    for number, x in queries:
        own = sorted((row.place, row.ref_id) for row in found if row.query_id == number)
        near = sorted((float(np.abs(wide(x) - wide(v)).sum()), n) for n, v in references)[:k]
        assert own == [(place + 1, n) for place, (_, n) in enumerate(near)]
    assert report["compared"] <= report["pairs"] == 90 * 200


def test_groups_are_bounded():
    sizes = {0: 3, 1: 9, 2: 40, 3: 2, 4: 8}
    layout = _layout(sizes, 10)
    assert [leaf for leaf, _, _ in layout] == [0, 1, 2, 3, 4]
    rows = {}
    for leaf, group, parts in layout:
        for part in range(parts):
            rows[group + part] = rows.get(group + part, 0) + sizes[leaf] / parts
    assert max(rows.values()) <= 10 and sorted(rows) == list(range(len(rows)))


def group(references, leaf_rows):
    """Leaves of references and what bounds them, as the jobs work them out."""
    tree = build_tree(references, len(references), leaf_rows)
    leaf = tree.descend(references)
    near, far = np.full(len(tree.pivots), np.inf), np.full(len(tree.pivots), -np.inf)
    for point, n in zip(references, leaf):
        for node in tree.path(int(n)):
            away = np.abs(point - tree.pivots[node]).sum()
            near[node], far[node] = min(near[node], away), max(far[node], away)
    return leaf, nearest.Bounds(tree, np.unique(leaf), near, far)


def in_order(points, references):
    """Distances summed one dimension after the other."""
    total = np.zeros((len(points), len(references)))
    for p, r in zip(points.T, references.T):
        total += np.abs(p[:, None] - r)
    return total


def unit(draw, rows, dims=64):
    found = draw.normal(size=(rows, dims))
    return (found / np.linalg.norm(found, axis=1)[:, None]).astype(np.float32).astype(float)


def vectors(kind, draw):
    if kind == "unit":
        return unit(draw, 150), unit(draw, 300)
    if kind == "counts":  # very many ties
        return draw.poisson(0.4, size=(150, 16)).astype(float), draw.poisson(0.4, size=(300, 16)).astype(float)
    if kind == "copies":
        return unit(draw, 100), np.vstack([np.tile(unit(draw, 1), (200, 1)), unit(draw, 100)])
    if kind == "one value":
        return np.ones((50, 3)), np.ones((90, 3))
    if kind == "outliers":
        return unit(draw, 100) * np.exp(2 * draw.normal(size=(100, 1))), unit(draw, 200) + 1e3 * (draw.random((200, 64)) < 1e-3)
    if kind == "far":
        return draw.normal(size=(100, 20)).round(2) + 3, draw.normal(size=(200, 20)).round(2)
    if kind == "largest":
        return unit(draw, 100) * 3e38, unit(draw, 200) * 3e38
    return draw.normal(size=(20, 1200)), draw.normal(size=(40, 1200))


@pytest.mark.parametrize("options", [(256, 4096), (8, 7)])
@pytest.mark.parametrize("k", [1, 5])
@pytest.mark.parametrize("kind", ["unit", "counts", "copies", "one value", "outliers", "far", "largest", "wide"])
def test_grid_changes_no_result(kind, k, options, monkeypatch):
    monkeypatch.setattr(nearest, "_L1_CELLS", 64)  # such small groups would be compared in full at once
    points, references = vectors(kind, np.random.default_rng(11))
    leaf_rows, block_rows = options
    leaf, bounds = group(references, leaf_rows)
    ids = np.arange(len(references)) * 3
    distance = in_order(points, references)
    order = np.lexsort((np.broadcast_to(ids, distance.shape), distance), axis=1)[:, :k]
    want = np.take_along_axis(distance, order, 1)
    for home in (bounds.leaves[np.arange(len(points)) % len(bounds.leaves)], np.full(len(points), -1)):
        for limit in (np.full(len(points), np.inf), want[:, -1].copy()):
            found, away, compared = nearest._search_group(bounds, k, block_rows, points, limit, home, ids, references, leaf)
            assert (found == ids[order]).all() and (away == want).all()
            assert compared <= distance.size


def test_what_is_farther_than_the_limit_is_left_out():
    draw = np.random.default_rng(12)
    points, references = unit(draw, 300), unit(draw, 700)
    leaf, bounds = group(references, 64)
    distance = in_order(points, references)
    limit = np.full(len(points), np.median(distance.min(axis=1)))
    found, away, _ = nearest._search_group(
        bounds, 1, 4096, points, limit, np.full(len(points), -1), np.arange(700), references, leaf)
    near = distance.min(axis=1) <= limit
    assert (found[:, 0] == np.where(near, distance.argmin(axis=1), -1)).all()
    assert (np.isinf(away[:, 0]) == ~near).all()


def test_steps_of_the_grid_bound_distances_from_below():
    draw = np.random.default_rng(13)
    for kind in ("unit", "counts", "outliers", "far", "wide"):
        points, references = vectors(kind, draw)
        grid = nearest._Grid(points, references)
        steps = grid.distances(grid.points, grid.references).T
        error = grid.point_error[:, None] + grid.reference_error
        assert ((steps - error) * grid.step <= in_order(points, references) * (1 + 1e-9) + 1e-9).all()


def test_few_pairs_are_computed_in_full(monkeypatch):
    """Where distances rule no leaf out, as for the given vectors."""
    draw, full = np.random.default_rng(14), []
    points, references = unit(draw, 3000), unit(draw, 3000)
    leaf, bounds = group(references, 1024)
    inner = nearest._l1_of_pairs
    monkeypatch.setattr(nearest, "_l1_of_pairs", lambda a, b: full.append(len(a)) or inner(a, b))
    _, _, compared = nearest._search_group(
        bounds, 1, 4096, points, np.full(3000, np.inf), bounds.tree.descend(points), np.arange(3000), references, leaf)
    assert compared > 0.9 * 3000 * 3000 and sum(full) < 0.02 * compared


def test_missing_values_take_the_way_in_full():
    points, references = np.array([[0.0, 1.0], [np.nan, 2.0]]), np.array([[0.0, 1.0], [5.0, 5.0], [0.5, 1.0]])
    leaf, bounds = group(references, 1024)
    found, away, _ = nearest._search_group(
        bounds, 1, 4096, points, np.full(2, np.inf), np.zeros(2, dtype=int), np.arange(3), references, leaf)
    assert found[0, 0] == 0 and away[0, 0] == 0
