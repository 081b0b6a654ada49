import importlib
import random

import pytest
from frames import WILD_IDS, documents, empty, ids, wild
from tessera.llm import near_duplicates
from tessera.llm.components import components


def brute(rows, shingle, percent=80):
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        width = min(shingle, len(words))
        sets[doc_id] = frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            low, high = sorted((len(sets[a]), len(sets[b])))
            if low and 100 * low >= percent * high and find(a) != find(b):
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (low + high - shared):
                    small, large = sorted((find(a), find(b)))
                    parent[large] = small
    return {d: (len(sets[d]), find(d)) for d in order}


def check(spark, docs, shingle, **options):
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], shingle)
    rows = near_duplicates.near_duplicates(docs, shingle, **options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


@pytest.mark.parametrize("shingle", [2, 5])
def test_table_against_all_pairs(spark, shingle):
    check(spark, documents(spark), shingle)


def family(seed, copies, words, edits):
    """Copies of one text, each with a few words of its own: more and less alike."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(words)]
    rows = []
    for number in range(copies):
        own = list(base)
        for _ in range(draw.randrange(edits)):
            own[draw.randrange(words)] = f"x{draw.randrange(10**6)}"
        rows.append((1000 * seed + number, " ".join(own)))
    return rows


def test_large_group_in_blocks_and_divided_nodes(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 24)
    monkeypatch.setattr(near_duplicates, "PIVOTS", 2)
    monkeypatch.setattr(near_duplicates, "CHUNK", 4)
    rows = family(1, 150, 100, 14) + family(2, 40, 100, 30) + family(3, 5, 20, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(spark, docs, 2, limit=16)


def test_node_that_cannot_be_divided_is_not_cut(spark, monkeypatch):
    # One tree: records that it brings to one node meet nowhere else.
    monkeypatch.setattr(near_duplicates, "trees_needed", lambda *_: 1)
    monkeypatch.setattr(near_duplicates, "START_DEPTH", 1)
    base = [f"w{n}" for n in range(2000)]
    docs = spark.createDataFrame(
        [(n, " ".join(base[:n] + [f"x{n}"] + base[n + 1:])) for n in range(60)], "doc_id long, text string")
    check(spark, docs, 2, limit=4)


def test_odd_rows(spark):
    rows = near_duplicates.near_duplicates(wild(spark), 2).collect()
    assert ids(rows) == WILD_IDS
    by_id = {}
    for row in rows:
        by_id.setdefault(row.doc_id, []).append((row.component_id, row.kept))
    assert by_id[1] == [(1, True)]
    assert by_id[6] == [(1, False), (1, False)]
    for alone in (2, 3, 4, 5, 7, 9):
        assert by_id[alone] == [(alone, True)]
    assert by_id[None] == [(None, True), (None, True)]
    assert near_duplicates.near_duplicates(empty(spark), 2).count() == 0


def test_number_of_trees_grows_with_recall():
    assert near_duplicates.trees_needed(0.8, 0.9) < near_duplicates.trees_needed(0.8, 0.999)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (201, 202), (202, 201)]
    draw = random.Random(1)
    draw.shuffle(edges)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {201: 201, 202: 201}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("chunk, most", [(None, 2), (100, 60)])
def test_few_edges_are_solved_without_rounds(spark, monkeypatch, chunk, most):
    # With a chunk of 100 nodes the edges go through rounds until 50 are left.
    module = importlib.import_module("tessera.llm.components")
    written, stage = [], module.stage
    monkeypatch.setattr(module, "stage", lambda df, name: written.append(name) or stage(df, name))
    if chunk:
        monkeypatch.setattr(module, "_CHUNK", chunk)
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(2000, 2000), (2002, 2001)]
    random.Random(2).shuffle(edges)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(16)).collect()}
    assert found == ({i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1100)} | {2001: 2001, 2002: 2001})
    assert len(written) <= most
    assert chunk is None or "ends" in written
