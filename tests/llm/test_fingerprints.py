import hashlib

import numpy as np
import pytest
from frames import WILD, WILD_IDS, documents, empty, ids, wild
from tessera.llm import fingerprints


def dice(left, right):
    a, b = (set(fingerprints.paragraph_digests(t).tolist()) for t in (left, right))
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


def expected(rows):
    texts = [r[1] or "" for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    found = []
    for place, row in enumerate(order):
        own, following = texts[place], texts[(place + 1) % len(texts)]
        quarter = len(own) // 4
        edited = own[: len(own) - quarter] + following[:quarter]
        found.append((row[0], len(own), hashlib.sha256(edited.encode()).hexdigest(), dice(own, edited), dice(own, following)))
    return sorted(found, key=str)


@pytest.mark.parametrize("parts", ["1", "3", "8", "64"])
def test_table_against_plain_code(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = fingerprints.fingerprints(documents(spark)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows), key=str)
    assert found == expected([(r.doc_id, r.text) for r in documents(spark).collect()])


def test_odd_rows(spark):
    rows = fingerprints.fingerprints(wild(spark)).collect()
    assert ids(rows) == WILD_IDS
    found = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows), key=str)
    assert found == expected([(row[0], row[1]) for row in WILD])
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 6)}) == 1
    assert fingerprints.fingerprints(empty(spark)).count() == 0


def test_single_document_follows_itself(spark):
    row = fingerprints.fingerprints(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).first()
    assert row.edited_sha256 == hashlib.sha256(b"a b c a").hexdigest() and row.near_next == 1.0


@pytest.mark.parametrize("cells", [12, 48, 192])
def test_peeling_finds_exactly_what_differs_or_says_so(cells):
    draw = np.random.default_rng(cells)
    left, right, differ = [], [], []
    for count in range(0, 60, 3):
        shared = draw.integers(0, 2**63, 300, dtype=np.uint64)
        only = draw.integers(0, 2**63, count, dtype=np.uint64)
        left.append(np.concatenate([shared, only[: count // 2]]))
        right.append(np.concatenate([only[count // 2 :], shared]))
        differ.append(count)
    found = fingerprints._peeled(left, right, cells)
    assert all(f in (-1, d) for f, d in zip(found.tolist(), differ))
    assert found[0] == 0 and (found >= 0).sum() >= min(len(differ), cells // 6)
    sizes = [len(a) + len(b) for a, b in zip(left, right)]
    assert fingerprints.likeness(left, right) == [1 - d / n for d, n in zip(differ, sizes)]


def test_repeated_paragraphs_count():
    once, twice = fingerprints.paragraph_digests("a\nb"), fingerprints.paragraph_digests("a\na\nb")
    assert len(set(twice.tolist())) == 3 and set(once.tolist()) < set(twice.tolist())


def test_two_fingerprints_tell_how_alike_their_texts_are(spark):
    """The likenesses of every row follow from the emitted columns."""
    rows = fingerprints.fingerprints(documents(spark)).orderBy("doc_id").collect()
    for row, following in zip(rows, [*rows[1:], rows[0]]):
        assert fingerprints.likeness_of(row.fingerprint, row.edited_fingerprint) == row.near_edited
        assert fingerprints.likeness_of(row.fingerprint, following.fingerprint) == row.near_next


def test_a_fingerprint_gives_back_its_digests_and_folds():
    draw = np.random.default_rng(3)
    for size in (0, 1, 2, 7, 50, 400, 3000):
        digests = draw.integers(0, 2**63, size, dtype=np.uint64)
        (sketch,) = fingerprints.sketches([digests])
        assert sorted(fingerprints.digests_of(sketch).tolist()) == sorted(digests.tolist())
        folded = fingerprints._folded(fingerprints._table_of(sketch), 12)
        assert all((a == b).all() for a, b in zip(folded, fingerprints._filled([digests], 12)))
        assert fingerprints.likeness_of(sketch, sketch) == 1.0
        (other,) = fingerprints.sketches([draw.integers(0, 2**63, 5, dtype=np.uint64)])
        assert fingerprints.likeness_of(sketch, other) == (0.0 if size + 5 else 1.0)
