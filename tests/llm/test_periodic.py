import hashlib
import random
import zlib
from fractions import Fraction

from frames import WILD_IDS, documents, empty, ids, wild
from tessera.llm import periodic


def plain_runs(words, least_length=6, least_exponent=4):
    """Every period tried at every place."""
    found = set()
    for period in range(1, len(words) // least_exponent + 1):
        at = 0
        while at + period < len(words):
            end = at
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            length = end - at + period
            if end > at and length >= max(least_length, least_exponent * period):
                if not any(all(words[k] == words[k + q] for k in range(at, at + length - q)) for q in range(1, period)):
                    found.add((at, period, length))
            at = max(end, at + 1)
    return [(start, length, period) for start, period, length in sorted(found)]


def sequences(count):
    draw = random.Random(7)
    for _ in range(count):
        kinds, size = draw.choice((1, 2, 3, 9)), draw.randrange(70)
        words = [draw.randrange(kinds) for _ in range(size)]
        if draw.random() < 0.5 and size > 4:
            period = draw.randrange(1, size // 3 + 1)
            words = [words[i % period] if draw.random() > 0.03 else words[i] for i in range(size)]
        yield [b"%d" % w for w in words]


def test_runs_are_those_of_plain_search():
    for words in sequences(2000):
        assert periodic.word_runs(words) == plain_runs(words)


def test_any_exponent_from_two():
    for words in sequences(500):
        assert periodic.runs_of(periodic._numbers(words), 2, 2) == plain_runs(words, 2, 2)


def test_tree_holds_every_suffix_and_its_common_prefixes():
    draw = random.Random(2)
    for _ in range(200):
        symbols = [draw.randrange(3) for _ in range(draw.randrange(1, 40))]
        tree = periodic.SuffixTree(symbols)
        closed = [*symbols, -1]
        assert tree.tour()[0] == sorted(range(len(closed)), key=lambda i: closed[i:])
        turned = [*(-s for s in symbols), -9]
        assert tree.tour(True)[0] == sorted(range(len(closed)), key=lambda i: turned[i:])
        common = periodic.CommonExtensions(tree)
        for left in range(len(symbols)):
            for right in range(left):
                size = 0
                while right + size < len(closed) and left + size < len(closed) and closed[left + size] == closed[right + size]:
                    size += 1
                assert common([left], [right])[0] == size


def expected(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    if words and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for start, length, period in runs for i in range(start + period, start + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


def test_every_text_of_the_table(spark):
    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect() if len((r.text or "").split()) < 1500}
    found = {r.doc_id: tuple(r)[1:] for r in periodic.run_digests(docs).collect()}
    assert len(found) == docs.count()
    for doc_id, text in texts.items():
        assert found[doc_id] == expected(doc_id, text)
    assert sum(f[0] for f in found.values()) > 0


def test_odd_rows(spark):
    rows = periodic.run_digests(wild(spark)).collect()
    assert ids(rows) == WILD_IDS
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    for doc_id in (2, 3, 4):
        assert tuple(by_id[doc_id])[1:] == (0, None, None, None, None, *[hashlib.sha256(b"").hexdigest()] * 2)
    assert by_id[5].n_runs >= 1 and by_id[5].period == 11
    assert periodic.run_digests(empty(spark)).count() == 0


def test_collapsed_text_keeps_the_first_period(spark):
    docs = spark.createDataFrame([(1, "x  a b a b a b a b\ty"), (2, "a a a a a"), (3, "z z z z z z")], "doc_id long, text string")
    rows = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert rows[1].collapsed == "x a b y" and [tuple(r) for r in rows[1].runs] == [(1, 8, 2)]
    assert rows[2].collapsed == "a a a a a" and rows[2].runs == [] and rows[3].collapsed == "z"
