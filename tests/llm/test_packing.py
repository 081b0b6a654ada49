import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from frames import documents, empty, wild
from tessera.llm import bpe, common, near_duplicates, packing
from tokenizers import Tokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")


def check_places(rows, capacity):
    bins = defaultdict(list)
    for row in rows:
        bins[row.sequence_id].append((row.offset, row.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_places(spark):
    docs = documents(spark)
    library = Tokenizer.from_file(WORDS)
    rows = packing.pack_documents(docs, WORDS).collect()
    by_doc = defaultdict(list)
    for row in rows:
        by_doc[row.doc_id].append(row)
    total = 0
    for doc in docs.collect():
        ids = library.encode(doc.text, add_special_tokens=False).ids + [0]
        total += len(ids)
        pieces = sorted(by_doc[doc.doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in pieces] == [(i, 2048 * i) for i in range(len(pieces))]
        for row in pieces:
            own = ids[row.start : row.start + 2048]
            assert row.length == len(own)
            assert row.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    assert check_places(rows, 2048) <= -(-total // 2048) + 1


def test_several_shares_islands_and_rounds(spark):
    draw = random.Random(4)
    pieces = spark.createDataFrame(
        [(i, draw.choice([1, 3, 40, 500, 700, 1025, 2000, 2048])) for i in range(900)], "doc_id long, length long")
    rows = packing.pack(pieces, share=100, generations=2).collect()
    assert len(rows) == 900
    sizes = [r.length for r in rows]
    used = check_places(rows, 2048)
    assert used >= -(-sum(sizes) // 2048)
    plain = packing.best_fit(range(900), sizes, packing.Packing([], [], 2048))
    assert used <= len(plain.bins)


def triplets(count, draw):
    """Sizes of which each three fill a bin: best fit does badly here."""
    sizes = []
    for _ in range(count):
        a = draw.randrange(380, 1000)
        b = draw.randrange(380, min(1948 - a, 1000))
        sizes += [a, b, 2048 - a - b]
    draw.shuffle(sizes)
    return sizes


def test_search_closes_most_of_the_gap_on_triplets():
    for seed in range(3):
        sizes = triplets(400, random.Random(seed))
        plain = packing.best_fit(range(1200), sizes, packing.Packing([], [], 2048))
        found = packing.evolve(sizes, 2048, seed)
        assert sorted(i for b in found.bins for i in b) == list(range(1200)) and max(found.fills) <= 2048
        assert len(plain.bins) - len(found.bins) >= (len(plain.bins) - 400) / 2


def test_shares_of_triplets_beat_best_fit(spark):
    sizes = triplets(200, random.Random(8))
    pieces = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long")
    plain = packing.best_fit(range(600), sizes, packing.Packing([], [], 2048))
    assert check_places(packing.pack(pieces, generations=10).collect(), 2048) < len(plain.bins)


def test_every_founder_and_child_holds_all_items():
    draw = random.Random(6)
    for sizes in ([2048] * 3, [1] * 50, [1], [1025] * 9, triplets(20, draw), [draw.randrange(1, 2048) for _ in range(99)]):
        for made in (packing.fill_bins(sizes, 2048, draw), packing.shuffled_fit(sizes, 2048, draw),
                     packing.mutate(packing.fill_bins(sizes, 2048, draw), sizes, draw)):
            assert sorted(i for b in made.bins for i in b) == list(range(len(sizes)))
            assert made.fills == [sum(sizes[i] for i in b) for b in made.bins] and max(made.fills) <= 2048


def test_words_merge_as_by_the_rank_of_pairs():
    own, merge = bpe.WordBpe(WORDS).encoder, packing.word_merger(WORDS)
    draw = random.Random(12)
    words = ["".join(draw.choice("abehinorst'.,éßс漢") for _ in range(draw.randrange(1, 25))) for _ in range(3000)]
    words += [t.removesuffix("</w>") for t in list(own.text.values())[:20000] if t.isascii() and t != "</w>"]
    for word in filter(None, words):
        assert merge(word) == list(own.encode(word)), word


def test_evolution_never_loses_an_item_and_does_not_get_worse():
    draw = random.Random(2)
    sizes = [draw.randrange(200, 1400) for _ in range(120)]
    start = packing.best_fit(range(120), sizes, packing.Packing([], [], 2048))
    found = packing.evolve(sizes, 2048, 1, [start], generations=15)
    assert sorted(i for b in found.bins for i in b) == list(range(120))
    assert found.fills == [sum(sizes[i] for i in b) for b in found.bins] and max(found.fills) <= 2048
    assert found.fitness() <= start.fitness()
    child = packing.crossover(found, start, sizes, draw)
    assert sorted(i for b in child.bins for i in b) == list(range(120))


def test_odd_rows(spark):
    rows = packing.pack_documents(wild(spark), WORDS).collect()
    assert check_places(rows, 2048) >= 1
    short = [r for r in rows if r.doc_id in (2, 3, 4)]
    assert {(r.length, r.ids_crc32) for r in short} == {(1, zlib.crc32(bytes(4)))}
    assert sum(r.doc_id == 6 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 2
    assert sum(r.doc_id == 5 for r in rows) > 10
    assert packing.pack_documents(empty(spark), WORDS).count() == 0


def test_a_packing_worker_splits_as_the_encoder_does_without_being_one():
    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    texts = ["Ünï ΑΣ İ <|endoftext|>x don't 3 漢字 \x1c", "a  b\n", "the cat's 42 <|startoftext|>"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], ["doc_id", "text"])
    try:
        list(packing.tokenized_pieces(Docs(), WORDS)([batch]))
        splitter, _ = common._kept()["packed", WORDS]
        whole = bpe.WordBpe(WORDS)
        assert not isinstance(splitter, bpe.WordBpe) and [*map(splitter.split, texts)] == [*map(whole.split, texts)]
    finally:
        common.release()


def test_duplicates_let_go_of_what_earlier_operators_kept():
    common.per_process("earlier", lambda: ["much"])
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b c"])], ["doc_id", "text"])
    assert len(list(near_duplicates._shingle_function(2, 16, False)([batch]))) == 1
    assert not common._kept()


def test_islands_let_go_of_the_words_and_tasks_hand_free_memory_back(monkeypatch):
    common.per_process("earlier", lambda: ["much"])
    frame = pd.DataFrame({"item": [1, 2], "length": [2000, 48], "bins": [None, None]})
    found = packing._island_function(2048, 1, -1, 1)((0, 0), frame)
    assert found["n_bins"].tolist() == [1, 1] and not common._kept()
    given = []
    monkeypatch.setattr(common, "hand_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5))], ["a"])
    assert [b.num_rows for b in common.sliced([batch], 2)] == [2, 2, 1] and given == [1]
    assert [*common.sliced([])] == [] and given == [1, 1]
