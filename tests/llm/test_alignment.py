import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from frames import WILD, WILD_IDS, documents, empty, ids, wild
from tessera.llm import alignment, common
from tessera.llm.bpe import byte_alphabet
from tokenizers import Tokenizer

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
NOTHING = (0,) * 6 + ("",)


class Plain:
    """Alignment as it is defined: every pair of tokens of a text compared by its bytes."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        values = {c: b for b, c in enumerate(byte_alphabet())}
        self.a_bytes = {i: bytes(values[c] for c in t) for t, i in self.a.get_vocab().items() if i < 50256}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        raw = (" " + (text or "")).encode()
        a = [(i, self.a_bytes[i]) for i in self.a.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, self.b_bytes(i)) for i in self.b.encode(text or "")]
        if not text or any(b"".join(t for _, t in side) != raw for side in (a, b)):
            return None
        placed = []
        for side in (a, b):
            at, found = 0, []
            for i, token in side:
                found.append((i, at, at + len(token)))
                at += len(token)
            placed.append(found)
        return placed

    def links(self, placed):
        a, b = placed
        first = 0
        for i, start, end in a:
            while b[first][2] <= start:
                first += 1
            at = first
            while at < len(b) and b[at][1] < end:
                yield i, b[at][0]
                at += 1

    def table(self, texts):
        placed = [self.tokens(t) for t in texts]
        links = [list(self.links(p)) if p else [] for p in placed]
        counts = Counter(pair for found in links for pair in found)
        best = Counter()
        for (_, b), n in counts.items():
            best[b] = max(best[b], n)
        for p, found in zip(placed, links):
            if not p:
                yield NOTHING
                continue
            shared = {end for _, _, end in p[0]} & {end for _, _, end in p[1]}
            sides = []
            for side in p:
                groups, own = [], []
                for i, _, end in side:
                    own.append(str(i))
                    if end in shared:
                        groups.append(",".join(own))
                        own = []
                sides.append(groups)
            groups = ["|".join(pair) for pair in zip(*sides, strict=True)]
            yield (len(p[0]), len(p[1]), len(groups), len(found),
                   sum(counts[pair] == best[pair[1]] for pair in found), sum(counts[pair] for pair in found),
                   hashlib.sha256(";".join(groups).encode()).hexdigest())


@pytest.fixture(scope="module")
def plain():
    return Plain()


def compared(rows, found):
    key = lambda r: (r[0] is not None, r[0], r[1:])
    return sorted((tuple(r) for r in found), key=key) == sorted(
        ((doc_id, *values) for doc_id, values in rows), key=key)


def test_odd_rows_equal_plain_alignment(spark, plain):
    found = alignment.aligned_digests(wild(spark), A, B).collect()
    assert ids(found) == WILD_IDS
    assert compared(zip([row[0] for row in WILD], plain.table([row[1] for row in WILD])), found)
    assert {tuple(r)[1:] for r in found if r.doc_id in (2, 3)} == {NOTHING}
    assert alignment.aligned_digests(empty(spark), A, B).count() == 0


TEXTS = ["a b  c\n\n d", " leading", "trailing ", "   ", "\n", "x▁y", "<|endoftext|> <s> </s>", "漢字と😀😀 é́",
         "don't  stop\tnow", "a" * 500, "   b", "it's the the the"]


def test_hard_texts(spark, plain):
    docs = spark.createDataFrame([*enumerate(TEXTS * 3)], "doc_id long, text string").repartition(5)
    assert compared(enumerate(plain.table(TEXTS * 3)), alignment.aligned_digests(docs, A, B).collect())


def test_few_windows_and_few_frequent_ones_change_nothing(spark, plain, monkeypatch):
    monkeypatch.setattr(alignment, "FREQUENT", 50)
    monkeypatch.setattr(alignment, "_WINDOWS", 100)
    monkeypatch.setattr(alignment, "_ROWS", 5)
    rows = [(r.doc_id, r.text) for r in documents(spark).limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = alignment.aligned_digests(docs, A, B).collect()
    assert compared(zip([r[0] for r in rows], plain.table([r[1] for r in rows])), found)


def test_every_text_of_the_table(spark, plain):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    found = alignment.aligned_digests(documents(spark), A, B).collect()
    assert compared(zip([r[0] for r in rows], plain.table([r[1] for r in rows])), found)


def test_windows_meet_only_where_both_have_a_boundary(plain):
    memo = alignment.WindowMemo(A, B)
    (numbers,) = memo.windows(["the cat,the dog  and\nthe bird"])
    assert len(numbers) > 3 and len(memo) == len(set(numbers))
    joined = ";".join(memo.texts[w] for w in numbers)
    assert hashlib.sha256(joined.encode()).hexdigest() == next(plain.table(["the cat,the dog  and\nthe bird"]))[6]


def test_a_worker_holds_the_windows_of_one_chunk_and_none_after_a_task(monkeypatch):
    monkeypatch.setattr(alignment, "_WINDOWS", 100)
    monkeypatch.setattr(alignment, "_ROWS", 5)
    texts = [f"a{n} b{n} c{n} d{n}" for n in range(200)]
    numbers = pa.array(range(200), pa.int64())
    batch = pa.RecordBatch.from_arrays([numbers, numbers, pa.array(texts)], ["row", "doc_id", "text"])
    try:
        memo = common.per_process(("align", A, B), lambda: alignment.WindowMemo(A, B))
        for _ in range(2):
            held = [len(memo) for _ in alignment._align_function(A, B)([batch])]
            assert 100 < max(held) < 200 and not memo and not memo.of_unit and not len(memo.links)
    finally:
        common.release()


def test_a_unit_of_one_window_is_kept_once_and_its_windows_go_by_number():
    memo = alignment.WindowMemo(A, B)
    (plain,) = memo.windows(["the cat sat on the mat"])
    assert not memo.several and not memo.of_ids and plain == [memo.of_unit[" " + w] for w in "the cat sat on the mat".split()]
    (again, several) = memo.windows(["the cat", "a\tb \n c\tb"])
    assert again == plain[:2] and memo.several and max(several) < len(memo) == len(memo.texts) == len(memo.sizes)
    windows = [memo.texts[w] for w in several]
    a, b = memo.a.encode(" a\tb \n c\tb"), memo.b.encode("a\tb \n c\tb")
    groups = [g.split("|") for g in ";".join(windows).split(";")]
    assert [int(i) for g in groups for i in g[0].split(",")] == a and [int(i) for g in groups for i in g[1].split(",")] == b
