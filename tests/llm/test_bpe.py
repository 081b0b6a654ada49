import hashlib
import random

import public_tokenizers
import pytest
from frames import WILD, WILD_IDS, documents, empty, ids, wild
from tessera.llm import bpe, token_counts
from tokenizers import Tokenizer

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LETTERS = "abehinorst'  .,!?<|>ÀéßΣİ漢²\u1680\x1c\x85\u0301\n\t019_"


def random_texts(count, longest=60):
    draw = random.Random(5)
    return ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(longest))) for _ in range(count)] + [
        "a" * n for n in range(20)] + ["x<|startoftext|> y<|endoftext|>", "<|STARTOFTEXT|>", "ΑΣ ΣΣ. Σ"]


@pytest.fixture(scope="module")
def library():
    return {path: Tokenizer.from_file(path) for path in (WORDS, BYTES)}


def test_prefix_encoding_equals_the_library(library):
    own = bpe.WordBpe(WORDS)
    for text in random_texts(1500):
        expected = library[WORDS].encode(text, add_special_tokens=False).ids
        assert [i for w in own.split(text) for i in ([w] if isinstance(w, int) else [t for t, _ in own.word(w)])] == expected


def test_compatible_pairs_are_those_that_stay_apart():
    own = bpe.WordBpe(WORDS).encoder
    draw = random.Random(3)
    tokens = [t for t in own.ids if len(t) < 5 and "\n" not in t]
    for _ in range(2000):
        left, right = draw.choice(tokens), draw.choice(tokens)
        assert own._meets(left, right) == (merged(left + right, own.ranks) != [left, right])


def merged(symbols, ranks):
    """Byte-pair merging as it is defined: the lowest rank first, leftmost first."""
    parts = list(symbols)
    while True:
        found = [(ranks[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_every_text_of_the_table(spark, library):
    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in bpe.encoded_digests(docs, WORDS).collect():
        found = library[WORDS].encode(texts[row.doc_id], add_special_tokens=False).ids
        decoded = library[WORDS].decode(found, skip_special_tokens=False)
        assert row.n_tokens == len(found)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_rows_and_round_trip(spark, library):
    rows = bpe.encoded_digests(wild(spark), WORDS).collect()
    assert ids(rows) == WILD_IDS
    nothing = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256) for r in rows if r.doc_id in (2, 3, 4)} == {(0, nothing)}
    encoded = bpe.encode(wild(spark), WORDS)
    texts = {r.doc_id: r.text for r in bpe.decode(encoded, WORDS).collect()}
    for doc_id, text, *_ in WILD:
        if doc_id is not None:
            found = library[WORDS].encode(text or "", add_special_tokens=False).ids
            assert texts[doc_id] == library[WORDS].decode(found, skip_special_tokens=False)
    assert bpe.encoded_digests(empty(spark), WORDS).count() == 0


def test_merged_length_is_that_of_plain_merging():
    counter = token_counts.TokenCounter(BYTES)
    draw = random.Random(1)
    for _ in range(500):
        symbols = "".join(draw.choice("Ġtheraindo") for _ in range(draw.randrange(1, 40)))
        assert token_counts.merged_length(symbols, counter.ranks) == len(merged(symbols, counter.ranks))


def test_counts_equal_the_library(spark, library):
    counter = token_counts.TokenCounter(BYTES)
    for text in random_texts(1500):
        assert counter.count(text) == len(library[BYTES].encode(text, add_special_tokens=False).ids), repr(text)
    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in token_counts.count_tokens(docs, BYTES).collect():
        assert row.n_tokens == len(library[BYTES].encode(texts[row.doc_id], add_special_tokens=False).ids)
        assert row.n_bytes == len(texts[row.doc_id].encode())
        assert row.over_limit == (row.n_tokens > 1024)


def test_counts_of_odd_rows(spark, library):
    rows = token_counts.count_tokens(wild(spark), BYTES).collect()
    assert ids(rows) == WILD_IDS
    by_id = {r.doc_id: r for r in rows}
    for doc_id, text, *_ in WILD:
        if doc_id is not None:
            assert by_id[doc_id].n_tokens == len(library[BYTES].encode(text or "", add_special_tokens=False).ids)
    assert by_id[2].n_bytes == 0 and not by_id[2].over_limit
    assert token_counts.count_tokens(empty(spark), BYTES).count() == 0


def test_both_ways_of_merging_agree():
    counter = token_counts.TokenCounter(BYTES)
    draw = random.Random(2)
    for length in [*range(1, 40), 63, 64, 65, 200]:
        for letters in ("Ġtheraindo", "aab", "Ġ0Ãł"):
            symbols = "".join(draw.choice(letters) for _ in range(length))
            want = len(merged(symbols, counter.ranks))
            assert token_counts._scanned_length(symbols, counter.ranks) == want
            assert token_counts._queued_length(symbols, counter.ranks) == want


def test_a_word_is_merged_once_whatever_signs_follow(library, monkeypatch):
    counter = token_counts.TokenCounter(BYTES)
    merge, seen = token_counts.merged_length, []
    monkeypatch.setattr(token_counts, "merged_length", lambda symbols, ranks: seen.append(symbols) or merge(symbols, ranks))
    texts = ["a qzxvkj, qzxvkj. (qzxvkj) qzxvkj", "b\n\nc  qzxvkj qzxvkj; qzxvkj!", "qzxvkj\tqzxvkj \n qzxvkj qzxvkj", "é qzxvkj ", " ", "\n",
             "\x1cx \x1cx", "a \x1cx", "word\n", "\nword 　 x y", "it's 'tis  's", "x \t\n y"]
    for text in texts:
        assert counter.count(text) == len(library[BYTES].encode(text, add_special_tokens=False).ids), repr(text)
    assert seen.count("Ġqzxvkj") == 1
    kept = counter.cache.limit
    counter.cache.limit = 4
    for n in range(200):  # a full cache goes on knowing what is asked for again and again
        counter.count(f"x qzxvkj y{n}qj z{n}qj")
    assert seen.count("Ġqzxvkj") == 1 and kept > 4
