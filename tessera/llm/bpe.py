"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token there is exactly one token that its encoding
can end with. It is found among the vocabulary strings that end there (the
suffix automaton names them) as the one that may follow the last token of
what stands before it. Back-pointers then give the ids. No merge is replayed.
"""

from __future__ import annotations

import json
import re
import unicodedata
from pyspark.sql import DataFrame, functions as F

from .common import BoundedCache, per_process, sliced

_END = "\n"  # stands for the end of a word; no byte is written as it
_CACHE = 300_000
_PAIRS = 500_000
_NEVER = float("inf")
# White_Space of Unicode, which Python's \s exceeds by U+001C to U+001F.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = "\x1c\x1d\x1e\x1f"


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class PrefixEncoder:
    """Encodes one pre-token at a time, in time linear in its length.

    `merges` are the pairs in order of their rank. Two neighbouring tokens
    are compatible if no merge across their border would have come before
    the merges that built them: `_meets` compares the tokens that stood at
    the border from either side with the ranks at which they were absorbed.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        import ahocorasick

        def plain(token: str) -> str:
            return token[: -len(suffix)] + _END if suffix and token.endswith(suffix) else token

        self.suffix = _END if suffix else ""
        self.ids = {plain(t): i for t, i in vocabulary.items()}
        self.text = {i: t for t, i in vocabulary.items()}
        self.ranks, self.parts, self.followers = {}, {}, {}
        for rank, (left, right) in enumerate(merges):
            left, right = plain(left), plain(right)
            self.ranks[left, right] = self.followers.setdefault(left, {})[right] = rank
            self.parts.setdefault(left + right, (left, right, rank))
        self.letters = byte_alphabet()
        self.tokens = {i: t for t, i in self.ids.items()}
        self.lengths = {i: len(t) for i, t in self.tokens.items()}
        # Strings that encode as themselves: symbols, and what some merge makes.
        self.whole = {t: (i,) for t, i in self.ids.items() if t in self.parts or len(t.replace(_END, "")) < 2}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token, (i, len(token) - 1))
        self.automaton.make_automaton()
        self._sides: dict[str, tuple[list, list]] = {}
        self._width = max(self.tokens) + 1
        self._pairs = BoundedCache(self._fits, _PAIRS)

    def _side(self, token: str, right: bool) -> list[tuple[str, float, float]]:
        """Tokens at one border of `token`, with ranks of birth and absorption."""
        found, absorbed = [], _NEVER
        while True:
            left_part, right_part, born = self.parts.get(token, (None, None, -1))
            found.append((token, born, absorbed))
            if left_part is None:
                return found
            token, absorbed = (right_part if right else left_part), born

    def _sides_of(self, token: str) -> tuple[list, list]:
        if token not in self._sides:
            self._sides[token] = self._side(token, False), self._side(token, True)
        return self._sides[token]

    def _meets(self, left: str, right: str) -> bool:
        """Whether some merge across the border comes first. At one rank the leftmost pair does."""
        followers, near = self.followers, self._sides_of(right)[0]
        for x, x_born, x_gone in self._sides_of(left)[1]:
            if x in followers:
                ranks = followers[x]
                for y, y_born, y_gone in near:
                    if y in ranks:
                        at = max(ranks[y], x_born, y_born)
                        if at < x_gone and at <= y_gone:
                            return True
        return False

    def _fits(self, pair: int) -> bool:
        left, right = divmod(pair, self._width)
        return not self._meets(self.tokens[left], self.tokens[right])

    def encode(self, pretoken: str) -> tuple[int, ...]:
        """The ids of a pre-token."""
        if pretoken.isascii() and pretoken.isprintable() and " " not in pretoken:
            return self.split(pretoken + self.suffix)
        letters = self.letters
        return self.split("".join([letters[b] for b in pretoken.encode()]) + self.suffix)

    def split(self, shown: str) -> tuple[int, ...]:
        """The ids of a pre-token that is already in the byte alphabet."""
        if shown in self.whole:
            return self.whole[shown]
        last, pairs, width = [-1] * len(shown), self._pairs, self._width
        for end, (token, back) in self.automaton.iter(shown):
            if last[end] < 0:
                if end == back:
                    last[end] = token
                elif (before := last[end - back - 1]) >= 0 and pairs[before * width + token]:
                    last[end] = token
        found, at, lengths = [], len(shown) - 1, self.lengths
        while at >= 0:
            token = last[at]
            if token < 0:
                raise ValueError(f"no token ends at place {at + 1} of {shown[:80]!r}")
            found.append(token)
            at -= lengths[token]
        found.reverse()
        return tuple(found)


def load_parts(path: str) -> tuple[dict, dict]:
    """The vocabulary file, and its special tokens by their string."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    return described, {t["content"]: t["id"] for t in described["added_tokens"]}


class WordSplitter:
    """The first steps of an encoding, which need no vocabulary: special strings, normal form, words, pre-tokens.

    Follows a vocabulary file with NFC, single blanks and lower case as its
    normal form, whose pre-tokens hold no white space.
    """

    def __init__(self, described: dict, special: dict[str, int]):
        import regex

        self.special = special
        steps = described["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.pretokens = regex.compile(pattern.replace(r"\s", WHITE)).findall
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.words = re.compile(f"[^{WHITE}]+").findall

    def split(self, text: str) -> list[str | int]:
        """Normalised words, and the ids of special strings between them."""
        if "<|" not in text:
            return self._words(text)
        found: list[str | int] = []
        for part in self.specials.split(text):
            found += [self.special[part]] if part in self.special else self._words(part)
        return found

    def _words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.words(text) if any(sign in text for sign in _ODD) else text.split()


class WordBpe(WordSplitter):
    """The whole encoding of a text: words as they are split, and their tokens.

    Pre-tokens end in a suffix. A word between white space is encoded once and kept in a bounded cache.
    """

    def __init__(self, path: str):
        described, special = load_parts(path)
        super().__init__(described, special)
        model = described["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.encoder = PrefixEncoder(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.written = model["end_of_word_suffix"] or ""
        self.names = self.encoder.text | {i: s for s, i in self.special.items()}
        self.known = BoundedCache(self.encoder.encode, _CACHE)

    def word_ids(self, word: str) -> tuple[int, ...]:
        """Ids of one normalised word. Letters alone are one pre-token, and so is a sign after them."""
        if word.isalpha():
            return self.known[word]
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return self.known[word[:-1]] + self.known[word[-1]]
        return tuple([i for p in self.pretokens(word) for i in self.known[p]])

    def word(self, word: str) -> list[tuple[int, str]]:
        """Ids and token strings of one normalised word."""
        return [(i, self.names[i]) for i in self.word_ids(word)]


def _encode_function(path: str):
    """Arrow batches of (doc_id, text) to counts and digests of ids and decoded text."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        def build():
            bpe = WordBpe(path)

            def compute(word):
                ids = (word,) if isinstance(word, int) else bpe.word_ids(word)
                return len(ids), " ".join(map(str, ids)), " ".join([bpe.names[i] for i in ids])

            return bpe, BoundedCache(compute, _CACHE)

        bpe, cache = per_process(("encode", path), build)
        for batch in sliced(batches):
            counts, ids_digests, text_digests = [], [], []
            for text in batch.column("text").to_pylist():
                found = [f for f in map(cache.__getitem__, bpe.split(text or "")) if f[0]]
                counts.append(sum(f[0] for f in found))
                ids_digests.append(hashlib.sha256(" ".join([f[1] for f in found]).encode()).hexdigest())
                text_digests.append(hashlib.sha256(" ".join([f[2] for f in found]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()),
                 pa.array(text_digests, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """Token counts and digests of ids and decoded text; one row per row of `docs`, no shuffle.

    Null and empty texts have no tokens and the digest of the empty string.
    Special strings inside a text become their ids. Repeated rows are encoded
    like any others, other columns are not read. A word over 64 characters
    is encoded in linear time each time it occurs and not cached.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _encode_function(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>): the ids themselves."""

    def run(batches):
        import pyarrow as pa

        def build():
            bpe = WordBpe(path)
            return bpe, BoundedCache(
                lambda w: (w,) if isinstance(w, int) else bpe.word_ids(w), _CACHE)

        bpe, cache = per_process(("ids", path), build)
        for batch in sliced(batches):
            ids = [[i for word in bpe.split(t or "") for i in cache[word]] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): token strings joined by one blank, special ones included.

    Null ids give a null text, no ids the empty one; an id outside the
    vocabulary is an error of the row's task.
    """

    def run(batches):
        import pyarrow as pa

        def build():
            described, special = load_parts(path)
            return {i: t for t, i in (described["model"]["vocab"] | special).items()}

        names = per_process(("names", path), build)
        for batch in sliced(batches):
            texts = [None if ids is None else " ".join([names[i] for i in ids])
                     for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, text string")
