"""Token counts without encoding most of a text.

A pre-token that is a vocabulary string known to encode as itself alone is
one token. That is proved once for the whole vocabulary, before any text is
read; only the other pre-tokens are merged.
"""

from __future__ import annotations

import heapq
import re
import sys
from itertools import repeat

from pyspark.sql import DataFrame, functions as F

from .bpe import WHITE, byte_alphabet, load_parts
from .common import AgingCache, per_process, sliced

_CACHE = 400_000
_SHORT = 64
_NEVER = sys.maxsize
# The split pattern of byte-level vocabularies.
PRETOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def merged_length(symbols: str, ranks: dict[tuple[str, str], int]) -> int:
    """How many tokens are left of `symbols` when all merges are done."""
    return _scanned_length(symbols, ranks) if len(symbols) <= _SHORT else _queued_length(symbols, ranks)


def _scanned_length(symbols: str, ranks: dict[tuple[str, str], int]) -> int:
    """Looks through the ranks of all neighbours for each merge: the least work for a word of usual length."""
    parts, rank = list(symbols), ranks.get
    waiting = list(map(rank, zip(symbols, symbols[1:]), repeat(_NEVER)))
    while waiting and (least := min(waiting)) != _NEVER:
        i = waiting.index(least)
        parts[i] += parts.pop(i + 1)
        del waiting[i]
        if i:
            waiting[i - 1] = rank((parts[i - 1], parts[i]), _NEVER)
        if i < len(waiting):
            waiting[i] = rank((parts[i], parts[i + 1]), _NEVER)
    return len(parts)


def _queued_length(symbols: str, ranks: dict[tuple[str, str], int]) -> int:
    """Keeps neighbours in a heap by rank, for long symbols: n log n."""
    parts: list[str | None] = list(symbols)
    following = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    waiting = [(rank, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
               if (rank := ranks.get((a, b))) is not None]
    heapq.heapify(waiting)
    left = len(parts)
    while waiting:
        _, i, a, b = heapq.heappop(waiting)
        j = following[i] if parts[i] == a else len(parts)
        if j >= len(parts) or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        left -= 1
        k = following[i] = following[j]
        if k < len(parts):
            before[k] = i
            if (rank := ranks.get((parts[i], parts[k]))) is not None:
                heapq.heappush(waiting, (rank, i, parts[i], parts[k]))
        if (h := before[i]) >= 0 and (rank := ranks.get((parts[h], parts[i]))) is not None:
            heapq.heappush(waiting, (rank, h, parts[h], parts[i]))
    return left


def whole_tokens(vocabulary: dict[str, int], ranks: dict[tuple[str, str], int]) -> set[str]:
    """The vocabulary strings whose own merges end in a single token."""
    return {token for token in vocabulary if merged_length(token, ranks) == 1}


class TokenCounter:
    """Counts the tokens of a text under a byte-level vocabulary file."""

    def __init__(self, path: str):
        import regex

        described, self.special = load_parts(path)
        model = described["model"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r
                      for r, m in enumerate(model["merges"])}
        self.letters = byte_alphabet()
        self.whole = whole_tokens(model["vocab"], self.ranks)
        pattern = PRETOKEN.replace(r"[^\s", f"[^{WHITE}").replace(r"(?!\S)", f"(?![^{WHITE}])").replace(
            r"\s", f"[{WHITE}]")
        self.pretokens = regex.compile(pattern).findall
        self.units = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.white = re.compile(f"[{WHITE}]").match
        self.specials = re.compile("|".join(map(re.escape, self.special)))
        self.irregular = re.compile("[\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|  |\n\n|\n ").search
        self.cache = AgingCache(self.word, _CACHE)

    def pretoken(self, pretoken: str) -> int:
        if pretoken.isascii() and pretoken.isprintable():
            shown = pretoken.replace(" ", self.letters[32])
        else:
            shown = "".join([self.letters[b] for b in pretoken.encode()])
        return 1 if shown in self.whole else merged_length(shown, self.ranks)

    def unit(self, unit: str) -> int:
        """Tokens of white space and the word after it, where no pre-token crosses the ends.

        Letters alone are one pre-token, with a blank before them or not. Of
        several pre-tokens, those after a blank are words that others may hold too.
        """
        if unit.isascii() and unit.removeprefix(" ").isalpha():
            return self.pretoken(unit)
        found = self.pretokens(unit)
        if len(found) == 1:
            return self.pretoken(unit)
        return sum([self.cache[p[1:]] if p[0] == " " and p[1:].isalnum() else self.pretoken(p) for p in found])

    def word(self, word: str) -> int:
        """Tokens of a word after a blank, or of a word together with the white space it begins with."""
        return self.unit(word if self.white(word) else " " + word)

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings.

        Single blanks belong to the word after them and a single line break
        stands alone, so that words can be looked up after a plain split.
        Only the first word of a text may have nothing before it.
        """
        if not text:
            return 0
        if " \n" in text or self.irregular(text):
            first, *units = self.units(text)
            words = [u[1:] if u[0] == " " and not self.white(u, 1) else u for u in units]
        else:
            first, *words = text.replace("\n", " \n").split(" ")
        counted = self.unit(first) if first else 0
        return counted + sum(map(self.cache.__getitem__, words))

    def count(self, text: str) -> int:
        if "<|" not in text:
            return self.plain(text)
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per row of `docs`, no shuffle.

    Null and empty texts count 0 bytes and tokens. Special strings of the
    file count one token each, wherever they stand. Other columns and
    repeated rows change nothing.
    """

    def run(batches):
        import pyarrow as pa

        counter = per_process(("count", path), lambda: TokenCounter(path))
        for batch in sliced(batches):
            counts = [counter.count(t) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)
