"""SentencePiece encoding and decoding with the place of every piece in the original text.

A text is first normalised: at each place the longest prefix that the compiled
character map knows is replaced, and every character that comes out remembers
the byte where what it came from begins. Pieces are merged from the normalised
characters and projected back to spans of original bytes.
"""

from __future__ import annotations

import heapq
import re
import struct
from itertools import accumulate
from operator import add

from pyspark.sql import DataFrame

from .common import AgingCache, per_process, sliced

SPACE = "▁"
_CACHE = 400_000
_SHORT = 96
_NEVER = float("inf")
_UNKNOWN, _CONTROL, _BYTE, _NORMAL = 2, 3, 6, 1  # kinds of piece in a model file


class CharacterMap:
    """Longest-prefix replacement by the compiled map of a model file; an empty map replaces nothing."""

    def __init__(self, compiled: bytes):
        self.units, self.texts = (), b""
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4)
            self.texts = compiled[4 + size:]

    def longest(self, text: bytes, start: int) -> tuple[str, int] | None:
        """What replaces the longest known prefix of `text[start:]`, and its length in bytes."""
        units = self.units
        if not units:
            return None
        found, at = None, self._below(units[0])
        for place in range(start, len(text)):
            at ^= text[place]
            unit = units[at]
            if unit & 0x800000FF != text[place]:
                break
            at ^= self._below(unit)
            if unit >> 8 & 1:
                found = units[at] & 0x7FFFFFFF, place + 1 - start
        if found is None:
            return None
        end = self.texts.index(b"\0", found[0])
        return self.texts[found[0]:end].decode(), found[1]

    @staticmethod
    def _below(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


class Normalizer:
    """The normal form of a text under a model's settings, aligned with its source."""

    def __init__(self, settings):
        self.map = CharacterMap(settings.precompiled_charsmap)
        self.prefix, self.squeeze = settings.add_dummy_prefix, settings.remove_extra_whitespaces
        self.space = SPACE if settings.escape_whitespaces else " "
        self.identity = not self.map.units and not self.squeeze and self.prefix and self.space == SPACE

    def _steps(self, text: str):
        """(replacement, byte where its source begins) from front to back."""
        if not self.map.units:
            starts = accumulate((len(c.encode()) for c in text), initial=0)
            yield from zip(text, starts)
            return
        raw, at = text.encode(), 0
        while at < len(raw):
            found = self.map.longest(raw, at)
            if found is None:
                width = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                found = raw[at:at + width].decode(), width
            yield found[0], at
            at += found[1]

    def __call__(self, text: str) -> tuple[str, list[int]]:
        """The normal form, and for each of its characters and its end the byte of the source."""
        letters: list[str] = []
        source: list[int] = []
        begun, blank = False, self.squeeze  # blanks are dropped at the beginning and after one another
        for replaced, start in self._steps(text):
            if not begun and not (self.squeeze and replaced == " "):
                begun = True
                if self.prefix:
                    letters.append(self.space)
                    source.append(start)
            if blank:
                replaced = replaced.lstrip(" ")
            if replaced:
                letters += replaced.replace(" ", self.space)
                source += [start] * len(replaced)
                blank = self.squeeze and replaced[-1] == " "
        end = len(text.encode())
        while self.squeeze and letters and letters[-1] == self.space:
            letters.pop()
            end = source.pop()
        return "".join(letters), [*source, end]


class PieceModel:
    """A merging model file: encodes texts to pieces and decodes ids.

    Models of other kinds, and pieces that users add, are refused.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as layout

        with open(path, "rb") as file:
            model = layout.ModelProto.FromString(file.read())
        kinds = {piece.type for piece in model.pieces}
        if model.trainer_spec.model_type != 2 or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only merging models without added pieces are supported")
        if model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that write blanks behind words are not supported")
        self.normalize = Normalizer(model.normalizer_spec)
        self.fallback, self.unknown_text = model.trainer_spec.byte_fallback, model.trainer_spec.unk_surface
        self.ids, self.costs, self.bytes = {}, {}, {}
        self.kinds, self.texts = [], []
        for number, piece in enumerate(model.pieces):
            self.kinds.append(piece.type)
            self.texts.append(piece.piece)
            if piece.type == _NORMAL:
                self.ids[piece.piece], self.costs[piece.piece] = number, -piece.score
            elif piece.type == _BYTE:
                self.bytes[int(piece.piece[1:-1], 16)] = number
            elif piece.type == _UNKNOWN:
                self.unknown = number
        self.glued = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}  # neighbours in some piece
        # Words can be merged one by one where no piece reaches over a blank or a line break.
        apart = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids)
        self.units = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*|[^{SPACE}\n]+" if apart else r"(?s:.+)").findall
        self.spaced = re.compile(" +[^ \n]*|\n[^ \n]*").findall
        self.whole = apart and self.fallback and self.normalize.identity and SPACE in self.ids
        self.names = {piece: str(i) for piece, i in self.ids.items()}
        self.pieces = AgingCache(self._pieces, _CACHE)
        self.known = AgingCache(self._part_digest, _CACHE)
        self.digested = AgingCache(self._digested, _CACHE)

    def _merge(self, unit: str) -> list[str]:
        """Characters joined by the best-scored pair first, the leftmost of equals."""
        parts, cost = list(unit), self.costs.get
        if len(parts) > _SHORT:
            return self._merge_long(parts)
        costs = [cost(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while costs and (least := min(costs)) != _NEVER:
            at = costs.index(least)
            parts[at] += parts.pop(at + 1)
            del costs[at]
            if at:
                costs[at - 1] = cost(parts[at - 1] + parts[at], _NEVER)
            if at < len(costs):
                costs[at] = cost(parts[at] + parts[at + 1], _NEVER)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap, in n log n."""
        costs, size = self.costs, len(parts)
        after, before = [*range(1, size + 1)], [*range(-1, size - 1)]
        waiting = [(costs[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in costs]
        heapq.heapify(waiting)
        while waiting:
            _, left, joined = heapq.heappop(waiting)
            right = after[left]
            if not parts[left] or right >= size or parts[left] + parts[right] != joined:
                continue
            parts[left], parts[right] = joined, ""
            behind = after[left] = after[right]
            if behind < size:
                before[behind] = left
                if (grown := joined + parts[behind]) in costs:
                    heapq.heappush(waiting, (costs[grown], left, grown))
            if before[left] >= 0 and (grown := parts[before[left]] + joined) in costs:
                heapq.heappush(waiting, (costs[grown], before[left], grown))
        return [p for p in parts if p]

    def _apart(self, unit: str) -> list[str]:
        """The unit cut between neighbours that no piece holds, so that each part is merged by itself."""
        glued = self.glued
        cuts = [i for i, pair in enumerate(map(add, unit, unit[1:]), 1) if pair not in glued]
        return [unit[i:j] for i, j in zip([0, *cuts], [*cuts, len(unit)])] if cuts else [unit]

    def _pieces(self, part: str) -> list[tuple[int, int]]:
        """(id, normalised characters) of every piece; of the bytes of an unknown one the last has the character."""
        found = []
        for joined in self._merge(part):
            if joined in self.ids:
                found.append((self.ids[joined], len(joined)))
            elif self.fallback:
                *first, last = [self.bytes[b] for b in joined.encode()]
                found += [(i, 0) for i in first] + [(last, len(joined))]
            else:
                found.append((self.unknown, len(joined)))
        return found

    def _part_digest(self, part: str) -> tuple[int, str, str, str]:
        """Like `_digested`, of a part of a word."""
        merged, spaced = self._merge(part), part.replace(SPACE, " ")
        names = [*map(self.names.get, merged)]
        if None not in names:
            if spaced.isascii():
                widths = map(len, merged)
            else:
                widths = [len(piece.replace(SPACE, " ").encode()) for piece in merged]
            return len(names), ",".join(names), ",".join(map(str, widths)), "".join(merged).replace(SPACE, " ")
        found, widths, at = self._pieces(part), [], 0
        for _, width in found:
            widths.append(len(spaced[at:at + width].encode()))
            at += width
        ids = [i for i, _ in found]
        return len(ids), ",".join(map(str, ids)), ",".join(map(str, widths)), self.decode(ids, inside=True)

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """(id, begin, end) of every piece: its place among the bytes of the original text."""
        normal, source = self.normalize(text)
        found, at = [], 0
        for unit in self.units(normal):
            for part in self._apart(unit):
                for number, width in self.pieces[part]:
                    begin, at = at, at + width
                    found.append((number, source[begin], source[at]))
        if not self.fallback:
            found = self._joined_unknown(found)
        return found

    def _joined_unknown(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Neighbouring unknown pieces are one."""
        kept: list[tuple[int, int, int]] = []
        for number, begin, end in found:
            if kept and number == kept[-1][0] == self.unknown:
                kept[-1] = (number, kept[-1][1], end)
            else:
                kept.append((number, begin, end))
        return kept

    def decode(self, ids: list[int], inside: bool = False) -> str:
        """The text of ids: blanks for their sign, runs of bytes read as UTF-8.

        The blank that was added in front is dropped, but not `inside` a text.
        """
        found: list[str] = []
        raw, adds = bytearray(), self.normalize.prefix or self.normalize.squeeze
        for number in [*ids, None]:
            kind = None if number is None else self.kinds[number]
            if kind == _BYTE:
                raw.append(int(self.texts[number][1:-1], 16))
                continue
            if raw:
                found.append(_utf8(bytes(raw)))
                raw.clear()
                inside = True
            if kind == _UNKNOWN:
                found.append(self.unknown_text)
                inside = True
            elif kind == _NORMAL:
                piece = self.texts[number]
                if not inside and adds and piece.startswith(SPACE):
                    piece, inside = piece[1:], not self.normalize.squeeze
                found.append(piece.replace(SPACE, " "))
                inside = inside or bool(piece)
        return "".join(found)

    def _digested(self, spaced: str) -> tuple[int, str, str, str]:
        """Of blanks and the word behind them: pieces, their ids, byte widths of their spans, decoded text."""
        parts = [self.known[part] for part in self._apart(spaced.replace(" ", SPACE))]
        if len(parts) == 1:
            return parts[0]
        counts, ids, widths, texts = zip(*parts)
        return sum(counts), ",".join(ids), ",".join(widths), "".join(texts)

    def digest(self, text: str) -> tuple[int, str, str, str]:
        """(pieces, ids, byte widths of their spans, decoded text) of a whole text.

        Spans lie end to end from the first byte, so their widths tell them.
        Where the normal form only adds and shows blanks, words are looked up.
        """
        if not text:
            return 0, "", "", ""
        if not self.whole or SPACE in text:
            found = self.encode(text)
            return (len(found), ",".join([str(i) for i, _, _ in found]),
                    ",".join([str(end - begin) for _, begin, end in found]), self.decode([i for i, _, _ in found]))
        found = [*map(self.digested.__getitem__, self.spaced(" " + text))]
        first, comma, others = ",".join([f[2] for f in found]).partition(",")
        return (sum([f[0] for f in found]), ",".join([f[1] for f in found]), f"{int(first) - 1}{comma}{others}",
                "".join([f[3] for f in found])[1:])


def _utf8(raw: bytes) -> str:
    """Bytes as text, one replacement sign for each byte that belongs to no character."""
    found, at = [], 0
    while at < len(raw):
        for width in (1, 2, 3, 4):
            try:
                found.append(raw[at:at + width].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            found.append("�")
            width = 1
        at += width
    return "".join(found)


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, widths_sha256): one row per row of `docs`, no shuffle.

    Ids and the byte widths of the spans of all pieces are digested as decimal
    numbers joined by commas. Null and empty texts have no pieces and the
    digest of the empty string. Repeated rows and null ids are encoded like
    any others, other columns are not read.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        def hexed(text: str) -> str:
            return hashlib.sha256(text.encode()).hexdigest()

        model = per_process(("pieces", path), lambda: PieceModel(path))
        for batch in sliced(batches):
            found = [model.digest(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.int64()),
                 *[pa.array([hexed(f[at]) for f in found], pa.string()) for at in (1, 3, 2)]],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "widths_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, widths_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, pieces array<struct<id, begin, end>>): ids with their places among the bytes of the text.

    Of the byte pieces of one character the last has its span, the others are
    empty spans before it. Null and empty texts have no pieces.
    """

    def run(batches):
        import pyarrow as pa

        names = ("id", "begin", "end")
        kind = pa.list_(pa.struct([("id", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())]))
        model = per_process(("pieces", path), lambda: PieceModel(path))
        for batch in sliced(batches):
            found = [[dict(zip(names, piece)) for piece in model.encode(text)] if text else []
                     for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "pieces"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, pieces array<struct<id:int,begin:long,end:long>>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, pieces). Null pieces give a null text; an unknown id is an error of its task."""

    def run(batches):
        import pyarrow as pa

        model = per_process(("pieces", path), lambda: PieceModel(path))
        for batch in sliced(batches):
            texts = [None if pieces is None else model.decode([p["id"] for p in pieces])
                     for pieces in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")
