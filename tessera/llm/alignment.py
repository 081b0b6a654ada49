"""Alignment of the tokens that two tokenizers make of the same text.

Both tokenise whole texts. Where tokens of both end and the next ones begin
with white space, the text is cut into windows of token ids. The alignment of a
window depends on its ids alone, so it is computed once and looked up after
that. Texts are lists of windows, and what is counted over the corpus is
counted over the windows of a chunk of texts at a time.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .bpe import WHITE, byte_alphabet, load_parts
from .common import per_process, sliced
from .token_counts import PRETOKEN

FREQUENT = 1 << 16  # what makes up more than one in so many of all occurrences is frequent
_WINDOWS = 350_000
_PLACES = 4_000_000
_ROWS = 128
_TEXTS = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "windows array<int>, times array<int>")
_WHITE = b" \n\t\r"
_BORDER = b"\xff" * 4  # between the packed ids of A and of B: larger than any id, whose highest byte is 0
_BLOCK = "▁"


class ByteTokens:
    """Byte-level BPE of a vocabulary file whose ids are its ranks; special strings are plain text."""

    def __init__(self, path: str):
        import tiktoken

        described, special = load_parts(path)
        values = {letter: byte for byte, letter in enumerate(byte_alphabet())}
        vocabulary = described["model"]["vocab"]
        ranks = {bytes([values[c] for c in t]): i for t, i in vocabulary.items() if t not in special}
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in described["model"]["merges"]]
        if merged != sorted(merged) or described["normalizer"] or len(ranks) != len(merged) + 256:
            raise ValueError("ids are not ranks of merges")
        self.encode = tiktoken.Encoding(
            "given", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token

    def of_units(self, units: list[str]) -> list[list[int]]:
        """Tokens of white space and what follows up to the next, which no pre-token crosses."""
        return [*map(self.encode, units)]


class PieceTokens:
    """Pieces of a model file that adds a blank in front."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.encode, self.blank = model.encode, model.piece_to_id(_BLOCK)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace(_BLOCK, " ").encode()
                      for i, piece in enumerate(pieces)]
        if any(_BLOCK in p.lstrip(_BLOCK) or "\n" in p for p in pieces):
            raise ValueError("pieces that reach over blanks or line breaks are not supported")

    def of_units(self, units: list[str]) -> list[list[int]]:
        """Tokens of white space and what follows; the blank that the model adds is the unit's own or taken off."""
        found = self.encode([u.removeprefix(" ") for u in units], num_threads=1)
        return [(ids or [self.blank]) if u[0] == " " else ids[1:] for u, ids in zip(units, found)]


class WindowMemo:
    """Units of text -> their windows' numbers; alignments are kept by number.

    It holds the windows of one chunk of texts: each chunk begins with an empty one, and a task ends with one.

    Whole texts are tokenised by way of their units, which begin where a blank
    or a line break follows something else. No token of either side crosses
    the border of a unit, and both begin anew there with white space, so that it is an
    anchor: the windows of a text are those of its units, and a unit is cut once.
    Most units are one window and stand for its number. Units of several windows stand for a negative
    one, -1 less a place in `several`; their windows are told apart by the ids of A, a border, and those of B.
    """

    def __init__(self, a_path: str, b_path: str):
        import numpy as np

        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.pair = _pair_type(len(self.a.bytes), len(self.b.bytes))
        self.widths = [np.array([len(t) for t in side.bytes], np.int64) for side in (self.a, self.b)]
        self.digits = [_digits(len(side.bytes)) for side in (self.a, self.b)]
        self.white = np.array([t[:1] in _WHITE and t != b"" for t in self.a.bytes])
        others = WHITE.replace("\n", "").replace(" ", "")
        self.units = re.compile(f"[ \n][{WHITE}]*[^{WHITE}]*(?:[{others}][{WHITE}]*[^{WHITE}]*)*").findall
        self.forget()

    def forget(self) -> None:
        from array import array

        self.of_unit: dict[str, int] = {}
        self.of_ids: dict[bytes, int] = {}
        self.several: list[list[int]] = []
        self.texts, self.links = [], array("i" if self.pair == "int" else "q")  # of all windows, end to end
        self.groups, self.sizes, self.n_a, self.n_b = (array("i") for _ in range(4))

    def __len__(self) -> int:
        return len(self.texts)

    def windows(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of the windows of each text.

        B writes its sign for a blank as one, so that it gives back any text
        without that sign; texts with it, and empty ones, have no windows.
        """
        units = [self.units(" " + text) if text and _BLOCK not in text else [] for text in texts]
        self.cut([u for u in dict.fromkeys(chain.from_iterable(units)) if u not in self.of_unit])
        found = [[*map(self.of_unit.__getitem__, own)] for own in units]
        if not self.several:
            return found
        return [[*chain.from_iterable([n] if n >= 0 else self.several[-1 - n] for n in own)] for own in found]

    def cut(self, units: list[str]) -> None:
        """Tokenises new units, which stand end to end, and cuts them where both sides begin with white space.

        That both give back the bytes of each unit is verified.
        """
        import numpy as np

        if not units:
            return
        encoded = [u.encode() for u in units]
        unit_ends, raw, sides = np.cumsum([*map(len, encoded)]), b"".join(encoded), []
        for side, widths in zip((self.a, self.b), self.widths):
            listed = side.of_units(units)
            sizes = [*map(len, listed)]
            ids = np.fromiter(chain.from_iterable(listed), np.uint32, sum(sizes))
            ends, last = np.cumsum(widths[ids]), np.cumsum(sizes) - 1
            if b"".join(map(side.bytes.__getitem__, ids.tolist())) != raw or (ends[last] != unit_ends).any():
                raise ValueError(f"tokens do not give back their text, of {raw[:80]!r} and what follows")
            sides.append((ids, ends))
        (a, a_ends), (b, b_ends) = sides
        shared = np.zeros(len(raw) + 1, bool)
        shared[b_ends] = True
        anchored = np.flatnonzero(self.white[a[1:]] & shared[a_ends[:-1]])  # the tokens of A before them
        ends = np.append(a_ends[anchored], len(raw))
        a_lasts, b_lasts = (np.searchsorted(e, ends) + 1 for e in (a_ends, b_ends))
        unit_lasts = np.searchsorted(ends, unit_ends) + 1  # the windows up to the end of each unit
        if len(ends) == len(units):
            numbers = self.learn(a, b, a_lasts, b_lasts)
        else:
            numbers = self.several_of(a, b, a_lasts, b_lasts, unit_lasts)
        self.of_unit.update(zip(units, numbers))

    def several_of(self, a, b, a_lasts, b_lasts, unit_lasts) -> list[int]:
        """What the units stand for, where some have several windows; of those, only the ones not yet met are aligned."""
        import numpy as np

        counts = np.diff(unit_lasts, prepend=0)
        alone = np.repeat(counts == 1, counts)
        a_cuts, b_cuts = (np.concatenate([[0], 4 * lasts]) for lasts in (a_lasts, b_lasts))
        a_raw, b_raw = a.tobytes(), b.tobytes()
        inner = np.flatnonzero(~alone)
        keys = [a_raw[i:j] + _BORDER + b_raw[k:m] for i, j, k, m in zip(
            a_cuts[inner].tolist(), a_cuts[inner + 1].tolist(), b_cuts[inner].tolist(), b_cuts[inner + 1].tolist())]
        first = {}
        for at, key in zip(inner.tolist(), keys):
            if key not in self.of_ids:
                first.setdefault(key, at)
        new = alone.copy()
        new[[*first.values()]] = True
        a_sizes, b_sizes = np.diff(a_lasts, prepend=0), np.diff(b_lasts, prepend=0)
        learnt = np.zeros(len(new), np.int64)
        learnt[new] = self.learn(a[np.repeat(new, a_sizes)], b[np.repeat(new, b_sizes)],
                                 np.cumsum(a_sizes[new]), np.cumsum(b_sizes[new]))
        self.of_ids.update((key, int(learnt[at])) for key, at in first.items())
        learnt[inner] = [*map(self.of_ids.__getitem__, keys)]
        numbers, listed = learnt[unit_lasts - 1], learnt.tolist()
        for unit in np.flatnonzero(counts > 1).tolist():
            last = int(unit_lasts[unit])
            self.several.append(listed[last - int(counts[unit]):last])
            numbers[unit] = -len(self.several)
        return numbers.tolist()

    def learn(self, a, b, a_lasts, b_lasts) -> range:
        """Align new windows, all in one go, and number them: their ids, and bytes, stand end to end on both sides.

        Where a token of A or of B ends, the two tokens over the byte before are
        linked; where both end, a group ends. A pair is written as
        (A id) * (size of B's vocabulary) + (B id). Windows are given by how many ids there are up to their ends.
        """
        import numpy as np

        first = len(self.texts)
        if not len(a_lasts):
            return range(first, first)
        a_ends, b_ends = (np.cumsum(widths[ids]) for widths, ids in zip(self.widths, (a, b)))
        ends = np.union1d(a_ends, b_ends)
        a_at, b_at = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        links = a[a_at].astype(np.int64) * len(self.b.bytes) + b[b_at]
        closes = (a_ends[a_at] == ends) & (b_ends[b_at] == ends)
        last_link = np.searchsorted(ends, a_ends[a_lasts - 1]) + 1
        last_group = np.cumsum(closes)[last_link - 1]
        text, b_to = self.written(a, b, a_at[closes] + 1, b_at[closes] + 1)
        to = b_to[b_lasts - 1].tolist()
        self.texts += [text[i:j - 1] for i, j in zip([0, *to], to)]
        for kept, values in ((self.links, links), (self.groups, np.diff(last_group, prepend=0)),
                             (self.sizes, np.diff(last_link, prepend=0)),
                             (self.n_a, np.diff(a_lasts, prepend=0)), (self.n_b, np.diff(b_lasts, prepend=0))):
            kept.frombytes(values.astype(kept.typecode).tobytes())
        return range(first, len(self.texts))

    def written(self, a, b, a_lasts, b_lasts):
        """All groups as `a1,a2|b1;` end to end, and where the text of each token of B ends in it.

        Groups are given by how many tokens of A and of B there are up to their ends.
        """
        import numpy as np

        group = np.arange(len(a_lasts))
        a_group, b_group = (np.repeat(group, np.diff(lasts, prepend=0)) for lasts in (a_lasts, b_lasts))
        a_place = np.arange(len(a)) + np.concatenate([[0], b_lasts])[a_group]
        b_place = np.arange(len(b)) + a_lasts[b_group]
        width = max(d.shape[1] for d in self.digits)
        cells = np.zeros((len(a) + len(b), width + 1), np.uint8)
        for place, ids, digits, lasts, sign in ((a_place, a, self.digits[0], a_lasts, "|"), (b_place, b, self.digits[1], b_lasts, ";")):
            signs = np.full(len(ids), ord(","), np.uint8)
            signs[lasts - 1] = ord(sign)
            cells[place, width - digits.shape[1]:width] = digits[ids]
            cells[place, width] = signs
        used = cells != 0
        to = np.cumsum(used.sum(axis=1))
        return cells[used].tobytes().decode("ascii"), to[b_place]


def _digits(size: int):
    """The decimal numbers below `size` as rows of characters, with zero bytes in front."""
    import numpy as np

    width = len(str(size - 1))
    return np.array([str(i).rjust(width, "\0").encode() for i in range(size)], f"S{width}").view(np.uint8).reshape(size, width)


def _align_function(a_path: str, b_path: str):
    """Arrow batches of (row, doc_id, text) to a row for each text, and one for each window met in a chunk of texts.

    A chunk goes by the row of its first text. It ends with the task, or when it
    has met `_WINDOWS` different windows or `_PLACES` of them in its texts.
    """

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        def listed(values, sizes, kind):
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))

        memo = per_process(("align", a_path, b_path), lambda: WindowMemo(a_path, b_path))
        pair = pa.int32() if memo.pair == "int" else pa.int64()
        names = [field.split()[0] for field in _TEXTS.split(", ")] + ["chunk", "window", "links", "n"]
        kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int32(),
                                    pa.list_(pair), pa.int64()]

        def table(chunk, **columns):
            size = len(next(iter(columns.values())))
            columns["chunk"] = pa.array(np.full(size, chunk), pa.int64())
            return pa.RecordBatch.from_arrays(
                [columns[n] if n in columns else pa.nulls(size, k) for n, k in zip(names, kinds)], names)

        def described():
            ends = np.cumsum(np.array(memo.sizes, np.int64))
            for start in range(0, len(met), 10_000):
                part = np.arange(start, min(start + 10_000, len(met)))
                sizes = np.diff(ends[part], prepend=ends[start - 1] if start else 0)
                links = np.array(memo.links[ends[part[0]] - sizes[0]:ends[part[-1]]])
                yield table(chunk, window=pa.array(part, pa.int32()), links=listed(links, sizes, pair), n=pa.array(met[part]))

        chunk, places, met = None, 0, np.zeros(0, np.int64)  # how often each window was met in this chunk
        for batch in sliced(batches, _ROWS):
            if len(memo) > _WINDOWS or places > _PLACES:
                yield from described()
                chunk, places, met = None, 0, np.zeros(0, np.int64)
            if chunk is None:
                chunk = batch.column("row")[0].as_py()
                memo.forget()
            found = memo.windows(batch.column("text").to_pylist())
            measures = [np.array(x) for x in (memo.n_a, memo.n_b, memo.groups, memo.sizes)]
            met = np.concatenate([met, np.zeros(len(memo) - len(met), np.int64)])
            counts, digests, windows, times = [], [], [], []
            for numbers in found:
                own, often = np.unique(np.array(numbers, np.int32), return_counts=True)
                met[own] += often
                counts.append([int(measure[own] @ often) for measure in measures])
                digests.append(hashlib.sha256(
                    ";".join([*map(memo.texts.__getitem__, numbers)]).encode()).hexdigest() if numbers else "")
                windows.append(own)
                times.append(often)
            sizes = [len(w) for w in windows]
            places += sum(sizes)
            yield table(
                chunk, row=batch.column("row"), doc_id=batch.column("doc_id"),
                **{name: pa.array([c[at] for c in counts], pa.int64())
                   for at, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                groups_sha256=pa.array(digests, pa.string()),
                windows=listed(np.concatenate([np.zeros(0, np.int32), *windows]), sizes, pa.int32()),
                times=listed(np.concatenate([np.zeros(0, np.int32), *times]).astype(np.int32), sizes, pa.int32()))
        yield from described()
        memo.forget()  # the worker lives on beside the next stages

    return run


def _pair_type(a_size: int, b_size: int) -> str:
    return "int" if a_size * b_size < 1 << 31 else "long"


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame, int]:
    """Texts as windows (chunk, row, doc_id, n_a, …, windows, times), windows (chunk, window, links, n), size of B's vocabulary.

    Both are written out. A window's number holds within a chunk of texts; `n` counts its occurrences there.
    """
    sizes = len(ByteTokens(a_path).bytes), len(PieceTokens(b_path).bytes)
    numbered = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    aligned = stage(numbered.select("row", "doc_id", "text").mapInArrow(
        _align_function(a_path, b_path),
        f"{_TEXTS}, chunk long, window int, links array<{_pair_type(*sizes)}>, n long"), "aligned")
    return (aligned.where("window is null").drop("window", "links", "n"),
            aligned.where("window is not null").select("chunk", "window", "links", "n"), sizes[1])


def link_counts(windows: DataFrame, b_size: int) -> DataFrame:
    """(item, n, best, total): a pair, how many windows hold it, whether no pair of its B id has more links, how many it has.

    The highest counts are broadcast: one row for each id of B's vocabulary.
    """
    pairs = stage(windows.select(F.explode("links").alias("item"), "n").groupBy("item").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("n")), "link-counts")
    b_id = F.col("item") % F.lit(b_size)
    most = pairs.groupBy(b_id.alias("_b")).agg(F.max("total").alias("_most"))
    return pairs.join(F.broadcast(most), b_id == F.col("_b")).select(
        F.col("item").cast("long").alias("item"), "n", (F.col("total") == F.col("_most")).cast("long").alias("best"), "total")


def window_values(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(chunk, window, best, total): for each window the sums of `best` and `total` over its links.

    Frequent pairs, of which there are fewer than `FREQUENT` whatever the
    data, are looked up where the window stands. The others, none of which
    is frequent, meet their values in a join.
    """
    import numpy as np

    every = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") * FREQUENT > every).select("item", "best", "total").toArrow()
    items, best, totals = (rows.column(name).to_numpy().astype(np.int64) for name in ("item", "best", "total"))
    order = np.argsort(items)
    shipped = windows.sparkSession.sparkContext.broadcast((items[order], best[order], totals[order]))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known_items, *known_values = shipped.value
        for batch in batches:
            column = batch.column("links")
            offsets = column.offsets.to_numpy()
            asked = column.values.to_numpy()[offsets[0]:offsets[-1]].astype(np.int64)
            offsets = offsets - offsets[0]
            place = np.searchsorted(known_items, asked)
            known = np.zeros(len(asked), bool)
            within = place < len(known_items)
            known[within] = known_items[place[within]] == asked[within]
            sums = []
            for values in known_values:
                one = np.zeros(len(asked), np.int64)
                one[known] = values[place[known]]
                ends = np.concatenate([[0], np.cumsum(one)])
                sums.append(pa.array(ends[offsets[1:]] - ends[offsets[:-1]], pa.int64()))
            left = pa.array(np.concatenate([[0], np.cumsum(~known)])[offsets].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk"), batch.column("window"), *sums,
                 pa.ListArray.from_arrays(left, pa.array(asked[~known]))], ["chunk", "window", "best", "total", "items"])

    looked_up = stage(windows.select("chunk", "window", "links").mapInArrow(
        run, "chunk long, window int, best long, total long, items array<long>"), "window-sums")
    rest = looked_up.where(F.size("items") > 0).select("chunk", "window", F.explode("items").alias("item"))
    others = rest.join(counts.drop("n"), "item").select("chunk", "window", "best", "total")
    return looked_up.select("chunk", "window", "best", "total").unionByName(others)


def _text_sums(texts, values):
    """Arrow tables of one chunk: a text's sums over its windows, by number."""
    import numpy as np
    import pyarrow as pa

    numbers = values.column("window").to_numpy()
    column = texts.column("windows").combine_chunks()
    offsets = column.offsets.to_numpy()
    asked = column.values.to_numpy()[offsets[0]:offsets[-1]]
    often = texts.column("times").combine_chunks()
    often = often.values.to_numpy()[often.offsets.to_numpy()[0]:].astype(np.int64)[:len(asked)]
    offsets = offsets - offsets[0]
    sums = []
    for name in ("best", "total"):
        by_number = np.zeros(int(numbers.max(initial=-1)) + 1, np.int64)
        np.add.at(by_number, numbers, values.column(name).to_numpy())
        ends = np.concatenate([[0], np.cumsum(by_number[asked] * often)])
        sums.append(pa.array(ends[offsets[1:]] - ends[offsets[:-1]], pa.int64()))
    kept = [texts.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*kept, *sums, texts.column("groups_sha256")], names=[
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def aligned_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per row of `docs`.

    A tokenises the text behind a blank, B the text itself. A text that is
    null, empty, or that either does not give back byte by byte (B writes
    U+2581 as a blank) has no tokens: all zeros and an empty digest.
    Repeated rows and null ids are texts like any others; other columns are
    not read. No text is shuffled; texts, as lists of numbers, meet the values
    of their windows chunk by chunk, and chunks are bounded.
    """
    texts, windows, b_size = align_documents(docs, a_path, b_path)
    values = window_values(windows, stage(link_counts(windows, b_size), "best-links"))
    return texts.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(
        _text_sums, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string")
