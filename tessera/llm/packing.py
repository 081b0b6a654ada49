"""Packing documents into sequences of a fixed size: a grouping genetic algorithm.

The genes are whole bins. A child takes the best-filled bins of one parent,
loses the bins of the other that hold documents twice, and puts the
documents without a bin back by best fit, after they have replaced smaller ones where
they fill a bin better. Pieces are dealt into shares of bounded size. A share that best
fit packs into as few bins as its sum allows is done; the others are
evolved on several islands, from founders that differ, and their elites
migrate between epochs. What remains of a share in badly filled bins is
dealt out anew with the remains of others.
"""

from __future__ import annotations

import bisect
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import stage
from .bpe import WordSplitter, byte_alphabet, load_parts
from .common import AgingCache, per_process, release, sliced

CAPACITY = 2048
SHARE = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 40
POPULATION = 8
ROUNDS = 3
_BIN_BITS = 24
_CACHE = 600_000
_END = b"\n"  # stands for the end of a word, in which no line break occurs


def word_merger(path: str):
    """A function from a pre-token to its ids under a vocabulary file with word ends.

    Neighbours are merged by the rank of what they make, not by the rank of the
    pair. Both are the same: when the two make a token of some rank, all merges of
    lower rank are done, and within the token's bounds they were done as if it
    stood alone, where what is left are the two parts that its own merge joins.
    """
    import tiktoken

    described, special = load_parts(path)
    values = {letter: byte for byte, letter in enumerate(byte_alphabet())}
    suffix = described["model"]["end_of_word_suffix"] or ""

    def raw(token: str) -> bytes:
        ends = bool(suffix) and token.endswith(suffix)
        return bytes([values[c] for c in (token[:-len(suffix)] if ends else token)]) + (_END if ends else b"")

    vocabulary = {t: i for t, i in described["model"]["vocab"].items() if t not in special}
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in described["model"]["merges"]]
    ranks = {raw(t): i for t, i in vocabulary.items()}
    if merged != sorted(merged) or len(ranks) != len(vocabulary):
        raise ValueError("ids are not ranks of merges")
    encode = tiktoken.Encoding("words", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    end = _END.decode() if suffix else ""
    return lambda pretoken: encode(pretoken + end)


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of each document, without a shuffle.

    A document's ids, and `end_id` after them, are cut into pieces of
    `capacity` if they are more. Null and empty texts are the end id alone.
    """

    def run(batches):
        import struct
        import zlib

        import pyarrow as pa

        def build():
            bpe, merge = WordSplitter(*load_parts(path)), word_merger(path)

            def compute(word):
                """A word's packed ids; its pre-tokens, where it is not one itself, are looked up."""
                if isinstance(word, int):
                    return struct.pack("<I", word)
                if not word.isalpha():
                    parts = bpe.pretokens(word)
                    if len(parts) != 1:
                        return b"".join([cache[part] for part in parts])
                ids = merge(word)
                return struct.pack(f"<{len(ids)}I", *ids)

            cache = AgingCache(compute, _CACHE)
            return bpe, cache

        bpe, cache = per_process(("packed", path), build)
        end, step = struct.pack("<I", end_id), 4 * capacity
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = b"".join(map(cache.__getitem__, bpe.split(text))) + end if text else end
                for piece, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """One individual: bins, each a list of item numbers, with their fill."""

    def __init__(self, bins: list[list[int]], fills: list[int], capacity: int):
        self.bins, self.fills, self.capacity = bins, fills, capacity

    def fitness(self) -> tuple[int, int]:
        """Fewer bins first, then fuller ones: the sum of squared fills, negated."""
        return len(self.bins), -sum(f * f for f in self.fills)


def best_fit(items: Sequence[int], sizes: Sequence[int], packing: Packing) -> Packing:
    """Puts `items`, the largest first, where the least room stays free."""
    capacity = packing.capacity
    free = sorted((capacity - fill, at) for at, fill in enumerate(packing.fills) if fill < capacity)
    for item in sorted(items, key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        place = bisect.bisect_left(free, (size, -1))
        if place < len(free):
            room, at = free.pop(place)
            packing.bins[at].append(item)
            packing.fills[at] += size
        else:
            room, at = capacity, len(packing.bins)
            packing.bins.append([item])
            packing.fills.append(size)
        if room > size:
            bisect.insort(free, (room - size, at))
    return packing


def replace(items: Sequence[int], sizes: Sequence[int], packing: Packing) -> list[int]:
    """Puts each item in the place of a smaller one whose bin it fills better; returns those without a place.

    The larger items come first. What an item drives out is smaller, so that the rest fits more easily.
    """
    loose = sorted(items, key=lambda i: sizes[i])
    free = sorted(((packing.capacity - fill, at) for at, fill in enumerate(packing.fills) if fill < packing.capacity),
                  key=lambda x: x[0])
    for room, at in free[:200]:
        for place, own in enumerate(packing.bins[at]):
            # The largest loose item that is larger than this one and still fits.
            found = bisect.bisect_right(loose, sizes[own] + room, key=lambda i: sizes[i]) - 1
            if found >= 0 and sizes[loose[found]] > sizes[own]:
                item = loose.pop(found)
                packing.bins[at][place] = item
                packing.fills[at] += sizes[item] - sizes[own]
                bisect.insort(loose, own, key=lambda i: sizes[i])
                break
    return loose


def fill_bins(sizes: Sequence[int], capacity: int, draw: random.Random) -> Packing:
    """A founder that fills one bin after another: a large item, and the two others that leave least room.

    Which of the largest comes next is drawn, so that founders differ.
    """
    at_size: dict[int, list[int]] = {}
    for item, size in enumerate(sizes):
        at_size.setdefault(size, []).append(item)
    known = sorted(at_size)
    bins, fills = [], []

    def take(size: int) -> int:
        items = at_size[size]
        if len(items) == 1:
            known.remove(size)
        return items.pop()

    while known:
        first = known[max(0, len(known) - 1 - int(draw.expovariate(1)))]
        own, room = [take(first)], capacity - first
        while room and known and known[0] <= room:
            top = bisect.bisect_right(known, room) - 1
            best = (room - known[top], (known[top],))
            for at in range(top, max(-1, top - 200), -1):
                if not best[0]:
                    break
                size = known[at]
                other = bisect.bisect_right(known, room - size) - 1
                if other >= 0 and (known[other] != size or len(at_size[size]) > 1):
                    best = min(best, (room - size - known[other], (size, known[other])))
            for size in best[1]:
                own.append(take(size))
                room -= size
        bins.append(own)
        fills.append(capacity - room)
    return Packing(bins, fills, capacity)


def shuffled_fit(sizes: Sequence[int], capacity: int, draw: random.Random) -> Packing:
    """A founder by best fit of the items in about their order of size."""
    blurred = [max(1, int(size * draw.uniform(0.8, 1.25))) for size in sizes]
    packing = Packing([], [], capacity)
    for item in sorted(range(len(sizes)), key=lambda i: -blurred[i]):
        if packing.fills and packing.fills[-1] + sizes[item] <= capacity:
            packing.bins[-1].append(item)
            packing.fills[-1] += sizes[item]
        else:
            packing.bins.append([item])
            packing.fills.append(sizes[item])
    order = sorted(range(len(packing.bins)), key=lambda b: -packing.fills[b])
    kept = order[:len(order) // 2]
    loose = [i for b in order[len(kept):] for i in packing.bins[b]]
    return best_fit(loose, sizes, Packing([packing.bins[b] for b in kept], [packing.fills[b] for b in kept], capacity))


def crossover(giver: Packing, taker: Packing, sizes: Sequence[int], draw: random.Random) -> Packing:
    """Injects the well-filled bins of `giver` into `taker`."""
    order = sorted(range(len(giver.bins)), key=lambda b: (-giver.fills[b], draw.random()))
    chosen = order[: max(1, int(len(order) * draw.uniform(0.3, 0.8)))]
    injected = {item for b in chosen for item in giver.bins[b]}
    bins, fills, displaced = [], [], []
    for items, fill in zip(taker.bins, taker.fills):
        if injected.isdisjoint(items):
            bins.append(list(items))
            fills.append(fill)
        else:
            displaced.extend(i for i in items if i not in injected)
    bins += [list(giver.bins[b]) for b in chosen]
    fills += [giver.fills[b] for b in chosen]
    child = Packing(bins, fills, taker.capacity)
    return best_fit(replace(displaced, sizes, child), sizes, child)


def mutate(packing: Packing, sizes: Sequence[int], draw: random.Random) -> Packing:
    """Empties the worst-filled bins and some others, and places their items anew."""
    worst = sorted(range(len(packing.bins)), key=lambda b: packing.fills[b])
    gone = set(worst[:2]) | {draw.randrange(len(packing.bins)) for _ in range(1 + len(worst) // 20)}
    loose = [i for b in gone for i in packing.bins[b]]
    draw.shuffle(loose)
    keep = [b for b in range(len(packing.bins)) if b not in gone]
    child = Packing([list(packing.bins[b]) for b in keep], [packing.fills[b] for b in keep], packing.capacity)
    return best_fit(replace(loose, sizes, child), sizes, child)


def least_bins(sizes: Sequence[int], capacity: int) -> int:
    return -(-sum(sizes) // capacity)


def evolve(sizes: Sequence[int], capacity: int, seed: int, founders: Sequence[Packing] = (),
           generations: int = GENERATIONS, population: int = POPULATION) -> Packing:
    """The best packing that this island finds; the founders' best is never lost, and it is no worse than best fit.

    Founders besides those given are best fit, bins filled one by one, and
    blurred orders. A child stays when it is better than the worst. Stops as soon as no
    packing can have fewer bins.
    """
    draw, least = random.Random(seed), least_bins(sizes, capacity)
    people = list(founders) or [best_fit(range(len(sizes)), sizes, Packing([], [], capacity))]
    best = min(people, key=Packing.fitness)
    while len(people) < population and len(best.bins) > least:
        people.append(shuffled_fit(sizes, capacity, draw) if len(people) % 3 == 2 else fill_bins(sizes, capacity, draw))
        best = min(people, key=Packing.fitness)
    for _ in range(generations):
        if len(best.bins) <= least:
            break
        giver, taker = draw.sample(people, 2)
        children = [mutate(crossover(giver, taker, sizes, draw), sizes, draw), crossover(taker, giver, sizes, draw)]
        people = sorted([*people, *children], key=Packing.fitness)[:population]
        best = people[0]
    return best


def _island_function(capacity: int, seed: int, epoch: int, generations: int):
    """Evolves the rows of one (share, island), going on from migrated elites.

    `bins` names an item's bin in each elite that has arrived, none at first.
    """

    def run(key, frame):
        import pandas as pd

        release()  # the words of the step before are not needed beside pandas
        frame = frame.sort_values(["item"], kind="stable").reset_index(drop=True)
        sizes = frame["length"].tolist()
        founders = []
        arrived = frame["bins"].tolist()
        for elite in range(len(arrived[0]) if arrived and arrived[0] is not None else 0):
            bins: dict[int, list[int]] = {}
            for item, names in enumerate(arrived):
                bins.setdefault(int(names[elite]), []).append(item)
            founders.append(Packing(list(bins.values()), [sum(sizes[i] for i in b) for b in bins.values()], capacity))
        share, island = int(key[0]), int(key[1])
        if epoch < 0:
            found = best_fit(range(len(sizes)), sizes, Packing([], [], capacity))
        else:
            found = evolve(sizes, capacity, hash((seed, epoch, share, island)), founders, generations)
        bin_of, fill_of = [0] * len(sizes), [0] * len(sizes)
        for number, (items, fill) in enumerate(zip(found.bins, found.fills)):
            for item in items:
                bin_of[item], fill_of[item] = number, fill
        return pd.DataFrame({
            "item": frame["item"], "length": frame["length"], "share": share, "island": island,
            "bin": bin_of, "fill": fill_of, "n_bins": len(found.bins),
            "open": len(found.bins) > least_bins(sizes, capacity), "squares": sum(f * f for f in found.fills)})

    return run


_EVOLVED = ("item long, length long, share long, island int, bin long, fill long, n_bins long, open boolean, "
            "squares long")


def _evolved(shares: DataFrame, capacity: int, seed: int, islands: int, epochs: int, generations: int) -> DataFrame:
    """The best packing of each share: (item, length, share, bin, fill)."""
    columns = ("item", "length", "share", "bin", "fill")
    fitted = stage(shares.withColumns({"island": F.lit(0), "bins": F.lit(None).cast("array<long>")}).groupBy(
        "share", "island").applyInPandas(_island_function(capacity, seed, -1, generations), _EVOLVED), "best-fit")
    settled = fitted.where(~F.col("open")).select(*columns)
    unsettled = fitted.where("open")
    if not unsettled.limit(1).collect():
        return settled
    people = unsettled.select(
        "item", "length", "share", F.array("bin").alias("bins"),
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    for epoch in range(epochs):
        evolved = stage(
            people.groupBy("share", "island").applyInPandas(
                _island_function(capacity, seed, epoch, generations), _EVOLVED), "islands")
        if epoch + 1 < epochs:
            # The elite of every island of a share reaches all its islands; each goes on with its own first.
            people = (
                evolved.groupBy("item", "length", "share")
                .agg(F.sort_array(F.collect_list(F.struct("island", "bin"))).alias("elites"))
                .withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
                .withColumn("bins", F.transform("elites", lambda e: e["bin"])).drop("elites"))
    winners = evolved.groupBy("share").agg(
        F.min(F.struct("n_bins", -F.col("squares"), "island")).alias("best")).select(
        "share", F.col("best.island").alias("island"))
    return settled.unionByName(evolved.join(winners, ["share", "island"]).select(*columns))


def pack(pieces: DataFrame, capacity: int = CAPACITY, share: int = SHARE, islands: int = ISLANDS,
         epochs: int = EPOCHS, generations: int = GENERATIONS, rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """`pieces` with sequence_id and offset; lengths from 1 to `capacity`.

    Every piece has one place and places have no gaps. Full pieces are
    sequences of their own. The others are dealt by hash into shares of about
    `share` pieces, so that neither a hot source nor equal lengths meet in
    one task. After each round the bins that are not nearly full are opened,
    and their pieces dealt out with those of other shares into fewer shares;
    after the last, all bins stand. Equal rows are separate pieces. Only
    (item, length) moves, with the piece itself joined back once.
    """
    numbered = stage(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    open_items = numbered.where(F.col("length") < capacity).select("item", "length")
    placed = numbered.where(F.col("length") >= capacity).select(
        "item", (F.col("item") * 2).alias("sequence_id"))
    waiting = open_items.count()
    for number in range(rounds):
        if not waiting:
            break
        shares = max(1, -(-waiting // share))
        dealt = open_items.select(
            "item", "length", F.pmod(F.xxhash64("item", F.lit(seed + number)), F.lit(shares)).alias("share"))
        evolved = stage(_evolved(dealt, capacity, seed + number, islands, epochs, generations), "evolved")
        last = number + 1 == rounds or shares == 1
        stands = F.lit(True) if last else F.col("fill") >= F.lit(capacity - capacity // 256)
        place = F.shiftleft(F.col("share") * rounds + number, _BIN_BITS) + F.col("bin")
        placed = placed.unionByName(evolved.where(stands).select("item", (place * 2 + 1).alias("sequence_id")))
        if last:
            break
        open_items = evolved.where(~stands).select("item", "length")
        waiting = open_items.count()
    sequence = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return (
        numbered.join(placed, "item")
        .withColumn("offset", F.coalesce(F.sum("length").over(sequence), F.lit(0)).cast("long"))
        .drop("item"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """All documents in as few sequences of `capacity` tokens as the islands find.

    Null and empty texts are one token; repeated rows are packed each; an
    empty table gives no rows.
    """
    return pack(tokenized_pieces(docs, path, capacity), capacity, **options).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
