"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch is a table of cells, each with the number, the sum of keys and the
sum of check values of the digests that fall into it. Subtracting the cells
of two versions leaves the digests that differ; peeling takes them out one
by one. If the table is too small for that, a larger one is made of both.

The sketch of a text is large enough to give back all its own digests. It
folds to half its size as often as it can be halved, so that two of any
size subtract. Two fingerprints alone thus tell how alike their texts are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import partitions, sliced

BASE_CELLS = 12
GROWTH = 4
PASSAGE = 5
_ATTEMPTS = 10
_CHUNK_CELLS = 400_000
_CELL = [("n", "<i4"), ("keys", "<u8"), ("checks", "<u8")]


def paragraph_digests(text: str, passage: int = PASSAGE):
    """One 64-bit digest for each paragraph: a line, or each `passage` words of a longer one.

    Equal paragraphs of a text are told apart by how many came before, so
    that the digests are distinct.
    """
    import numpy as np
    import xxhash

    digest, found = xxhash.xxh3_64_intdigest, []
    for line in text.split("\n"):
        words = line.split()
        found += [digest(" ".join(words[i : i + passage])) for i in range(0, len(words), passage)]
    keys = np.array(found, np.uint64)
    if len(set(found)) < len(found):
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.searchsorted(ordered, ordered)
        times = np.empty(len(keys), np.uint64)
        times[order] = (np.arange(len(keys)) - first).astype(np.uint64)
        keys = keys ^ _mixed(times * np.uint64(0xD6E8FEB86659FD93)) * (times > 0)
    return keys


def _mixed(values):
    """A well-spread function of 64-bit numbers."""
    import numpy as np

    values = values ^ values >> np.uint64(33)
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ values >> np.uint64(33)
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ values >> np.uint64(33)


def _places(keys, cells: int):
    """The three cells of each key, one in each third of the table.

    A third has a power of two of cells, and the place in a smaller one follows from that in a larger.
    """
    import numpy as np

    third = cells // 3
    return [(_mixed(keys + np.uint64(k)) & np.uint64(third - 1)).astype(np.int64) + k * third for k in range(3)]


def _check(keys):
    import numpy as np

    return _mixed(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)


def _add(table, owners, keys, signs, cells: int):
    """Adds keys, with their signs, to the tables of their owners."""
    import numpy as np

    counts, sums, checks = table
    signed = signs.astype(np.int64).view(np.uint64)
    values, marks = keys * signed, _check(keys) * signed
    for place in _places(keys, cells):
        at = owners * cells + place
        np.add.at(counts, at, signs)
        np.add.at(sums, at, values)
        np.add.at(checks, at, marks)


def _empty(tables: int, cells: int):
    import numpy as np

    size = tables * cells
    return np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)


def _filled(digests: list, cells: int):
    """Tables of `cells` cells, one for each array of digests."""
    import numpy as np

    table = _empty(len(digests), cells)
    owners = np.repeat(np.arange(len(digests)), [len(d) for d in digests])
    keys = np.concatenate([*digests, np.zeros(0, np.uint64)])
    _add(table, owners, keys, np.ones(len(keys), np.int64), cells)
    return table


def sketches(digests: list) -> list[str]:
    """The sketch of each array of digests as text: number of cells, then their contents in base 64.

    It has `BASE_CELLS` doubled until there are three for each two digests, and
    further until all digests can be peeled out of it.
    """
    import base64

    import numpy as np

    found: list[str] = [""] * len(digests)
    cells = np.full(len(digests), BASE_CELLS)
    sizes = np.array([len(d) for d in digests], np.int64)
    while (low := 2 * cells < 3 * sizes).any():
        cells[low] *= 2
    waiting = np.arange(len(digests))
    while len(waiting):
        stuck = []
        for size in np.unique(cells[waiting]).tolist():
            todo = waiting[cells[waiting] == size]
            step = max(1, _CHUNK_CELLS // size)
            for part in (todo[i : i + step] for i in range(0, len(todo), step)):
                table = _filled([digests[i] for i in part], size)
                rows = np.empty((len(part), size), _CELL)
                for name, values in zip(("n", "keys", "checks"), table):
                    rows[name] = values.reshape(len(part), size)
                peeled = _peel(table, len(part), size)[0] >= 0
                for i, row, whole in zip(part.tolist(), rows, peeled.tolist()):
                    if whole:
                        found[i] = f"{size}:{base64.b64encode(row.tobytes()).decode()}"
                    else:
                        stuck.append(i)
        waiting = np.array(stuck, np.int64)
        cells[waiting] *= 2
    return found


def _table_of(fingerprint: str):
    """The cells of one fingerprint."""
    import base64

    import numpy as np

    rows = np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), _CELL)
    return [rows["n"].astype(np.int64), rows["keys"].astype(np.uint64), rows["checks"].astype(np.uint64)]


def _folded(table, cells: int):
    """The same sketch in fewer cells: those that a smaller table would not tell apart are added up."""
    return [values.reshape(3, -1, cells // 3).sum(axis=1, dtype=values.dtype).reshape(-1) for values in table]


def digests_of(fingerprint: str):
    """All digests that a fingerprint holds."""
    table = _table_of(fingerprint)
    return _peel(table, 1, len(table[0]))[1]


def likeness_of(left: str, right: str) -> float:
    """1 less the share of differing digests of two texts, from their fingerprints alone.

    The larger one is folded, both are subtracted and peeled; where that gets
    stuck, their digests are peeled out of each and go through larger tables.
    """
    import numpy as np

    a, b = _table_of(left), _table_of(right)
    cells, total = min(len(a[0]), len(b[0])), int(a[0].sum() + b[0].sum()) // 3
    rest = [x - y for x, y in zip(_folded(a, cells), _folded(b, cells))]
    differ = int(_peel(rest, 1, cells)[0][0])
    if differ < 0:
        return likeness([digests_of(left)], [digests_of(right)])[0]
    return float(np.where(total > 0, 1 - differ / max(total, 1), 1.0))


def _peeled(left: list, right: list, cells: int):
    """For each pair, how many digests differ, or -1 if peeling got stuck."""
    import numpy as np

    pairs = len(left)
    table = _empty(pairs, cells)
    for side, sign in ((left, 1), (right, -1)):
        keys = np.concatenate([*side, np.zeros(0, np.uint64)])
        owners = np.repeat(np.arange(pairs), [len(d) for d in side])
        _add(table, owners, keys, np.full(len(keys), sign, np.int64), cells)
    return _peel(table, pairs, cells)[0]


def _peel(table, pairs: int, cells: int):
    """Takes all digests out of tables: how many each held, or -1 if peeling got stuck, and the digests of all."""
    import numpy as np

    counts, sums, checks = table
    found, taken = np.zeros(pairs, np.int64), [np.zeros(0, np.uint64)]
    waiting = np.flatnonzero(np.abs(counts) == 1)
    for _ in range(2 * cells + 8):
        signs = counts[waiting]
        keys = sums[waiting] * signs.view(np.uint64)
        pure = (np.abs(signs) == 1) & (checks[waiting] * signs.view(np.uint64) == _check(keys))
        if not pure.any():
            break
        owners, keys, signs = waiting[pure] // cells, keys[pure], signs[pure]
        order = np.lexsort((keys, owners))
        owners, keys, signs = owners[order], keys[order], signs[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
        owners, keys, signs = owners[fresh], keys[fresh], signs[fresh]
        np.add.at(found, owners, 1)
        taken.append(keys)
        _add(table, owners, keys, -signs, cells)
        waiting = np.unique(np.concatenate([owners * cells + p for p in _places(keys, cells)]))
        waiting = waiting[np.abs(counts[waiting]) == 1]
    stuck = (counts != 0) | (sums != 0) | (checks != 0)
    found[stuck.reshape(pairs, cells).any(axis=1)] = -1
    return found, np.concatenate(taken)


def likeness(left: list, right: list) -> list[float]:
    """1 less the share of differing digests, by subtracting and peeling sketches of each pair.

    The first table has at least as many cells as the sizes differ by; a
    pair that does not peel is tried again with `GROWTH` times the cells.
    Two texts without paragraphs are alike.
    """
    import numpy as np

    sizes = np.array([[len(a), len(b)] for a, b in zip(left, right)], np.int64).reshape(-1, 2)
    differ = np.full(len(left), -1)
    cells = np.full(len(left), BASE_CELLS)
    while (low := cells < np.abs(sizes[:, 0] - sizes[:, 1])).any():
        cells[low] *= GROWTH
    for _ in range(_ATTEMPTS):
        for size in np.unique(cells[differ < 0]).tolist():
            todo = np.flatnonzero((differ < 0) & (cells == size))
            step = max(1, _CHUNK_CELLS // size)
            for part in (todo[i : i + step] for i in range(0, len(todo), step)):
                differ[part] = _peeled([left[i] for i in part], [right[i] for i in part], size)
        cells[differ < 0] *= GROWTH
        if (differ >= 0).all():
            break
    for i in np.flatnonzero(differ < 0):  # stuck in every table: count without one
        differ[i] = len(np.setxor1d(left[i], right[i], assume_unique=True))
    total = sizes.sum(axis=1)
    return np.where(total > 0, 1 - differ / np.maximum(total, 1), 1.0).tolist()


def _deal_function(splits: list[int], first: int | None, none_first: bool):
    """Marks rows with their part; the first row of a part goes to the part before it as well.

    The first document of all follows the last one, as a guest of the last part.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        bounds = np.array(splits, np.int64)
        for batch in batches:
            ids = batch.column("doc_id")
            missing = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
            values = np.asarray(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), np.int64)
            part = np.where(missing, 0, np.searchsorted(bounds, values, side="right"))
            edge = ~missing & np.isin(values, bounds)
            wraps = missing if none_first else ~missing & (values == (first or 0))
            for chosen, at, guest in (
                    (np.arange(len(part)), part, 0), (np.flatnonzero(edge), part - 1, 1),
                    (np.flatnonzero(wraps), np.full(len(part), len(bounds)), 2)):
                if len(chosen):
                    rows = pa.array(chosen)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at[chosen], pa.int32()), pa.array(np.full(len(chosen), guest, np.int32)),
                         ids.take(rows), batch.column("text").take(rows)], ["part", "guest", "doc_id", "text"])

    return run


def _fingerprint_function(batch_rows: int = 128):
    """Rows in order, guests last, to fingerprints of each own row and its edited text."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        def rows():
            for batch in sliced(batches, batch_rows):
                yield from zip(*(batch.column(n).to_pylist() for n in ("guest", "doc_id", "text")))

        def made(waiting, following):
            ids, texts = [w[1] for w in waiting], [w[2] or "" for w in waiting]
            nexts = [*texts[1:], following[2] or ""]
            edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, nexts)]
            own = [paragraph_digests(t) for t in texts]
            own_next = [*own[1:], paragraph_digests(nexts[-1])]
            changed = [paragraph_digests(t) for t in edited]
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(sketches(own)), pa.array(sketches(changed)),
                pa.array(likeness(own, changed), pa.float64()), pa.array(likeness(own, own_next), pa.float64())],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        waiting = []
        for row in rows():
            if waiting and (row[0] or len(waiting) >= batch_rows):
                yield made(waiting, row)
                waiting = []
            if row[0]:
                break
            waiting.append(row)
        for _ in batches:
            pass

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text: one row per row of `docs`.

    The edited text has the last quarter of its code points replaced by the
    first as many of the next document's, by ascending id; the first follows
    the last. Rows with equal ids are ordered by text, null ids come first.
    Null texts are empty; an empty text has a fingerprint of empty cells, and
    is 1 like another empty one. A single document follows itself.

    Texts move once, to parts between ids that an approximate quantile names.
    Rows of a part are sorted and streamed, at most a batch in memory; one
    row per part goes along with the part before it.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    facts = docs.agg(
        F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10 * parts).alias("splits"),
        F.min("doc_id").alias("first"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("missing")).first()
    splits = sorted(set(facts["splits"] or []))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _deal_function(splits, facts["first"], facts["missing"] > 0), "part int, guest int, doc_id long, text string")
    return (
        dealt.repartitionById(len(splits) + 1, F.col("part"))
        .sortWithinPartitions("guest", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
        .select("guest", "doc_id", "text")
        .mapInArrow(
            _fingerprint_function(),
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double"))
