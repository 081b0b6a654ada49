"""Quality by the votes of the nearest labelled documents in a latent-semantic space.

Terms describe how a text is written, not what it is about: the shapes of
its words, its shortest words, and how much it repeats itself. Weighted term
counts of a bounded labelled sample give the space; each document is compared
with every labelled vector in blocks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .common import AgingCache, BoundedCache, per_process, sliced
from .labelled import held_out, training_sample

PER_CLASS = 2048
WIDTH = 2048
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 8
THRESHOLD = 0.3
_CACHE = 150_000
_TERMS = 50_000
_SHAPES = 20_000
_BLOCK = 256
_OUTLINE = 12
_SUMMARY_WEIGHT = 3.0


@dataclass(frozen=True)
class QualityModel:
    """What scoring needs: term weights, axes, and the labelled vectors with labels and weights."""

    idf: object
    axes: object
    vectors: object
    labels: object
    weights: object
    prior: float


def _term(name: str) -> int:
    import zlib

    return zlib.crc32(name.encode()) % WIDTH


class _Kinds(dict):
    """The sign that stands for each character in a shape, by code point."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "x" if c.isalpha() else c
        self[code] = kind
        return kind


def _shape_terms(shape: str, length: int, terms) -> tuple[int, ...]:
    """Terms of words of one shape and length class. Of a longer shape, each `_OUTLINE` runs are a term, to the word's end."""
    found = [f"shape {shape[i : i + _OUTLINE]}" for i in range(0, len(shape), _OUTLINE)]
    found += [f"end {shape[-2:]}", f"length {length}"]
    found += [f"sign {s}" for s in dict.fromkeys(shape) if s not in "aA0x"]
    return tuple([terms[name] for name in found])


class _WordTerms:
    """A word's shape with runs made one, its end, its length, and itself if it is short.

    `terms` holds the number of each name, one object for all words. Shapes are far fewer than words, so their terms are kept.
    """

    def __init__(self, terms):
        self.terms, self.kinds, self.runs = terms, _Kinds(), re.compile(r"(.)\1+", re.DOTALL).sub
        self.shapes = BoundedCache(lambda key: _shape_terms(*key, terms), _SHAPES)

    def __call__(self, word: str) -> tuple[int, ...]:
        if word.isascii() and word.islower() and word.isalpha():
            shape = "a"
        else:
            shape = self.runs(r"\1", word.translate(self.kinds))
        key = shape, min(len(word), 40) // 4
        found = self.shapes[key] if len(shape) <= 64 else _shape_terms(*key, self.terms)
        return found if len(word) > 4 else (*found, self.terms[f"word {word.lower()}"])


def _summary_terms(text: str, words: list[str]) -> list[int]:
    """Terms for the whole text: size, repetition of words, neighbours and lines."""
    count = len(words)
    lines = [line for line in text.split("\n") if line.strip()]
    pairs = set(zip(words, words[1:]))
    measures = {
        "size": min(count.bit_length(), 16),
        "distinct pairs": int(8 * len(pairs) / max(1, count - 1)),
        "twice in a row": int(10 * sum(map(str.__eq__, words, words[1:])) / max(1, count)),
        "distinct lines": int(6 * len(set(lines)) / max(1, len(lines))),
        "line length": min((len(text) // max(1, len(lines))).bit_length(), 14),
        "upper": int(10 * sum(map(str.isupper, words)) / max(1, count)),
    }
    return [_term(f"{name} {value}") for name, value in measures.items()]


def _counted(texts: list, words_terms):
    """Rows of damped term counts, one per text."""
    from itertools import chain

    import numpy as np

    rows = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(rows, texts):
        words = (text or "").split()
        if words:
            found = np.fromiter(chain.from_iterable(map(words_terms.__getitem__, words)), np.int64)
            counts = np.bincount(found, minlength=WIDTH)
            at = np.flatnonzero(counts)
            row[at] += np.log1p(counts[at] * (100.0 / len(words))).astype(np.float32)
        for term in _summary_terms(text or "", words):
            row[term] += _SUMMARY_WEIGHT
    return rows


def _words_terms():
    def build():
        terms = BoundedCache(_term, _TERMS)
        return AgingCache(_WordTerms(terms), _CACHE)

    return per_process("quality terms", build)


def _unit(rows):
    import numpy as np

    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    """Learns the space from at most `per_class` labelled documents of either class.

    Term rows of the sample are made on the executors; only they come to the
    driver (2 * `per_class` * `WIDTH` floats at most), for one decomposition.
    Without labelled rows the model gives every document the score 0.5.
    """
    import numpy as np

    sample, weights = training_sample(docs, labels, label, per_class)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches):
            rows = _counted(batch.column("text").to_pylist(), _words_terms())
            packed = []
            for row in rows:
                at = np.flatnonzero(row)
                packed.append(np.rec.fromarrays([at.astype(np.int32), row[at]]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())],
                ["doc_id", "label", "terms"])

    found = sample.mapInArrow(run, "doc_id long, label int, terms binary").toArrow().sort_by(
        [("doc_id", "ascending"), ("terms", "ascending")])
    if not found.num_rows:
        empty = np.zeros((0, 1), np.float32)
        return QualityModel(np.zeros(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), empty,
                            np.zeros(0), np.zeros(0), 0.5)
    rows = np.zeros((found.num_rows, WIDTH), np.float32)
    for row, packed in zip(rows, found.column("terms").to_pylist()):
        terms = np.frombuffer(packed, [("at", np.int32), ("value", np.float32)])
        row[terms["at"]] = terms["value"]
    marks = np.asarray(found.column("label").to_pylist())
    idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype(np.float32) + 1
    weighted = _unit(rows * idf)
    _, turned = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    axes = turned[:, ::-1][:, :RANK].astype(np.float32)
    weight = np.array([weights[int(m)] for m in marks])
    return QualityModel(
        idf, axes, _unit(weighted @ axes).astype(np.float32), marks, weight, float(np.average(marks, weights=weight)))


def _votes(model: QualityModel, rows):
    """Scores of term rows: labels of the nearest vectors, weighted by similarity.

    Rows are multiplied in blocks of one size, filled up with zeros, so that
    a text's score does not depend on the texts beside it. All vectors as
    near as the last neighbour vote, so that ties do not depend on their
    order; similarities are compared to five digits.
    """
    import numpy as np

    if not len(model.vectors):
        return np.full(len(rows), model.prior)
    padded = np.zeros((-(-len(rows) // _BLOCK) * _BLOCK, WIDTH), np.float32)
    padded[: len(rows)] = rows
    blocks = [_block_votes(model, padded[i : i + _BLOCK]) for i in range(0, len(padded), _BLOCK)]
    return np.concatenate([*blocks, np.zeros(0)])[: len(rows)]


def _block_votes(model: QualityModel, rows):
    import numpy as np

    at = _unit(_unit(rows * model.idf) @ model.axes)
    nearness = np.round((at @ model.vectors.T).astype(np.float64), 5)
    count = min(NEIGHBOURS, nearness.shape[1])
    last = np.partition(nearness, -count, axis=1)[:, -count, None]
    near = nearness >= last
    vote = np.zeros(nearness.shape)
    vote[near] = np.maximum(nearness[near], 0) ** SHARPNESS
    vote *= model.weights
    total = vote.sum(axis=1)
    return np.where(total > 0, (vote @ model.labels) / np.maximum(total, 1e-300), model.prior).clip(0, 1).round(9)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of `docs`, no shuffle.

    The model is broadcast: `2 * PER_CLASS` vectors and `WIDTH * RANK` axes,
    about 1.5 MB whatever the size of the data. Null texts are scored like
    empty ones, by the terms of an empty text. Equal texts get equal scores.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches, _BLOCK):
            rows = _counted(batch.column("text").to_pylist(), _words_terms())
            scores = _votes(QualityModel(**shipped.value), rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.asarray(scores, np.float64))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose text scores at least `threshold`, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches, _BLOCK):
            scores = _votes(QualityModel(**shipped.value), _counted(batch.column("text").to_pylist(), _words_terms()))
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
