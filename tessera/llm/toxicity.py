"""Toxicity by a weighted lexicon, matched by one automaton over folded text.

Look-alike letters and digits that stand for letters are folded first. The
lexicon, words and beginnings of words, is learned from a bounded sample of
labelled rows, and so are the phrases in which an entry means no harm.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .common import WORD, sliced
from .labelled import held_out, training_sample

PER_CLASS = 6144
ENTRIES = 4096
LEAST_SUPPORT = 6
SHORTEST, LONGEST = 3, 9
LEAST_WEIGHT = 1.5
PHRASES = 1024
MOST_REPEATS = 3
_COUNT_CACHE = 400_000
THRESHOLD = 0.5

# Letters of other scripts that look like Latin ones, and signs written for letters.
HOMOGLYPHS = dict(zip("асеорхуіјѕԁһԛԝӏαοеıɡ", "aceopxyijsdhqwlaoeig"))
SIGNS = dict(zip("013457@$!|", "oieast" + "asil"))


def fold(text: str) -> str:
    """Lower-case text, with look-alike letters, and signs within words, made Latin letters.

    Accents stay: in some languages they tell one word from another.
    """
    import re
    import unicodedata

    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = re.sub("[​-‍⁠﻿­]+", "", text)
        text = text.translate(str.maketrans(HOMOGLYPHS))
    if re.search(r"[013457@$!|]", text):
        signs = str.maketrans(SIGNS)

        def read(found):
            word = found.group()
            body = word.rstrip("!|.")
            letters = sum(map(str.isalpha, body))
            spelled = letters > 1 or 2 * letters >= len(body) > 0
            return body.translate(signs) + word[len(body):] if spelled else word

        text = re.sub(r"[^\s,;:()\"]*[013457@$!|][^\s,;:()\"]*", read, text)
    return text


def words_of(folded: str) -> list[str]:
    """The runs of letters of a folded text, in order."""
    import re

    return re.findall(r"[^\W\d_]+", folded)


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights: ` word ` is a whole word, ` begin` the beginning of one.

    `exceptions` are pairs of neighbouring words in which an entry does not
    count. `curve` turns the measures of `toxic_weight` and 1 into a score,
    by the logistic function.
    """

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (0.0, 0.0, -60.0)

    def automaton(self):
        import ahocorasick

        built = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            built.add_word(entry, (len(entry), weight))
        if self.weights:
            built.make_automaton()
        return built


def toxic_weight(text: str, lexicon: Lexicon, automaton) -> tuple[float, float]:
    """The weight of entries found in `text`, per root of its length in words and per 20 words.

    A word has the weight of its heaviest entry and counts `MOST_REPEATS`
    times at most, so that a word repeated without end says no more.
    """
    words = words_of(fold(text))
    if not words or not lexicon.weights:
        return 0.0, 0.0
    counts = Counter(words)
    joined = f" {' '.join(counts)} "
    found: dict[str, float] = {}
    for end, (length, weight) in automaton.iter(joined):
        start = end + 2 - length
        word = joined[start : joined.index(" ", start)]
        found[word] = max(weight, found.get(word, 0.0))
    if found and lexicon.exceptions:
        for before, word, after in zip(["", *words], words, [*words[1:], ""]):
            if word in found and (
                    f"{before} {word}" in lexicon.exceptions or f"{word} {after}" in lexicon.exceptions):
                counts[word] -= 1
    total = sum(weight * min(counts[word], MOST_REPEATS) for word, weight in found.items())
    size = len(words) + 20
    return total / math.sqrt(size), 20 * total / size


def _candidates(word: str) -> list[str]:
    """The entries that a word would match."""
    whole = [f" {word} "] if len(word) <= 24 else []
    return whole + [f" {word[:length]}" for length in range(SHORTEST, min(LONGEST, len(word)) + 1)]


def _entry_counts(sample: DataFrame) -> DataFrame:
    """(entry, texts, toxic, clean): toxic texts with an entry, and its occurrences by class."""

    def run(batches):
        import pyarrow as pa

        texts, totals = Counter(), {0: Counter(), 1: Counter()}

        def flush():
            entries = sorted(totals[0].keys() | totals[1].keys())
            columns = [pa.array(entries, pa.string())] + [
                pa.array([c[e] for e in entries], pa.int64()) for c in (texts, totals[1], totals[0])]
            for counter in (texts, *totals.values()):
                counter.clear()
            return pa.RecordBatch.from_arrays(columns, ["entry", "texts", "toxic", "clean"])

        for batch in sliced(batches):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                own = Counter()
                for word, count in Counter(words_of(fold(text or ""))).items():
                    for entry in _candidates(word):
                        own[entry] += min(count, MOST_REPEATS)
                totals[label].update(own)
                if label:
                    texts.update(own.keys())
            if len(totals[0]) + len(totals[1]) > _COUNT_CACHE:
                yield flush()
        yield flush()

    return sample.mapInArrow(run, "entry string, texts long, toxic long, clean long").groupBy("entry").agg(
        F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _chosen(rows: Sequence, sizes: dict[int, float]) -> dict[str, float]:
    """Log ratios of the rates of entries that mark toxic texts; none that a shorter one covers.

    `sizes` are the words of either class.
    """
    chosen: dict[str, float] = {}
    for row in sorted(rows, key=lambda r: (len(r["entry"].rstrip()), r["entry"])):
        entry = row["entry"]
        toxic = (row["toxic"] + 0.5) / (sizes[1] + 1)
        clean = (row["clean"] + 0.5) / (sizes[0] + 1)
        weight = math.log(toxic / clean)
        shorter = [entry[:k] for k in range(2, len(entry))]
        covered = max((chosen.get(s, 0.0) for s in shorter), default=0.0)
        if weight > LEAST_WEIGHT and weight > covered + 0.7 * bool(covered):
            chosen[entry] = min(weight, 8.0)
    return chosen


def _fit_curve(values, labels, weights) -> tuple[float, ...]:
    """Coefficients of a weighted logistic curve, by Newton's method with a light penalty."""
    import numpy as np

    design = np.column_stack([values, np.ones(len(values))])
    theta = np.zeros(design.shape[1])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (weights * (labels - chance)) - 0.1 * theta
        bend = (design * (weights * chance * (1 - chance))[:, None]).T @ design + 0.1 * np.eye(len(theta))
        step = np.linalg.solve(bend, gradient)
        theta += step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, theta))


def fit_lexicon(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Lexicon:
    """Learns from at most `per_class` labelled documents of either class.

    Counting runs on the executors; to the driver come the `ENTRIES` best
    entries, the `PHRASES` commonest harmless phrases, and one number per
    sampled text. Without toxic rows the lexicon is empty and all scores 0.
    """
    import numpy as np

    sample, weights = training_sample(docs, labels, label, per_class)
    sizes, texts = {0: 1.0, 1: 1.0}, {0: 0, 1: 0}
    for row in sample.groupBy("label").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.regexp_count("text", F.lit(WORD))).alias("words")).collect():
        sizes[row["label"]], texts[row["label"]] = float(row["words"] or 0), row["n"]
    if not texts[1]:
        return Lexicon({})
    lift = (F.col("toxic") + 0.5) * (sizes[0] + 1) / ((F.col("clean") + 0.5) * (sizes[1] + 1))
    support = max(min(LEAST_SUPPORT, max(2, texts[1] // 20)), texts[1] // 100)
    rows = _entry_counts(sample).where((F.col("texts") >= support) & (lift > math.exp(LEAST_WEIGHT))).orderBy(
        F.desc(F.col("toxic") * F.log(lift)), "entry").limit(ENTRIES).collect()
    chosen = _chosen(rows, sizes)
    if not chosen:
        return Lexicon({})

    def phrases(batches):
        import pyarrow as pa

        plain = Lexicon(chosen)
        automaton = plain.automaton()
        for batch in sliced(batches):
            found, marks = [], []
            for text, mark in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = words_of(fold(text or ""))
                hits = set()
                for i, word in enumerate(words):
                    if next(automaton.iter(f" {word} "), None):
                        hits |= {" ".join(words[max(0, i - 1) : i + 1]), " ".join(words[i : i + 2])}
                found += sorted(h for h in hits if " " in h)
                marks += [mark] * (len(found) - len(marks))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.string()), pa.array(marks, pa.int32())], ["phrase", "label"])

    harmless = sample.mapInArrow(phrases, "phrase string, label int").groupBy("phrase").agg(
        F.sum(F.col("label")).alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).where(
        (F.col("clean") >= 3) & (F.col("clean") > 10 * F.col("toxic"))).orderBy(
        F.desc("clean"), "phrase").limit(PHRASES).collect()
    lexicon = Lexicon(chosen, frozenset(r["phrase"] for r in harmless))

    def measure(batches):
        import pyarrow as pa

        automaton = lexicon.automaton()
        for batch in sliced(batches):
            values = [toxic_weight(t or "", lexicon, automaton) for t in batch.column("text").to_pylist()]
            columns = [pa.array([v[k] for v in values], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("label")], ["x", "y", "label"])

    found = sample.mapInArrow(measure, "x double, y double, label int").toArrow().sort_by(
        [("x", "ascending"), ("y", "ascending"), ("label", "ascending")])
    marks = np.asarray(found.column("label").to_pylist(), float)
    values = np.column_stack([found.column(n).to_pylist() for n in ("x", "y")])
    curve = _fit_curve(values, marks, np.array([weights[int(m)] for m in marks]))
    return Lexicon(chosen, lexicon.exceptions, curve)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of `docs`, no shuffle.

    Null and empty texts are scored as texts without any entry. The lexicon
    has at most `ENTRIES` entries and `PHRASES` exceptions and goes to every
    task. Equal texts get equal scores.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vars(lexicon))

    def run(batches):
        import pyarrow as pa

        known = Lexicon(**shipped.value)
        automaton = known.automaton()
        for batch in sliced(batches):
            scores = []
            for text in batch.column("text").to_pylist():
                x, y = toxic_weight(text or "", known, automaton)
                value = known.curve[0] * x + known.curve[1] * y + known.curve[2]
                scores.append(1 / (1 + math.exp(-max(-60.0, min(60.0, value)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
