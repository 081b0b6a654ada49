"""Where models plug in, and built-in stand-ins that need no weights.

Every hook is a column function. Model-backed ones load once per Python
task and see Arrow batches; only the prompt or text column leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

from ..functions.binding import let
from .tokenizers import words

GENERATED = "array<struct<response:string,finish_reason:string,response_token_len:int>>"
Answer = tuple[str, str, int]


class Generator:
    """Prompt column to `GENERATED`: one entry per returned sequence."""

    name = "generator"

    def answers(self, prompt: Column, n: int) -> Column:
        raise NotImplementedError

    def prompt_length(self, prompt: Column) -> Column:
        return F.size(words(prompt))


class EchoGenerator(Generator):
    """Answers with the sequence number and the prompt itself."""

    name = "echo"

    def answers(self, prompt: Column, n: int) -> Column:
        def answer(i: int) -> Column:
            text = F.concat(F.lit(f"[{i}] "), prompt)
            return F.struct(text.alias("response"), F.lit("stop").alias("finish_reason"),
                            F.size(words(text)).alias("response_token_len"))

        return F.array(*[answer(i) for i in range(n)])


class FunctionGenerator(Generator):
    """A model: `load()` returns a callable (prompts, n) -> answers per prompt.

    A batch that fails is tried again prompt by prompt; a prompt that fails
    by itself yields error rows, which a resumed job takes up again.
    """

    def __init__(self, load: Callable[[], Callable[[list[str], int], Sequence[Sequence[Answer]]]],
                 name: str = "model"):
        self.name = name
        self._load = load

    def answers(self, prompt: Column, n: int) -> Column:
        load = self._load

        @F.pandas_udf(GENERATED)
        def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()

            def one(text: str) -> Sequence[Answer]:
                try:
                    return model([text], n)[0]
                except Exception:
                    return [("", "error", 0)] * n

            for prompts in batches:
                texts = prompts.tolist()
                try:
                    answered = list(model(texts, n))
                except Exception:
                    answered = [one(text) for text in texts]
                yield pd.Series([
                    [{"response": text, "finish_reason": reason, "response_token_len": length}
                     for text, reason, length in rows] for rows in answered], dtype=object)

        return generate.asNondeterministic()(prompt)


class Embedder:
    """Text column to `array<float>`."""

    def vectors(self, text: Column) -> Column:
        raise NotImplementedError


class TrigramEmbedder(Embedder):
    """Counts of hashed character trigrams."""

    def __init__(self, size: int = 64):
        self.size = size

    def vectors(self, text: Column) -> Column:
        def slots(padded: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(1), F.length(padded) - 2),
                lambda i: (F.crc32(F.substring(padded, i, F.lit(3))) % self.size).cast("int"))

        def counts(found: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.lit(self.size - 1)),
                lambda slot: (F.size(found) - F.size(F.array_remove(found, slot))).cast("float"))

        return let(let(F.concat(F.lit("  "), F.lower(text), F.lit("  ")), slots), counts)


class FunctionEmbedder(Embedder):
    """A model: `load()` returns a callable from texts to vectors."""

    def __init__(self, load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]):
        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series([list(v) for v in model(texts.tolist())], dtype=object)

        self._udf = embed

    def vectors(self, text: Column) -> Column:
        return F.when(text.isNotNull(), self._udf(F.coalesce(text, F.lit(""))))


class Classifier:
    """Token ids to `array<double>` logits, one per class."""

    name = "classifier"

    def logits(self, input_ids: Column) -> Column:
        raise NotImplementedError


class BucketClassifier(Classifier):
    """Class scores are the shares of ids that fall into each class."""

    name = "buckets"

    def __init__(self, n_classes: int = 2):
        self.n_classes = n_classes

    def logits(self, input_ids: Column) -> Column:
        total = F.greatest(F.size(input_ids), F.lit(1)).cast("double")

        def share(k: int) -> Column:
            members = F.filter(input_ids, lambda x: F.pmod(x, F.lit(self.n_classes)) == k)
            return F.size(members) / total

        return F.array(*[share(k) for k in range(self.n_classes)])


class FunctionClassifier(Classifier):
    """A model: `load()` returns a callable from id lists to logit lists."""

    def __init__(self, load: Callable[[], Callable[[list[list[int]]], Sequence[Sequence[float]]]],
                 name: str = "model"):
        self.name = name

        @F.pandas_udf("array<double>")
        def classify(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for ids in batches:
                yield pd.Series([list(v) for v in model([list(x) for x in ids])], dtype=object)

        self._udf = classify

    def logits(self, input_ids: Column) -> Column:
        return self._udf(input_ids)
