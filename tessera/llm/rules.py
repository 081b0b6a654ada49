"""Quality rules: a table of thresholds compiled into one projection.

No user function runs. A text is split once; everything else is read off the
arrays of its words and lines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import let
from .common import WORD

_BLANK = r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """Keeps a text whose `measure` lies within [low, high]; None is no bound."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def passes(self, value: Column) -> Column:
        held = F.lit(True)
        if self.low is not None:
            held = held & (value >= self.low)
        if self.high is not None:
            held = held & (value <= self.high)
        return F.coalesce(held, F.lit(False))


# Frequent function words of the four languages.
STOP_WORDS = (
    "the and that for with this from are was not of to in is on as at by it be or an a "
    "der die und das ist von den mit für auf ein eine zu im des dem nicht "
    "le la les des et est une un dans pour que qui pas avec sur par de du en au "
    "el los las y una que por con para del no es se al su lo").split()

RULES = (
    Rule("mean word length", "mean_word_chars", 2, 14),
    Rule("symbols per word", "symbols_per_word", None, 0.1),
    Rule("stop words", "n_stop_words", 2),
    Rule("copied lines", "dup_line_ratio", None, 0.5),
    Rule("upper case letters", "upper_ratio", None, 0.5),
    Rule("words with a letter", "letter_word_ratio", 0.8),
    Rule("lines ending in an ellipsis", "ellipsis_line_ratio", None, 0.3),
    Rule("lines starting with a bullet", "bullet_line_ratio", None, 0.9),
)


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0 where there is nothing to divide."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _n(value: Column) -> Column:
    return value.cast("long")


def _words(text: Column) -> Column:
    """The words in order. The pieces between blanks, less the empty ones at either end."""
    return F.array_remove(F.split(text, _BLANK + "+"), "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Where all hashes of windows differ there is none. Else windows are sorted
    by hash, words and place, so that equal ones are neighbours; the places of
    those cover three words each.
    """
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1)))
    hashes = F.when(F.size(words) < 4, F.array().cast("array<bigint>")).otherwise(F.transform(
        places, lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2))))

    def covered(found: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

        repeated = F.filter(found, lambda x, k: F.coalesce(same(x, F.get(found, k - 1)), F.lit(False)) | F.coalesce(
            same(x, F.get(found, k + 1)), F.lit(False)))
        inside = F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(inside))

    def counted(found: Column) -> Column:
        windows = F.sort_array(F.transform(found, lambda h, i: F.struct(
            h.alias("h"), F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"),
            i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(windows, covered))

    return let(hashes, counted)


def _where_found(text: Column, signs: Sequence[str], count: Column) -> Column:
    """`count`, which is 0 where none of the signs occurs."""
    found = F.lit(False)
    for sign in signs:
        found = found | text.contains(sign)
    return F.when(found, count).otherwise(F.lit(0))


def word_measures(text: Column) -> Column:
    """(n_words, word_chars, n_repeat_words) of a text without null, which is split once."""
    return let(_words(text), lambda words: F.struct(
        _n(F.size(words)).alias("n_words"), _n(F.char_length(F.array_join(words, ""))).alias("word_chars"),
        _n(_repeat_words(words)).alias("n_repeat_words")))


def line_measures(text: Column) -> Column:
    """(n_lines, n_dup_lines): lines with a word."""
    return let(F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)), lambda lines: F.struct(
        _n(F.size(lines)).alias("n_lines"), _n(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines")))


def sign_measures(text: Column) -> dict[str, Column]:
    """What else the base and the threshold table ask for."""
    stops = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    return {
        "n_symbols": _n(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))),
        "n_letters": _n(F.char_length(F.regexp_replace(text, r"[^\p{L}]+", ""))),
        "n_upper": _n(F.regexp_count(text, F.lit(r"\p{Lu}"))),
        "n_stop_words": _n(F.size(F.array_intersect(F.split(F.lower(text), r"[^\p{L}]+"), stops))),
        "n_letter_words": _n(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D\p{L}]*\p{L}[^\x20\x09-\x0D]*"))),
        "n_ellipsis_lines": _n(_where_found(text, ["...", "…"], F.regexp_count(
            text, F.lit(r"(?:\.\.\.|…)[\x20\x09]*(?:\n|$)")))),
        "n_bullet_lines": _n(_where_found(text, ["- ", "* ", "• "], F.regexp_count(
            text, F.lit(r"(?:^|\n)[\x20\x09]*[-*•]\x20")))),
    }


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """`docs` with the measures, `base_failed`, `kept` and the rules that failed.

    One projection, no shuffle. A null text has no words. A text without
    words fails the base rule; ratios over nothing are 0. Columns of `docs`
    named like a measure are replaced. Repeated rows get equal results.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.withColumns({"_of_words": word_measures(text), "_of_lines": line_measures(text)}).withColumns(
        {name: F.col(f"_of_words.{name}") for name in ("n_words", "word_chars", "n_repeat_words")}
        | {name: F.col(f"_of_lines.{name}") for name in ("n_lines", "n_dup_lines")} | sign_measures(text)
    ).drop("_of_words", "_of_lines")
    measured = counted.withColumns(ratios(F.col))
    return measured.withColumn("failed_rules", _failed(F.col, rules)).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def ratios(of: Callable[[str], Column]) -> dict[str, Column]:
    """What follows from the counts, `of` naming one; the base rule among them."""
    return {
        "mean_word_chars": _ratio(of("word_chars"), of("n_words")),
        "symbols_per_word": _ratio(of("n_symbols"), of("n_words")),
        "dup_line_ratio": _ratio(of("n_dup_lines"), of("n_lines")),
        "upper_ratio": _ratio(of("n_upper"), of("n_letters")),
        "letter_word_ratio": _ratio(of("n_letter_words"), of("n_words")),
        "ellipsis_line_ratio": _ratio(of("n_ellipsis_lines"), of("n_lines")),
        "bullet_line_ratio": _ratio(of("n_bullet_lines"), of("n_lines")),
        "base_failed": (of("n_words") < 50) | (100 * of("n_repeat_words") > 50 * of("n_words")),
    }


def _failed(of: Callable[[str], Column], rules: Sequence[Rule]) -> Column:
    return F.filter(
        F.array(*[F.when(~rule.passes(of(rule.measure)), F.lit(rule.name)) for rule in rules]), lambda name: name.isNotNull())


def passes_rules(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """`kept` of `quality_rules` as one expression, for filters.

    A filter on a computed column is moved below the projection and computes
    each measure once for each rule that asks for it; here all are computed once.
    """
    whole = F.coalesce(text, F.lit(""))
    counts = F.struct(word_measures(whole).alias("words"), line_measures(whole).alias("lines"), *[
        count.alias(name) for name, count in sign_measures(whole).items()])

    def verdict(found: Column) -> Column:
        own = {name: found["words"][name] for name in ("n_words", "word_chars", "n_repeat_words")}
        own |= {name: found["lines"][name] for name in ("n_lines", "n_dup_lines")}

        def count(name: str) -> Column:
            return own[name] if name in own else found[name]

        derived = ratios(count)
        return ~derived["base_failed"] & (F.size(_failed(lambda n: derived[n] if n in derived else count(n), rules)) == 0)

    return let(counts, verdict)


OUTPUT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

_STOPS_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
         regexp_replace(coalesce(text, ''), '[^\\p{{L}}]', '', 'g') AS letters
  FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM t WHERE len(words) > 2),
grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM places),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM grams, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         length(letters) AS n_letters, length(regexp_replace(letters, '[^\\p{{Lu}}]', '', 'g')) AS n_upper,
         len(list_intersect(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), [{_STOPS_SQL}])) AS n_stops,
         len(list_filter(words, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words,
         len(regexp_extract_all(text, '(?:\\.\\.\\.|\\x{{2026}})[\\x20\\x09]*(?:\\n|$)')) AS n_ellipsis,
         len(regexp_extract_all(text, '(?:^|\\n)[\\x20\\x09]*[-*\\x{{2022}}]\\x20')) AS n_bullets
  FROM t LEFT JOIN repeated r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 14 * n_words AND n_symbols / n_words <= 0.1
       AND n_stops >= 2 AND CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END <= 0.5
       AND CASE WHEN n_letters > 0 THEN n_upper / n_letters ELSE 0 END <= 0.5 AND n_letter_words / n_words >= 0.8
       AND CASE WHEN n_lines > 0 THEN n_ellipsis / n_lines ELSE 0 END <= 0.3
       AND CASE WHEN n_lines > 0 THEN n_bullets / n_lines ELSE 0 END <= 0.9 AS kept
FROM b
"""
