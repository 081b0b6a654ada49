"""String expressions for conversations, prompts and generated answers.

Everything here builds a `Column`; nothing runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import let

# The separator between conversation segments, the blank line
# between prompt segments, and the two role templates.
SEGMENT_SEP = "[[SEP]]"
PROMPT_SEP = "\n\n"
ROLE_TEMPLATES = {
    "headed": {"user": "### User: ", "assistant": "### Assistant: "},
    "plain": {"user": "", "assistant": ""},
}

# Diagnosis patterns in order of preference, and the literal
# words each of them needs (None: always tried).
DIAGNOSIS_PATTERNS = [
    (r"The most likely diagnosis is [^,]+, specifically ([^,\.]+).", "The most likely diagnosis is "),
    (r"The most likely diagnosis is[:]?([^,\.]+)", "The most likely diagnosis is"),
    (r"The probable diagnosis is([^,\.]+)", "The probable diagnosis is"),
    (r"([^,\.]+) is the most likely diagnosis", " is the most likely diagnosis"),
    (r"Diagnosis is[:]?([^,\.]+)", "Diagnosis is"),
    (r"Diagnosis shows([^,\.]+)", "Diagnosis shows"),
    (r"Diagnosis may be[:]?([^,\.]+)", "Diagnosis may be"),
    (r"Likely suffering from[:]?([^,\.]+)", "Likely suffering from"),
    (r"^([^,\.\s]+)", None),
]

# Fixed value: code prefix lengths that are compared.
CODE_PREFIXES = (1, 3, 5, 7)


def template(name: str | None) -> dict[str, str]:
    """Role prefixes by template name; `headed` is the default."""
    key = name or "headed"
    if key not in ROLE_TEMPLATES:
        raise ValueError(f"unknown prompt template: {key}")
    return ROLE_TEMPLATES[key]


def segments(text: Column) -> Column:
    """Split on the literal separator and keep empty segments."""
    return F.split(text, r"\Q" + SEGMENT_SEP + r"\E", -1)


def first_segment(text: Column) -> Column:
    return F.substring_index(text, SEGMENT_SEP, 1)


def last_segment(text: Column) -> Column:
    return F.substring_index(text, SEGMENT_SEP, -1)


def _all_but_last(segs: Column) -> Column:
    return F.slice(segs, F.lit(1), F.size(segs) - 1)


def replace_last_segment(text: Column, response: Column) -> Column:
    """The conversation with its final segment exchanged for `response`."""
    return let(segments(text), lambda segs: F.array_join(
        F.concat(_all_but_last(segs), F.array(response)), SEGMENT_SEP))


def add_role_prefix(segs: Column, template_name: str | None = None) -> Column:
    """Even positions speak as the user, odd ones as the assistant."""
    roles = template(template_name)
    return F.transform(
        segs,
        lambda seg, i: F.concat(
            F.when(i % 2 == 0, F.lit(roles["user"])).otherwise(F.lit(roles["assistant"])), seg),
    )


def has_empty_answer(segs: Column) -> Column:
    """Is any assistant segment (odd position, unprefixed) empty?"""
    return F.exists(F.filter(segs, lambda seg, i: i % 2 == 1), lambda seg: seg == "")


def even_segments(segs: Column) -> Column:
    """Segments with `''` appended when the assistant's turn is missing."""
    return let(segs, lambda s: F.when(
        F.size(s) % 2 == 1, F.concat(s, F.array(F.lit("")))).otherwise(s))


def reference_answer(text: Column) -> Column:
    """The last segment once the turn count is even; `''` for an open question."""
    return F.element_at(even_segments(segments(text)), -1)


def generation_prompt(text: Column, template_name: str | None = None,
                      with_last: bool = False, sep: str = PROMPT_SEP) -> Column:
    """The prefixed conversation, its final answer blanked unless `with_last`."""
    segs = even_segments(segments(text))
    if not with_last:
        segs = let(segs, lambda s: F.concat(_all_but_last(s), F.array(F.lit(""))))
    return F.array_join(add_role_prefix(segs, template_name), sep)


def answer_from_output(output: Column, template_name: str | None = None) -> Column:
    """What follows the last assistant marker in a decoded model output."""
    marker = template(template_name)["assistant"]
    if not marker:
        raise ValueError("this template has no assistant marker to split on")
    return F.substring_index(output, marker, -1)


def chat_message(context: Column, instruction: str) -> Column:
    """One user message: the context, a blank line, the instruction."""
    content = F.concat(context, F.lit("\n\n"), F.lit(instruction), F.lit("\n"))
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def extract_diagnosis(response: Column) -> Column:
    """Group 1 of the first pattern that matches; null when none does.

    A plain substring test stands before each regular expression, so long
    answers are scanned by a regex only where it can match.
    """
    found = []
    for pattern, needed in DIAGNOSIS_PATTERNS:
        # Python's \s also covers U+001C..U+001F, which Java's does not.
        java = "(?sU)" + pattern.replace(r"\.\s]", r"\.\s\x1c-\x1f]")
        hit = F.nullif(F.regexp_extract(response, java, 1), F.lit(""))
        found.append(hit if needed is None else F.when(F.contains(response, F.lit(needed)), hit))
    return F.coalesce(*found)


def prefix_match(left: Column, right: Column, length: int) -> Column:
    """Equal up to `length` characters; a null on either side never matches."""
    same = F.substring(left, 1, length) == F.substring(right, 1, length)
    return F.coalesce(same, F.lit(False))


def code_agreement(truth: Column, predicted: Column) -> Column:
    """How many of the compared prefix lengths agree, 0 to 4."""
    total = F.lit(0)
    for length in CODE_PREFIXES:
        total = total + prefix_match(truth, predicted, length).cast("int")
    return total


def seeded_key(seed: int, *parts: Column) -> Column:
    """A reproducible random-looking key for breaking ties and shuffling."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def seeded_uniform_int(seed: int, n: Column, *parts: Column) -> Column:
    """A reproducible integer in 1..n."""
    word = F.conv(F.substring(seeded_key(seed, *parts), 1, 8), 16, 10).cast("bigint")
    return (F.pmod(word, n.cast("bigint")) + 1).cast("int")
