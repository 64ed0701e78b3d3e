"""Text rules: cleaning, length limits, code formats and keyword classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumbook.functions.rules import CODE_DIGITS, MAX_TEXT, MIN_TEXT


def cleaned(text: Column) -> Column:
    """Spaces trimmed at both ends; other white space stays."""
    return F.trim(text)


def length_ok(text: Column, low: int = MIN_TEXT, high: int = MAX_TEXT) -> Column:
    """True when the cleaned text has between ``low`` and ``high`` characters."""
    return F.char_length(cleaned(text)).between(low, high)


def code_format_ok(code: Column, digits: int = CODE_DIGITS) -> Column:
    # \z, not $: Java's $ also matches before a final line feed.
    return F.coalesce(cleaned(code).rlike(rf"^[0-9]{{{digits}}}\z"), F.lit(False))


def digits_prefix(text: Column, size: int = 2) -> Column:
    return F.substring(F.regexp_replace(text, "[^0-9]", ""), 1, size)


def number_or(text: Column, default: int) -> Column:
    """The text as an integer; zero, nothing or no number give the default."""
    return F.coalesce(F.nullif(text.try_cast("int"), F.lit(0)), F.lit(default))


def name_initial(name: Column) -> Column:
    return F.upper(F.substring(name, 1, 1))


def first_match_class(
    text: Column, classes: Sequence[tuple[str, Sequence[Sequence[str]]]], default: str = "other"
) -> Column:
    """Name of the first class whose rule the lower-cased text satisfies.

    A rule is a list of groups; every group needs at least one of its
    substrings in the text.
    """
    lowered = F.lower(text)
    result = None
    for name, groups in classes:
        hit = F.lit(True)
        for group in groups:
            any_of = F.lit(False)
            for word in group:
                any_of = any_of | lowered.contains(word)
            hit = hit & any_of
        result = F.when(hit, F.lit(name)) if result is None else result.when(hit, F.lit(name))
    return F.lit(default) if result is None else result.otherwise(F.lit(default))
