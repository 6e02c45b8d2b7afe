"""``*`` / ``?`` name patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and messages of a pattern check.
MAX_PATTERN_LENGTH = 100
FORBIDDEN_CHARACTERS = "[<>|&;`$]"
EMPTY_MESSAGE = "Pattern cannot be empty"
TOO_LONG_MESSAGE = "Pattern is too long (max 100 characters)"
FORBIDDEN_MESSAGE = "Pattern contains invalid characters"


def pattern_regex(pattern: str) -> str:
    """Regex body of one literal pattern."""
    pieces = {"*": ".*", "?": "."}
    return "".join(pieces.get(ch) or re.escape(ch) for ch in pattern)


def matches_any(name: Column, patterns: list[str]) -> Column:
    """Case-insensitive full match of any pattern; an empty list matches everything."""
    if not patterns:
        return F.lit(True)
    return name.rlike(r"(?i)\A(?:" + "|".join(pattern_regex(p) for p in patterns) + r")\z")


def pattern_list(text: Column) -> Column:
    """Comma list to trimmed, non-empty patterns (an empty array for NULL or blank text)."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p))
    return F.filter(pieces, lambda p: p != "")


def column_like(pattern: Column) -> Column:
    """The ``ILIKE`` form of a pattern held in a column."""
    return F.translate(F.regexp_replace(pattern, r"([%_\\])", r"\\$1"), "*?", "%_")


def validation_message(pattern: Column) -> Column:
    """Error text of a pattern, NULL when it is usable."""
    return (
        F.when(pattern.isNull() | (F.trim(pattern) == ""), EMPTY_MESSAGE)
        .when(F.length(pattern) > MAX_PATTERN_LENGTH, TOO_LONG_MESSAGE)
        .when(pattern.rlike(FORBIDDEN_CHARACTERS), FORBIDDEN_MESSAGE)
    )
