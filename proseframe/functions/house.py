"""House rules that exist only as written instructions: spacing, dates, year spans, initials, subscripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"


def spacing(text: Column) -> Column:
    """One space between words, none before punctuation."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<=\S) {2,}", " "), r" +([,.;:!?])(?!\S*\d)", "$1")


def dates(text: Column) -> Column:
    """"31st December, 2023" as "31 December 2023"."""
    return F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}_])(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTH}),?\s+(\d{{4}})", "$1 $2 $3")


def year_spans(text: Column) -> Column:
    """"1914-18" and "1914 - 1918" with an en dash and no spaces."""
    return F.regexp_replace(text, r"(?<![\p{L}\p{N}_\-])((?:1[5-9]|20)\d{2})\s*-\s*((?:1[5-9]|20)?\d{2})(?![\p{L}\p{N}_\-])", "$1–$2")


def initials(text: Column) -> Column:
    """"J K Smith" as "J. K. Smith"."""
    return F.regexp_replace(text, r"(?<![\p{L}\p{N}_.])([A-Z])(?=\s+(?:[A-Z]\.?\s+)*[A-Z][a-z]+)(?<!\bA)(?<!\bI)", "$1.")


def plain_subscripts(text: Column) -> Column:
    """"CO₂" as "CO2"."""
    return F.translate(text, "₀₁₂₃₄₅₆₇₈₉", "0123456789")


def in_scientific_context(text: Column, start: Column, end: Column, reach: int = 6) -> Column:
    """Whether =, ≈ or ± stands within reach of the place [start, end), counted from 0."""
    a = F.greatest(start - reach, F.lit(0))
    return text.substr((a + 1).cast("int"), (end + reach - a).cast("int")).rlike("[=≈±]")
