"""Building blocks over text columns: replacing with a function, splitting into matches and gaps, fixed lookups."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A word in any script. Java's \w is ASCII unless (?U) is given.
WORD = r"[\p{L}\p{N}_]+"


def lit_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lit_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value computed once, however often fn uses it: rules in a chain would otherwise double their work at every step."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def replace_each(text: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """The text with fn(match) for every match of the pattern, or the match itself where that is null; stays in the JVM."""

    def change(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: F.coalesce(fn(m), m))
        joined = F.array_join(F.zip_with(F.split(t, pattern, -1), found, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
        return F.when(t.rlike(pattern), joined).otherwise(t)

    return let(text, change)


def outside(text: Column, protected: str, fn: Callable[[Column], Column]) -> Column:
    """fn applied to the gaps between matches of the protected pattern; the matches stay as they are."""

    def change(t: Column) -> Column:
        kept = F.regexp_extract_all(t, F.lit(protected), F.lit(0))
        joined = F.array_join(F.zip_with(F.transform(F.split(t, protected, -1), fn), kept, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
        return F.when(t.isNull(), t).otherwise(joined)

    return let(text, change)


def with_text(df: DataFrame, fn: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """df with fn applied to its text column; nulls stay null."""
    return df.withColumn(text, F.when(F.col(text).isNotNull(), fn(F.col(text))))


def count_matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.lit(0))


def words(text: Column) -> Column:
    """All words in any script."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def replace_first(text: Column, pattern: str, replacement: Column) -> Column:
    """Replaces the first match only."""
    at = F.regexp_instr(text, F.lit(pattern))
    hit = F.regexp_extract(text, pattern, 0)
    return F.when(at > 0, F.concat(text.substr(F.lit(1), at - 1), replacement, text.substr(at + F.length(hit), F.length(text)))).otherwise(text)


def normalise_spaces(text: Column) -> Column:
    """Thin and no-break spaces as plain ones."""
    return F.translate(text, "\u2009\u00a0", "  ")


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """NFC. Spark has no expression for it; ASCII never leaves the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _composed(text)).otherwise(text)


def xml_safe(text: Column) -> Column:
    """A text fit for XML: composed, and xml_safe_controls."""
    return xml_safe_controls(composed(text))


def xml_safe_controls(text: Column) -> Column:
    """Vertical tab and form feed as line ends; other control characters and non-characters dropped."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x0B\x0C]", "\n"), r"[\x00-\x08\x0E-\x1F￾￿]", "")


def normalise_key(text: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def is_acronym_ratio(token: Column) -> Column:
    """More than one character, at least four fifths of them capitals."""
    return (F.length(token) > 1) & (F.length(F.regexp_replace(token, r"[^\p{Lu}]", "")) / F.length(token) >= 0.8)


def is_acronym_short(token: Column) -> Column:
    """No space, letters all capitals, at most 15 characters."""
    t = F.trim(token)
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    return (~t.contains(" ")) & (F.length(letters) > 0) & (F.upper(letters) == letters) & (F.length(t) <= 15)
