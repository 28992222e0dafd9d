"""Spans of a text that rules must leave alone: finding, merging, masking and working around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .currency import SPAN
from .text import count_matches, outside

# What is protected, as Java patterns.
CODE_FENCE = r"(?s)```.*?\n.*?```"
QUOTED = r'"[^"\n]*"|“[^”\n]*”|(?<![\p{L}\p{N}_])\'[^\'\n]*\'(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])‘[^’\n]*’(?![\p{L}\p{N}_])'
HTML_TAGS = ("table", "thead", "tbody", "tfoot", "tr", "header", "footer", "figure")
HTML_BLOCK = "(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in HTML_TAGS)
HTML_IMAGE = r"(?is)<img\b[^>]*>"
MD_HEADING = r"(?m)^#{1,6}\s.*$|^[^\n]+\n(?:=+|-{3,})[ \t]*$"
MD_IMAGE = r"(?s)!\[[^\]]*\]\([^)]+\)"
MD_NOTE = r"(?m)^\[\^[^\]]+\]:[^\n]*\n(?:[ \t].*\n)*"
PLACEHOLDER = r"§FOOTNOTE:[^§]+§|FN_PLACEHOLDER[^§\n]*"
STARRED = r"(?s)\*\*.*?\*\*|\*(?!\*).*?\*"
PAR_MARK = r"<<par>>"
PATTERNS = {
    "code": CODE_FENCE, "quote": QUOTED, "html": HTML_BLOCK, "image_tag": HTML_IMAGE, "heading": MD_HEADING, "md_image": MD_IMAGE,
    "md_note": MD_NOTE, "placeholder": PLACEHOLDER, "starred": STARRED, "par": PAR_MARK, "currency": SPAN,
}
#: Everything protected in one alternation, so that overlapping finds can't disagree. Scoped flags keep the parts apart.
def _scoped(p: str) -> str:
    if p.startswith("(?") and ")" in p and p[2] in "ismx":
        flags, rest = p[2 : p.index(")")], p[p.index(")") + 1 :]
        return f"(?{flags}:{rest})"
    return f"(?:{p})"


PROTECTED = "|".join(_scoped(PATTERNS[k]) for k in ("code", "html", "image_tag", "heading", "md_image", "md_note", "placeholder", "par", "starred", "quote"))


def span_counts(text: Column) -> dict[str, Column]:
    """How many spans of each kind a text has. A cheap test for the opening character comes first."""
    guard = {"code": "```", "html": "<", "image_tag": "<", "md_image": "![", "md_note": "[^", "par": "<<", "starred": "*", "placeholder": "F"}
    return {k: F.when(text.contains(guard[k]), count_matches(text, p)).otherwise(F.lit(0)) if k in guard else count_matches(text, p) for k, p in PATTERNS.items()}


def spans(text: Column, pattern: str) -> Column:
    """Half-open spans [s, e) of a pattern, counted from 0, as an array of structs in order."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["g"]) + F.length(x["m"])).cast("int").alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["g"])).cast("int").alias("s"), (acc["at"] + F.length(x["g"]) + F.length(x["m"])).cast("int").alias("e")))).alias("out"),
    )
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def merge_spans(array: Column) -> Column:
    """Overlapping and touching spans of an array joined."""
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when(F.size(acc) == 0, F.array(x)).when(x["s"] <= last["e"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(array), empty, step)


def contains_place(array: Column, place: Column) -> Column:
    """Whether a place lies in any span."""
    return F.exists(array, lambda x: (x["s"] <= place) & (place < x["e"]))


def token_letters(i: Column) -> Column:
    """0, 1, .. 25, 26 .. as a, b, .. z, aa ..: letters, so that rules for digits can't touch a token."""
    one = lambda k: F.char((97 + k).cast("int"))
    first = F.floor(i / 26).cast("int")
    second = F.floor((first - 1) / 26).cast("int")
    return F.when(i < 26, one(i)).when(i < 702, F.concat(one(first - 1), one(i % 26))).otherwise(F.concat(one(second - 1), one((first - 1) % 26), one(i % 26)))


def mask(text: Column, pattern: str, tag: str) -> tuple[Column, Column]:
    """The text with every match replaced by §TAG§letters§, and the array of what was there."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tokens = F.transform(found, lambda m, i: F.concat(F.lit(f"§{tag}§"), token_letters(i), F.lit("§")))
    return F.array_join(F.zip_with(gaps, tokens, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), ""), found


def unmask(text: Column, bucket: Column, tag: str) -> Column:
    """Puts back what mask took out."""
    pairs = F.transform(bucket, lambda v, i: F.struct(F.concat(F.lit(f"§{tag}§"), token_letters(i), F.lit("§")).alias("t"), v.alias("v")))
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["t"], p["v"]))


def outside_quotes(text: Column, fn: Callable[[Column], Column]) -> Column:
    return outside(text, QUOTED, fn)


def outside_protected(text: Column, fn: Callable[[Column], Column]) -> Column:
    return outside(text, PROTECTED, fn)


def is_table_or_figure_line(line: Column) -> Column:
    """Two or more bars or tabs, a caption word at the start, or a rule between a table's rows."""
    n = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    caption = line.rlike(r"(?i)^\s*(?:(?:Table|Figure|Chart|Exhibit)(?![\p{L}\p{N}_])|Fig\.)")
    return (n("|") >= 2) | (n("\t") >= 2) | caption | line.rlike(r"^\s*\|? *-+ *(?:\| *-+ *)+\|?\s*$")


def by_line(text: Column, fn: Callable[[Column], Column]) -> Column:
    """fn applied to every line that isn't a table or figure line."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.when(is_table_or_figure_line(line), line).otherwise(fn(line))), "\n")
