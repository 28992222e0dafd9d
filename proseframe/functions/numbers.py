"""House style for numbers, percentages, ranges, temperatures and units, as column expressions.

The order in a pipeline matters: ranges before percentages, percentages before single digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, lit_array, lit_map, outside, replace_each

# Number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = ["", "", *"twenty thirty forty fifty sixty seventy eighty ninety".split()]
STYLES = ("hyphen", "long", "and", "space")
#: What may not touch a digit that is to be spelt.
TOUCH = r"\p{L}\p{N}_./:\-§"
# Words after a decimal that aren't units.
NOT_UNITS = ("per", "percent", "of", "million", "billion", "thousand", "is", "are", "and", "to", "in", "degree", "degrees")


def _at(words: list[str], i: Column) -> Column:
    return F.element_at(lit_array(words), (i + 1).cast("int"))


def _div(n: Column, k: int) -> Column:
    return F.floor(n / k).cast("long")


def _below_100(n: Column, join: str) -> Column:
    rest = n % 10
    return F.when(n < 20, _at(ONES, F.least(n, F.lit(19)))).otherwise(F.concat(_at(TENS, F.least(_div(n, 10), F.lit(9))), F.when(rest == 0, F.lit("")).otherwise(F.concat(F.lit(join), _at(ONES, rest)))))


def _below_1000(n: Column, join: str, after_hundred: str) -> Column:
    h, rest = _div(n, 100), n % 100
    return F.when(n < 100, _below_100(n, join)).otherwise(F.concat(_at(ONES, F.least(h, F.lit(9))), F.lit(" hundred"), F.when(rest == 0, F.lit("")).otherwise(F.concat(F.lit(after_hundred), _below_100(rest, join)))))


def int_words(n: Column, style: str = "hyphen") -> Column:
    """A whole number in words. Beyond a style's range the digits stay.

    hyphen: 0 to 99, "twenty-five". long: 0 to 999 999 999 999, "one thousand two hundred five".
    and: 0 to 999, "two hundred and five". space: up to 999 999 either way of zero, "minus twenty five".
    """
    return let(n.cast("long"), lambda m: _int_words(m, style))


def _int_words(n: Column, style: str) -> Column:
    digits = n.cast("string")
    if style == "hyphen":
        return F.when((n >= 0) & (n < 100), _below_100(n, "-")).otherwise(digits)
    if style == "and":
        return F.when((n >= 0) & (n < 1000), _below_1000(n, "-", " and ")).otherwise(digits)
    if style == "space":
        m = F.abs(n)
        k, rest = _div(m, 1000), m % 1000
        words = F.when(m < 1000, _below_1000(m, " ", " ")).otherwise(F.concat(_below_1000(k, " ", " "), F.lit(" thousand"), F.when(rest == 0, F.lit("")).otherwise(F.concat(F.lit(" "), _below_1000(rest, " ", " ")))))
        return F.when(m > 999_999, digits).otherwise(F.concat(F.when(n < 0, F.lit("minus ")).otherwise(F.lit("")), words))
    if style == "long":
        parts = []
        for size, name in ((10**9, "billion"), (10**6, "million"), (10**3, "thousand")):
            k = _div(n, size) % 1000
            parts.append(F.when(k > 0, F.concat(_below_1000(k, "-", " "), F.lit(f" {name}"))))
        rest = n % 1000
        parts.append(F.when((rest > 0) | (n == 0), _below_1000(rest, "-", " ")))
        return F.when((n >= 0) & (n < 10**12), F.concat_ws(" ", *parts)).otherwise(digits)
    raise ValueError(f"style must be one of {STYLES}")


def decimal_words(token: Column) -> Column:
    """"1.5" as "one point five", ".5" as "zero point five", "-2.25" as "minus two point two five"."""
    bare = F.regexp_replace(token, r"^[-−]", "")
    whole, part = F.split_part(bare, F.lit("."), F.lit(1)), F.split_part(bare, F.lit("."), F.lit(2))
    digits = F.transform(F.regexp_extract_all(part, F.lit(r"\d"), F.lit(0)), lambda d: _at(ONES, d.cast("int")))
    return F.concat(F.when(token.rlike(r"^[-−]"), F.lit("minus ")).otherwise(F.lit("")), F.when(whole == "", F.lit("zero")).otherwise(int_words(whole.try_cast("long"))), F.lit(" point "), F.array_join(digits, " "))


WORD_VALUES = {w: i for i, w in enumerate(ONES)} | {w: 10 * i for i, w in enumerate(TENS) if w}


def words_to_int_99(words: Column) -> Column:
    """Words up to ninety-nine as a number, null if unknown."""
    m = lit_map(WORD_VALUES)

    def value(w: Column) -> Column:
        tens, ones = F.element_at(m, F.split_part(w, F.lit("-"), F.lit(1))), F.element_at(m, F.split_part(w, F.lit("-"), F.lit(2)))
        return F.when(~w.contains("-"), F.element_at(m, w)).when((tens >= 20) & (ones < 20), tens + ones)

    return let(F.lower(F.trim(words)), value)


def words_to_int(words: Column) -> Column:
    """Words with hundred and thousand as a number; null if any word isn't a number."""
    m = lit_map(WORD_VALUES | {"hundred": 100, "thousand": 1000})
    tokens = F.filter(F.split(F.lower(F.trim(words)), r"[\s-]+"), lambda t: t != "and")
    values = F.transform(tokens, lambda t: F.element_at(m, t))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("part"))
    step = lambda acc, v: F.struct(
        F.when(v == 1000, acc["total"] + F.greatest(acc["part"], F.lit(1)) * 1000).otherwise(acc["total"]).alias("total"),
        F.when(v == 1000, F.lit(0)).when(v == 100, F.greatest(acc["part"], F.lit(1)) * 100).otherwise(acc["part"] + v).alias("part"),
    )
    return F.when(F.exists(values, lambda v: v.isNull()) | (F.size(tokens) == 0), F.lit(None)).otherwise(F.aggregate(values, start, step, lambda acc: acc["total"] + acc["part"]))


def words_to_numerals(text: Column) -> Column:
    """Number words of ten or more as numerals; smaller ones stay."""
    units, teens, tens = "|".join(ONES[:10]), "|".join(ONES[10:]), "|".join(TENS[2:])
    below = rf"(?:(?:{tens})(?:[\s-](?:{'|'.join(ONES[1:10])}))?|{teens}|{units})"
    pattern = rf"(?i)\b{below}(?:\s+hundred(?:\s+(?:and\s+)?{below})?)?(?:\s+thousand(?:\s+{below}(?:\s+hundred(?:\s+(?:and\s+)?{below})?)?)?)?\b"
    return replace_each(text, pattern, lambda m: let(words_to_int(m), lambda n: F.when(n >= 10, n.cast("string")).otherwise(m)))


def spell_digits(text: Column) -> Column:
    """Single digits that stand alone, in words."""
    return replace_each(text, rf"(?<![{TOUCH}])[0-9](?![{TOUCH}])", lambda d: _at(ONES[:10], d.cast("int")))


def _small(n: Column) -> Column:
    return let(n.cast("int"), lambda k: F.when(k < 10, _at(ONES[:10], F.least(k, F.lit(9)))).otherwise(k.cast("string")))


def ranges_to_words(text: Column) -> Column:
    """"3-4%" as "three to four per cent", "12–15" as "12 to 15"."""
    say = lambda m: F.concat(_small(F.regexp_extract(m, r"^(\d+)", 1)), F.lit(" to "), _small(F.regexp_extract(m, r"[-–]\s*(\d+)", 1)))
    text = replace_each(text, r"(?<![\d.,\p{L}/:\-–])\d{1,3}\s*[-–]\s*\d{1,3}\s*[%％](?![\p{L}\p{N}_])", lambda m: F.concat(say(m), F.lit(" per cent")))
    return replace_each(text, r"(?<![\d.,\p{L}/:\-–])\d{1,3}\s*[-–]\s*\d{1,3}(?![\d\-–/]|[.,]\d|\s*[%％])", say)


def percent_symbol(text: Column) -> Column:
    """"5%" as "5 per cent", "30%YoY" as "30 per cent YoY"; decimals keep the sign."""
    text = F.regexp_replace(text, r"(?<![\d.,])(\d{1,3}(?:,\d{3})*)\s*[%％]([A-Za-z])", "$1 per cent $2")
    return F.regexp_replace(text, r"(?<![\d.,])(\d{1,3}(?:,\d{3})*)\s*[%％](?![\p{L}\p{N}_])", "$1 per cent")


def percent_word(text: Column) -> Column:
    """"5 percent", "5.25percent" as "5 per cent", "5.25 per cent"."""
    return F.regexp_replace(text, r"(?i)(?<![\p{L}\p{N}_§])(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\.\d+)\s*percent(?![\p{L}\p{N}_])", "$1 per cent")


def percent_word_number(text: Column) -> Column:
    """"twenty-five percent" as "25 per cent"."""
    words = "|".join(ONES) + "|(?:" + "|".join(TENS[2:]) + ")(?:-(?:" + "|".join(ONES[1:10]) + "))?"
    return replace_each(text, rf"(?i)(?<![\p{{L}}\p{{N}}_-])(?:{words})\s*percent(?![\p{{L}}\p{{N}}_])", lambda m: F.concat(words_to_int_99(F.regexp_replace(m, r"(?i)\s*percent$", "")).cast("string"), F.lit(" per cent")))


def temperatures(text: Column, style: str = "Degree") -> Column:
    """"1.5°C" as "1.5 Degree Celsius"; style "degrees" gives "1.5 degrees Celsius" and "1 degree Celsius"."""
    number = r"(?<![\p{L}\p{N}_\-])[+\-−]?\d+(?:\.\d+)?"
    pattern = rf"{number}\s*°\s*[CFcf](?![\p{{L}}\p{{N}}_])"
    value = lambda m: F.regexp_extract(m, r"^([+\-−]?\d+(?:\.\d+)?)", 1)
    if style == "Degree":
        word = lambda m: F.lit(" Degree ")
    else:
        word = lambda m: F.when(F.abs(F.regexp_replace(value(m), "−", "-").cast("double")) == 1, F.lit(" degree ")).otherwise(F.lit(" degrees "))
    return replace_each(text, pattern, lambda m: F.concat(value(m), word(m), F.when(m.rlike("(?i)c$"), F.lit("Celsius")).otherwise(F.lit("Fahrenheit"))))


def decimals_to_words(text: Column) -> Column:
    """Decimals in words unless a percentage or temperature follows."""
    pattern = rf"(?i)(?<![{TOUCH}])(?:\d+\.\d+|\.\d+)(?!\.\d)(?![{TOUCH}]*[\p{{L}}\p{{N}}_/:\-§])(?!\s*(?:per\s*cent|percent|%|％|°\s*[CF]|[CF]\b|degrees?\s+(?:celsius|fahrenheit)))"
    return replace_each(text, pattern, decimal_words)


def sentence_start_numbers(text: Column, style: str = "hyphen") -> Column:
    """A whole number that begins a line or sentence, in words with a capital; those the style has no words for keep their digits."""
    pattern = r"(?m)(?:^|(?<=[.!?])\s+)\d{1,3}(?:,\d{3})*(?![\d\p{L}_]|[.,]\d|\s*[-–%])"

    def say(m: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(m, r"\s+", ""), ",", "")
        shown = lambda w: F.when(w == bare, F.regexp_replace(m, r"^\s+", "")).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000)))
        return F.concat(F.regexp_extract(m, r"^(\s*)", 1), let(int_words(bare.try_cast("long"), style), shown))

    return replace_each(text, pattern, say)


def plural_units(text: Column) -> Column:
    """"1.25 metre" as "1.25 metres"; words that aren't units stay."""
    no = "|".join(NOT_UNITS)
    pattern = rf"(?i)(?<![\p{{L}}\p{{N}}_.])\d+\.\d+\s+(?!(?:{no})\b)[A-Za-z]+\b"
    return replace_each(text, pattern, lambda m: F.when((F.regexp_extract(m, r"^([\d.]+)", 1).cast("double") > 1) & ~m.rlike("(?i)s$"), F.concat(m, F.lit("s"))).otherwise(m))


def fraction_verb(text: Column) -> Column:
    """"1.25 metres is" as "1.25 metres are" above one."""
    return replace_each(text, r"(?<![\p{L}\p{N}_.,])\d+(?:\.\d+)?\s+[A-Za-z]+\s+is\b", lambda m: F.when(F.regexp_extract(m, r"^([\d.]+)", 1).cast("double") > 1, F.regexp_replace(m, r"is$", "are")).otherwise(m))


def number_rules(text: Column, quotes: str | None = None) -> Column:
    """Ranges, percentages, temperatures, decimals, digits and sentence starts, in this order."""

    def rules(t: Column) -> Column:
        for f in (ranges_to_words, percent_symbol, percent_word, percent_word_number, temperatures, decimals_to_words, spell_digits):
            t = f(t)
        return t

    return sentence_start_numbers(outside(text, quotes, rules) if quotes else rules(text))
