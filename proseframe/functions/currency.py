"""House style for currency amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import lit_map, replace_each

# Codes and the signs they become.
SYMBOLS = {"GBP": "£", "EUR": "€", "JPY": "¥", "SGD": "S$", "USD": "US$", "INR": "₹"}
CODE_OF = {v: k for k, v in SYMBOLS.items()} | {"$": "USD"}
SIGN = r"(?:US\$|S\$|€|£|¥|₹)"
AMOUNT = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
#: A currency amount that rules for plain numbers must not touch.
SPAN = rf"(?i){SIGN}\s?\d[\d,]*(?:\.\d+)?(?:\s+(?:million|billion))?"


def currency_symbols(text: Column) -> Column:
    """"usd 5" as "US$5", one space before million and billion, none after the sign. HK$5 and the like stay."""
    for code, sign in SYMBOLS.items():
        text = F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}_]){code}\s*(\d)", sign.replace("$", r"\$") + "$1")
    text = F.regexp_replace(text, r"(?<=[€£¥₹]|(?<![A-Za-z])(?:U?S)\$)\s+(?=\d)", "")
    return F.regexp_replace(text, rf"(?i)({SIGN}(?:{AMOUNT}))\s*(million|billion)\b", "$1 $2")


def codes_in(text: Column) -> Column:
    """Currency codes in a text, in the order of first mention."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(?<![\p{L}\p{N}_$])(?:US\$|S\$|\$|€|£|¥|₹|(?:GBP|EUR|JPY|SGD|USD|INR)(?![\p{L}]))(?=\s*\d)"), F.lit(0))
    m = lit_map(CODE_OF | {k: k for k in SYMBOLS})
    return F.array_distinct(F.transform(found, lambda x: F.element_at(m, F.upper(x))))


def add_sgd(df: DataFrame, fx: DataFrame, text: str = "text") -> DataFrame:
    """with_sgd over a text column by the table fx(code, to_sgd). Only the currencies that have a sign can be met, so at most as many rates are read, one for each."""
    rates = fx.where(F.col("code").isin(*SYMBOLS) & (F.col("to_sgd") > 0)).groupBy("code").agg(F.max("to_sgd").cast("decimal(18,8)").alias("r")).collect()
    m = F.create_map(*[x for c, r in sorted(map(tuple, rates)) for x in (F.lit(c), F.lit(r).cast("decimal(18,8)"))]) if rates else F.lit(None).cast("map<string,decimal(18,8)>")
    return df.withColumn(text, with_sgd(F.col(text), m))


def with_sgd(text: Column, rates: Column) -> Column:
    """Adds "(S$x)" after each amount that isn't in Singapore dollars and isn't converted already; rates is a map of code -> decimal rate.

    Two decimals and thousands commas; a scale word stays a scale word; without a rate the amount stays.
    """
    pattern = rf"(?i)(?<![\p{{L}}\p{{N}}_$])(?:US\$|S\$|€|£|¥|₹)(?:{AMOUNT})(?:\s+(?:million|billion))?(?!\d|,\d|\.\d|\s*\(S\$\s?\d)"
    code = lit_map(CODE_OF)

    def one(m: Column) -> Column:
        sign = F.upper(F.regexp_extract(m, rf"(?i)^({SIGN})", 1))
        value = F.regexp_replace(F.regexp_extract(m, rf"({AMOUNT})", 1), ",", "").try_cast("decimal(20,6)")
        rate = F.element_at(rates, F.element_at(code, sign))
        scale = F.lower(F.regexp_extract(m, r"(?i)(\s+(?:million|billion))$", 1))
        add = F.concat(F.lit(" (S$"), F.format_number(F.round(value * rate, 2), 2), F.regexp_replace(scale, r"^\s+", " "), F.lit(")"))
        return F.when((sign == "S$") | rate.isNull(), m).otherwise(F.concat(m, add))

    return replace_each(text, pattern, one)
