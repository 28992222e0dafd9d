"""Rules on literal pairs."""

import pytest
from pyspark.sql import functions as F

from proseframe.functions import currency, house, numbers, protect, spelling, text

RATES = "map('USD', cast(1.35 as decimal(18,8)), 'EUR', cast(1.46 as decimal(18,8)))"


def run(spark, fn, value):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("o")).first()["o"]


PAIRS = [
    (numbers.spell_digits, "5 projects", "five projects"), (numbers.spell_digits, "12 projects", "12 projects"), (numbers.spell_digits, "1.5 and US$5", "1.5 and US$five"), (numbers.spell_digits, "é5 and 5-6 v1.2", "é5 and 5-6 v1.2"),
    (numbers.sentence_start_numbers, "10 projects were funded", "Ten projects were funded"), (numbers.sentence_start_numbers, "Yes. 3 left. 25 firms", "Yes. Three left. Twenty-five firms"), (numbers.sentence_start_numbers, "1,234 stay", "1,234 stay"), (numbers.sentence_start_numbers, "3.5 stay", "3.5 stay"),
    (numbers.fraction_verb, "1.25 metres is needed", "1.25 metres are needed"), (numbers.fraction_verb, "0.5 litre is left", "0.5 litre is left"),
    (numbers.percent_symbol, "5% of", "5 per cent of"), (numbers.percent_symbol, "30%YoY", "30 per cent YoY"), (numbers.percent_symbol, "3.25%", "3.25%"), (numbers.percent_symbol, "1,200%", "1,200 per cent"),
    (numbers.percent_word, "5 percent", "5 per cent"), (numbers.percent_word, "6.4percent.", "6.4 per cent."), (numbers.percent_word, "percentage", "percentage"),
    (numbers.percent_word_number, "twenty-five percent", "25 per cent"), (numbers.percent_word_number, "ninety percent", "90 per cent"),
    (numbers.ranges_to_words, "3-4%", "three to four per cent"), (numbers.ranges_to_words, "3–4 and 12-15", "three to four and 12 to 15"), (numbers.ranges_to_words, "2019-20", "2019-20"), (numbers.ranges_to_words, "1-2-3", "1-2-3"),
    (numbers.temperatures, "1.5°C", "1.5 Degree Celsius"), (numbers.temperatures, "98 °f.", "98 Degree Fahrenheit."), (numbers.temperatures, "−4°C", "−4 Degree Celsius"),
    (numbers.decimals_to_words, "rose 1.5 points", "rose one point five points"), (numbers.decimals_to_words, "6.4 per cent", "6.4 per cent"), (numbers.decimals_to_words, "1.5°C", "1.5°C"), (numbers.decimals_to_words, "v1.2.3", "v1.2.3"),
    (numbers.plural_units, "1.25 metre", "1.25 metres"), (numbers.plural_units, "12.25 per cent", "12.25 per cent"), (numbers.plural_units, "0.5 metre", "0.5 metre"),
    (numbers.words_to_numerals, "five of twenty five and two hundred and six", "five of 25 and 206"),
    (currency.currency_symbols, "usd 5 and HK$5", "US$5 and HK$5"), (currency.currency_symbols, "US$ 2million", "US$2 million"), (currency.currency_symbols, "S$300", "S$300"),
    (spelling.british, "organize color; realization", "organise colour; realisation"), (spelling.british, "capsize and Prize", "capsize and Prize"), (spelling.british, "The World Health Organization", "The World Health Organization"), (spelling.british, "COLOR Color", "COLOUR Colour"),
    (spelling.consistent_foreign, "Uluma, SHIAH, shi'a", "Ulema, SHIA, shia"),
    (lambda c: protect.outside_quotes(c, numbers.percent_symbol), "India's 5% and Nepal's 5%, “5%”", "India's 5 per cent and Nepal's 5 per cent, “5%”"),
    (lambda c: protect.outside_protected(c, numbers.spell_digits), '*5* "5" <<par>> 5', '*5* "5" <<par>> five'),
    (lambda c: protect.by_line(c, numbers.percent_symbol), "a 5%\n| 5% | b |\nTable 1: 5%", "a 5 per cent\n| 5% | b |\nTable 1: 5%"),
    (numbers.number_rules, "12.25 per cent of 5%", "12.25 per cent of five per cent"), (text.xml_safe_controls, "a\x0bb\x01c￾", "a\nbc"),
]


def test_pairs(spark):
    wrong = []
    for fn, given, want in PAIRS:
        got = run(spark, fn, given)
        if got != want:
            wrong.append((given, got, want))
    assert not wrong


@pytest.mark.parametrize("given,want", [("US$100", "US$100 (S$135.00)"), ("US$2 million", "US$2 million (S$2.70 million)"), ("₹500", "₹500"), ("S$5", "S$5"), ("US$100 (S$135)", "US$100 (S$135)"), ("€1,000.50 now", "€1,000.50 (S$1,460.73) now")])
def test_sgd(spark, given, want):
    assert run(spark, lambda c: currency.with_sgd(c, F.expr(RATES)), given) == want


@pytest.mark.parametrize("fn,given,want", [
    (house.dates, "31st December, 2023", "31 December 2023"), (house.year_spans, "1914-18 and 1914 - 1918, 2024-07-19", "1914–18 and 1914–1918, 2024-07-19"), (house.spacing, "Hello ,  there", "Hello, there"), (house.spacing, "in .5 of", "in .5 of"),
    (house.initials, "J K Smith and A Man", "J. K. Smith and A Man"), (house.plain_subscripts, "CO₂", "CO2"),
])
def test_house(spark, fn, given, want):
    assert run(spark, fn, given) == want


def test_null_and_empty(spark):
    for fn in (numbers.number_rules, currency.currency_symbols, spelling.british, lambda c: protect.outside_protected(c, numbers.spell_digits)):
        assert run(spark, fn, None) is None and run(spark, fn, "") == ""


def test_long_text(spark):
    t = "In 5 of 7 cases, 3-4% rose. " * 4000
    assert run(spark, numbers.number_rules, t).count("three to four per cent") == 4000


def test_int_words(spark):
    d = spark.createDataFrame([(n,) for n in (0, 5, 21, 99, 100, 105, 999, 1000, 12345, 10**6, -5)], "n long")
    got = d.select(*[numbers.int_words(F.col("n"), s).alias(s) for s in numbers.STYLES]).collect()
    assert [r["hyphen"] for r in got[:5]] == ["zero", "five", "twenty-one", "ninety-nine", "100"]
    assert got[5]["and"] == "one hundred and five" and got[5]["long"] == "one hundred five" and got[5]["space"] == "one hundred five"
    assert got[8]["space"] == "twelve thousand three hundred forty five" and got[8]["long"] == "twelve thousand three hundred forty-five"
    assert got[10]["space"] == "minus five" and got[10]["hyphen"] == "-5"


def test_mask_roundtrip_and_spans(spark):
    d = spark.createDataFrame([(' '.join(f'"q{i}"' for i in range(800)),), ("none",), ("",), (None,)], "t string")
    masked, bucket = protect.mask(F.col("t"), protect.QUOTED, "PROT")
    got = d.select(masked.alias("m"), bucket.alias("b"), protect.unmask(masked, bucket, "PROT").alias("back"), "t").collect()
    assert all(r["back"] == r["t"] for r in got)
    assert "§PROT§aa§" in got[0]["m"] and "§PROT§aaa§" in got[0]["m"] and len(set(got[0]["m"].split())) == 800
    s = spark.createDataFrame([([(5, 9), (0, 2), (2, 3), (8, 12)],)], "a array<struct<s:int,e:int>>").select(protect.merge_spans(F.col("a")).alias("m")).first()["m"]
    assert [tuple(x) for x in s] == [(0, 3), (5, 12)]


BRITISH = {
    "flavored": "flavoured", "Harbors": "Harbours", "RUMORS": "RUMOURS", "humorous": "humorous", "vigorous": "vigorous", "neighborhood": "neighbourhood", "theater": "theatre", "centered": "centred", "kilometers": "kilometres", "Somber": "Sombre", "analog": "analogue", "cataloging": "cataloguing",
    "offense": "offence", "defenseless": "defenceless", "canceled": "cancelled", "Labeling": "Labelling", "travelers": "travellers", "modeled": "modelled", "analyzed": "analysed", "Paralyze": "Paralyse", "fulfill": "fulfil", "gray": "grey", "skeptical": "sceptical", "maneuvers": "manoeuvres",
    "travel": "travel", "labels": "labels", "later": "later", "power": "power", "actor": "actor", "behavioral": "behavioural", "sense": "sense", "organize": "organise", "prize": "prize", "doctor": "doctor", "dialed": "dialled", "dialog": "dialogue",
}


def test_british_families(spark):
    d = spark.createDataFrame(list(BRITISH.items()), "us string, uk string")
    assert {r["us"]: r["w"] for r in d.select("us", spelling.british(F.col("us")).alias("w")).collect()} == BRITISH
