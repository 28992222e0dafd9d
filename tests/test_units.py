"""Problem 4."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proseframe.operators import units as U

CASES = [
    ("8.883", "ML, thousands", 8883.0, "ML"), ("about 888.79 crore litreѕ in 1999", None, 8887.9e6, "l"), ("2002: 8.8879 thousand ML", None, 8887.9, "ML"), ("Table 9 gives €579,000 k for 2024", None, 579e6, "EUR"),
    ("roughly 6.9365MW", None, 6.9365, "MW"), ("98,25,60,00,000 imperial gallons", None, 98256000000.0, "imp_gal"), ("about S$8.06462 × 10^7 in 2014", None, 8.06462e7, "SGD"), ("BDT 95.69bn across 6 districts", None, 95.69e9, "BDT"),
    ("705.7 thousand pounds sterling", None, 705700.0, "GBP"), ("705.7 thousand pounds", None, 705700.0, "lb"), ("(73.94 deg. F, provisional)", None, 73.94, "F"), ("316.75 K", None, 316.75, "K"), ("１．０３７８８ ＴＷｈ", None, 1.03788, "TWh"),
    ("three thousand three hundred and nineteen million cubic metres", None, 3319e6, "m3"), ("445 740 000", "in cubic metres", 445740000.0, "m3"), ("see annex", "tonnes", None, None), ("tbc", None, None, None), ("12", None, None, None), ("", "t", None, None), (None, "t", None, None),
    ("1.1737e8", "USD", 1.1737e8, "USD"), ("107.4", "GBP m", 107.4e6, "GBP"), ("5", "INR L", 5e5, "INR"), ("5", "BDT cr", 5e7, "BDT"), ("5", "JPY '000", 5e3, "JPY"), ("181 thousan﻿d tonnes acro⁠ss 15 district‍s", None, 181e3, "t"), ("−4.5°C", None, -4.5, "C"), ("3.5E+06", "in long tons", 3.5e6, "long_ton"),
    ("about 3,5 km away", None, 3.5, "km"), ("1.234,5 kg", None, 1234.5, "kg"), ("1,234 kg", None, 1234.0, "kg"), ("12,34,567 kg", None, 1234567.0, "kg"), ("-3,25 km", None, -3.25, "km"), ("pages 3,4,5 and 7 kg", None, 7.0, "kg"), ("5 km and 7 kg", None, 5.0, "km"),
]


@pytest.mark.parametrize("text,note,number,unit", CASES)
def test_parse(text, note, number, unit):
    got = U.parse_quantity(text, note)
    assert (got is None and number is None) or (got[1] == unit and got[0] == pytest.approx(number))


def test_graph():
    c = U.compose_conversions(U.EDGES, U.CANONICAL.values())
    kind, a, b = c["F"]
    assert kind == "C" and 212 * a + b == pytest.approx(100) and 32 * a + b == pytest.approx(0)
    assert c["acre_ft"][1] == pytest.approx(1233.48184, rel=1e-6) and c["knot"][1] == pytest.approx(0.514444, rel=1e-5)
    assert set(U.SPELLINGS) - U.MONEY <= set(c)
    with pytest.raises(ValueError):
        U.compose_conversions([*U.EDGES, ("mile", "m", 1600, 0)], U.CANONICAL.values())
    with pytest.raises(ValueError):
        U.compose_conversions([*U.EDGES, ("m", "t", 1, 0)], U.CANONICAL.values())


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.one_of(st.none(), st.text(max_size=20)))
def test_any_text(text, note):
    got = U.parse_quantity(text, note)
    assert got is None or (isinstance(got[0], float) and isinstance(got[1], str))


def test_pairs_against_all(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        g = rng.choice([1, 1, 1, 2, 3, None])
        v = rng.choice([None, 0.0, float("nan"), -5.0 * rng.uniform(0.99, 1.01), 100 * 1.004 ** rng.randint(0, 9), 1e9 * rng.uniform(0.98, 1.02)])
        rows.append((i, g, rng.choice(["mass", "mass", "money"]), v))
    d = spark.createDataFrame(rows, "k long, g long, quantity_kind string, value double")
    d = d.union(d.limit(50))
    got = sorted((r["a"], r["b"]) for r in U.agreeing_pairs(d, "k", "g").collect())
    want = []
    for (i, g, q, v), (j, h, r, w) in itertools.combinations(rows, 2):
        if g is not None and g == h and q == r and v is not None and w is not None and v == v and w == w and (v > 0) == (w > 0) and (v < 0) == (w < 0):
            if max(abs(v), abs(w)) <= 1.01 * min(abs(v), abs(w)):
                want.append((i, j))
    assert got == sorted(want)


def test_table(spark):
    fx = spark.createDataFrame([("USD", 1.35), ("XTS", None), (None, 2.0)], "code string, to_sgd double")
    conv = U.conversion_table(spark, fx)
    d = spark.createDataFrame([(1, "US$2 million", None, "x"), (2, "about 2 t in 2002", None, "y"), (3, "EUR 5", None, None), (4, None, None, None), (5, "see", "t", None)], "id int, text string, unit_note string, value string")
    got = {r["id"]: (r["canonical_unit"], r["value"]) for r in U.with_quantities(d, conv).collect()}
    assert got == {1: ("SGD", pytest.approx(2.7e6)), 2: ("t", 2.0), 3: (None, None), 4: (None, None), 5: (None, None)}
    assert U.with_quantities(d.limit(0), conv).count() == 0


def test_every_quantity(spark):
    assert U.parse_quantities("5 km, then US$2 million and 7 kg in 2002", None) == [(5.0, "km"), (2e6, "USD"), (7.0, "kg")]
    d = spark.createDataFrame([(1, "5 km and 7 kg", None), (2, "none", None), (3, "12", "t")], "id int, text string, unit_note string")
    got = sorted((r["id"], r["value"]) for r in U.with_quantities(d, U.conversion_table(spark), every=True).na.fill(-1.0, ["value"]).collect())
    assert got == [(1, 0.007), (1, 5000.0), (2, -1.0), (3, 12.0)]


def test_rates_are_never_collected(spark):
    fx = spark.range(15_000).selectExpr("concat('X', id) AS code", "CAST(1 + id AS DOUBLE) AS to_sgd")
    conv = U.conversion_table(spark, fx.union(spark.createDataFrame([("usd ", 1.5), ("C", 9.0)], fx.schema)))
    got = {r["unit"]: (r["canonical"], r["kind"], r["a"]) for r in conv.where("unit IN ('X14999', 'USD', 'C')").collect()}
    assert got == {"X14999": ("SGD", "money", 15000.0), "USD": ("SGD", "money", 1.5), "C": ("C", "temperature", 1.0)}


def test_hot_series(spark):
    """A series of equal values gives one row for each key, and pairs of different values meet once."""
    d = spark.range(3000).selectExpr("id AS k", "1 AS g", "'mass' AS quantity_kind", "CASE WHEN id < 2990 THEN 100.0D WHEN id < 2999 THEN 100.5D ELSE 300.0D END AS value")
    got = {r["value"]: (r["same"], r["links"]) for r in U.agreement(d, "k", "g").select("value", "same", "links").distinct().collect()}
    assert got == {100.0: (2990, 9), 100.5: (9, 2990), 300.0: (1, 0)}
    assert U.agreement(d, "k", "g").count() == 3000
    assert U.agreeing_pairs(d.where("k >= 2980"), "k", "g").count() == 19 * 18 // 2
