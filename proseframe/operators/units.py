"""Problem 4: the same quantity in different units and scales.

Units are the nodes of a graph, known conversions its edges, each an affine function
y = a * x + b. From every canonical unit a breadth-first search composes the shortest chain of
edges to each unit; every edge left over closes a cycle, which must give the identity. The
compositions form a small table (unit, canonical, a, b); quantities get their value in the
canonical unit by an equi-join with it on the unit they were stated in.

Defined results: a null or empty text, a text without a number, or without any unit (neither in
the text nor in the note), states no quantity and has a null value; a currency without a rate has
a null value; repeated rows are kept as they are by with_quantities and counted once by
agreeing_pairs; zero agrees with zero only; negative values agree by size with values of the same
sign; extra columns pass through with_quantities unchanged,
but for those named like its results, which are replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import deque
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import checked_broadcast
from .lineage import cut_lineage

# Conversions, (from, to, a, b): to = a * from + b. Several say the same by another way.
EDGES = [
    ("g", "kg", 0.001, 0), ("kg", "t", 0.001, 0), ("kt", "t", 1000, 0), ("quintal", "kg", 100, 0), ("quintal", "t", 0.1, 0), ("lb", "kg", 0.45359237, 0), ("oz", "lb", 1 / 16, 0), ("short_ton", "lb", 2000, 0), ("long_ton", "lb", 2240, 0), ("short_ton", "kg", 907.18474, 0), ("Mt", "t", 1e6, 0),
    ("km", "m", 1000, 0), ("cm", "m", 0.01, 0), ("mm", "cm", 0.1, 0), ("mile", "ft", 5280, 0), ("mile", "km", 1.609344, 0), ("ft", "m", 0.3048, 0), ("inch", "cm", 2.54, 0), ("ft", "inch", 12, 0), ("yd", "ft", 3, 0), ("nmi", "m", 1852, 0),
    ("ha", "m2", 10000, 0), ("km2", "ha", 100, 0), ("km2", "m2", 1e6, 0), ("sqmi", "km2", 2.589988110336, 0), ("acre", "sqmi", 1 / 640, 0), ("acre", "m2", 4046.8564224, 0), ("ft2", "m2", 0.09290304, 0),
    ("l", "m3", 0.001, 0), ("ML", "l", 1e6, 0), ("ML", "m3", 1000, 0), ("GL", "ML", 1000, 0), ("ft3", "m3", 0.028316846592, 0), ("acre_ft", "ft3", 43560, 0), ("us_gal", "l", 3.785411784, 0), ("imp_gal", "l", 4.54609, 0), ("km3", "m3", 1e9, 0), ("bbl", "us_gal", 42, 0),
    ("J", "kJ", 0.001, 0), ("kJ", "MJ", 0.001, 0), ("MJ", "GJ", 0.001, 0), ("GJ", "TJ", 0.001, 0), ("PJ", "TJ", 1000, 0), ("kWh", "MJ", 3.6, 0), ("MWh", "kWh", 1000, 0), ("MWh", "GJ", 3.6, 0), ("GWh", "MWh", 1000, 0), ("TWh", "GWh", 1000, 0), ("GWh", "TJ", 3.6, 0), ("Wh", "kWh", 0.001, 0),
    ("W", "kW", 0.001, 0), ("kW", "MW", 0.001, 0), ("GW", "MW", 1000, 0), ("TW", "GW", 1000, 0),
    ("kmh", "ms", 1 / 3.6, 0), ("mph", "kmh", 1.609344, 0), ("knot", "kmh", 1.852, 0), ("knot", "ms", 1852 / 3600, 0), ("fts", "ms", 0.3048, 0),
    ("K", "C", 1, -273.15), ("F", "C", 5 / 9, -160 / 9), ("F", "K", 5 / 9, 459.67 * 5 / 9),
]
#: kind of quantity -> its canonical unit
CANONICAL = {"mass": "t", "length": "m", "area": "m2", "volume": "m3", "energy": "MWh", "power": "MW", "speed": "ms", "temperature": "C", "money": "SGD"}

# How units are written. Case matters where a spelling has capitals and one letter or is an abbreviation.
SPELLINGS = {
    "g": "grams|gram|g", "kg": "kilograms|kilogram|kilogrammes|kgs|kg", "t": "metric tons|metric ton|tonnes|tonne|t", "kt": "kilotonnes|kilotonne|kt", "Mt": "megatonnes|megatonne|Mt", "quintal": "quintals|quintal", "lb": "pounds|pound|lbs|lb", "oz": "ounces|ounce|oz", "short_ton": "short tons|short ton", "long_ton": "long tons|long ton",
    "km": "kilometres|kilometre|kilometers|kilometer|kms|km", "m": "metres|metre|meters|meter|m", "cm": "centimetres|centimetre|cm", "mm": "millimetres|millimetre|mm", "mile": "miles|mile|mi", "ft": "feet|foot|ft", "inch": "inches|inch", "yd": "yards|yard|yd", "nmi": "nautical miles|nautical mile|nmi",
    "m2": "square metres|square metre|square meters|sq metres|sq m|m2|m²", "ha": "hectares|hectare|ha", "km2": "square kilometres|square kilometre|square kilometers|sq kilometres|sq. km|sq km|km2|km²", "sqmi": "square miles|square mile|sq miles|sq. mi|sq mi", "acre": "acres|acre", "ft2": "square feet|sq ft|ft2|ft²",
    "l": "litres|litre|liters|liter|l", "ML": "megalitres|megalitre|ML", "GL": "gigalitres|gigalitre|GL", "m3": "cubic metres|cubic metre|cubic meters|cu m|cu. m|m3|m³", "ft3": "cubic feet|cubic foot|cu ft|ft3|ft³", "acre_ft": "acre-feet|acre-foot|acre feet", "us_gal": "US gallons|US gallon", "imp_gal": "imperial gallons|imperial gallon", "km3": "cubic kilometres|km3|km³", "bbl": "barrels|barrel|bbl",
    "J": "joules|joule|J", "kJ": "kilojoules|kilojoule|kJ", "MJ": "megajoules|megajoule|MJ", "GJ": "gigajoules|gigajoule|GJ", "TJ": "terajoules|terajoule|TJ", "PJ": "petajoules|petajoule|PJ", "Wh": "watt-hours|watt-hour|Wh", "kWh": "kilowatt-hours|kilowatt-hour|kilowatt hours|kWh", "MWh": "megawatt-hours|megawatt-hour|megawatt hours|MWh", "GWh": "gigawatt-hours|gigawatt-hour|gigawatt hours|GWh", "TWh": "terawatt-hours|terawatt-hour|terawatt hours|TWh",
    "W": "watts|watt|W", "kW": "kilowatts|kilowatt|kW", "MW": "megawatts|megawatt|MW", "GW": "gigawatts|gigawatt|GW", "TW": "terawatts|terawatt|TW",
    "kmh": "kilometres per hour|kilometre per hour|kilometers per hour|km per hour|km/h|kmph|kph", "mph": "miles per hour|mile per hour|mi/h|mph", "knot": "knots|knot|kn", "ms": "metres per second|metre per second|meters per second|m per second|m/s", "fts": "feet per second|ft/s",
    "C": "degrees Celsius|degree Celsius|degrees C|deg. C|deg C|°C|° C|℃|Celsius", "F": "degrees Fahrenheit|degree Fahrenheit|degrees F|deg. F|deg F|°F|° F|℉|Fahrenheit", "K": "degrees kelvin|kelvins|kelvin|K",
    "USD": "US dollars|US dollar|U.S. dollars|USD|US$", "EUR": "euros|euro|EUR|€", "GBP": "pounds sterling|pound sterling|GBP|£", "INR": "Indian rupees|Indian rupee|INR|Rs.|Rs|₹", "JPY": "Japanese yen|yen|JPY|¥", "AUD": "Australian dollars|Australian dollar|AUD|A$", "CNY": "Chinese yuan|yuan|renminbi|RMB|CNY", "BDT": "Bangladeshi taka|taka|BDT|Tk.|Tk|৳", "LKR": "Sri Lankan rupees|Sri Lankan rupee|LKR", "NPR": "Nepali rupees|Nepalese rupees|Nepali rupee|NPR", "SGD": "Singapore dollars|Singapore dollar|SGD|S$",
}
# Scale words; those of SHORT count only beside a currency.
SCALES = {"hundred": 1e2, "hundreds": 1e2, "thousand": 1e3, "thousands": 1e3, "lakh": 1e5, "lakhs": 1e5, "million": 1e6, "millions": 1e6, "crore": 1e7, "crores": 1e7, "billion": 1e9, "billions": 1e9, "trillion": 1e12, "trillions": 1e12}
SHORT = {"'000": 1e3, "k": 1e3, "K": 1e3, "m": 1e6, "mn": 1e6, "mln": 1e6, "M": 1e6, "bn": 1e9, "bln": 1e9, "b": 1e9, "B": 1e9, "tn": 1e12, "L": 1e5, "lac": 1e5, "cr": 1e7, "Cr.": 1e7, "cr.": 1e7, "Cr": 1e7}
UNITS_AS_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())} | {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
LOOK_ALIKES = str.maketrans("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁΑΒΕΖΗΙΚΜΝΟΡΤΥΧονıɡ", "ABESIJKMHOPCTYXaesijopcyxhdABEZHIKMNOPTYXovig")
GONE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
MONEY = set("USD EUR GBP INR JPY AUD CNY BDT LKR NPR SGD".split())


def compose_conversions(edges: Iterable[tuple[str, str, float, float]], canonical: Iterable[str], tolerance: float = 1e-9) -> dict[str, tuple[str, float, float]]:
    """unit -> (canonical unit, a, b) by the fewest edges. Raises ValueError if two ways differ, or two canonical units are linked."""
    graph: dict[str, list[tuple[str, float, float]]] = {}
    edges = list(edges)
    for u, v, a, b in edges:
        if not (math.isfinite(a) and math.isfinite(b)) or a == 0:
            raise ValueError(f"no affine function from {u} to {v}")
        graph.setdefault(u, []).append((v, a, b))
        graph.setdefault(v, []).append((u, 1 / a, -b / a))
    found: dict[str, tuple[str, float, float]] = {}
    for root in canonical:
        if root in found:
            raise ValueError(f"{root} and {found[root][0]} are both canonical, but linked")
        found[root] = (root, 1.0, 0.0)
        todo = deque([root])
        while todo:
            u = todo.popleft()
            _, a, b = found[u]
            for v, ka, kb in graph.get(u, []):  # v = ka * u + kb, so u = (v - kb) / ka
                if v not in found:
                    found[v] = (root, a / ka, b - a * kb / ka)
                    todo.append(v)
    for u, v, a, b in edges:
        if u in found and v in found:
            (cu, au, bu), (cv, av, bv) = found[u], found[v]
            for x in (1.0, 250.0):
                one, two = au * x + bu, av * (a * x + b) + bv
                if cu != cv or abs(one - two) > tolerance * max(1.0, abs(one), abs(two)):
                    raise ValueError(f"the cycle through {u} and {v} isn't consistent: {one} and {two}")
    return found


def conversion_table(spark: SparkSession, fx: DataFrame | None = None) -> DataFrame:
    """(unit, canonical, kind, a, b). fx(code, to_sgd) adds a money edge for each positive rate; each leads
    straight to the canonical currency, so it is its own shortest composition and closes no cycle, and
    rates, however many, are never collected."""
    kind = {u: k for k, u in CANONICAL.items()}
    rows = [(u, c, kind[c], a, b) for u, (c, a, b) in sorted(compose_conversions(EDGES, CANONICAL.values()).items())]
    known = spark.createDataFrame(rows, "unit string, canonical string, kind string, a double, b double")
    if fx is None:
        return known
    code = F.upper(F.trim("code"))
    rates = fx.where(F.col("code").isNotNull() & (F.col("to_sgd") > 0) & ~code.isin([u for u, *_ in rows])).groupBy(code.alias("unit")).agg(F.max(F.col("to_sgd").cast("double")).alias("a"))
    return known.unionByName(rates.select("unit", F.lit(CANONICAL["money"]).alias("canonical"), F.lit("money").alias("kind"), "a", F.lit(0.0).alias("b")))


@lru_cache(maxsize=1)
def _grammar() -> dict:
    unit_of: dict[str, str] = {}
    for u, names in SPELLINGS.items():
        for n in names.split("|"):
            unit_of[n] = u
    folded = {n.lower(): u for n, u in unit_of.items() if len(n) > 4}
    money = [n for n, u in unit_of.items() if u in MONEY]
    longest = lambda xs: "|".join(re.escape(x).replace(r"\ ", r"\s+") for x in sorted(xs, key=lambda x: (-len(x), x)))
    words = "|".join(sorted([*UNITS_AS_WORDS, "hundred", "thousand"], key=lambda x: -len(x)))
    # thousands or lakhs set apart, points between thousands and a decimal comma, a decimal comma before one or two digits, or plain
    number = r"[+\-−]?\s?(?:\d{1,3}(?:[ ,']\d{2,3})*[ ,']\d{3}(?!\d)|\d{1,3}(?:\.\d{3})+,\d+|\d+,\d{1,2}(?![\d,]|\.\d)|\d+)(?:\.\d+)?(?:[eE][+\-]?\d+|\s?[×x]\s?10\s?\^\s?[+\-−]?\d+)?"
    spelt = rf"(?:{words})(?:(?:-|\s+and\s+|\s+)(?:{words}))*"
    plain, long_ = longest(unit_of), longest(SCALES)
    short = longest(SHORT)
    after = r"(?![^\W\d_])"
    unit_long = longest([n for n in unit_of if len(n) > 4])
    return {
        "unit_of": unit_of, "folded": folded,
        "number": re.compile(rf"(?<![\w.,])(?:(?P<digits>{number})|(?P<words>{spelt})(?![\w]))", re.I),
        "money_before": re.compile(rf"(?P<unit>{longest(money)})\s?$"),
        "tail": re.compile(rf"\s*-?(?:(?P<scale>(?i:{long_})){after}\s*)?(?P<unit>{plain}|(?i:{unit_long})){after}"),
        "money_tail": re.compile(rf"\s*(?P<scale>(?i:{long_})|{short}){after}"),
        "money_after": re.compile(rf"\s*(?:(?P<scale>(?i:{long_})|{short}){after}\s*)?(?P<unit>{longest(money)}){after}"),
        "scale_only": re.compile(rf"\s*(?P<scale>(?i:{long_})){after}"),
        "note": re.compile(rf"^\s*(?:\(?in\s+)?(?:(?P<s1>(?i:{long_}))\s+)?(?P<unit>{plain}|(?i:{unit_long})){after}\s*,?\s*(?P<s2>(?i:{long_})|{short})?\s*\)?\s*$"),
    }


def clean(text: str) -> str:
    """Plain letters for the look-alikes that unit names may hold."""
    return GONE.sub("", re.sub("−", "-", unicodedata.normalize("NFKC", text))).translate(LOOK_ALIKES)


def _words_value(text: str) -> float:
    total = part = 0
    for w in re.findall(r"[a-z]+", text.lower()):
        if w == "hundred":
            part = max(part, 1) * 100
        elif w == "thousand":
            total, part = total + max(part, 1) * 1000, 0
        elif w != "and":
            part += UNITS_AS_WORDS[w]
    return float(total + part)


def _digits_value(text: str) -> float:
    s = re.sub(r"[×x]10\^", "e", re.sub(r"\s", "", text).replace("−", "-").lower())
    body, e, power = s.partition("e")
    if re.fullmatch(r"[+-]?(?:\d+|\d{1,3}(?:\.\d{3})+),\d+", body) and not re.fullmatch(r"[+-]?\d{1,3},\d{3}", body):  # a decimal comma
        body = body.replace(".", "").replace(",", ".")
    return float(re.sub(r"[,']", "", body) + e + power)


def _scale(name: str | None) -> float:
    return 1.0 if not name else SCALES.get(name.lower(), SHORT.get(name, 1.0))


def _unit(name: str) -> str:
    g = _grammar()
    name = re.sub(r"\s+", " ", name)
    return g["unit_of"].get(name) or g["folded"].get(name.lower())


def parse_note(note: str | None) -> tuple[str, float] | None:
    """The unit and scale that a column's note names."""
    if not note:
        return None
    m = _grammar()["note"].match(clean(note))
    return (_unit(m["unit"]), _scale(m["s1"]) * _scale(m["s2"])) if m else None


def parse_quantities(text: str | None, note: str | None = None) -> list[tuple[float, str]]:
    """(number with its scale, unit) of each quantity that the text states, in its order; the note gives the unit of the first number of a text that has none."""
    if not text:
        return []
    g, t = _grammar(), clean(text)
    found, first = [], None
    for m in g["number"].finditer(t):
        if m["words"] and not re.search(r"[a-z]", m["words"], re.I):
            continue
        value = lambda m=m: _digits_value(m["digits"]) if m["digits"] else _words_value(m["words"])
        if before := g["money_before"].search(t[: m.start()]):
            tail = g["money_tail"].match(t, m.end())
            found.append((value() * _scale(tail and tail["scale"]), _unit(before["unit"])))
        elif tail := g["money_after"].match(t, m.end()) or g["tail"].match(t, m.end()):
            found.append((value() * _scale(tail["scale"]), _unit(tail["unit"])))
        else:
            first = first or (m, value)
    by = None if found or not first else parse_note(note)
    if by:
        m, value = first
        own = g["scale_only"].match(t, m.end())
        found.append((value() * (_scale(own["scale"]) if own else by[1]), by[0]))
    return found


def parse_quantity(text: str | None, note: str | None = None) -> tuple[float, str] | None:
    """The first quantity that the text states."""
    return next(iter(parse_quantities(text, note)), None)


PARSED = T.StructType([T.StructField("number", T.DoubleType()), T.StructField("unit", T.StringType())])


@F.pandas_udf(T.ArrayType(PARSED))
def _parse(text: pd.Series, note: pd.Series) -> pd.Series:
    return pd.Series([[{"number": n, "unit": u} for n, u in parse_quantities(t, by)] for t, by in zip(text, note)])


def with_quantities(df: DataFrame, conversions: DataFrame, text: str = "text", note: str = "unit_note", every: bool = False) -> DataFrame:
    """df with kind, number, unit, canonical and value of the first quantity that the text states; null where it states none.

    every=True gives a row for each quantity of a text, or one row of nulls.

    Units are few, so a join by shuffle would put most rows into a few tasks: the conversions, of counted size, are broadcast.
    """
    c = conversions.select(F.col("unit").alias("__unit_u"), F.col("canonical").alias("__unit_c"), F.col("kind").alias("__unit_k"), F.col("a").alias("__unit_a"), F.col("b").alias("__unit_b"))
    all_ = _parse(F.col(text), F.col(note))
    d = df.withColumn("__unit_q", F.explode_outer(all_) if every else F.get(all_, F.lit(0))).withColumn("__unit_qu", F.col("__unit_q.unit"))
    d = d.join(checked_broadcast(c), F.col("__unit_qu") == F.col("__unit_u"), "left")
    out = {"quantity_kind": F.col("__unit_k"), "stated_number": F.col("__unit_q.number"), "stated_unit": F.col("__unit_q.unit"), "canonical_unit": F.col("__unit_c"), "value": F.col("__unit_q.number") * F.col("__unit_a") + F.col("__unit_b")}
    keep = [x for x in df.columns if x not in out]
    return d.select(*keep, *(v.alias(k) for k, v in out.items()))


def _stated(df: DataFrame, key: str, group: str, value: str, kind: str) -> DataFrame:
    """(k, g, q, v): each key once."""
    v = F.col(value)
    base = df.where(v.isNotNull() & ~F.isnan(v) & F.col(group).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(kind).alias("q"), v.alias("v"))
    return base.groupBy("k", "g").agg(F.min(F.struct("q", "v")).alias("s")).select("k", "g", "s.q", "s.v")


def agreeing_values(stated: DataFrame, ratio: float = 1.01) -> DataFrame:
    """(g, q, v1, v2), v1 < v2, of each two different values of one group and kind that agree: the larger is at most ratio times the smaller.

    Equal values meet as one, however often they are stated. The values are binned by logarithm, a
    bin as wide as the ratio, and joined by (group, kind, bin) with their own and the next bin: a
    group that holds a third of all rows is spread over its bins, and only values close to each
    other ever meet.
    """
    width = math.log(ratio) * (1 + 1e-9)
    size = F.abs("v")
    values = stated.where("v <> 0").select("g", "q", "v").distinct().withColumn("bin", F.floor(F.log(size) / width).cast("long")).withColumn("sg", F.signum("v"))
    left = values.select("g", "q", "sg", F.col("v").alias("va"), F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("b"), F.col("bin").alias("own"))
    right = values.select("g", "q", "sg", F.col("v").alias("vb"), F.col("bin").alias("b"))
    near = F.greatest(F.abs("va"), F.abs("vb")) <= F.least(F.abs("va"), F.abs("vb")) * ratio * (1 + 1e-12)
    once = (F.col("own") < F.col("b")) | (F.col("va") < F.col("vb"))
    return left.join(right, ["g", "q", "sg", "b"]).where(near & once & (F.col("va") != F.col("vb"))).select("g", "q", F.least("va", "vb").alias("v1"), F.greatest("va", "vb").alias("v2"))


def agreeing_pairs(df: DataFrame, key: str, group: str, value: str = "value", kind: str = "quantity_kind", ratio: float = 1.01) -> DataFrame:
    """(a, b), a < b: different keys of one group and kind whose values agree: agreeing_values brought back to the keys that state them."""
    base = cut_lineage(_stated(df, key, group, value, kind))
    same = base.groupBy("g", "q", "v").agg(F.count("*").alias("n")).where("n > 1").select("g", "q", F.col("v").alias("v1"), F.col("v").alias("v2"))
    pairs = agreeing_values(base, ratio).union(same)
    ka, kb = (base.select("g", "q", F.col("k").alias(f"k{i}"), F.col("v").alias(f"v{i}")) for i in "12")
    both = pairs.join(ka, ["g", "q", "v1"]).join(kb, ["g", "q", "v2"]).where((F.col("v1") < F.col("v2")) | (F.col("k1") < F.col("k2")))
    return both.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b"))


def agreement(df: DataFrame, key: str, group: str, value: str = "value", kind: str = "quantity_kind", ratio: float = 1.01) -> DataFrame:
    """(key, group, kind, value, same, links): each key with the number of keys that state the same value, itself included, and of those that agree with it otherwise; its size is that of df, however many pairs there are."""
    base = cut_lineage(_stated(df, key, group, value, kind))
    counts = base.groupBy("g", "q", "v").agg(F.count("*").alias("same"))
    pairs = agreeing_values(base, ratio)
    both = pairs.select("g", "q", F.col("v1").alias("v"), F.col("v2").alias("o")).union(pairs.select("g", "q", F.col("v2").alias("v"), F.col("v1").alias("o")))
    links = both.join(counts.select("g", "q", F.col("v").alias("o"), F.col("same").alias("n")), ["g", "q", "o"]).groupBy("g", "q", "v").agg(F.sum("n").alias("links"))
    out = base.join(counts, ["g", "q", "v"]).join(links, ["g", "q", "v"], "left")
    return out.select(F.col("k").alias(key), F.col("g").alias(group), F.col("q").alias(kind), F.col("v").alias(value), "same", F.coalesce("links", F.lit(0)).alias("links"))
