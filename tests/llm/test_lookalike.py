"""Problem 5 against per-row normalisation and literal cases."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from proseframe.llm import lookalike as L

CHANGED = [
    ("Τhe plan", "The plan"), ("thе уоuthful", "the youthful"), ("А modest plan", "A modest plan"), ("２０２２．", "2022."), ("Ｉｎｔｅｒｖｉｅｗ： ", "Interview: "), ("eﬀect", "effect"), ("Méridale", "Méridale"), ("𝐭𝐡𝐞", "the"), ("a b c　d", "a b c d"),
    ("pro­vin​cial﻿", "provincial"), ("сельскaя", "сельская"), ("district‍s", "districts"), ("a‮b", "ab"), ("Å", "Å"), ("n‑o", "n-o"), ("ﺍﻟ", "ال"), ("Ⅳ", "IV"), ("ộ", "ộ"), ("ộ", "ộ"), ("한", "한"),
]
KEPT = ["", "plain  text", "(क्‍ष और ज्‍ञ)", "(می‌شود)", "(Θαλάσσια πολιτική)", "5 μm", "α-particle", "Он и я, а в том", "(（沿海）能源年鉴)", "海　岸", "H₂O 7½ m² … – “q” 30°C €5", "Ålnäs coup d'œil", "한국", "Σ = Ω", "é", "\t\n", "👩‍💻 ok", "Прибрежная политика"]


def test_cases():
    got = L.consistent_array(pa.array([a for a, _ in CHANGED] + KEPT + [None])).to_pylist()
    assert got == [b for _, b in CHANGED] + KEPT + [None]
    again = L.consistent_array(pa.array([b for _, b in CHANGED])).to_pylist()
    assert again == [b for _, b in CHANGED]


def test_nfc_against_library():
    rng = random.Random(0)
    pool = [*range(0xC0, 0x180), *range(0x300, 0x34F), *range(0x9BE, 0x9D8), 0x9C7, 0x1100, 0x1161, 0x11A8, 0x344, 0x212B, 0x915, 0x93C, 0x958, 0x1EA5, 97, 101, 0xAC00]
    texts = ["".join(chr(rng.choice(pool)) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    cp, off = L.code_points(pa.array(texts))
    new, row = L._nfc(cp, np.repeat(np.arange(len(texts)), np.diff(off)), L.tables())
    got = L.to_arrow(new, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))])).to_pylist()
    assert got == [unicodedata.normalize("NFC", t) for t in texts]


def test_slices_and_long():
    a = pa.array(["x", None, "Τhe", "", "ok"] * 3)
    assert L.consistent_array(a.slice(1, 8)).to_pylist() == ["x" if v == "x" else "The" if v == "Τhe" else v for v in a.slice(1, 8).to_pylist()]
    long = "a" + "́" * 5000 + "Τhe " * 20000
    assert L.consistent_array(pa.array([long])).to_pylist()[0] == unicodedata.normalize("NFC", "a" + "́" * 5000) + "The " * 20000
    assert L.consistent_array(pa.array([], pa.string())).to_pylist() == []


def test_table(spark):
    d = spark.createDataFrame([(1, "Τhe", "c"), (1, "Τhe", "c"), (2, None, "c"), (3, "", "c"), (4, "plain", "c")], "id int, text string, consistent string")
    assert [(r["id"], r["consistent"]) for r in L.with_consistent(d).orderBy("id").collect()] == [(1, "The"), (1, "The"), (2, None), (3, ""), (4, "plain")]
    assert [r["id"] for r in L.inconsistent_rows(d).collect()] == [1, 1] and L.inconsistent_rows(d.limit(0)).count() == 0
    assert d.select(L.consistent_text(F.lit(None).cast("string")).alias("x")).first()["x"] is None


LIVING = ["ışık kapı", "kapı", "Kapı açıldı ve ışık söndü, herkes dışarı çıktı.", "МОСКВА", "Москва", "москва", "ЕСОСОР", "сорос", "ɩlɩ kɛ"]


def test_living_letters_stay():
    assert L.consistent_array(pa.array(LIVING)).to_pylist() == LIVING
    assert len(set(L.consistent_array(pa.array(["ışık", "işik", "isik"])).to_pylist())) == 3


def test_living_letters_that_must_be_others():
    rows = ["The natıonal council met again on Monday in the hall", "the wıde road", "nаtıonal", "a ɡood plan", "МОСКВА and СОР rules"]
    assert L.consistent_array(pa.array(rows)).to_pylist() == ["The national council met again on Monday in the hall", "the wide road", "national", "a good plan", "MOCKBA and COP rules"]
