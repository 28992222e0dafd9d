"""Problem 3."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proseframe.llm import splitting as S


def points(t):
    return np.frombuffer(t.encode("utf-32-le"), np.uint32)


def test_sparse_table_against_scan():
    rng = random.Random(2)
    s = np.array([rng.randint(0, 5) for _ in range(800)], np.int8)
    t = S.StrongestCut(s, 300)
    for _ in range(2000):
        a = rng.randint(0, 700)
        b = min(799, a + rng.randint(0, 299))
        k = max(range(a, b + 1), key=lambda i: (s[i], i))
        assert t.query(a, b) == (k, s[k])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,;\n。é§FOOTNOTE:1", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_any_text(t, most, over):
    p = S.cut(points(t), most, over)
    assert p[0][0] == 0 and p[-1][1] == len(t) and all(0 < b - a <= most or not t for a, b, _ in p)
    assert all(q[0] == r[1] - over for r, q in zip(p, p[1:]))
    assert t[: p[0][1]] + "".join(t[r[1] : q[1]] for r, q in zip(p, p[1:])) == t


def test_boundaries():
    t = "One two three. Four five six, seven.\n\nEight nine ten. §FOOTNOTE:12§ end"
    s = S.strengths(points(t))
    assert s[15] == S.SENTENCE and s[t.index("seven")] == S.CLAUSE and s[t.index("Eight")] == S.BLOCK and s[4] == S.WORD and s[2] == 0
    assert not s[t.index("§") + 1 : t.rindex("§") + 1].any()
    assert S.strengths(points("海。岸，边"))[2] == S.SENTENCE and S.strengths(points("海。岸，边"))[4] == S.CLAUSE
    assert S.cut(points("x" * 25), 10, 2) == [(0, 10, 0), (8, 18, 0), (16, 25, S.BLOCK)]
    with pytest.raises(ValueError):
        S.cut(points("abc"), 3, 3)


def test_placeholders():
    long = "§FOOTNOTE:" + "9" * 60 + "§"
    t = "see § 5 and § 6 there. " + long + " word end. " + "§ 7"
    s = S.strengths(points(t))
    assert s[t.index("and")] == S.WORD and s[t.index("5")] == S.WORD and s[t.index("§ 7")] == S.SENTENCE
    assert not s[t.index(long) + 1 : t.index(long) + len(long)].any()
    # a hard cut steps back before a placeholder that lies at the limit
    t = "x" * 40 + "§FOOTNOTE:12§" + "y" * 60
    assert S.cut(points(t), 48, 4)[0] == (0, 40, 0)
    assert S.cut(points(long + "x" * 50), 48, 4)[0] == (0, 48, 0)  # longer than a piece may be
    assert S.cut(points("e" + "\u0301" * 3 + "क्" * 30), 20, 2)[0][1] == 20
    assert S.cut(points("ab" * 9 + "e\u0301" + "c" * 30), 19, 2)[0][1] == 18


def test_long_blocks():
    t = "word end. " * 60000
    full = S.strengths(points(t))
    p = S.cut(points(t), 1500, 150)
    assert all(full[b] == power for _, b, power in p[:-1]) and len(p) > 400


def test_table(spark):
    rows = [("paragraph", "d", 1, "a b. " * 10), ("paragraph", "d", 1, "a b. " * 10), ("paragraph", "d", 2, None), ("paragraph", "d", 3, ""), ("other", "d", 4, "x" * 99), ("paragraph", None, 5, "y" * 21), ("paragraph", "d", 6, "z" * 20)]
    d = spark.createDataFrame(rows, "item_kind string, owner_id string, item_idx int, text string")
    lim = spark.createDataFrame([("paragraph", 20, 4), (None, 5, 1)], "item_kind string, max_chars int, overlap_chars int")
    got = S.once(S.split_oversized(d, lim)).collect()
    assert {(r["owner_id"], r["item_idx"]) for r in got} == {("d", 1), (None, 5)} and all(len(r["text"]) <= 20 for r in got)
    assert sum(r["item_idx"] == 1 for r in got) == got[0]["n_pieces"] if got[0]["item_idx"] == 1 else True
    assert S.split_oversized(d.limit(0), lim).count() == 0
