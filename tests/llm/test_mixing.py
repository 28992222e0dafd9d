"""Problem 7."""

import random

import pytest
from pyspark.sql import functions as F

from proseframe.llm import mixing as M


def counts(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choices(["a", "b", "c", None, "zz"], [60, 25, 5, 5, 5])[0], rng.randint(1, 400)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, tokens long")


TARGETS = [("A", 0.4, 1), ("b ", 0.3, 2), ("c", 0.2, 3), ("absent", 0.1, 2), (None, 0.1, 1)]


@pytest.mark.parametrize("total", [None, 90_000, 10**12])
def test_shares(spark, total):
    rows, d = counts(spark)
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mix = M.mix_sources(d, t, total, docs_per_bucket=50).collect()
    caps, size = {"a": 1, "b": 2, "c": 3}, {i: k for i, _, k in rows}
    uses = {}
    for r in mix:
        uses.setdefault((r["source"], r["doc_id"]), set()).add(r["repeat_no"])
        assert r["tokens"] == size[r["doc_id"]]
    assert all(len(u) <= caps[s] and u == set(range(1, len(u) + 1)) for (s, _), u in uses.items())
    got = {s: sum(r["tokens"] for r in mix if r["source"] == s) for s in caps}
    whole = {s: sum(k for _, x, k in rows if x == s) for s in caps}
    if total == 10**12:
        assert got == {s: whole[s] * caps[s] for s in caps}
        return
    budget = total or min(whole[s] * caps[s] / w for s, w in (("a", 4 / 9), ("b", 3 / 9), ("c", 2 / 9)))
    assert sum(got.values()) <= budget + 1 and sum(got.values()) > budget - 3 * 400
    for s, w in (("a", 4 / 9), ("b", 3 / 9), ("c", 2 / 9)):
        assert got[s] == pytest.approx(w * budget, abs=401)
    first = {s: min(r["finish_time"] for r in mix if r["source"] == s) for s in caps}
    assert all(v > 0 for v in first.values())


def test_report_and_edges(spark):
    _, d = counts(spark, 300)
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    r = {x["source"]: x for x in M.mix_report(M.mix_sources(d, t), t).collect()}
    assert r["absent"]["tokens"] == 0 and sum(x["share"] for x in r.values()) == pytest.approx(1) and set(r) == {"a", "b", "c", "absent"}
    empty = M.mix_sources(d.limit(0), t)
    assert empty.count() == 0 and all(x["share"] == 0 for x in M.mix_report(empty, t).collect())


def test_order_is_by_hash_and_repeatable(spark):
    _, d = counts(spark, 500)
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    key = lambda x: sorted(map(tuple, x.collect()))
    assert key(M.mix_sources(d, t)) == key(M.mix_sources(d.repartition(3), t)) == key(M.mix_sources(d.union(d), t))
    assert key(M.mix_sources(d, t, 20_000)) != key(M.mix_sources(d, t, 20_000, seed=5))


def test_tokens(spark):
    d = spark.createDataFrame([(1, "Working Paper", "hello world"), (2, None, ""), (3, "x", None), (4, "WORKING-PAPER ", "naïve 海岸 " * 3000)], "doc_id long, source string, text string")
    got = {r["doc_id"]: (r["source"], r["tokens"]) for r in M.token_counts(d).collect()}
    assert got[1] == ("working_paper", 2) and set(got) == {1, 4} and got[4][0] == "working_paper"
    sliced = {r["doc_id"]: r["tokens"] for r in M.token_counts(d, slice_chars=1000).collect()}
    assert sliced == {i: n for i, (_, n) in got.items()}


def test_slices_keep_every_token():
    from proseframe.llm.shared import TOKENIZERS, encoding

    enc, rng = encoding(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), random.Random(7)
    for _ in range(300):
        t = "".join(rng.choice([" ", "  ", "\n", "\t", "a", "word", "Ω", "'s", "'t", "12", ".", "—", "海", "e\u0301", "\u00a0"]) for _ in range(rng.randint(0, 120)))
        parts = list(M.slices(t, rng.randint(1, 20)))
        assert "".join(parts) == t
        assert [x for p in parts for x in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
    assert len(list(M.slices("x" * 5000, 10))) == 1
