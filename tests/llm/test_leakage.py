"""Problem 6 against brute force."""

import random

import numpy as np
import pytest

from proseframe.llm import leakage as K

WORDS = [f"w{i}" for i in range(300)]


def make(seed=3):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 60)))) for i in range(12)]
    docs = []
    for i in range(300):
        w = [rng.choice(WORDS) for _ in range(rng.randint(0, 200))]
        if rng.random() < 0.5:
            t = rng.choice(items)[1].split()
            a = rng.randint(0, len(t) // 2)
            part = [x if rng.random() > 0.06 else "zz" for x in t[a : a + rng.randint(4, len(t))]]
            k = rng.randint(0, len(w))
            w = w[:k] + part + w[k:]
        docs.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return items, docs


def brute(items, docs, cover):
    out = set()
    for d, text in docs:
        w = K.words(text or "")
        for i, t in items:
            v = K.words(t or "")
            place = {}
            for q in range(len(v) - K.SHINGLE + 1):
                place.setdefault(tuple(v[q : q + K.SHINGLE]), []).append(q)
            hits = [(p, q) for p in range(len(w) - K.SHINGLE + 1) for q in place.get(tuple(w[p : p + K.SHINGLE]), [])]
            width = int(len(v) * K.WINDOW) + K.SHINGLE
            best = max((len({q + k for p, q in hits if p0 <= p and p + K.SHINGLE <= p0 + width for k in range(K.SHINGLE)}) for p0, _ in hits), default=0)
            if v and best / len(v) >= cover:
                out.add((d, i))
    return out


@pytest.mark.parametrize("most", [K.MAX_ITEM_CHARS, 0])
def test_against_brute(spark, most):
    items, docs = make()
    d = spark.createDataFrame(docs + docs[:40] + [(900, None), (901, ""), (902, "  ")], "doc_id long, text string")
    e = spark.createDataFrame(items + items[:2] + [(50, None), (51, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in K.leaked_items(d, e, max_item_chars=most).collect()}
    assert got == brute(items, docs, K.COVER) and len(got) > 30


def test_edges(spark):
    d = spark.createDataFrame([(1, "a b c d e f g", "x")], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([(1, "A, b; c-d e. F g!")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["cover"]) for r in K.leaked_items(d, e).collect()] == [(1, 1, 1.0)]
    assert K.leaked_items(d.limit(0), e).count() == 0 and K.leaked_items(d, e.limit(0)).count() == 0


def test_lookalikes_and_index(spark):
    t = "the coastal council approved seven new harbour permits after long debate"
    d = spark.createDataFrame([(1, t.replace("a", "а").replace("council", "ｃｏｕｎｃｉｌ").replace("debate", "deb​ate"))], "doc_id long, text string")
    assert K.leaked_items(d, spark.createDataFrame([(7, t)], "item_id long, text string")).count() == 1
    ix = K.ItemIndex([["a"] * 9, [], ["a", "b"]])
    assert len(ix.of_item[0]) == 5 and len(ix.of_item[1]) == 0
    assert ix.shingles(np.array([0, 0, 0, 0, 0, -1, 0]))[0].tolist() == [0]
    assert K.best_window(np.array([0, 100]), np.array([0, 0]), 10) == (0.5, 0, 5)


INDIC = "परिषद ने नए बजट को मंज़ूरी दी और घाटी के किसानों ने इस साल धान बोया जबकि सदस्य घर चले गए"


def test_one_tokenizer_on_both_paths(spark):
    assert K.words("हिन्दी भाषा, naïve e\u0301a x_1") == ["हिन्दी", "भाषा", "naïve", "e\u0301a", "x_1"]
    w = INDIC.split()
    d = spark.createDataFrame([(1, "अथ " + INDIC), (2, " ".join(w[:9]) + " तथा अन्य"), (3, " ".join(reversed(w))), (4, "ISTANBUL İzmir ΣΑΣ " + INDIC.upper())], "doc_id long, text string")
    e = spark.createDataFrame([(1, INDIC), (2, "istanbul İZMİR σας " + INDIC)], "item_id long, text string")
    a, b = (sorted(map(tuple, K.leaked_items(d, e, max_item_chars=m).collect())) for m in (K.MAX_ITEM_CHARS, 0))
    assert a == b and {(x[0], x[1]) for x in a} >= {(1, 1), (1, 2), (2, 1), (4, 1), (4, 2)} and 3 not in {x[0] for x in a}


def test_phrase_in_all_items_joins_none(spark):
    """A phrase that all items and documents have isn't in any item's prefix while it covers too little to make a case."""
    rng = random.Random(8)
    phrase = "answer the following question with one of the options given below"
    own = [" ".join(rng.choice(WORDS) for _ in range(50)) for _ in range(40)]
    d = spark.createDataFrame([(i, phrase + " " + (own[i] if i < 3 else " ".join(rng.choice(WORDS) for _ in range(50)))) for i in range(200)], "doc_id long, text string")
    e = spark.createDataFrame([(i, phrase + " " + t) for i, t in enumerate(own)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in K.leaked_items(d, e).collect()}
    assert got == {(0, 0), (1, 1), (2, 2)}
    sh, docs = np.arange(57), np.where(np.arange(57) < 7, 200, 1)
    assert K.prefix_shingles(np.arange(57), sh, docs, 61, K.COVER)[-1] >= 7 and not set(range(7)) & set(K.prefix_shingles(np.arange(57), sh, docs, 61, K.COVER))


def test_prefix_loses_no_case():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(5, 40))
        sh = rng.integers(0, 12, n - K.SHINGLE + 1)
        count = rng.integers(1, 9, 12)
        at = np.arange(len(sh))
        kept = set(K.prefix_shingles(at, sh, count[sh], n, 0.4))
        rest = np.array([i for i in at if sh[i] not in kept], int)
        assert len(np.unique(rest[:, None] + np.arange(K.SHINGLE))) / n < 0.4


def test_index_of_many_items():
    import time

    rng = np.random.default_rng(1)
    lists = [[f"w{x}" for x in rng.integers(0, 20_000, 80)] for _ in range(50_000)]
    t = time.perf_counter()
    ix = K.ItemIndex(lists)
    assert time.perf_counter() - t < 10 and len(ix.of_item) == 50_000 and all(len(x) == 76 for x in ix.of_item)
