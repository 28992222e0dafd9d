"""Problem 8: held-out accuracy on made-up and real labelled rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from proseframe.llm import langid as G

EN = ["The council approved the new budget.", "Farmers in the valley planted rice this year.", "She wrote that the harbour would open soon.", "After the debate, the members went home."]
FR = ["Le conseil a approuvé le nouveau budget.", "Les agriculteurs de la vallée ont planté du riz.", "Elle a écrit que le port ouvrirait bientôt.", "Après le débat, les membres sont rentrés."]
HI = ["परिषद ने नए बजट को मंज़ूरी दी।", "घाटी के किसानों ने इस साल धान बोया।", "उसने लिखा कि बंदरगाह जल्द खुलेगा।", "बहस के बाद सदस्य घर चले गए।"]


def corpus():
    texts, labels = [], []
    for i in range(60):
        for lang, s in (("en", EN), ("fr", FR), ("hi", HI)):
            texts.append(" ".join(s[(i + k) % 4] for k in range(3)))
            labels.append(lang if i % 10 else "it")  # a tenth are wrong
    return texts, labels


def test_fit_drops_wrong_labels():
    m = G.fit(*corpus())
    assert m.languages == ["en", "fr", "hi"]
    s = G.segments_of(m, [" ".join(EN + FR[:2] + EN), "", "12 34", "Le budget."])
    assert [(d, m.languages[x], n) for d, x, n in zip(s["doc"], s["lang"], s["sentences"])][:3] == [(0, "en", 4), (0, "fr", 2), (0, "en", 4)]
    assert set(s["doc"].tolist()) <= {0, 3}
    assert m.languages[int(m.backoff("approuvées").argmax())] == "fr" and m.languages[int(m.backoff("ज़मीनें").argmax())] == "hi"


def test_labels(spark):
    d = spark.createDataFrame([(" EN ",), ("en_SG",), ("English",), ("fra",), ("de;ne;ru",), ("xx",), ("und",), ("",), (None,), ("zh-CN",), ("pt-BR; Hindi",)], "l string")
    assert [r["c"] for r in d.select(G.label_codes(F.col("l")).alias("c")).collect()] == [["en"], ["en"], ["en"], ["fr"], ["de", "ne", "ru"], [], [], [], [], ["zh"], ["pt", "hi"]]


def test_table(spark):
    texts, labels = corpus()
    rows = [(i, t, x) for i, (t, x) in enumerate(zip(texts, labels))] + [(900, " ".join(EN + HI[:2]), "en"), (901, " ".join(EN + HI[:2]), "English; hin"), (902, None, "en"), (903, "", None), (904, "...", None), (905, FR[0], "en"), (900, " ".join(EN + HI[:2]), "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = G.train(d)
    got = {(r["doc_id"], r["lang"]) for r in G.unnamed_passages(d, m).collect()}
    assert {x for x in got if x[0] >= 900} == {(900, "hi")}
    assert {x[0] for x in got if x[0] < 900} == {i for i, x in enumerate(labels) if x == "it"}
    segs = G.segments(d, m).dropDuplicates(["doc_id", "seg_no"])
    a = segs.where("doc_id = 900").orderBy("seg_no").collect()
    text = rows[180][1]
    assert [text[r["start_pos"] : r["end_pos"]].strip() for r in a] == [" ".join(EN), " ".join(HI[:2])]
    top = {r["doc_id"]: (r["lang"], r["confidence"]) for r in G.document_languages(segs).collect()}
    assert top[900][0] == "en" and 0 < top[900][1] < 1 and 902 not in top and 904 not in top
    assert G.segments(d.limit(0), m).count() == 0 and G.unnamed_passages(d.limit(0), G.train(d.limit(0))).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["doc_id"]).where("length(text) > 200").withColumn("c", G.label_codes(F.col("lang"))).where("size(c) = 1")
    rows = d.select("doc_id", "text", F.col("c")[0].alias("c")).orderBy("doc_id").collect()
    m = G.fit([r["text"] for r in rows[::2]], [r["c"] for r in rows[::2]])
    s = G.segments_of(m, [r["text"] for r in rows[1::2]])
    named = [r["c"] for r in rows[1::2]]
    hit = {i for i, x in zip(s["doc"].tolist(), s["lang"].tolist()) if m.languages[x] == named[i]}
    assert len(hit) / len(named) > 0.85  # about a tenth of the labels are wrong on purpose


def test_long_text():
    m = G.fit(*corpus())
    s = G.segments_of(m, ["the council and the valley " * 50_000])
    assert s["words"].sum() == 250_000


TH = ["สภาอนุมัติงบประมาณใหม่เมื่อวานนี้", "ชาวนาในหุบเขาปลูกข้าวปีนี้", "เธอเขียนว่าท่าเรือจะเปิดเร็วๆนี้", "หลังจากการอภิปรายสมาชิกกลับบ้าน"]


def test_script_without_spaces():
    texts, labels = corpus()
    more = ["\n".join(TH[(i + k) % 4] for k in range(3)) for i in range(20)]
    m = G.fit(texts + more, labels + ["th"] * 20)
    s = G.segments_of(m, ["\n".join([*EN, *TH[:2], *EN]), TH[0]])
    assert [(d, m.languages[x], n) for d, x, n in zip(s["doc"], s["lang"], s["sentences"])] == [(0, "en", 4), (0, "th", 2), (0, "en", 4), (1, "th", 1)]
    assert s["words"][1] == len("".join(TH[:2]))


def test_whole_words_count():
    m = G.fit(*corpus())
    head = "q" * 70
    assert m.languages[int(m.backoff(head + "approuvéesbudgetvallée" * 3).argmax())] == "fr"  # what tells comes after 64 letters
    assert not m.backoff("Ω☃").any()
    tokens = [f"approuv{i}" for i in range(3000)]
    m.learn(tokens)
    assert np.allclose([m.table[m[t]] for t in tokens[:50]], [m.backoff(t) for t in tokens[:50]])


def test_confidence_is_that_of_the_language_given():
    m = G.fit(*corpus())
    s = G.segments_of(m, ["Le budget. " + " ".join(EN) + " Budget. " + " ".join(EN)])
    assert ((s["conf"] > 0) & (s["conf"] <= 1)).all()
    k = [m.languages[x] for x in s["lang"]].index("en")
    assert s["conf"][k] > 0.9


def test_unlabelled_rows_change_nothing(spark):
    texts, labels = corpus()
    rows = [(i, t, x) for i, (t, x) in enumerate(zip(texts, labels))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    more = spark.range(100_000, 100_000 + 100 * len(rows)).selectExpr("id AS doc_id", "'Nothing is known of this text.' AS text", "CASE WHEN id % 2 = 0 THEN 'und' END AS lang")
    a, b = G.train(d), G.train(d.union(more))
    assert a.languages == b.languages and dict(a) == dict(b) and np.array_equal(a.scores, b.scores)
    few = G.train(d, sample_docs=20)
    assert few.languages == ["en", "fr", "hi"]
