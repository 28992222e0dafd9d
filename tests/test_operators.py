"""Operators on small tables."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from proseframe.operators import connectors, diff, mentions, notes, sessions, structure
from proseframe.sources import dims


def test_expand(spark):
    d = spark.createDataFrame([("a", 0, "Greenhouse gases and GHG."), ("a", 1, "The GHG and the (GHG)."), ("b", 0, "Greenhouse Gases (GHG) rise; greenhouse gases fall."), ("c", 0, None), ("c", 1, ""), ("c", 2, "GHGs only")], "doc string, i int, text string")
    ab = spark.createDataFrame([("GHG", "Greenhouse Gases"), ("UN", "United Nations")], "abbr string, full string")
    got = {(r["doc"], r["i"]): r["text"] for r in mentions.expand_mentions(d, ab, "doc", "i").collect()}
    assert got == {("a", 0): "Greenhouse Gases (GHG) and GHG.", ("a", 1): "The GHG and the (GHG).", ("b", 0): "Greenhouse Gases (GHG) rise; GHG fall.", ("c", 0): None, ("c", 1): "", ("c", 2): "GHGs only"}


def test_expand_long_terms(spark):
    full = {"UNFCCC": "United Nations Framework Convention on Climate Change", "UNESCAP": "United Nations Economic and Social Commission for Asia and the Pacific", "UN": "United Nations", "LONG": " ".join(f"w{i}" for i in range(40))}
    ab = spark.createDataFrame(list(full.items()), "abbr string, full string")
    d = spark.createDataFrame([("a", i, f"The {t} and {t}.") for i, t in enumerate(full.values())], "doc string, i int, text string")
    got = {r["i"]: r["text"] for r in mentions.expand_mentions(d, ab, "doc", "i").collect()}
    assert got == {i: f"The {t} ({a}) and {a}." for i, (a, t) in enumerate(full.items())}
    assert {r["text"] for r in mentions.expand_mentions(d, ab.limit(0), "doc", "i").collect()} == {r["text"] for r in d.collect()}


def test_synonyms_and_variants(spark):
    d = spark.createDataFrame([("a", 0, "The Republic of Korea and South Korea"), ("a", 1, "ROK")], "doc string, i int, text string")
    r = mentions.unify_terms(d, dims.state_synonyms(spark), "doc", "i").collect()
    assert [(x["chosen"], x["mentions"], x["replaced"]) for x in r] == [("Republic of Korea", 3, 2)]
    v = spark.createDataFrame([("Ulema Council", "Council of Ulema"), ("Ulema Council", "Council")], "entity string, variant string")
    got = mentions.canonical_variants(spark.createDataFrame([(1, "The Council of Ulema, a Council; council")], "k int, text string"), v, ["k"]).first()["text"]
    assert got == "The Ulema Council, a Ulema Council; council"


def test_hits_that_overlap_in_a_chain(spark):
    terms = ["a b c", "c d e", "e f", "f", "a b", "g", "g h", "h i", "i"]
    d = spark.createDataFrame([(t,) for t in terms], "term string")
    rng = random.Random(2)
    texts = ["a b c d e f", "g h i"] + [" ".join(rng.choice("abcdefghi") for _ in range(40)) for _ in range(30)]
    texts += ["a b c d e f g h i " * 20]
    want = set()
    for k, t in enumerate(texts):
        w, end = t.split(), 0
        for i in range(len(w)):
            n = max((n for n in (1, 2, 3) if i + n <= len(w) and " ".join(w[i : i + n]) in terms), default=0)
            if n and i >= end:
                want.add((k, i, n, " ".join(w[i : i + n])))
                end = i + n
    got = [tuple(r) for r in mentions.dictionary_hits(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), d, ["k"], "text", "term").select("k", "pos", "n", "term").collect()]
    assert {x[1:] for x in want if x[0] == 0} == {(0, 3, "a b c"), (4, 2, "e f")}
    assert sorted(got) == sorted(want)


def test_unified_texts(spark):
    rows = [("a", 0, "South Korea, “the ROK” and 'PRC'."), ("a", 1, 'The ROK, "South Korea" and south korea; Republic of Korea!'), ("b", 0, '"ROK" and Republic "of Korea", dprk'), ("b", 1, "The ROK, PRC's, South Korea"), ("b", 2, None), ("b", 3, ""), ("b", 4, "none")]
    d = spark.createDataFrame(rows, "doc string, i int, text string")
    got = {(r["doc"], r["i"]): r["text"] for r in mentions.unify_texts(d, dims.state_synonyms(spark), "doc", "i").collect()}
    assert got == {r[:2]: r[2] for r in rows} | {("a", 1): 'The South Korea, "South Korea" and south korea; South Korea!', ("b", 1): "The ROK, PRC's, ROK"}
    all_of_it = {(r["doc"], r["i"]): r["text"] for r in mentions.unify_texts(d, dims.state_synonyms(spark), "doc", "i", protected=None).collect()}
    assert all_of_it["a", 0] == "South Korea, “the South Korea” and 'PRC'."


def test_variants_outside_quotes(spark):
    v = spark.createDataFrame([("China", "PRC"), ("China", "People's Republic of China")], "entity string, variant string")
    t = "PRC and \"PRC\", “the People's Republic of China” and People's Republic of China, 'PRC' PRC"
    got = mentions.canonical_variants(spark.createDataFrame([(1, t)], "k int, text string"), v, ["k"]).first()["text"]
    assert got == "China and \"PRC\", “the People's Republic of China” and China, 'PRC' China"


def test_nested_and_usa(spark):
    d = spark.createDataFrame([("Term (Term (ABBR))", "Term (ABBR)"), ("Term (Term)", "Term"), ("The United States of America", "The United States of America (USA)")], "t string, w string")
    assert all(r["o"] == r["w"] for r in d.select("w", mentions.usa_special_case(mentions.clean_nested(F.col("t"))).alias("o")).collect())


def test_dictionary_merge(spark):
    base = spark.createDataFrame([("base", "GHG", "Green House Gases", 0)], "category string, abbr string, full string, prio int")
    got = {r["abbr"]: r["full"] for r in mentions.merge_dictionaries(base.union(dims.categories(spark))).collect()}
    assert got["GHG"] == "Greenhouse Gases" and len(got) == 12


def test_json_dictionary(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('{"UN": "United Nations ", "GoI": "Government of India"}')
    assert {(r["abbr"], r["full"]) for r in dims.read_dictionary(spark, str(p)).collect()} == {("UN", "United Nations"), ("GoI", "Government of India")}
    bad = tmp_path / "b.json"
    bad.write_text("{}")
    assert dims.first_dictionary([str(tmp_path / "none"), str(bad), str(p)])["GoI"] == "Government of India"


def test_toc_and_first(spark):
    rows = [("d", 0, ""), ("d", 1, "Title"), ("d", 2, "Contents"), ("d", 3, "1 A"), ("d", 4, ""), ("d", 5, "Introduction"), ("d", 6, "Text")]
    d = spark.createDataFrame(rows, "doc_id string, para_idx int, text string").withColumn("style", F.lit(None).cast("string"))
    assert [r["in_toc"] for r in structure.with_toc_flag(d).orderBy("para_idx").collect()] == [False, False, True, True, False, False, False]
    assert [r["para_idx"] for r in structure.with_first_text(d).where("is_first").collect()] == [1]


def test_runs(spark):
    rows = [("d", 0, 0, "Bold ", True, None, "text"), ("d", 0, 1, "too ", True, False, "text"), ("d", 0, 2, None, None, None, "footnote_ref"), ("d", 0, 3, "plain", False, False, "text"), ("d", 0, 4, "both", True, True, "text"), ("d", 0, 5, "  ", False, True, "text")]
    r = spark.createDataFrame(rows, "doc_id string, para_idx int, run_idx int, text string, bold boolean, italic boolean, kind string")
    assert [x["marked"] for x in structure.coalesced_runs(r, ["doc_id", "para_idx"]).orderBy("island").collect()] == ["**Bold too** ", "plain", "***both***"]
    new = spark.createDataFrame([("d", 0, "Bald two plain and both!")], "doc_id string, para_idx int, new string")
    parts = [x["text"] for x in structure.resliced(r, new, ["doc_id", "para_idx"]).orderBy("run_idx").collect()]
    assert "".join(parts) == "Bald two plain and both!" and parts[0] == "Bald "


def test_citation_like(spark):
    d = spark.createDataFrame([("[12]",), ("12",), ("Ibid., p. 3",), ("(see)",), ("a² b",), ("x§FOOTNOTE:1§",), ("Plain text",), (None,)], "t string")
    assert [r["o"] for r in d.select(structure.is_citation_like(F.col("t")).alias("o")).collect()] == [True] * 6 + [False] * 2


def test_notes(spark):
    d = spark.createDataFrame([("https://x/2024-07-19/a", "19 July 2024"), ("https://x/19-07-2024", "19 July 2024"), ("https://x/2024-13-19", None), ("https://x/2024_Jul_9", "9 Jul 2024"), ("https://x", None)], "u string, w string")
    assert all(r["o"] == r["w"] for r in d.select("w", notes.url_date(F.col("u")).alias("o")).collect())
    s = spark.createDataFrame([("(https://x.org) *a*",)], "t string").select(notes.markdown_segments(F.col("t")).alias("s")).first()["s"]
    assert [(x["text"], x["type"]) for x in s] == [("https://x.org", "hyperlink"), ("a", "italic")]
    c = spark.createDataFrame([("d", 1, "A", "1"), ("d", 2, "A", "1"), ("d", 3, "A", "2"), ("d", 4, "B", "2"), ("d", 5, "A", "2")], "doc string, i int, work string, pages string")
    assert [r["form"] for r in notes.short_citations(c, "doc", "i", "work", "pages").orderBy("i").collect()] == ["full", "ibid", "ibid_page", "full", "op_cit"]


def test_diff():
    assert diff.align("a b c", "a x c") == [{"text": "a ", "hl": False}, {"text": "x", "hl": True}, {"text": " c", "hl": False}]
    assert diff.align(None, "n") == [{"text": "n", "hl": True}] and diff.align("gone", "") == []
    for a, b in (("the cat sat", "a cat sat down"), ("x", "x"), ("", "y z")):
        assert "".join(s["text"] for s in diff.align(a, b)) == b


def test_changed(spark):
    b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, text string")
    a = spark.createDataFrame([(1, "a"), (2, "B"), (3, "new"), (4, None)], "k int, text string")
    assert {(r["k"], r["old"], r["new"]) for r in diff.changed(b, a, ["k"]).collect()} == {(2, "b", "B"), (3, "", "new")}


def test_sessions(spark):
    d = spark.createDataFrame([("s", 1, 'ACRONYM_STATE:{"UN": true}\n\nText'), ("s", 2, "ACRONYM_STATE:{bad\n\nText"), ("s", 3, None)], "session_id string, batch_num int, content string")
    r = d.select(sessions.state_of(F.col("content")).alias("s"), sessions.text_of(F.col("content")).alias("t")).collect()
    assert r[0]["s"] == {"UN": True} and r[0]["t"] == "Text" and r[1]["s"] is None and r[1]["t"].startswith("ACRONYM_STATE") and r[2]["t"] is None
    h = spark.createDataFrame([("s", i, "x" * n) for i, n in ((1, 100), (2, 1000), (3, 10))], "session_id string, batch_num int, content string")
    assert [x["batch_num"] for x in sessions.trimmed_history(h, "session_id", "batch_num", "content", 100).collect()] == [3]


def test_budget_batches(spark):
    d = spark.createDataFrame([("d", i, s) for i, s in enumerate([5, 5, 9, 100, 1])], "doc_id string, i int, s int")
    assert [r["batch"] for r in structure.budget_batches(d, "doc_id", "i", F.col("s"), 10).orderBy("i").collect()] == [0, 0, 1, 2, 3]


def test_limiter_and_halving(spark):
    c = spark.createDataFrame([("a", 0.0, 30000), ("a", 1.0, 10000), ("a", 2.0, 5), ("a", 70.0, 39000)], "s string, at double, tokens long")
    assert [round(r["sent_at"], 1) for r in sessions.simulate_limiter(c, "s", "at", "tokens", 39000).orderBy("at").collect()] == [0.0, 60.0, 60.0, 120.0]
    h = spark.createDataFrame([("a", i, 60) for i in range(5)], "k string, i int, n long")
    assert [r["part"] for r in sessions.halved_batches(h, ["k"], "i", "n", 130).orderBy("i").collect()] == [0, 0, 1, 2, 2]


def test_connectors(spark):
    t = spark.createDataFrame([(1, 'Say "5%" now'), (2, 'Say "5%" now'), (3, "boom")], "k int, text string")

    class Shout:
        def __call__(self, prompt):
            if "boom" in prompt:
                raise RuntimeError("no")
            return "Corrected:\n" + prompt.rpartition("Input text:")[2].strip().replace("Say", "SAY")

    cache = spark.createDataFrame([], "key string, response string")
    got = {r["k"]: r["corrected"] for r in connectors.corrected(t, "Fix", Shout(), cache).collect()}
    assert got == {1: 'SAY "5%" now', 2: 'SAY "5%" now', 3: "boom"}
    p = spark.createDataFrame([("x",), ("x",), ("y",)], "prompt string")
    assert connectors.ask(p, cache, connectors.Table({"x": "1"})).count() == 2
    tries = []

    def flaky(prompt):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError
        return "ok"

    assert connectors.with_retries(flaky, 3, sleep=lambda s: None)("p") == "ok"
    with pytest.raises(RuntimeError):
        connectors.first_of(lambda p: (_ for _ in ()).throw(RuntimeError()))("p")


def test_batched_rewrite(spark):
    rows = [("d", 0, "One §FOOTNOTE:1§ two"), ("d", 1, "Three"), ("d", 2, ""), ("d", 3, "§FOOTNOTE:2§"), ("d", 4, "four, §FOOTNOTE:3§§FOOTNOTE:4§ five"), ("e", 0, None), ("e", 1, "x")]
    d = spark.createDataFrame(rows, "doc_id string, para_idx int, text string")
    cache = spark.createDataFrame([], "key string, response string")

    def shout(prompt):
        return "Corrected:\n" + prompt.rpartition("Input text:")[2].strip().upper()

    for size in (1, 2, 5):
        got = {(r["doc_id"], r["para_idx"]): r["rewritten"] for r in connectors.batched_rewrite(d, "Do", shout, cache, batch_size=size).collect()}
        assert got == {("d", 0): "ONE §FOOTNOTE:1§ TWO", ("d", 1): "THREE", ("d", 3): "§FOOTNOTE:2§", ("d", 4): "FOUR, §FOOTNOTE:3§§FOOTNOTE:4§ FIVE", ("e", 1): "X"}
    lost = connectors.batched_rewrite(d, "Do", lambda p: "Corrected:\nonly one", cache, batch_size=5).where("doc_id = 'd' AND para_idx = 0").first()
    assert lost["rewritten"] == rows[0][2]


def test_acronym_stream(spark, tmp_path):
    from proseframe.streaming.acronyms import acronym_stream

    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    pd.DataFrame({"session_id": ["a", "a", "b"], "batch_num": pd.array([2, 1, 1], "int32"), "content": ["UN and ILO", "The UN met", None]}).to_parquet(src / "1.parquet")
    s = spark.readStream.schema("session_id string, batch_num int, content string").parquet(str(src))
    q = acronym_stream(s).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["batch_num"], r["acronym"], r["is_new"]) for r in spark.read.parquet(str(out)).collect()} == {(1, "UN", True), (2, "UN", False), (2, "ILO", True)}


def test_ordered_against_windows(spark):
    import random

    from pyspark.sql import Window

    from proseframe.operators.ordered import with_last_before, with_number

    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, None, "x", "y"])) for k in ("a", "b", None) for i in rng.sample(range(200), 60)]
    d = spark.createDataFrame(rows, "k string, i int, e string")
    w = Window.partitionBy("k").orderBy("i")
    for block in (1, 7, 1000):
        n = with_number(d, ["k"], "i", "n", block).withColumn("m", F.row_number().over(w))
        assert n.where("n <> m").count() == 0 and n.count() == len(rows)
        p = with_last_before(d, ["k"], "i", F.col("e"), "p", block).withColumn("q", F.last("e", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        assert p.where("NOT p <=> q").count() == 0 and p.count() == len(rows)


def test_budget_blocks_against_fold(spark):
    import random

    def fold(sizes, budget):
        cur, b, out = 0, 0, []
        for s in sizes:
            if cur > 0 and cur + s > budget:
                cur, b = 0, b + 1
            cur += s
            out.append(b)
        return out

    rng = random.Random(9)
    docs = {f"d{k}": [rng.choice([0, 0, 1, 3, 7, 12, 25]) for _ in range(rng.randint(1, 60))] for k in range(12)}
    docs[None] = [0, 30, 0, 5]
    rows = [(k, i, s) for k, v in docs.items() for i, s in enumerate(v)]
    d = spark.createDataFrame(rows, "doc_id string, i int, s int")
    for block in (1, 4, 1000):
        got = {(r["doc_id"], r["i"]): r["batch"] for r in structure.budget_batches(d, "doc_id", "i", F.col("s"), 10, block).collect()}
        want = {(k, i): b for k, v in docs.items() for i, b in enumerate(fold(v, 10))}
        assert got == want, block


def test_checked_broadcast(spark):
    from proseframe.operators.joins import checked_broadcast

    d = spark.createDataFrame([(i, str(i)) for i in range(20)], "k int, v string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    big = spark.range(1000).selectExpr("cast(id as int) AS k")
    assert "broadcast" in plan(big.join(checked_broadcast(d), "k")) and "broadcast" not in plan(big.join(checked_broadcast(d, 10), "k"))
    assert big.join(checked_broadcast(d, 10), "k").count() == 20


def test_dictionary_hits_of_long_entries_and_texts(spark):
    """Entries of any length, and a text of 100 000 words in a time that grows with its length."""
    import time

    long = " ".join(f"w{i}" for i in range(13))
    d = spark.createDataFrame([(1, long), (2, "w3 w4"), (3, "x y")], "e int, term string")
    t = spark.createDataFrame([(1, "see " + long.upper() + " and w3 w4"), (2, None), (3, ""), (4, "x y " * 50_000)], "k int, text string")
    at = time.perf_counter()
    got = mentions.dictionary_hits(t, d, ["k"], "text", "term").groupBy("k", "e", "n").count().collect()
    assert {tuple(r) for r in got} == {(1, 1, 13, 1), (1, 2, 2, 1), (4, 3, 2, 50_000)}
    new = mentions.expand_mentions(t.withColumn("doc", F.lit(1)), spark.createDataFrame([("XY", "x y")], "abbr string, full string"), "doc", "k").where("k = 4").first()["text"]
    assert new == "x y (XY)" + " XY" * 49_999 + " "
    assert time.perf_counter() - at < 60


def test_collapse_names(spark):
    rows = [(1, 0, 'Dr Anna Maria Berg met Raj Rao. "Raj Rao" said'), (1, 1, "Anna Maria Berg and Prof. Raj Rao met Li Wei."), (2, 0, "Raj  Rao, then Raj Rao"), (2, 1, None), (2, 2, "nobody")]
    got = {(r["d"], r["i"]): r["text"] for r in mentions.collapse_names(spark.createDataFrame(rows, "d int, i int, text string"), "d", "i").collect()}
    assert got == {(1, 0): rows[0][2], (1, 1): "Berg and Rao met Li Wei.", (2, 0): "Raj  Rao, then Rao", (2, 1): None, (2, 2): "nobody"}


def test_dictionaries_keep_the_last(spark):
    d = spark.createDataFrame([(1, "UN", "United Nations"), (2, "U.N.", "united  nations"), (3, "EU", "European Union"), (4, "European Commission", "EC"), (5, "EC", "Extra Credit")], "o int, abbr string, full string")
    assert {(r["o"], r["abbr"]) for r in mentions.dedupe_expansions(d, "o").collect()} == {(2, "U.N."), (3, "EU"), (4, "European Commission"), (5, "EC")}
    assert {(r["abbr"], r["full"]) for r in mentions.oriented_dictionary(d.where("o >= 3"), "o", "abbr", "full").collect()} == {("EU", "European Union"), ("EC", "Extra Credit")}


def test_align_between_ends():
    def plain(x):
        return [(s["text"], s["hl"]) for s in x]

    assert plain(diff.align("a b c", "a x c")) == [("a ", False), ("x", True), (" c", False)]
    assert plain(diff.align("a a", "a a a")) == [("a a", False), (" a", True)] and plain(diff.align("", "a")) == [("a", True)] and diff.align("a", "") == [] and plain(diff.align("a", "a")) == [("a", False)]
    long = "word and " * 20_000
    got = plain(diff.align(long + "old" + long, long + "new" + long))
    assert "".join(t for t, _ in got) == long + "new" + long and [t for t, hl in got if hl] == ["newword"]


def test_results_glosses_and_cache(spark, tmp_path):
    r = spark.createDataFrame([(1, i, u) for i, u in enumerate(["https://skip.org/a", "http://www.skip.org", "https://a.org", None, "https://notskip.org", "https://b.org", "https://c.org"])], "q int, n int, url string")
    assert [x["n"] for x in connectors.top_results(r, ["q"], "n", "url", ("skip.org",)).orderBy("n").collect()] == [2, 3, 4, 5]
    p = spark.createDataFrame([(1, 1, "the shura council met"), (1, 2, None), (1, 3, "shura")], "doc_id int, para_idx int, text string")
    g = spark.createDataFrame([(1, 1, "shura", "assembly"), (1, 1, "shura council", "body"), (1, 3, "shura", "other"), (1, 3, "", "x")], "doc_id int, para_idx int, phrase string, gloss string")
    got = {x["para_idx"]: x["text"] for x in connectors.with_glosses(p, connectors.first_glosses(g, "doc_id", ["para_idx"]), ["doc_id", "para_idx"]).collect()}
    assert got == {1: "the **shura* (assembly) council* (body) met", 2: None, 3: "*shura* (assembly)"}
    path = str(tmp_path / "cache")
    assert connectors.load_cache(spark, path).count() == 0
    connectors.save_cache(spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None)], "key string, response string"), path)
    assert [tuple(x) for x in connectors.load_cache(spark, path).collect()] == [("a", "x")]


def test_scanned_variants(spark):
    d = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "doc_id int, text string")
    replies = connectors.Table({"Scan.\n<<DOC-START>>\nx\n<<DOC-END>>": 'Found: {"China": ["PRC", "China"], "UN": ["U.N."]}', "Scan.\n<<DOC-START>>\ny\n<<DOC-END>>": "none"})
    cache = spark.createDataFrame([], "key string, response string")
    assert {tuple(x) for x in connectors.scanned_variants(d, "Scan.", replies, cache).collect()} == {(1, "China", "PRC"), (1, "UN", "U.N.")}


def test_expansion_batches_carry_state(spark):
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate(["The UN met.", "a", "b", "c", "ISAS and UN.", "d"])], "doc_id int, para_idx int, text string")
    cache = spark.createDataFrame([], "key string, response string")
    r = connectors.batched_expansion(d, "Do.", connectors.Rewriter(str.upper), cache).orderBy("para_idx").collect()
    assert [(x["batch"], x["known"], x["rewritten"]) for x in r] == [(0, 0, "THE UN MET."), (0, 0, "A"), (0, 0, "B"), (0, 0, "C"), (1, 1, "ISAS AND UN."), (1, 1, "D")]


def test_progress(spark):
    from proseframe.operators.progress import ProgressLog

    log = ProgressLog()
    d = log.watch(log.watch(spark.range(10), "read").where("id > 3"), "kept")
    assert d.count() == 6 and log.lines() == [("read", 10), ("kept", 6)]


def test_heading_signs_stay_outside_markers(spark):
    d = spark.createDataFrame([(1, 0, "text", "## Head ", True, False), (1, 1, "text", "tail", False, True), (2, 0, "text", "#tag", True, True)], "k int, run_idx int, kind string, text string, bold boolean, italic boolean")
    assert [r["marked"] for r in structure.coalesced_runs(d, ["k"]).orderBy("k", "island").collect()] == ["## **Head** ", "*tail*", "***#tag***"]
