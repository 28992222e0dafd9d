"""Queries of structure: predicates over paragraphs, flags, batches, runs, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import diff, notes as nt, structure as st
from ..operators.joins import checked_broadcast
from ..functions import numbers
from ..functions import text as tx
from .base import LINE, NOTES, PARAS, RUNS, Registry, lines, notes, paragraphs, runs, table

query = Registry()
KEY = "regexp_replace(lower(coalesce(style, '')), '\\s+', '', 'g')"
T = "coalesce(text, '')"


@query(f"SELECT doc_id, para_idx, {KEY} LIKE 'heading%' OR {KEY} IN ('title', 'subtitle') AS heading, contains({KEY}, 'heading') OR contains({KEY}, 'title') AS heading_wide, contains({KEY}, 'quote') AS quote, contains({KEY}, 'toc') AS toc, lower(trim({T})) IN ('abbreviations', 'executive summary', 'introduction', 'conclusion') AS section FROM {PARAS}")
def heading_like(spark: SparkSession, sf: str) -> DataFrame:
    s, t = F.col("style"), F.col("text")
    return paragraphs(spark, sf, "style", "text").select("doc_id", "para_idx", st.is_heading_style(s).alias("heading"), st.is_heading_contains(s).alias("heading_wide"), st.is_quote_style(s).alias("quote"), st.is_toc_style(s).alias("toc"), st.is_section_heading(t).alias("section"))


@query(f"SELECT doc_id, kind, note_id, regexp_matches(t, '^\\[.*\\]$') OR regexp_matches(t, '^\\d{{1,3}}$') OR regexp_matches(t, '(?i)\\bet al\\.|\\bibid\\b|\\bop\\. cit\\.|\\bcf\\.|\\bpp\\.|\\bvol\\.') OR regexp_matches(t, '^[\\[(^*]') OR regexp_matches(t, '[†‡§¹²³]') OR regexp_matches(t, '§FOOTNOTE:\\d+§') AS citation FROM (SELECT doc_id, kind, note_id, trim({T}) AS t FROM {NOTES})")
def citation_like(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf, "text").select("doc_id", "kind", "note_id", st.is_citation_like(F.col("text")).alias("citation"))


@query(f"""SELECT doc_id, para_idx, contains(k, 'toc') OR ((t = 'contents' OR coalesce(e, false)) AND t <> '' AND t NOT IN ('abbreviations', 'executive summary', 'introduction', 'conclusion')) AS in_toc FROM (
    SELECT doc_id, para_idx, t, k, last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM (
    SELECT doc_id, para_idx, {KEY} AS k, lower(trim({T})) AS t, CASE WHEN lower(trim({T})) = 'contents' THEN true WHEN lower(trim({T})) IN ('abbreviations', 'executive summary', 'introduction', 'conclusion') THEN false END AS ev FROM {PARAS}))""")
def toc_flag(spark: SparkSession, sf: str) -> DataFrame:
    return st.with_toc_flag(paragraphs(spark, sf, "style", "text")).select("doc_id", "para_idx", "in_toc")


_CITES = "(regexp_matches(t, '^\\[.*\\]$') OR regexp_matches(t, '^\\d{1,3}$') OR regexp_matches(t, '(?i)\\bet al\\.|\\bibid\\b|\\bop\\. cit\\.|\\bcf\\.|\\bpp\\.|\\bvol\\.') OR regexp_matches(t, '^[\\[(^*]') OR regexp_matches(t, '[†‡§¹²³]') OR regexp_matches(t, '§FOOTNOTE:\\d+§'))"


@query(f"SELECT doc_id, para_idx FROM (SELECT DISTINCT ON (doc_id, para_idx) doc_id, para_idx, trim({T}) AS t, coalesce(len(footnote_refs), 0) AS n FROM paragraphs) WHERE (length(t) > 0 OR n > 0) AND NOT ({_CITES} AND n <= 0)")
def paragraphs_to_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    return st.to_rewrite(paragraphs(spark, sf, "text", "footnote_refs")).select("doc_id", "para_idx")


@query(f"SELECT doc_id, min(para_idx) AS para_idx FROM {PARAS} WHERE length(trim({T})) > 0 GROUP BY doc_id")
def first_nonempty(spark: SparkSession, sf: str) -> DataFrame:
    return st.with_first_text(paragraphs(spark, sf, "text")).where("is_first").select("doc_id", "para_idx")


@query(f"""SELECT doc_id, max(CASE WHEN r = 1 THEN text END) AS title, max(CASE WHEN r = 2 THEN text END) AS lead FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS r FROM {PARAS} WHERE length(trim({T})) > 0) WHERE r <= 2 GROUP BY doc_id""")
def title_and_lead(spark: SparkSession, sf: str) -> DataFrame:
    full = paragraphs(spark, sf, "text").where(F.length(F.trim("text")) > 0)
    top = full.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("para_idx"))).where("r <= 2")
    return top.groupBy("doc_id").agg(F.max(F.when(F.col("r") == 1, F.col("text"))).alias("title"), F.max(F.when(F.col("r") == 2, F.col("text"))).alias("lead"))


@query(f"""SELECT doc_id, para_idx, text FROM (SELECT doc_id, para_idx, text, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS r FROM {PARAS} WHERE length(trim({T})) > 0) WHERE r <= 80""")
def preview_lines(spark: SparkSession, sf: str) -> DataFrame:
    return st.first_per_document(paragraphs(spark, sf, "text").where(F.length(F.trim("text")) > 0), "doc_id", "para_idx", 80)


@query(f"""SELECT doc_id, para_idx FROM {RUNS} GROUP BY doc_id, para_idx HAVING bool_or(coalesce(bold, false)) AND length(trim(string_agg({T}, '' ORDER BY run_idx))) > 0
    AND len(string_split(trim(regexp_replace(string_agg({T}, '' ORDER BY run_idx), '\\s+', ' ', 'g')), ' ')) <= 7""")
def short_bold_heading(spark: SparkSession, sf: str) -> DataFrame:
    return st.short_bold(runs(spark, sf, "text", "bold"), ["doc_id", "para_idx"]).select("doc_id", "para_idx")


_TOC = f"""SELECT doc_id, para_idx, contains(k, 'toc') OR ((t = 'contents' OR coalesce(e, false)) AND t <> '' AND t NOT IN ('abbreviations', 'executive summary', 'introduction', 'conclusion')) AS in_toc FROM (
    SELECT doc_id, para_idx, t, k, last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM (
    SELECT doc_id, para_idx, {KEY} AS k, lower(trim({T})) AS t, CASE WHEN lower(trim({T})) = 'contents' THEN true WHEN lower(trim({T})) IN ('abbreviations', 'executive summary', 'introduction', 'conclusion') THEN false END AS ev FROM {PARAS}))"""


@query(f"""WITH p AS (SELECT DISTINCT ON (doc_id, para_idx) *, {KEY} AS k FROM paragraphs), toc AS ({_TOC}),
    first AS (SELECT doc_id, min(para_idx) AS m FROM p WHERE length(trim({T})) > 0 GROUP BY doc_id),
    bold AS (SELECT doc_id, para_idx FROM {RUNS} GROUP BY doc_id, para_idx HAVING bool_or(coalesce(bold, false)) AND length(trim(string_agg({T}, '' ORDER BY run_idx))) > 0 AND len(string_split(trim(regexp_replace(string_agg({T}, '' ORDER BY run_idx), '\\s+', ' ', 'g')), ' ')) <= 7)
    SELECT p.doc_id, p.para_idx, NOT (p.in_table OR p.k LIKE 'heading%' OR p.k IN ('title', 'subtitle') OR contains(p.k, 'quote') OR p.has_image OR coalesce(len(p.footnote_refs), 0) > 0) AS safe,
      t.in_toc OR contains(p.k, 'heading') OR contains(p.k, 'title') OR f.m IS NULL OR p.para_idx < f.m OR b.doc_id IS NOT NULL OR p.in_table OR p.has_image AS skipped
    FROM p JOIN toc t USING (doc_id, para_idx) LEFT JOIN first f ON p.doc_id = f.doc_id LEFT JOIN bold b ON p.doc_id = b.doc_id AND p.para_idx = b.para_idx""")
def paragraph_safe_and_skipped(spark: SparkSession, sf: str) -> DataFrame:
    p = paragraphs(spark, sf, "text", "style", "in_table", "has_image", "footnote_refs")
    return st.with_skipped(st.with_safe(p), runs(spark, sf, "text", "bold")).select("doc_id", "para_idx", "safe", "skipped")


@query(f"""SELECT p.doc_id, count(*) AS repeats FROM {PARAS} p WHERE EXISTS (SELECT 1 FROM {PARAS} h WHERE h.doc_id = p.doc_id AND regexp_replace(lower(coalesce(h.style, '')), '\\s+', '', 'g') = 'title' AND trim(coalesce(h.text, '')) = trim(coalesce(p.text, ''))) GROUP BY p.doc_id""")
def header_text_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs whose trimmed text is one of the document's header texts, here its titles."""
    p = paragraphs(spark, sf, "style", "text").withColumn("t", F.trim(F.coalesce("text", F.lit(""))))
    heads = p.where(st.style_key(F.col("style")) == "title").select("doc_id", "t").distinct()
    return p.join(heads, ["doc_id", "t"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("repeats"))


@query(f"SELECT doc_id, para_idx, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) - 1) // 4 AS INTEGER) AS batch FROM {PARAS} WHERE NOT skip")
def para_batches(spark: SparkSession, sf: str) -> DataFrame:
    return st.fixed_batches(paragraphs(spark, sf, "skip").where("NOT skip").select("doc_id", "para_idx"), "doc_id", "para_idx", 4)


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, para_idx, length({T}) + 50 AS s, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS r FROM {PARAS}),
    f AS (SELECT doc_id, para_idx, r, CAST(s AS BIGINT) AS cur, 0 AS batch FROM p WHERE r = 1
      UNION ALL SELECT p.doc_id, p.para_idx, p.r, CASE WHEN f.cur + p.s > 8000 THEN p.s ELSE f.cur + p.s END, CASE WHEN f.cur + p.s > 8000 THEN f.batch + 1 ELSE f.batch END FROM f JOIN p ON p.doc_id = f.doc_id AND p.r = f.r + 1)
    SELECT doc_id, para_idx, CAST(batch AS INTEGER) AS batch FROM f""")
def char_budget_batches(spark: SparkSession, sf: str) -> DataFrame:
    return st.budget_batches(paragraphs(spark, sf, "text"), "doc_id", "para_idx", F.length(F.coalesce("text", F.lit(""))) + 50, 8000)


@query(f"SELECT doc_id, string_agg({T}, chr(10) ORDER BY para_idx) AS joined FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS r FROM {PARAS} WHERE NOT skip) WHERE r <= 10 GROUP BY doc_id")
def context_head(spark: SparkSession, sf: str) -> DataFrame:
    p = paragraphs(spark, sf, "text", "skip").where("NOT skip")
    return st.joined_text(st.first_per_document(p, "doc_id", "para_idx", 10), ["doc_id"], "para_idx", "text", "\n")


@query(f"""WITH r AS (SELECT doc_id, para_idx, run_idx, kind, {T} AS text, coalesce(bold, false) AS b, coalesce(italic, false) AS i FROM {RUNS}),
    c AS (SELECT *, CASE WHEN kind <> 'text' OR lag(kind) OVER w IS NULL OR lag(kind) OVER w <> kind OR lag(b) OVER w <> b OR lag(i) OVER w <> i THEN 1 ELSE 0 END AS ch FROM r WINDOW w AS (PARTITION BY doc_id, para_idx ORDER BY run_idx)),
    g AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id, para_idx ORDER BY run_idx ROWS UNBOUNDED PRECEDING) AS island FROM c),
    x AS (SELECT doc_id, para_idx, CAST(island AS INTEGER) AS island, any_value(b) AS b, any_value(i) AS i, string_agg(text, '' ORDER BY run_idx) AS t FROM g WHERE kind = 'text' GROUP BY ALL)
    SELECT doc_id, para_idx, island, concat(regexp_extract(body, '^#{{1,6}}\\s+'), s, substr(body, length(regexp_extract(body, '^#{{1,6}}\\s+')) + 1), s, substr(t, length(body) + 1)) AS marked FROM (SELECT *, concat(CASE WHEN b THEN '**' ELSE '' END, CASE WHEN i THEN '*' ELSE '' END) AS s, regexp_replace(t, '\\s+$', '') AS body FROM x) WHERE length(trim(regexp_replace(t, '\\s+', ' ', 'g'))) > 0""")
def run_coalesce_markers(spark: SparkSession, sf: str) -> DataFrame:
    return st.coalesced_runs(runs(spark, sf, "text", "bold", "italic", "kind"), ["doc_id", "para_idx"]).select("doc_id", "para_idx", "island", "marked")


@query(f"""WITH r AS (SELECT doc_id, para_idx, run_idx, {T} AS t FROM {RUNS}), j AS (SELECT doc_id, para_idx, concat('~', string_agg(t, '' ORDER BY run_idx), '!') AS new FROM r GROUP BY ALL),
    w AS (SELECT doc_id, para_idx, run_idx, length(t) AS n, coalesce(sum(length(t)) OVER (PARTITION BY doc_id, para_idx ORDER BY run_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, lead(run_idx) OVER (PARTITION BY doc_id, para_idx ORDER BY run_idx) IS NULL AS l FROM r)
    SELECT doc_id, para_idx, run_idx, CASE WHEN l THEN substr(new, CAST(a AS BIGINT) + 1) ELSE substr(new, CAST(a AS BIGINT) + 1, n) END AS text FROM w JOIN j USING (doc_id, para_idx)""")
def run_reslice(spark: SparkSession, sf: str) -> DataFrame:
    r = runs(spark, sf, "text")
    j = st.joined_text(r, ["doc_id", "para_idx"], "run_idx", "text", "").select("doc_id", "para_idx", F.concat(F.lit("~"), "joined", F.lit("!")).alias("new"))
    return st.resliced(r, j, ["doc_id", "para_idx"])


@query(f"""SELECT doc_id, para_idx, count(*) FILTER (regexp_matches(s, '^§FOOTNOTE:\\d+§$')) AS footnotes, count(*) AS segments, CAST(sum(length(trim(s))) AS BIGINT) AS chars FROM (SELECT doc_id, para_idx, unnest(regexp_extract_all(text, '§FOOTNOTE:\\d+§|[^§]+')) AS s FROM {PARAS} WHERE length(text) > 0) GROUP BY doc_id, para_idx""")
def footnote_split(spark: SparkSession, sf: str) -> DataFrame:
    e = paragraphs(spark, sf, "text").where("length(text) > 0").select("doc_id", "para_idx", F.explode(st.footnote_segments(F.col("text"))).alias("s"))
    return e.groupBy("doc_id", "para_idx").agg(F.count(F.when(F.col("s.kind") == "footnote", 1)).alias("footnotes"), F.count("*").alias("segments"), F.sum(F.length("s.text")).alias("chars"))


@query(f"""SELECT coalesce(n.doc_id, p.doc_id) AS doc_id, coalesce(notes, 0) AS notes, coalesce(refs, 0) AS refs, coalesce(placeholders, 0) AS placeholders, coalesce(notes, 0) >= coalesce(refs, 0) AS kept FROM
    (SELECT doc_id, count(*) AS notes FROM {NOTES} WHERE note_id NOT IN (-1, 0) GROUP BY doc_id) n FULL JOIN
    (SELECT doc_id, CAST(sum(len(footnote_refs)) AS BIGINT) AS refs, CAST(sum(len(regexp_extract_all({T}, '§FOOTNOTE:\\d+§'))) AS BIGINT) AS placeholders FROM (SELECT DISTINCT ON (doc_id, para_idx) doc_id, para_idx, text, footnote_refs FROM paragraphs) GROUP BY doc_id) p ON n.doc_id = p.doc_id""")
def footnote_count(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf).where("note_id NOT IN (-1, 0)").groupBy("doc_id").agg(F.count("*").alias("notes"))
    p = paragraphs(spark, sf, "text", "footnote_refs").groupBy("doc_id").agg(F.sum(F.coalesce(F.size("footnote_refs"), F.lit(0)).cast("long")).alias("refs"), F.sum(tx.count_matches(F.coalesce("text", F.lit("")), st.FOOTNOTE).cast("long")).alias("placeholders"))
    return n.join(p, "doc_id", "full").na.fill(0).select("doc_id", "notes", "refs", "placeholders", (F.col("notes") >= F.col("refs")).alias("kept"))


@query(f"""SELECT doc_id, count(*) AS before, count(*) FILTER (NOT contains({T}, '2019')) AS after, count(*) FILTER (contains({T}, '2019')) = 0 AS kept, count(*) FILTER (contains({T}, '2019')) > 0 AS fewer FROM {NOTES} WHERE note_id NOT IN (-1, 0) GROUP BY doc_id""")
def notes_preserved(spark: SparkSession, sf: str) -> DataFrame:
    """Notes before and after a rewriting that lost those that speak of 2019."""
    n = notes(spark, sf, "text").where("note_id NOT IN (-1, 0)")
    return nt.preserved(n, n.where(~F.coalesce(F.col("text"), F.lit("")).contains("2019")), ["doc_id"])


@query(f"""SELECT doc_id, para_idx, run_idx, md5(regexp_replace(replace(replace(nfc_normalize(text), chr(11), chr(10)), chr(12), chr(10)), '[\\x00-\\x08\\x0E-\\x1F]', '', 'g')) AS digest FROM {RUNS} WHERE text IS NOT NULL""")
def xml_safe_runs(spark: SparkSession, sf: str) -> DataFrame:
    return tx.with_text(runs(spark, sf, "text").where("text IS NOT NULL"), tx.xml_safe).select("doc_id", "para_idx", "run_idx", F.md5("text").alias("digest"))


@query(f"SELECT doc_id, kind, note_id, CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY note_id) AS INTEGER) AS number FROM {NOTES} WHERE note_id NOT IN (-1, 0) AND length(text) > 0")
def note_renumber(spark: SparkSession, sf: str) -> DataFrame:
    return nt.numbered_notes(notes(spark, sf, "text")).select("doc_id", "kind", "note_id", "number")


@query(f"SELECT doc_id, count(*) AS refs, count(*) FILTER (superscript) AS raised, count(*) FILTER (coalesce(bold, false)) AS bold FROM {RUNS} WHERE kind = 'footnote_ref' GROUP BY doc_id")
def footnote_run_format(spark: SparkSession, sf: str) -> DataFrame:
    r = runs(spark, sf, "kind", "superscript", "bold").where("kind = 'footnote_ref'")
    return r.groupBy("doc_id").agg(F.count("*").alias("refs"), F.count(F.when(F.col("superscript"), 1)).alias("raised"), F.count(F.when(F.col("bold"), 1)).alias("bold"))


@query(f"SELECT doc_id, para_idx, coalesce(b, false) AS style_bold FROM (SELECT doc_id, para_idx, {KEY} AS k FROM {PARAS}) LEFT JOIN (VALUES ('title', true), ('heading1', true), ('heading2', true), ('normal', false)) s(k, b) USING (k)")
def style_bold(spark: SparkSession, sf: str) -> DataFrame:
    dim = spark.createDataFrame([("title", True), ("heading1", True), ("heading2", True), ("normal", False)], "k string, b boolean")
    return paragraphs(spark, sf, "style").withColumn("k", st.style_key(F.col("style"))).join(checked_broadcast(dim), "k", "left").select("doc_id", "para_idx", F.coalesce("b", F.lit(False)).alias("style_bold"))


@query(f"""SELECT p.doc_id, p.para_idx, 'Calibri' AS font, CAST(CASE WHEN p.para_idx = f.m AND (p.k LIKE 'heading%' OR p.k IN ('title', 'subtitle')) THEN 28 ELSE 24 END AS INTEGER) AS half_points FROM (SELECT *, {KEY} AS k FROM {PARAS}) p LEFT JOIN (SELECT doc_id, min(para_idx) AS m FROM {PARAS} WHERE length(trim({T})) > 0 GROUP BY doc_id) f ON p.doc_id = f.doc_id""")
def font_policy(spark: SparkSession, sf: str) -> DataFrame:
    p = st.with_first_text(paragraphs(spark, sf, "text", "style"))
    font, size, _ = st.style_policy(F.lit(False), st.is_heading_style(F.col("style")), F.col("is_first"))
    return p.select("doc_id", "para_idx", font.alias("font"), size.alias("half_points"))


@query(f"SELECT doc_id, count(*) FILTER (in_table) AS table_paragraphs, count(*) FILTER (has_image) AS images, count(*) FILTER (skip) AS skipped FROM {PARAS} GROUP BY doc_id")
def table_and_image_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    c = lambda x: F.count(F.when(F.col(x), 1))
    return paragraphs(spark, sf, "in_table", "has_image", "skip").groupBy("doc_id").agg(c("in_table").alias("table_paragraphs"), c("has_image").alias("images"), c("skip").alias("skipped"))


@query("WITH x AS (SELECT l_suppkey AS k, l_orderkey % 500 AS s, l_orderkey % 500 + CAST(l_quantity AS INTEGER) AS e FROM lineitem), y AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM x), z AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM y) SELECT k, min(s) AS s, max(e) AS e FROM z GROUP BY k, g")
def span_merge(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").selectExpr("l_suppkey AS k", "l_orderkey % 500 AS s", "l_orderkey % 500 + CAST(l_quantity AS INT) AS e")
    return st.merged_spans(x, "k")


@query(f"SELECT k, n, concat('a§FOOTNOTE:', n, '§ b§FOOTNOTE:', q, '§§FOOTNOTE:', q + 1, '§') AS text FROM {LINE}")
def placeholder_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    f = lambda c: F.concat(F.lit("§FOOTNOTE:"), c, F.lit("§"))
    t = F.concat(F.lit("a"), f("n"), f("n"), f("n"), F.lit(" b"), f("q"), f(F.col("q") + 1), f(F.col("q") + 1))
    return lines(spark, sf).select("k", "n", st.dedupe_placeholders(t).alias("text"))


_AROUND = [(' "', '" '), ("'", '" '), ("'\"\"", "'"), ("\"''", '"'), ("'\"", "'"), ("''", "''")]


@query("SELECT c_custkey AS k, c_custkey % 6 IN (0, 2, 3) AS whole_quote, c_custkey % 3 = 0 AS leak FROM customer")
def quote_and_leak(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda i: F.element_at(tx.lit_array([x[i] for x in _AROUND]), (F.col("c_custkey") % 6 + 1).cast("int"))
    t = F.concat(side(0), "c_name", side(1))
    r = F.concat(F.when(F.col("c_custkey") % 3 == 0, F.lit("TASK 1: ")).otherwise(F.lit("A task: ")), "c_name")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), st.is_whole_quote(t).alias("whole_quote"), st.leaks_prompt(r).alias("leak"))


# ---- notes and citations

@query("SELECT l_orderkey AS k, l_linenumber AS n, strftime(l_shipdate, '%d %B %Y') AS iso, strftime(l_shipdate, '%d %B %Y') AS dmy, strftime(l_shipdate, '%d %b %Y') AS named FROM lineitem")
def url_date(spark: SparkSession, sf: str) -> DataFrame:
    u = lambda f, end: nt.url_date(F.concat(F.lit("https://x.org/a/"), F.date_format("l_shipdate", f), F.lit(end)))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), u("yyyy-MM-dd", "/wp.pdf").alias("iso"), u("dd/MM/yyyy", "-x").alias("dmy"), u("yyyy_MMM_dd", ".html").alias("named"))


_URLS = ["https://x.org/WP_7.pdf", "https://x.org/policy-brief/7", "https://x.org/technical_report", "https://x.org/research-paper", "https://x.org/a"]
_KIND = "['Working Paper', 'Policy Brief', 'Technical Report', 'Working Paper', 'Policy Brief'][CAST(o_orderkey % 5 AS INTEGER) + 1]"
@query(f"SELECT o_orderkey AS k, {_KIND} AS kind, concat('paper_type: ', {_KIND}) AS meta FROM orders")
def paper_type(spark: SparkSession, sf: str) -> DataFrame:
    u = F.element_at(tx.lit_array(_URLS), (F.col("o_orderkey") % 5 + 1).cast("int"))
    s = F.lit("This policy brief says")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), nt.paper_type(u, s).alias("kind"), nt.citation_metadata(u, s, "gov.example", "A", "P", "S").alias("meta"))


@query(f"SELECT doc_id, kind, note_id, CASE WHEN regexp_matches(text, 'https?://[^\\s)]+') THEN text ELSE concat(text, ' https://n.example/', note_id) END AS text FROM {NOTES} WHERE text IS NOT NULL")
def url_append(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf, "text").where("text IS NOT NULL").select("doc_id", "kind", "note_id", nt.append_url(F.col("text"), F.concat(F.lit("https://n.example/"), "note_id")).alias("text"))


@query("SELECT o_orderkey AS k, concat('plain:See |italic:Title ', o_orderkey, '|plain: at |hyperlink:https://x.org/', o_orderkey, '|plain: and |hyperlink:http://y.org') AS segments FROM orders")
def md_segments(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("See *Title "), "o_orderkey", F.lit("* at (https://x.org/"), "o_orderkey", F.lit(") and http://y.org"))
    s = F.array_join(F.transform(nt.markdown_segments(t), lambda x: F.concat(x["type"], F.lit(":"), x["text"])), "|")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), s.alias("segments"))


@query("SELECT o_orderkey AS k, concat('A, “T”, ', o_orderkey, '.') AS headed, concat('A line ', o_orderkey) AS bare FROM orders")
def reply_footnote(spark: SparkSession, sf: str) -> DataFrame:
    a = F.concat(F.lit("Sure.\nFormatted Footnote:\nA, “T”, "), "o_orderkey", F.lit(".\n\nNote: checked."))
    b = F.concat(F.lit("I apologize.\n A line "), "o_orderkey", F.lit("\n\nNote: x"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), nt.reply_footnote(a).alias("headed"), nt.reply_footnote(b).alias("bare"))


@query(f"""WITH c AS (SELECT doc_id, note_id, split_part(text, ',', 1) AS work, regexp_extract(text, 'p+\\. ([0-9–]+)', 1) AS pages FROM {NOTES} WHERE note_id NOT IN (-1, 0) AND text IS NOT NULL),
    w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, work ORDER BY note_id) AS seen, lag(work) OVER d AS pw, lag(pages) OVER d AS pp FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY note_id))
    SELECT doc_id, note_id, CASE WHEN seen = 1 THEN 'full' WHEN pw = work AND pp = pages THEN 'ibid' WHEN pw = work THEN 'ibid_page' ELSE 'op_cit' END AS form FROM w""")
def ibid_opcit(spark: SparkSession, sf: str) -> DataFrame:
    c = notes(spark, sf, "text").where("note_id NOT IN (-1, 0) AND text IS NOT NULL").select("doc_id", "note_id", F.split_part("text", F.lit(","), F.lit(1)).alias("work"), F.regexp_extract("text", "p+\\. ([0-9–]+)", 1).alias("pages"))
    return nt.short_citations(c, "doc_id", "note_id", "work", "pages").select("doc_id", "note_id", "form")


@query(f"""SELECT n.doc_id, n.note_id, concat('rId', coalesce(m, 0) + row_number() OVER (PARTITION BY n.doc_id ORDER BY n.note_id)) AS rel_id FROM {NOTES} n LEFT JOIN (SELECT doc_id, count(DISTINCT para_idx) AS m FROM paragraphs WHERE para_idx > 0 GROUP BY doc_id) p ON n.doc_id = p.doc_id WHERE contains(text, 'https://')""")
def relation_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids for the links of notes, after those that the document has, here one per paragraph."""
    w = Window.partitionBy("doc_id").orderBy("para_idx")
    have = paragraphs(spark, sf).where("para_idx > 0").select("doc_id", F.concat(F.lit("rId"), F.row_number().over(w)).alias("rel_id"))
    links = notes(spark, sf, "text").where(F.col("text").contains("https://")).select("doc_id", F.col("note_id").alias("ord"), F.col("text").alias("target"))
    return nt.with_relations(links, have).select("doc_id", F.col("ord").alias("note_id"), "rel_id")


# ---- differences

@query(f"SELECT doc_id, para_idx, CAST(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|\\s+|[^\\p{{L}}\\p{{N}}_\\s]')) AS INTEGER) AS tokens FROM {PARAS} WHERE text IS NOT NULL")
def diff_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs(spark, sf, "text").where("text IS NOT NULL").select("doc_id", "para_idx", F.size(diff.diff_tokens(F.col("text"))).alias("tokens"))


@query(f"SELECT doc_id, para_idx, text AS old, replace(text, 'federal', 'national') AS new FROM {PARAS} WHERE contains(text, 'federal')")
def para_diff_changed(spark: SparkSession, sf: str) -> DataFrame:
    p = paragraphs(spark, sf, "text")
    return diff.changed(p, p.withColumn("text", F.replace("text", F.lit("federal"), F.lit("national"))), ["doc_id", "para_idx"])


def _body_and_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of paragraphs and of notes: part, doc_id, item_idx, text."""
    n = notes(spark, sf, "text").where("note_id NOT IN (-1, 0)").select(F.col("kind").alias("part"), "doc_id", F.col("note_id").alias("item_idx"), "text")
    return paragraphs(spark, sf, "text").select(F.lit("body").alias("part"), "doc_id", F.col("para_idx").alias("item_idx"), "text").unionByName(n)


@query()
def para_diff_highlight(spark: SparkSession, sf: str) -> DataFrame:
    t = _body_and_notes(spark, sf)
    return diff.highlighted_segments(diff.changed(t, t.withColumn("text", numbers.number_rules(F.col("text"))), ["part", "doc_id", "item_idx"]), ["part", "doc_id", "item_idx"])


@query(f"""SELECT part, doc_id, item_idx, count(*) AS highlighted FROM (SELECT 'body' AS part, doc_id, para_idx AS item_idx, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {PARAS} WHERE contains(text, 'federal')
    UNION ALL SELECT kind, doc_id, note_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) FROM {NOTES} WHERE contains(text, 'federal') AND note_id NOT IN (-1, 0)) WHERE w = 'federal' GROUP BY part, doc_id, item_idx""")
def highlights_by_part(spark: SparkSession, sf: str) -> DataFrame:
    """One word replaced in body and notes: each place becomes one highlighted segment, which holds the new word only."""
    t = _body_and_notes(spark, sf)
    new = F.regexp_replace("text", r"(?<![\p{L}\p{N}_])federal(?![\p{L}\p{N}_])", "national")
    s = diff.highlighted_segments(diff.changed(t, t.withColumn("text", new), ["part", "doc_id", "item_idx"]), ["part", "doc_id", "item_idx"])
    return s.where("hl AND text = 'national'").groupBy("part", "doc_id", "item_idx").agg(F.count("*").alias("highlighted"))


QUERIES, ORACLE = query.queries, query.oracle
