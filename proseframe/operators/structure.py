"""Structure of documents: predicates over paragraphs, running flags, batches, runs and their markers.

Numbers and flags that run over a whole document go block by block (operators.ordered), since one
document may hold a large share of all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import BLOCK, with_last_before, with_number

SECTIONS = ("abbreviations", "executive summary", "introduction", "conclusion")
FOOTNOTE = r"§FOOTNOTE:\d+§"


def style_key(style: Column) -> Column:
    """A style's name in lower case without spaces."""
    return F.regexp_replace(F.lower(F.coalesce(style, F.lit(""))), r"\s+", "")


def is_heading_style(style: Column) -> Column:
    s = style_key(style)
    return s.startswith("heading") | s.isin("title", "subtitle")


def is_heading_contains(style: Column) -> Column:
    s = style_key(style)
    return s.contains("heading") | s.contains("title")


def is_quote_style(style: Column) -> Column:
    return style_key(style).contains("quote")


def is_toc_style(style: Column) -> Column:
    return style_key(style).contains("toc")


def is_section_heading(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin(*SECTIONS)


def is_citation_like(text: Column) -> Column:
    """Brackets, bare numbers, citation words, note signs or a footnote placeholder."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return t.rlike(r"^\[.*\]$") | t.rlike(r"^\d{1,3}$") | t.rlike(r"(?i)\bet al\.|\bibid\b|\bop\. cit\.|\bcf\.|\bpp\.|\bvol\.") | t.rlike(r"^[\[(^*]") | t.rlike("[†‡§¹²³]") | t.rlike(FOOTNOTE)


def is_whole_quote(text: Column) -> Column:
    """A line in double quotes, or in single ones that hold two double ones at their start, or the other way round."""
    t = F.trim(text)
    around = lambda a, z: t.startswith(a) & t.endswith(z)
    return around('"', '"') | around("'\"\"", "'") | around("\"''", '"')


def with_safe(paragraphs: DataFrame) -> DataFrame:
    """Adds safe: a paragraph that may be rewritten, which is in no table, no heading, no quotation, and holds text only (no image, no note reference)."""
    s = F.col("style")
    nontext = F.coalesce("has_image", F.lit(False)) | (F.coalesce(F.size("footnote_refs"), F.lit(0)) > 0)
    return paragraphs.withColumn("safe", ~(F.coalesce("in_table", F.lit(False)) | is_heading_style(s) | is_quote_style(s) | nontext))


def with_skipped(paragraphs: DataFrame, runs: DataFrame, most_words: int = 7) -> DataFrame:
    """Adds skipped: contents (a running flag), heading or title by style, what comes before a document's first text, short and bold, in a table, or an image."""
    d = with_toc_flag(paragraphs)
    full = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    first = paragraphs.where(full).groupBy(F.col("doc_id").alias("__doc")).agg(F.min("para_idx").alias("__first"))
    bold = short_bold(runs, ["doc_id", "para_idx"], most_words).select(F.col("doc_id").alias("__d"), F.col("para_idx").alias("__p"), F.lit(True).alias("__bold"))
    d = d.join(first, F.col("doc_id") == F.col("__doc"), "left").join(bold, (F.col("doc_id") == F.col("__d")) & (F.col("para_idx") == F.col("__p")), "left")
    early = F.coalesce(F.col("para_idx") < F.col("__first"), F.lit(True))
    no = F.lit(False)
    skipped = F.col("in_toc") | is_heading_contains(F.col("style")) | early | F.coalesce("__bold", no) | F.coalesce("in_table", no) | F.coalesce("has_image", no)
    return d.select(*paragraphs.columns, skipped.alias("skipped"))


def to_rewrite(paragraphs: DataFrame, text: str = "text", refs: str = "footnote_refs") -> DataFrame:
    """Paragraphs worth rewriting: with a text or a footnote reference, and not a mere citation without one."""
    n = F.coalesce(F.size(refs), F.lit(0))
    full = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0
    return paragraphs.where((full | (n > 0)) & ~(is_citation_like(F.col(text)) & (n <= 0)))


# Markers that only a prompt holds.
LEAK_MARKS = ("ROLE", "TASK", "CHAIN-OF-THOUGHT", "DO NOT", "OUTPUT FORMAT", "Input text:")


def leaks_prompt(text: Column, marks: tuple[str, ...] = LEAK_MARKS) -> Column:
    hit = F.lit(False)
    for m in marks:
        hit = hit | text.contains(m)
    return hit


def with_toc_flag(paragraphs: DataFrame, doc: str = "doc_id", order: str = "para_idx", text: str = "text", style: str = "style") -> DataFrame:
    """Adds in_toc: a TOC style, the word contents, or a non-empty paragraph after contents and before a section heading."""
    t = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    event = F.when(t == "contents", True).when(is_section_heading(F.col(text)), False)
    d = with_last_before(paragraphs, [doc], order, event, "in_toc")
    open_ = (t == "contents") | F.coalesce("in_toc", F.lit(False))
    return d.withColumn("in_toc", is_toc_style(F.col(style)) | (open_ & (t != "") & ~is_section_heading(F.col(text))))


def with_first_text(paragraphs: DataFrame, doc: str = "doc_id", order: str = "para_idx", text: str = "text") -> DataFrame:
    """Adds is_first: the document's first paragraph that isn't empty."""
    full = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0
    first = paragraphs.where(full).groupBy(F.col(doc).alias("__doc")).agg(F.min(order).alias("__first"))
    d = paragraphs.join(first, F.col(doc) == F.col("__doc"), "left")
    return d.select(*paragraphs.columns, F.coalesce(F.col(order) == F.col("__first"), F.lit(False)).alias("is_first"))


def short_bold(runs: DataFrame, keys: list[str], most_words: int = 7) -> DataFrame:
    """Paragraphs of at most most_words words of which any run is bold."""
    per = runs.groupBy(*keys).agg(F.max(F.coalesce("bold", F.lit(False))).alias("any_bold"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_idx", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("text"))
    return per.where(F.col("any_bold") & (F.length(F.trim("text")) > 0) & (F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")) <= most_words))


def fixed_batches(df: DataFrame, doc: str, order: str, n: int) -> DataFrame:
    """Adds batch: every n rows of a document in order, from 0."""
    return with_number(df, [doc], order, "batch").withColumn("batch", F.floor((F.col("batch") - 1) / n).cast("int"))


def fold_sizes(sizes: np.ndarray, budget: int, carried: int = 0) -> tuple[np.ndarray, int]:
    """Batch of each size, from 0, given what the open batch carries already; and what is carried on. A size is never parted from an empty batch."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    batch, at, n = np.zeros(len(sizes), np.int64), 0, 0
    while True:
        # the first place at which the open batch would exceed the budget, though it holds something
        end = max(int(np.searchsorted(sums, sums[at] - carried + budget, side="right")) - 1, at)
        if carried == 0:
            while end < len(sizes) and sums[end] == sums[at]:  # nothing in it yet: takes one, however large
                end += 1
        batch[at:end] = n
        if end >= len(sizes):
            return batch, int(carried + sums[-1] - sums[at])
        at, carried, n = end, 0, n + 1


def budget_batches(df: DataFrame, doc: str, order: str, size: Column, budget: int, block: int = BLOCK) -> DataFrame:
    """(doc, order, batch), batch from 0: rows in order until the next would exceed the budget.

    A fold over a document. One of a single block of rows is folded in the JVM. Of a longer one each
    block says for every place where its first new batch may begin how it would go on from there, the
    blocks are chained by these summaries, and then each block is cut given what it takes over. sizes
    are whole numbers from 0; order is a whole number, unique within doc.
    """
    d = df.select(F.col(doc).alias("doc"), F.col(order).cast("long").alias("ord"), F.greatest(size, F.lit(0)).cast("long").alias("size")).withColumn("block", F.coalesce(F.floor(F.col("ord") / block), F.lit(-1)).cast("long"))
    kind = dict(d.dtypes)["doc"]
    long_docs = d.groupBy("doc").agg(F.min("block").alias("__a"), F.max("block").alias("__b")).where("__a < __b").select(F.col("doc").alias("__doc"))
    is_long = d["doc"].eqNullSafe(long_docs["__doc"])
    short, d = d.join(long_docs, is_long, "left_anti"), d.join(long_docs, is_long, "left_semi")

    def step(acc: Column, x: Column) -> Column:
        over = (acc["cur"] > 0) & (acc["cur"] + x["s"] > budget)
        b = F.when(over, acc["b"] + 1).otherwise(acc["b"])
        return F.struct(F.when(over, x["s"]).otherwise(acc["cur"] + x["s"]).alias("cur"), b.alias("b"), F.array_append(acc["out"], F.struct(x["o"].alias("o"), b.alias("b"))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("cur"), F.lit(0).alias("b"), F.array().cast("array<struct<o:bigint,b:int>>").alias("out"))
    rows = F.sort_array(F.collect_list(F.struct(F.col("ord").alias("o"), F.col("size").alias("s"))))
    folded = short.groupBy("doc").agg(F.aggregate(rows, start, step, lambda acc: acc["out"]).alias("x")).select("doc", F.explode("x").alias("y")).select("doc", F.col("y.o").alias("ord"), F.col("y.b").alias("batch"))

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("ord")["size"].to_numpy()
        sums = np.concatenate([[0], np.cumsum(s)])
        starts = range(int(np.searchsorted(sums, budget, side="right")) if len(s) else 0)
        ends = []
        for j in starts:  # places at which a batch that came in may end
            b, carry = fold_sizes(s[j:], budget)
            ends.append((int(b[-1]) + 1 if len(b) else 0, carry))
        return pd.DataFrame({"doc": pdf["doc"].iloc[:1], "block": pdf["block"].iloc[:1], "sums": [sums[: len(ends) + 1].tolist()], "batches": [[x for x, _ in ends]], "carries": [[x for _, x in ends]], "total": [int(sums[-1])]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        carried, n, out = 0, 0, []
        for r in pdf.sort_values("block").itertuples():
            out.append((r.doc, r.block, carried, n))
            if carried and carried + r.total > budget:
                j = max(int(np.searchsorted(np.asarray(r.sums), budget - carried, side="right")) - 1, 0)
                n, carried = n + r.batches[j], r.carries[j]
            elif carried:
                carried += r.total
            else:
                n, carried = n + max(r.batches[0] - 1, 0), r.carries[0]
        return pd.DataFrame(out, columns=["doc", "block", "carried", "n"])

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        batch, _ = fold_sizes(pdf["size"].to_numpy(), budget, int(pdf["carried"].iloc[0]))
        return pd.DataFrame({"doc": pdf["doc"], "ord": pdf["ord"], "batch": (batch + int(pdf["n"].iloc[0])).astype("int32")})

    s = d.groupBy("doc", "block").applyInPandas(summary, f"doc {kind}, block long, sums array<long>, batches array<long>, carries array<long>, total long")
    c = s.groupBy("doc").applyInPandas(chain, f"doc {kind}, block long, carried long, n long").withColumnsRenamed({"doc": "__doc", "block": "__block"})
    j = d.join(c, d["doc"].eqNullSafe(c["__doc"]) & (d["block"] == c["__block"])).select("doc", "ord", "size", "block", "carried", "n")
    out = folded.unionByName(j.groupBy("doc", "block").applyInPandas(cut, f"doc {kind}, ord long, batch int"))
    return out.select(F.col("doc").alias(doc), F.col("ord").cast(dict(df.dtypes)[order]).alias(order), "batch")


def first_per_document(df: DataFrame, doc: str, order: str, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(doc).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def joined_text(df: DataFrame, keys: list[str], order: str, text: str, separator: str) -> DataFrame:
    """The texts of each group in order, joined."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda x: x["t"]), separator).alias("joined"))


def coalesced_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring text runs of equal format joined, with their asterisk markers: keys, island, bold, italic, text, marked.

    References part islands. Trailing spaces and a Markdown heading's number signs stay outside the markers; islands of white space only vanish.
    """
    r = runs.select(*keys, "run_idx", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("bold", F.lit(False)).alias("b"), F.coalesce("italic", F.lit(False)).alias("i"))
    w = Window.partitionBy(*keys).orderBy("run_idx")
    state = F.struct("b", "i", "kind")
    change = F.coalesce((F.lag(state).over(w) != state) | (F.col("kind") != "text"), F.lit(True)).cast("int")
    r = r.withColumn("_c", change).withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    g = r.where("kind = 'text'").groupBy(*keys, "island").agg(F.first("b").alias("bold"), F.first("i").alias("italic"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_idx", "text"))), lambda x: x["text"]), "").alias("text"))
    g = g.where(F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0)
    stars = F.concat(F.when(F.col("bold"), F.lit("**")).otherwise(F.lit("")), F.when(F.col("italic"), F.lit("*")).otherwise(F.lit("")))
    body = F.regexp_replace("text", r"\s+$", "")
    sign = F.regexp_extract(body, r"^#{1,6}\s+", 0)
    return g.withColumn("marked", F.concat(sign, stars, F.substring(body, F.length(sign) + 1, F.length(body)), stars, F.substring(F.col("text"), F.length(body) + 1, F.length("text"))))


def resliced(runs: DataFrame, new_text: DataFrame, keys: list[str]) -> DataFrame:
    """A rewritten text cut at the lengths of the original runs, the last run taking the rest: keys, run_idx, text. new_text has keys and new."""
    w = Window.partitionBy(*keys).orderBy("run_idx")
    r = runs.select(*keys, "run_idx", F.length(F.coalesce("text", F.lit(""))).alias("_n"))
    r = r.withColumn("_from", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_last", F.lead("run_idx").over(w).isNull())
    j = r.join(new_text, keys)
    return j.select(*keys, "run_idx", F.when(F.col("_last"), F.col("new").substr((F.col("_from") + 1).cast("int"), F.length("new"))).otherwise(F.col("new").substr((F.col("_from") + 1).cast("int"), F.col("_n").cast("int"))).alias("text"))


def footnote_segments(text: Column) -> Column:
    """Text and footnote segments in order: array of (kind, text, space_before, space_after, is_empty)."""
    parts = F.regexp_extract_all(text, F.lit(FOOTNOTE + r"|(?:(?!§FOOTNOTE:\d+§)[\s\S])+"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(
        F.when(p.rlike("^" + FOOTNOTE + "$"), F.lit("footnote")).otherwise(F.lit("text")).alias("kind"), F.trim(p).alias("text"),
        p.rlike(r"^\s").alias("space_before"), p.rlike(r"\s$").alias("space_after"), (F.length(F.trim(p)) == 0).alias("is_empty"),
    ))


def dedupe_placeholders(text: Column) -> Column:
    """Repeats of one footnote placeholder right after itself dropped."""
    return F.regexp_replace(text, rf"({FOOTNOTE})\1+", "$1")


def merged_spans(df: DataFrame, key: str, start: str = "s", end: str = "e") -> DataFrame:
    """Rows of spans with overlapping and touching ones joined, as gaps and islands: (key, s, e)."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_new", F.when(F.col(start) <= before, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "_g").agg(F.min(start).alias("s"), F.max(end).alias("e")).drop("_g")


def style_policy(is_note: Column, is_heading: Column, is_first: Column) -> tuple[Column, Column, Column]:
    """Font, size in half points and colour of a paragraph: Calibri, 14 pt for the main heading, 12 for the body, 10 for notes, black."""
    return F.lit("Calibri"), F.when(is_note, 20).when(is_first & is_heading, 28).otherwise(24), F.lit("000000")
