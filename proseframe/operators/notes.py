"""Footnotes and citations: dates and paper types from addresses, replies, links, numbering, ibid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lit_array
from .ordered import with_last_before, with_number

# Months.
MONTHS = "January February March April May June July August September October November December".split()
URL = r"https?://[^\s)]+"


def _month(n: Column) -> Column:
    i = F.try_to_number(n, F.lit("99")).cast("int")
    return F.when((i >= 1) & (i <= 12), F.element_at(lit_array(MONTHS), F.greatest(F.least(i, F.lit(12)), F.lit(1))))


def url_date(url: Column) -> Column:
    """"19 July 2024" out of an address: year-month-day, then day-month-year, then year-Name-day. A month that can't be goes to the next pattern; days keep their zeros."""

    def by(pattern: str, year: int, month: int, day: int, named: bool = False) -> Column:
        y, m, d = (F.regexp_extract(url, pattern, i) for i in (year, month, day))
        name = m if named else _month(m)
        return F.when((y != "") & name.isNotNull(), F.concat_ws(" ", d, name, y))

    return F.coalesce(by(r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", 1, 2, 3), by(r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", 3, 2, 1), by(r"(\d{4})[-_]?([a-zA-Z]{3,9})[-_]?(\d{1,2})", 1, 2, 3, True))


PAPER = r"(?i)WP_|working[_\s-]?paper|research[_\s-]?paper|policy[_\s-]?brief|technical[_\s-]?report"


def paper_type(url: Column, snippet: Column) -> Column:
    """Working Paper, Policy Brief or Technical Report, by the address first, then by the snippet; null if neither tells."""
    low = F.lower(url)
    by_url = F.when(url.contains("WP_") | low.contains("working"), "Working Paper").when(low.contains("policy"), "Policy Brief").when(low.contains("technical"), "Technical Report").otherwise("Working Paper")
    by_snippet = F.when(snippet.rlike(r"(?i)working[_\s-]?paper"), "Working Paper").when(snippet.rlike(r"(?i)policy[_\s-]?brief"), "Policy Brief").when(snippet.rlike(r"(?i)technical[_\s-]?report"), "Technical Report").otherwise("Working Paper")
    return F.when(url.rlike(PAPER), by_url).when(snippet.rlike(PAPER), by_snippet)


def citation_metadata(url: Column, snippet: Column, domain: str, agency: str, place: str, series: str) -> Column:
    """Lines of what an address tells: its date, paper type and, for one domain, agency, place and the name of its series."""
    kind = paper_type(url, snippet)
    here = url.contains(domain)
    kind = F.when(here & (kind.isNull() | (kind == "Working Paper")), F.lit(series)).otherwise(kind)
    return F.concat_ws("\n", F.concat(F.lit("extracted_date: "), url_date(url)), F.concat(F.lit("paper_type: "), kind), F.when(here, F.lit(f"agency: {agency}")), F.when(here, F.lit(f"place: {place}")))


# Lines of a reply that are no footnote.
SKIP = ("i apologize", "sorry", "without a meaningful search result", "insufficient to verify", "is incomplete", "note:", "warning:", "corrected:", "formatted:", "```")


def reply_footnote(reply: Column) -> Column:
    """The footnote in a reply: what follows its heading up to an empty line, else all lines but apologies."""
    after = F.trim(F.element_at(F.split(reply, "Formatted Footnote:", 2), 2))
    block = F.regexp_replace(F.element_at(F.split(F.regexp_replace(after, r"^\s+", ""), r"\n\n", 2), 1), r"\s+$", "")
    lines = F.transform(F.split(reply, r"\r?\n"), lambda x: F.trim(x))

    def fine(x: Column) -> Column:
        ok = x != ""
        for s in SKIP:
            ok = ok & ~F.lower(x).contains(s)
        return ok

    return F.when(reply.contains("Formatted Footnote:"), block).otherwise(F.array_join(F.filter(lines, fine), " "))


def append_url(text: Column, url: Column) -> Column:
    """The text and, if it holds no address and there is one, the address."""
    return F.when(url.isNotNull() & (url != "") & ~text.rlike(URL), F.concat(text, F.lit(" "), url)).otherwise(text)


def markdown_segments(text: Column) -> Column:
    """Array of (text, type): plain, italic (between asterisks) or hyperlink (an address, in brackets or not, once)."""
    parts = F.regexp_extract_all(text, F.lit(r"\*[^*]+\*|\(https?://[^\s)]+\)|https?://[^\s)]+|(?:(?!\*[^*]+\*|\(?https?://)[\s\S])+"), F.lit(0))
    seg = F.transform(parts, lambda p: F.when(p.rlike(r"^\*[^*]+\*$"), F.struct(F.regexp_replace(p, r"^\*|\*$", "").alias("text"), F.lit("italic").alias("type"))).when(p.rlike(r"^\(?https?://"), F.struct(F.regexp_replace(p, r"^\(|\)$", "").alias("text"), F.lit("hyperlink").alias("type"))).otherwise(F.struct(p.alias("text"), F.lit("plain").alias("type"))))
    return F.filter(seg, lambda s: F.length(F.trim(s["text"])) > 0)


def numbered_notes(notes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Real notes (ids other than -1 and 0, with text) numbered from 1 by id: adds number."""
    real = notes.where("note_id NOT IN (-1, 0) AND length(text) > 0")
    return with_number(real, [doc, "kind"], "note_id", "number")


def preserved(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, before, after, kept, fewer): how many rows each group had and has; kept if none is missing, fewer where a warning is due."""
    b, a = (x.groupBy(*keys).agg(F.count("*").alias(n)) for x, n in ((before, "before"), (after, "after")))
    both = b.join(a, keys, "full").na.fill(0, ["before", "after"])
    return both.select(*keys, "before", "after", (F.col("before") == F.col("after")).alias("kept"), (F.col("after") < F.col("before")).alias("fewer"))


def with_relations(links: DataFrame, existing: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A relationship id for each new link, after the highest that the document has: links(doc, ord, target), existing(doc, rel_id)."""
    top = existing.groupBy(doc).agg(F.max(F.regexp_extract("rel_id", r"^rId(\d+)$", 1).try_cast("int")).alias("_top"))
    return with_number(links, [doc], "ord", "_n").join(top, doc, "left").withColumn("rel_id", F.concat(F.lit("rId"), (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("string"))).drop("_top", "_n")


def short_citations(citations: DataFrame, doc: str, order: str, work: str, pages: str) -> DataFrame:
    """Adds form: full for a work's first citation in a document, "Ibid." right after itself on the same pages, "Ibid., p" on others, "op. cit." later on."""
    first = citations.groupBy(F.col(doc).alias("__d"), F.col(work).alias("__w")).agg(F.min(order).alias("__first"))
    c = with_last_before(citations, [doc], order, F.struct(F.col(work).alias("w"), F.col(pages).alias("p")), "__prev")
    c = c.join(first, F.col(doc).eqNullSafe(F.col("__d")) & F.col(work).eqNullSafe(F.col("__w")))
    same = F.col("__prev").isNotNull() & F.col("__prev.w").eqNullSafe(F.col(work))
    form = F.when(F.col(order) == F.col("__first"), "full").when(same & F.col("__prev.p").eqNullSafe(F.col(pages)), "ibid").when(same, "ibid_page").otherwise("op_cit")
    return c.select(*citations.columns, form.alias("form"))
