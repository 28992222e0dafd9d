"""Calls to services behind one protocol, with offline stand-ins; everything around the call is a DataFrame.

Only distinct prompts that the cache lacks are asked, once each, by Arrow batches. A failed call
gives no reply and the caller keeps its text.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.protect import PROTECTED, mask, unmask
from .mentions import acronyms
from .notes import append_url, markdown_segments, reply_footnote, with_relations
from .sessions import cache_key, corrected_text, json_object, missing_prompts, reconciled, reply_segments
from .structure import fixed_batches, footnote_segments, leaks_prompt


class Connector(Protocol):
    """Replies to a prompt; raises if it can't."""

    def __call__(self, prompt: str) -> str: ...


class Echo:
    """Offline: replies with the prompt's text after the last Input text:, under the heading that callers expect."""

    def __call__(self, prompt: str) -> str:
        return "Corrected:\n" + prompt.rpartition("Input text:")[2].strip()


class Rewriter:
    """Offline: replies with a function of the prompt's text after the last Input text:."""

    def __init__(self, fn: Callable[[str], str]):
        self.fn = fn

    def __call__(self, prompt: str) -> str:
        return "Corrected:\n" + self.fn(prompt.rpartition("Input text:")[2].strip())


class Table:
    """Offline: replies from a table of known prompts."""

    def __init__(self, replies: dict[str, str]):
        self.replies = replies

    def __call__(self, prompt: str) -> str:
        return self.replies[prompt]


def with_retries(call: Connector, times: int = 3, wait_s: float = 0.0, factor: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Connector:
    """Tries up to `times`, waiting wait_s * factor ** n between."""

    def run(prompt: str) -> str:
        for n in range(times):
            try:
                return call(prompt)
            except Exception:  # noqa: BLE001
                if n + 1 == times:
                    raise
                sleep(wait_s * factor**n)
        raise AssertionError

    return run


def first_of(*calls: Connector) -> Connector:
    """The first that replies: a primary service and its fallbacks."""

    def run(prompt: str) -> str:
        error: Exception | None = None
        for c in calls:
            try:
                return c(prompt)
            except Exception as e:  # noqa: BLE001
                error = e
        raise error or ValueError("no service")

    return run


def ask(prompts: DataFrame, cache: DataFrame, connector: Connector, prompt: str = "prompt", at_once: int | None = None) -> DataFrame:
    """The cache(key, response) with the replies to all prompts that it lacked. at_once bounds the calls made at the same time."""
    todo = missing_prompts(prompts, cache, prompt)
    todo = todo.repartition(at_once, "key") if at_once else todo

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies = []
            for p in b["prompt"]:
                try:
                    replies.append(connector(p))
                except Exception:  # noqa: BLE001
                    replies.append(None)
            yield pd.DataFrame({"key": b["key"], "response": replies})

    return cache.select("key", "response").unionByName(todo.mapInPandas(run, "key string, response string"))


def corrected(texts: DataFrame, instructions: str, connector: Connector, cache: DataFrame, text: str = "text") -> DataFrame:
    """Adds corrected: the reply to each text with its protected spans masked, unmasked again; the text itself where the reply is missing or leaks the prompt."""
    masked, bucket = mask(F.col(text), PROTECTED, "PROT")
    d = texts.withColumn("_m", masked).withColumn("_b", bucket).withColumn("_p", F.concat(F.lit(instructions + "\nInput text:\n"), F.col("_m"))).withColumn("key", cache_key(F.col("_p")))
    replies = ask(d, cache, connector, "_p")
    d = d.join(replies, "key", "left").withColumn("_r", corrected_text(F.col("response")))
    good = F.col("_r").isNotNull() & ~leaks_prompt(F.col("_r"))
    return d.withColumn("corrected", F.when(good, unmask(F.col("_r"), F.col("_b"), "PROT")).otherwise(F.col(text))).drop("_m", "_b", "_p", "_r", "key", "response")


SEPARATOR = "\n---\n"


def batched_rewrite(paragraphs: DataFrame, instructions: str, connector: Connector, cache: DataFrame, doc: str = "doc_id", order: str = "para_idx", text: str = "text", batch_size: int = 5) -> DataFrame:
    """(doc, order, text, rewritten): paragraphs rewritten in batches of a document's neighbours.

    A batch's text segments (footnote placeholders stay behind) are joined, asked for once, and cut
    again. If the number of segments or a segment's placeholders differ, the originals stand.
    """
    full = paragraphs.where(F.length(F.trim(text)) > 0).select(doc, order, text)
    b = fixed_batches(full, doc, order, batch_size).withColumn("_s", footnote_segments(F.col(text)))
    asked = b.withColumn("_t", F.transform(F.filter("_s", lambda s: (s["kind"] == "text") & ~s["is_empty"]), lambda s: s["text"]))
    g = asked.groupBy(doc, "batch").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, "_t"))), lambda x: x["_t"])).alias("_o"))
    g = g.withColumn("_p", F.concat(F.lit(instructions + "\nInput text:\n"), F.array_join("_o", SEPARATOR))).withColumn("key", cache_key(F.col("_p")))
    g = g.join(ask(g, cache, connector, "_p"), "key", "left")
    reply = F.when(F.size("_o") > 0, reply_segments(corrected_text(F.col("response"))))
    g = g.select(doc, "batch", F.coalesce(reconciled(F.col("_o"), reply), F.col("_o")).alias("_n"))
    # each paragraph's segments begin after those of the batch's earlier paragraphs
    w = Window.partitionBy(doc, "batch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = asked.withColumn("_from", F.coalesce(F.sum(F.size("_t")).over(w), F.lit(0)).cast("int")).join(g, [doc, "batch"])
    is_text = lambda s: (s["kind"] == "text") & ~s["is_empty"]
    spaced = lambda s, t: F.concat(F.when(s["space_before"], F.lit(" ")).otherwise(F.lit("")), t, F.when(s["space_after"], F.lit(" ")).otherwise(F.lit("")))
    nth = lambda i: F.col("_from") + F.size(F.filter(F.slice("_s", F.lit(1), i + 1), is_text)) - 1
    new = F.array_join(F.transform("_s", lambda s, i: F.when(is_text(s), spaced(s, F.get("_n", nth(i)))).when(s["is_empty"], F.lit(" ")).otherwise(s["text"])), "")
    return parts.select(doc, order, text, F.regexp_replace(new, r"^\s+|\s+$", "").alias("rewritten"))


def load_cache(spark: SparkSession, path: str, reset: bool = False) -> DataFrame:
    """cache(key, response) as saved; one that can't be read, or is to be forgotten at the start of a run, is empty."""
    try:
        if reset:
            return spark.createDataFrame([], "key string, response string")
        return spark.read.schema("key string, response string").parquet(path).where("key IS NOT NULL")
    except AnalysisException:
        return spark.createDataFrame([], "key string, response string")


def save_cache(cache: DataFrame, path: str) -> None:
    """The replies that were given, once each; a missing reply isn't kept, so it is asked for again."""
    cache.where("response IS NOT NULL").groupBy("key").agg(F.min("response").alias("response")).write.mode("overwrite").parquet(path)


def batched_expansion(paragraphs: DataFrame, instructions: str, connector: Connector, cache: DataFrame, doc: str = "doc_id", order: str = "para_idx", text: str = "text", batch_size: int = 4) -> DataFrame:
    """(doc, order, batch, known, rewritten): paragraphs given to a service in batches that carry the acronyms of a document's earlier batches.

    Which acronyms are known before a batch follows from the texts (those whose first batch is
    earlier), so all batches can be asked for at once; a prompt is the state, an empty line and the
    batch's texts. Where the reply has not as many segments as the batch, its texts stand.
    """
    full = paragraphs.where(F.length(F.trim(text)) > 0).select(doc, order, text)
    b = fixed_batches(full, doc, order, batch_size)
    first = acronyms(b, [doc, "batch"], text).groupBy(doc, F.col("word").alias("_a")).agg(F.min("batch").alias("_b"))
    g = b.groupBy(doc, "batch").agg(F.sort_array(F.collect_list(F.struct(order, F.col(text).alias("_t")))).alias("_o"))
    earlier = g.select(doc, "batch").join(first, doc).where(F.col("_b") < F.col("batch")).groupBy(doc, "batch").agg(F.sort_array(F.collect_list("_a")).alias("_k"))
    g = g.join(earlier, [doc, "batch"], "left").withColumn("_k", F.coalesce("_k", F.array().cast("array<string>")))
    state = F.concat(F.lit("ACRONYM_STATE:"), F.to_json(F.map_from_arrays("_k", F.transform("_k", lambda _: F.lit(True)))))
    own = F.transform("_o", lambda x: x["_t"])
    g = g.withColumn("_p", F.concat(F.lit(instructions + "\n"), state, F.lit("\n\nInput text:\n"), F.array_join(own, SEPARATOR))).withColumn("key", cache_key(F.col("_p")))
    g = g.join(ask(g, cache, connector, "_p"), "key", "left").withColumn("_n", F.coalesce(reconciled(own, reply_segments(corrected_text(F.col("response")))), own))
    e = g.select(doc, "batch", F.size("_k").alias("known"), F.explode(F.arrays_zip("_o", "_n")).alias("_x"))
    return e.select(doc, F.col(f"_x._o.{order}").alias(order), "batch", "known", F.col("_x._n").alias("rewritten"))


def reformatted_notes(notes: DataFrame, instructions: str, connector: Connector, cache: DataFrame, keys: list[str], text: str = "text", url: str | None = None) -> DataFrame:
    """Adds formatted, the footnote in a service's reply (the text itself where there is none), with the address of column url after it if it holds none, and segments: its plain, italic and linked parts."""
    d = notes.withColumn("_p", F.concat(F.lit(instructions + "\nInput text:\n"), F.col(text))).withColumn("key", cache_key(F.col("_p")))
    d = d.join(ask(d.where("_p IS NOT NULL"), cache, connector, "_p"), "key", "left").withColumn("_r", reply_footnote(F.col("response")))
    new = append_url(F.when(F.length(F.trim("_r")) > 0, F.col("_r")).otherwise(F.col(text)), F.col(url) if url else F.lit(None).cast("string"))
    return d.withColumn("formatted", new).withColumn("segments", markdown_segments(F.col("formatted"))).drop("key", "response", "_p", "_r")


def note_links(formatted: DataFrame, existing: DataFrame, doc: str = "doc_id", note: str = "note_id") -> DataFrame:
    """(doc, ord, target, rel_id): a relationship for the address of each reformatted note, after those that the document has."""
    links = formatted.select(doc, F.col(note).alias("ord"), F.get(F.filter("segments", lambda s: s["type"] == "hyperlink"), F.lit(0))["text"].alias("target")).where("target IS NOT NULL")
    return with_relations(links, existing, doc)


def scanned_variants(documents: DataFrame, instructions: str, connector: Connector, cache: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, entity, variant) of a service's scan of whole documents; a reply without a JSON object gives nothing."""
    d = documents.where(F.col(text).isNotNull()).select(doc, F.concat(F.lit(instructions + "\n<<DOC-START>>\n"), F.col(text), F.lit("\n<<DOC-END>>")).alias("_p")).withColumn("key", cache_key(F.col("_p")))
    found = d.join(ask(d, cache, connector, "_p"), "key").select(doc, F.explode(F.from_json(json_object(F.col("response")), "map<string,array<string>>")).alias("entity", "_v"))
    return found.select(doc, "entity", F.explode("_v").alias("variant")).where("variant <> entity").distinct()


def with_glosses(paragraphs: DataFrame, glosses: DataFrame, keys: list[str], text: str = "text", most: int = 6) -> DataFrame:
    """Paragraphs with the first mention of each phrase in italics, its gloss after it in brackets: glosses(keys, phrase, gloss), the longest `most` of a paragraph, the longest first."""
    size = F.struct((-F.length("phrase")).alias("less"), "phrase", "gloss")
    per = glosses.where("length(phrase) > 0 AND length(gloss) > 0").groupBy(*keys).agg(F.slice(F.sort_array(F.collect_set(size)), 1, most).alias("_g"))
    t = paragraphs.join(per, keys, "left")

    def add(s: Column, g: Column) -> Column:
        at = F.instr(s, g["phrase"])
        return F.when(at > 0, F.concat(s.substr(F.lit(1), at - 1), F.lit("*"), g["phrase"], F.lit("* ("), g["gloss"], F.lit(")"), s.substr(at + F.length(g["phrase"]), F.length(s)))).otherwise(s)

    return t.select(*[c for c in paragraphs.columns if c != text], F.coalesce(F.aggregate("_g", F.col(text), add), F.col(text)).alias(text))


def first_glosses(glosses: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """Each gloss of a phrase replaced by the one that its document gives first."""
    first = glosses.groupBy(doc, "phrase").agg(F.min_by("gloss", F.struct(*order)).alias("_g"))
    return glosses.join(first, [doc, "phrase"]).withColumn("gloss", F.col("_g")).drop("_g")


def top_results(results: DataFrame, keys: list[str], rank: str, url: str, not_from: tuple[str, ...] = (), most: int = 4) -> DataFrame:
    """The first results of each search, those of excluded domains left out before they are counted."""
    host = F.regexp_extract(F.lower(F.col(url)), r"^[a-z]+://(?:[^/@]*@)?(?:www\.)?([^/:?#]+)", 1)
    kept = results.where(~F.coalesce(host.isin(*not_from), F.lit(False))) if not_from else results
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(rank))).where(F.col("_n") <= most).drop("_n")


def citation_url(urls: Column, not_from: str = "http://dx.doi.org") -> Column:
    """The first address of a search's results that isn't a resolver's, null if there is none."""
    return F.get(F.filter(urls, lambda u: u.isNotNull() & ~u.startswith(not_from)), F.lit(0))


# The labels of the topic classifier and words that speak for each.
TOPICS = {
    "International Relations, Multipolarity and Multilateralism": ["trade", "tariff", "export", "import", "multilateral", "treaty", "investment"],
    "Politics, Society and Governance": ["election", "council", "policy", "public", "government", "court", "society"],
    "Strategic Technologies": ["digital", "satellite", "server", "radar", "technology", "data"],
    "Sustainability and the Environment": ["climate", "forest", "water", "energy", "renewable", "coastal", "emission"],
    "Trade and Economics": ["market", "wage", "budget", "bond", "loan", "currency", "price"],
}


def topic_scores(df: DataFrame, keys: list[str], text: str, topics: dict[str, list[str]] | None = None) -> DataFrame:
    """(keys, topic, score): the topic with most of its words in the text; ties go to the first by name; none scores null. An offline stand-in for a classifier."""
    t = topics or TOPICS
    low = F.lower(F.col(text))
    scored = F.array(*[F.struct((-F.size(F.regexp_extract_all(low, F.lit(r"\b(?:" + "|".join(w) + r")"), F.lit(0)))).alias("neg"), F.lit(k).alias("topic")) for k, w in sorted(t.items())])
    best = F.element_at(F.array_sort(scored), 1)
    return df.where(F.col(text).isNotNull()).select(*keys, F.when(best["neg"] < 0, best["topic"]).alias("topic"), (-best["neg"]).alias("score"))
