"""Abbreviations, synonyms, variants and names: first mention, later mention, and dictionary work.

Dictionaries meet texts by an equi-join on word n-grams: each place of a text whose word begins an
entry is joined with the lengths of such entries, and its n-grams of these lengths with the
dictionary's keys, so the work grows with a text's length, not with texts times entries. A row
carries only as many words as the longest entry has. A dictionary of counted, bounded size is
broadcast; a larger one is joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.protect import QUOTED
from ..functions.text import WORD, is_acronym_short, let, normalise_key, words
from .joins import checked_broadcast
from .lineage import cut_lineage

DEFINED = r"([A-Za-z\s]+)\s*\(([A-Za-z0-9]+)\)"
#: words are found with their places: (word, number from 0)


def word_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row for each word: keys, pos (from 0), word."""
    return df.select(*keys, F.posexplode(words(F.col(text))).alias("pos", "word"))


def acronyms(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Words of two or more capitals, with their places."""
    return word_rows(df.where(F.col(text).rlike("[A-Z]{2}")), keys, text).where(F.col("word").rlike("^[A-Z]{2,}$"))


def first_mentions(df: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """(doc, acronym, first_pos, mentions, nth) of each acronym of each document; nth orders them by first mention."""
    per = acronyms(df, [doc], text).groupBy(doc, F.col("word").alias("acronym")).agg(F.min("pos").cast("int").alias("first_pos"), F.count("*").alias("mentions"))
    return per.withColumn("nth", F.row_number().over(Window.partitionBy(doc).orderBy("first_pos")))


def defined_terms(text: Column) -> Column:
    """Array of (abbr, term) for every "Term (ABBR)"; term is the run of letters and spaces before the bracket."""
    terms, abbrs = F.regexp_extract_all(text, F.lit(DEFINED), F.lit(1)), F.regexp_extract_all(text, F.lit(DEFINED), F.lit(2))
    pairs = F.zip_with(abbrs, terms, lambda a, t: F.struct(a.alias("abbr"), F.trim(F.regexp_replace(t, r"^\s+|\s+$", "")).alias("term")))
    return F.filter(pairs, lambda p: p["term"] != "")


def merge_dictionaries(df: DataFrame, key: str = "abbr", prio: str = "prio") -> DataFrame:
    """One row per key, that of the highest priority: a category's entry overrides the base's."""
    w = Window.partitionBy(key).orderBy(F.col(prio).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def oriented_pairs(left: Column, right: Column) -> tuple[Column, Column]:
    """(abbr, full) of two strings of which either may be the abbreviation."""
    a, b = F.trim(left), F.trim(right)
    first = F.when(is_acronym_short(a) & ~is_acronym_short(b), True).when(is_acronym_short(b) & ~is_acronym_short(a), False).when(a.contains(" ") & ~b.contains(" "), False).when(~a.contains(" ") & b.contains(" "), True).otherwise(F.length(a) <= F.length(b))
    return F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)


def expansion_key(full: Column) -> Column:
    return normalise_key(full)


def protected_words(text: Column, protected: str) -> Column:
    """For each word of the text whether it is in a match of the protected pattern, which begins and ends between words."""
    marks = lambda part, inside: F.transform(words(part), lambda _: F.lit(inside))
    kept = F.regexp_extract_all(text, F.lit(protected), F.lit(0))
    return F.flatten(F.zip_with(F.split(text, protected, -1), kept, lambda g, m: F.concat(marks(g, False), F.coalesce(marks(m, True), F.array().cast("array<boolean>")))))


def dictionary_hits(texts: DataFrame, dictionary: DataFrame, keys: list[str], text: str, term: str, fold: bool = True, protected: str | None = None) -> DataFrame:
    """Places in the texts where dictionary terms occur as whole words, longest first, without overlaps.

    texts has keys and text, dictionary has term and any other columns. Result: keys, pos (word
    number from 0), n (words), and the dictionary's columns. A place that overlaps an earlier kept hit
    is dropped, and so is one with a word in a match of the protected pattern.
    """
    low = (lambda c: F.lower(c)) if fold else (lambda c: c)
    d = dictionary.withColumn("_key", low(F.array_join(words(F.col(term)), " "))).where("_key <> ''")
    starts = d.groupBy(F.element_at(F.split("_key", " "), 1).alias("_first")).agg(F.sort_array(F.collect_set(F.size(F.split("_key", " ")))).alias("_ns"))
    longest = d.agg(F.coalesce(F.max(F.size(F.split("_key", " "))), F.lit(1))).first()[0]
    guard = protected_words(F.col(text), protected) if protected else F.lit(None).cast("array<boolean>")
    places = let(F.struct(words(F.col(text)).alias("w"), guard.alias("g")), lambda x: F.transform(x["w"], lambda _, i: F.struct(F.slice(x["w"], i + 1, longest).alias("w"), (F.slice(x["g"], i + 1, longest) if protected else F.lit(None).cast("array<boolean>")).alias("g"))))
    at = texts.where(F.col(text).isNotNull()).select(*keys, F.posexplode(places).alias("pos", "_x")).withColumn("_first", low(F.col("_x.w")[0]))
    grams = at.join(checked_broadcast(starts), "_first").select(*keys, "pos", "_x", F.explode(F.filter("_ns", lambda n: n <= F.size("_x.w"))).alias("n"))
    if protected:
        grams = grams.where(~F.array_contains(F.slice("_x.g", 1, F.col("n")), True))
    grams = grams.select(*keys, "pos", "n", low(F.array_join(F.slice("_x.w", 1, F.col("n")), " ")).alias("_key"))
    hits = grams.join(checked_broadcast(d), "_key").drop("_key")
    # runs of hits that overlap in a chain: one begins where no earlier hit ends beyond
    rest = [c for c in hits.columns if c not in (*keys, "pos", "n")]
    by = Window.partitionBy(*keys).orderBy("pos", F.col("n").desc(), *rest)
    end = F.max(F.col("pos") + F.col("n")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("_new", F.coalesce((end <= F.col("pos")).cast("int"), F.lit(1)))
    hits = hits.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    # within a run, a hit is kept if the last one kept ends before it
    hit = F.struct("pos", (-F.col("n")).alias("less"), *rest)
    runs = hits.groupBy(*keys, "_run").agg(F.sort_array(F.collect_list(hit)).alias("_all"))
    none = F.filter("_all", lambda x: F.lit(False))
    ends = lambda x: x["pos"] - x["less"]
    kept = F.aggregate("_all", none, lambda k, x: F.when((F.size(k) == 0) | (ends(F.get(k, F.size(k) - 1)) <= x["pos"]), F.concat(k, F.array(x))).otherwise(k))
    return runs.select(*keys, F.explode(kept).alias("_x")).select(*keys, "_x.pos", (-F.col("_x.less")).alias("n"), *[f"_x.{c}" for c in rest])


def expand_mentions(texts: DataFrame, dictionary: DataFrame, doc: str, order: str, text: str = "text") -> DataFrame:
    """Texts with the first mention of each entry in a document as "Full (ABBR)" and later ones as "ABBR".

    dictionary(abbr, full). One pass: all entries at once, longest match first, no overlaps; a
    mention that already reads "Full (ABBR)" stays and counts. A text that holds nothing stays.
    """
    both = dictionary.select("abbr", "full", F.col("abbr").alias("term"), F.lit(False).alias("is_full")).union(dictionary.select("abbr", "full", F.col("full").alias("term"), F.lit(True).alias("is_full")))
    h = cut_lineage(dictionary_hits(texts, both, [doc, order], text, "term"))
    # "Full (ABBR)": an abbreviation right after its full form is part of it
    seq = Window.partitionBy(doc, order).orderBy("pos")
    h = h.withColumn("_prev", F.lag(F.struct("abbr", (F.col("pos") + F.col("n")).alias("e"), "is_full")).over(seq))
    h = h.withColumn("_tail", F.coalesce((F.col("_prev.abbr") == F.col("abbr")) & F.col("_prev.is_full") & (F.col("_prev.e") == F.col("pos")) & ~F.col("is_full"), F.lit(False)))
    h = h.withColumn("_whole", F.coalesce(F.lead("_tail").over(seq), F.lit(False))).where("NOT _tail")
    # the first mention is a minimum, which is aggregated before the shuffle, not a rank over all mentions
    first = h.groupBy(doc, "abbr").agg(F.min(F.struct(order, "pos")).alias("_first"))
    is_first = (F.col(order) == F.col(f"_first.{order}")) & (F.col("pos") == F.col("_first.pos"))
    shown = F.when(is_first, F.concat("full", F.lit(" ("), "abbr", F.lit(")"))).otherwise(F.col("abbr"))
    return _replaced(texts, h.where("NOT _whole").join(first, [doc, "abbr"]).withColumn("_shown", shown), [doc, order], text, "_shown")


def unify_terms(texts: DataFrame, groups: DataFrame, doc: str, order: str, text: str = "text") -> DataFrame:
    """Of each group of synonyms the term that a document mentions first, and where: (doc, group_id, chosen, first_order, first_pos, mentions, replaced).

    groups(group_id, ord, term). Ties in place can't be: of terms at one place the longest is meant.
    """
    h = dictionary_hits(texts, groups.select("group_id", F.col("ord").alias("_ord"), "term"), [doc, order], text, "term")
    per = h.groupBy(doc, "group_id", F.lower("term").alias("_low")).agg(F.min(F.struct(F.col(order).alias("o"), F.col("pos").alias("p"), F.col("_ord"), F.col("term"))).alias("_at"), F.count("*").alias("n"))
    top = per.groupBy(doc, "group_id").agg(F.min(F.struct("_at", "n")).alias("_top"), F.sum("n").alias("mentions"))
    return top.select(doc, "group_id", F.col("_top._at.term").alias("chosen"), F.col("_top._at.o").alias("first_order"), F.col("_top._at.p").alias("first_pos"), "mentions", (F.col("mentions") - F.col("_top.n")).alias("replaced"))


def unify_texts(texts: DataFrame, groups: DataFrame, doc: str, order: str, text: str = "text", protected: str | None = QUOTED) -> DataFrame:
    """Texts in which all terms of a group of synonyms read as the one that their document mentions first: groups(group_id, ord, term).

    Mentions in quotations neither count nor change; protected=None has them do both. The chosen
    term's own mentions keep their case.
    """
    h = cut_lineage(dictionary_hits(texts, groups.select("group_id", F.col("ord").alias("_ord"), "term"), [doc, order], text, "term", protected=protected))
    chosen = h.groupBy(doc, "group_id").agg(F.min_by("term", F.struct(F.col(order).alias("o"), F.col("pos").alias("p"), F.col("_ord"))).alias("chosen"))
    change = h.join(chosen, [doc, "group_id"]).where(F.lower("term") != F.lower("chosen"))
    return _replaced(texts, change, [doc, order], text, "chosen")


def canonical_variants(texts: DataFrame, variants: DataFrame, keys: list[str], text: str = "text", protected: str | None = QUOTED) -> DataFrame:
    """Texts with every variant outside quotations, as a whole word and in its own case, replaced by its entity: variants(entity, variant), longest first."""
    d = variants.where("variant <> entity")
    h = dictionary_hits(texts.where(F.col(text).isNotNull()), d, keys, text, "variant", fold=False, protected=protected)
    return _replaced(texts, h, keys, text, "entity")


def _replaced(texts: DataFrame, hits: DataFrame, keys: list[str], text: str, by: str) -> DataFrame:
    """Texts with the words of each hit(keys, pos, n), which don't overlap, replaced by its column `by`. Every word is copied once, so the work grows with the text's length."""
    per = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "n", F.col(by).alias("by")))).alias("_h"))
    t = texts.join(per, keys, "left")

    def build(x: Column) -> Column:
        end = lambda k: F.coalesce(F.get(x["h"], k)["pos"] + F.get(x["h"], k)["n"], F.lit(0))
        between = lambda a, b: F.array_join(F.slice(x["t"], a + 1, b - a), "")
        parts = F.transform(x["h"], lambda h, k: F.concat(between(end(k - 1), h["pos"]), F.get(x["g"], h["pos"]), h["by"]))
        return F.concat(F.array_join(parts, ""), between(end(F.size(x["h"]) - 1), F.size(x["t"])), F.element_at(x["g"], -1))

    gaps, w = F.split(F.col(text), WORD, -1), words(F.col(text))
    whole = let(F.struct(gaps.alias("g"), w.alias("w")), lambda x: F.struct(F.col("_h").alias("h"), x["g"].alias("g"), F.transform(x["w"], lambda v, i: F.concat(F.get(x["g"], i), v)).alias("t")))
    return t.select(*[c for c in texts.columns if c != text], F.when(F.col("_h").isNull(), F.col(text)).otherwise(let(whole, build)).alias(text))


def dedupe_expansions(df: DataFrame, order: str, full: str = "full") -> DataFrame:
    """One row for each expansion, written alike but for case and white space: the last by order."""
    w = Window.partitionBy(expansion_key(F.col(full))).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def oriented_dictionary(df: DataFrame, order: str, left: str, right: str) -> DataFrame:
    """(abbr, full) of pairs of which either side may be the abbreviation, the last by order for each abbreviation."""
    abbr, full = oriented_pairs(F.col(left), F.col(right))
    return df.select(abbr.alias("abbr"), full.alias("full"), F.col(order).alias("_o")).groupBy("abbr").agg(F.max_by("full", F.struct("_o", "full")).alias("full"))


# Fixed value: a name of two or more capitalised words, with or without a title.
FULL_NAME = r"(?<![\p{L}\p{N}_])(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+)?[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?![\p{L}\p{N}_])"


def collapse_names(texts: DataFrame, doc: str, order: str, text: str = "text", protected: str | None = QUOTED, name: str = FULL_NAME) -> DataFrame:
    """Texts with a document's first mention of each full name kept and later ones, title and all, as the last name; mentions in quotations neither count nor change.

    The first mention is a minimum for each document and name, so that no window holds a document's mentions.
    """
    pattern = rf"{protected}|{name}" if protected else name
    found = texts.where(F.col(text).rlike(name)).select(doc, order, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("_i", "_m"))
    plain = F.regexp_replace(F.regexp_replace("_m", r"^(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+", ""), r"\s+", " ")
    found = found.withColumn("_name", F.when(F.col("_m").rlike(f"^(?:{name})$"), plain))
    first = found.where("_name IS NOT NULL").groupBy(doc, "_name").agg(F.min(F.struct(order, "_i")).alias("_first"))
    later = (F.col(order) != F.col(f"_first.{order}")) | (F.col("_i") != F.col("_first._i"))
    shown = found.join(first, [doc, "_name"], "left").select(doc, order, "_i", F.when(later, F.element_at(F.split("_name", " "), -1)).alias("_by"))
    per = shown.groupBy(doc, order).agg(F.sort_array(F.collect_list(F.struct("_i", "_by"))).alias("_h"), F.count("_by").alias("_n")).where("_n > 0").drop("_n")
    t = texts.join(per, [doc, order], "left")
    change = lambda s: F.array_join(F.zip_with(F.split(s, pattern, -1), F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), lambda m, i: F.coalesce(F.get("_h", i)["_by"], m)), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return t.select(*[c for c in texts.columns if c != text], F.when(F.col("_h").isNull(), F.col(text)).otherwise(let(F.col(text), change)).alias(text))


def entity_variants(pairs: DataFrame, doc: str) -> DataFrame:
    """(doc, entity, variants): each defined term of a document with the abbreviations that stand for it, in order: pairs(doc, abbr, term). What a scan for variants finds without a service."""
    return pairs.where("term <> '' AND abbr <> term").groupBy(doc, F.col("term").alias("entity")).agg(F.sort_array(F.collect_set("abbr")).alias("variants"))


def clean_nested(text: Column) -> Column:
    """"X (X (A))" as "X (A)", "X (X)" as "X"."""
    text = F.regexp_replace(text, r"\b([\p{L}\p{N}_][\p{L}\p{N}_ ]+?)\s*\(\1\s*\(([\p{L}\p{N}_]+)\)\)", "$1 ($2)")
    return F.regexp_replace(text, r"\b([\p{L}\p{N}_][\p{L}\p{N}_ ]+?)\s*\(\1\)", "$1")


def usa_special_case(text: Column) -> Column:
    """The United States of America gets one abbreviation, after the whole name."""
    text = F.regexp_replace(text, r"(?i)\b(The\s+United\s+States)\s*\(\s*US\s*\)\s+(of\s+America)\s*\(\s*USA\s*\)", "$1 $2 (USA)")
    return F.regexp_replace(text, r"(?i)\bThe United States\s+of America\b(?!\s*\(\s*USA\s*\))", "The United States of America (USA)")


def abbreviation_context(pairs: DataFrame, doc: str) -> DataFrame:
    """For each document the text that lists its defined abbreviations: pairs(doc, abbr, term)."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("abbr", "term"))), lambda p: F.concat(F.lit("- "), p["term"], F.lit(" ("), p["abbr"], F.lit(")"))), "\n")
    return pairs.groupBy(doc).agg(F.concat(F.lit("PREVIOUSLY DEFINED ABBREVIATIONS:\n"), lines).alias("context"))
