"""Queries of abbreviations, synonyms, variants, names, and of sessions with a language model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import connectors, mentions as mn, sessions as ss
from ..sources import dims
from .base import BATCHES, DOCS, NOTES, PARAS, Registry, batches, documents, notes, paragraphs, spread, table

query = Registry()
WORDS = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+')"
EXPLODED = f"(SELECT doc_id, CAST(generate_subscripts({WORDS}, 1) - 1 AS INTEGER) AS pos, unnest({WORDS}) AS word FROM {DOCS} WHERE text IS NOT NULL)"


@query(f"SELECT doc_id, word AS acronym, min(pos) AS first_pos, count(*) AS mentions, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS INTEGER) AS nth FROM {EXPLODED} WHERE regexp_matches(word, '^[A-Z]{{2,}}$') GROUP BY doc_id, word")
def acronym_first_mention(spark: SparkSession, sf: str) -> DataFrame:
    return mn.first_mentions(documents(spark, sf, "text"), "doc_id")


_DEF = r"([A-Za-z\s]+)\s*\(([A-Za-z0-9]+)\)"
_FOUND = f"(SELECT doc_id, para_idx, unnest(regexp_extract_all(text, '{_DEF}', 2)) AS abbr, trim(regexp_replace(unnest(regexp_extract_all(text, '{_DEF}', 1)), '^\\s+|\\s+$', '', 'g')) AS term, generate_subscripts(regexp_extract_all(text, '{_DEF}', 2), 1) AS i FROM {PARAS} WHERE text IS NOT NULL)"


def _defined(spark: SparkSession, sf: str) -> DataFrame:
    p = paragraphs(spark, sf, "text").where("text IS NOT NULL")
    return p.select("doc_id", "para_idx", F.posexplode(mn.defined_terms(F.col("text"))).alias("i", "d")).select("doc_id", "para_idx", "i", "d.abbr", "d.term")


@query(f"SELECT doc_id, abbr, arg_max(term, para_idx * 100000 + i) AS term FROM {_FOUND} WHERE term <> '' GROUP BY doc_id, abbr")
def defined_abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    return _defined(spark, sf).groupBy("doc_id", "abbr").agg(F.max_by("term", F.struct("para_idx", "i")).alias("term"))


@query(f"SELECT doc_id, string_agg(DISTINCT a, ',' ORDER BY a) AS abbrs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\(([A-Z]{{2,}})\\)', 1)) AS a FROM {PARAS} WHERE text IS NOT NULL) GROUP BY doc_id")
def parenthesised_abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    e = paragraphs(spark, sf, "text").where("text IS NOT NULL").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\(([A-Z]{2,})\)"), F.lit(1))).alias("a"))
    return e.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("a")), ",").alias("abbrs"))


_PW = f"(SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM {PARAS} WHERE text IS NOT NULL)"
@query(f"SELECT doc_id, upper(form) AS abbr, string_agg(DISTINCT form, ',' ORDER BY form) AS forms FROM (SELECT doc_id, abbr AS form FROM {_FOUND} UNION ALL SELECT doc_id, word FROM {_PW} WHERE regexp_matches(word, '^[A-Z]{{2,}}$')) GROUP BY doc_id, upper(form)")
def acronym_forms(spark: SparkSession, sf: str) -> DataFrame:
    p = paragraphs(spark, sf, "text").where("text IS NOT NULL")
    both = p.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(mn.DEFINED), F.lit(2))).alias("form")).union(mn.acronyms(p, ["doc_id"]).select("doc_id", F.col("word").alias("form")))
    return both.groupBy("doc_id", F.upper("form").alias("abbr")).agg(F.array_join(F.sort_array(F.collect_set("form")), ",").alias("forms"))


@query(f"SELECT doc_id, word AS abbr, count(*) AS mentions FROM {_PW} w WHERE regexp_matches(word, '^[A-Z]{{2,}}$') AND NOT EXISTS (SELECT 1 FROM {_FOUND} f WHERE f.doc_id = w.doc_id AND f.abbr = w.word AND f.term <> '') GROUP BY doc_id, word")
def acronym_undefined(spark: SparkSession, sf: str) -> DataFrame:
    p = paragraphs(spark, sf, "text").where("text IS NOT NULL")
    known = _defined(spark, sf).select("doc_id", F.col("abbr").alias("word")).distinct()
    return mn.acronyms(p, ["doc_id"]).join(known, ["doc_id", "word"], "left_anti").groupBy("doc_id", F.col("word").alias("abbr")).agg(F.count("*").alias("mentions"))


_VALUES = "(VALUES ('base', 'GHG', 'Green House Gases', 0), ('base', 'UN', 'United Nations', 0), ('base', 'GDP', 'Gross Domestic Product', 0), " + ", ".join(f"('{c}', '{a}', '{f}', 1)" for c, d in dims.CATEGORIES.items() for a, f in d.items()) + ") t(category, abbr, \"full\", prio)"
_BASE = [("base", "GHG", "Green House Gases", 0), ("base", "UN", "United Nations", 0), ("base", "GDP", "Gross Domestic Product", 0)]


@query(f'SELECT abbr, arg_max("full", prio) AS expansion, arg_max(category, prio) AS category, lower(replace(arg_max("full", prio), \' \', \'\')) AS expansion_key FROM {_VALUES} GROUP BY abbr')
def abbr_map_merge(spark: SparkSession, sf: str) -> DataFrame:
    base = spark.createDataFrame(_BASE, "category string, abbr string, full string, prio int")
    return mn.merge_dictionaries(base.union(dims.categories(spark))).select("abbr", F.col("full").alias("expansion"), "category", mn.expansion_key(F.col("full")).alias("expansion_key"))


@query("SELECT n_nationkey AS k, concat('N', CAST(n_nationkey AS VARCHAR)) AS abbr, concat(n_name, ' Office') AS expansion FROM nation")
def abbr_pairs_oriented(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("N"), "n_nationkey").alias("a"), F.concat("n_name", F.lit(" Office")).alias("f"))
    abbr, full = mn.oriented_pairs(F.when(F.col("k") % 2 == 0, F.col("a")).otherwise(F.col("f")), F.when(F.col("k") % 2 == 0, F.col("f")).otherwise(F.col("a")))
    return n.select("k", abbr.alias("abbr"), full.alias("expansion"))


_TALK = ["Talks at the UN resumed.", "The United Nations met.", "United Nations (UN) staff left.", "Greenhouse Gases and GHG rose."]
@query("""WITH o AS (SELECT o_custkey AS doc, o_orderkey AS ord, o_orderkey % 4 AS t FROM orders), u AS (SELECT *, row_number() OVER (PARTITION BY doc, t = 3 ORDER BY ord) AS nth FROM o)
    SELECT doc, ord, CASE t WHEN 0 THEN concat('Talks at the ', CASE WHEN nth = 1 THEN 'United Nations (UN)' ELSE 'UN' END, ' resumed.') WHEN 1 THEN concat('The ', CASE WHEN nth = 1 THEN 'United Nations (UN)' ELSE 'UN' END, ' met.')
      WHEN 2 THEN 'United Nations (UN) staff left.' ELSE concat(CASE WHEN nth = 1 THEN 'Greenhouse Gases (GHG)' ELSE 'GHG' END, ' and GHG rose.') END AS text FROM u""")
def abbr_expand(spark: SparkSession, sf: str) -> DataFrame:
    o = spread(table(spark, sf, "orders")).select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ord"), F.element_at(tx.lit_array(_TALK), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("text"))
    return mn.expand_mentions(o, dims.categories(spark).select("abbr", "full"), "doc", "ord")


@query(f"""WITH w AS (SELECT doc_id, para_idx, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS pos, lower(unnest(ws)) AS word FROM (SELECT doc_id, para_idx, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS ws FROM {PARAS} WHERE text IS NOT NULL)),
    s AS (SELECT DISTINCT group_id, ord, term, lower(regexp_replace(term, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) AS word FROM synonym_dim), d AS (SELECT word, min(group_id) AS group_id, arg_min(term, ord) AS term, min(ord) AS ord FROM s WHERE word <> '' GROUP BY word)
    SELECT doc_id, group_id, arg_min(term, CAST(para_idx AS BIGINT) * 1000000 + pos) AS chosen, CAST(min(CAST(para_idx AS BIGINT) * 1000000 + pos) // 1000000 AS INTEGER) AS first_order, CAST(min(CAST(para_idx AS BIGINT) * 1000000 + pos) % 1000000 AS INTEGER) AS first_pos, count(*) AS mentions FROM w JOIN d USING (word) GROUP BY doc_id, group_id""")
def synonym_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    dim = table(spark, sf, "synonym_dim").withColumn("w", F.lower(F.array_join(tx.words(F.col("term")), " "))).where("w <> ''").groupBy("w").agg(F.min("group_id").alias("group_id"), F.min("ord").alias("ord"), F.min_by("term", "ord").alias("term"))
    u = mn.unify_terms(paragraphs(spark, sf, "text"), dim, "doc_id", "para_idx")
    return u.select("doc_id", "group_id", "chosen", "first_order", "first_pos", "mentions")


@query("""WITH o AS (SELECT o_custkey AS doc, o_orderkey AS ord, o_orderkey % 4 AS t FROM orders),
    f AS (SELECT doc, CASE arg_min(t, ord) FILTER (t < 2) WHEN 0 THEN 'The United States of America' WHEN 1 THEN 'The United States' END AS us, CASE arg_min(t, ord) FILTER (t > 1) WHEN 2 THEN 'South Korea' WHEN 3 THEN 'Republic of Korea' END AS kr FROM o GROUP BY doc)
    SELECT o.doc, ord, CASE t WHEN 0 THEN concat(us, ' met.') WHEN 1 THEN concat('Aid of ', CASE us WHEN 'The United States' THEN 'the United States' ELSE us END, ', and "the United States of America" quoted.')
      WHEN 2 THEN concat(kr, ' and ', kr, ' spoke.') ELSE concat('Talks with the ', kr, '.') END AS text FROM o JOIN f ON o.doc = f.doc""")
def synonym_unified_talk(spark: SparkSession, sf: str) -> DataFrame:
    """The first term of each group that a customer's texts mention, of one word or several, takes the place of the others outside quotations."""
    t = tx.lit_array(["The United States of America met.", 'Aid of the United States, and "the United States of America" quoted.', "South Korea and ROK spoke.", "Talks with the Republic of Korea."])
    o = spread(table(spark, sf, "orders")).select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ord"), F.element_at(t, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("text"))
    return mn.unify_texts(o, dims.state_synonyms(spark), "doc", "ord")


@query()
def synonym_unified(spark: SparkSession, sf: str) -> DataFrame:
    return mn.unify_texts(paragraphs(spark, sf, "text"), dims.state_synonyms(spark), "doc_id", "para_idx")


@query("SELECT c_custkey AS k, concat('China and China met ', c_name, '; the United States, PRCX and prc. \"PRC talks\", ‘PRC’ and China''s.') AS text FROM customer")
def variant_canonical(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("People's Republic of China and PRC met "), "c_name", F.lit("; the United States of America, PRCX and prc. \"PRC talks\", ‘PRC’ and PRC's."))
    v = spark.createDataFrame([("China", "PRC"), ("China", "People's Republic of China"), ("United States", "United States of America")], "entity string, variant string")
    return mn.canonical_variants(table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), t.alias("text")), v, ["k"])


@query("""SELECT mention_id, CASE WHEN row_number() OVER (PARTITION BY doc_id, name_text ORDER BY para_idx, run_idx, mention_id) > 1 THEN split_part(name_text, ' ', 2) ELSE name_text END AS shown FROM (SELECT DISTINCT mention_id, doc_id, para_idx, run_idx, name_text FROM name_mentions) WHERE regexp_matches(name_text, '^[A-Z][a-z]+ [A-Z][a-z]+$')""")
def name_collapse(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "name_mentions").dropDuplicates(["mention_id"]).where(F.col("name_text").rlike("^[A-Z][a-z]+ [A-Z][a-z]+$"))
    n = F.row_number().over(Window.partitionBy("doc_id", "name_text").orderBy("para_idx", "run_idx", "mention_id"))
    return m.select("mention_id", F.when(n > 1, F.split_part("name_text", F.lit(" "), F.lit(2))).otherwise(F.col("name_text")).alias("shown"))


_PEOPLE = [("Anna", "Berg"), ("Raj Kumar", "Rao"), ("Li", "Wei")]
@query("""WITH o AS (SELECT o_custkey AS doc, o_orderkey AS ord, CAST(o_orderkey % 3 AS INTEGER) AS i, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) AS nth FROM orders), n AS (SELECT *, ['Anna Berg', 'Raj Kumar Rao', 'Li Wei'][i + 1] AS f, ['Berg', 'Rao', 'Wei'][i + 1] AS l FROM o)
    SELECT doc, ord, concat('today ', CASE WHEN nth = 1 THEN concat('Dr ', f) ELSE l END, ' wrote "', f, '", says ', l, ' himself.') AS text FROM n""")
def name_collapse_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in which a person named in full is named by the last name from the second time on, title and all, outside quotations."""
    full = F.element_at(tx.lit_array([f"{a} {b}" for a, b in _PEOPLE]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("today Dr "), full, F.lit(' wrote "'), full, F.lit('", says '), full, F.lit(" himself.")).alias("text"))
    return mn.collapse_names(o, "doc", "ord")


@query("SELECT lower(p_brand) AS expansion_key, max(p_partkey) AS k, arg_max(concat('B', p_partkey), p_partkey) AS abbr FROM part GROUP BY p_brand")
def expansion_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Entries whose expansions differ in case and white space only are one, the last."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    full = F.when(k % 3 == 0, F.upper("p_brand")).when(k % 3 == 1, F.regexp_replace("p_brand", "#", " # ")).otherwise(F.col("p_brand"))
    d = mn.dedupe_expansions(p.select(k.alias("k"), F.concat(F.lit("B"), k).alias("abbr"), full.alias("full")), "k")
    return d.select(mn.expansion_key(F.col("full")).alias("expansion_key"), "k", "abbr")


@query("SELECT concat('N', c_nationkey) AS abbr, arg_max(concat(c_name, ' Office'), c_custkey) AS expansion FROM customer GROUP BY c_nationkey")
def abbr_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs written either way round; the last expansion of each abbreviation stays."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    a, f = F.concat(F.lit("N"), "c_nationkey"), F.concat("c_name", F.lit(" Office"))
    d = c.select(k.alias("k"), F.when(k % 2 == 0, a).otherwise(f).alias("l"), F.when(k % 2 == 0, f).otherwise(a).alias("r"))
    return mn.oriented_dictionary(d, "k", "l", "r").select("abbr", F.col("full").alias("expansion"))


@query(f"SELECT doc_id, term AS entity, string_agg(DISTINCT abbr, ',' ORDER BY abbr) AS variants FROM {_FOUND} WHERE term <> '' AND abbr <> term GROUP BY doc_id, term")
def entity_variants(spark: SparkSession, sf: str) -> DataFrame:
    return mn.entity_variants(_defined(spark, sf), "doc_id").select("doc_id", "entity", F.array_join("variants", ",").alias("variants"))


@query(f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+')) AS person FROM {PARAS} WHERE text IS NOT NULL")
def person_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs(spark, sf, "text").where("text IS NOT NULL").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+ [A-Z][a-z]+"), F.lit(0))).alias("person")).distinct()


@query("SELECT o_orderkey AS k, concat('The United States of America (USA) and ', o_orderkey, ' Term (ABBR) in Carbon Tax') AS text FROM orders")
def nested_and_usa(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("The United States (US) of America (USA) and "), "o_orderkey", F.lit(" Term (Term (ABBR)) in Carbon Tax (Carbon Tax)"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), mn.usa_special_case(mn.clean_nested(t)).alias("text"))


@query(f"SELECT doc_id, count(*) FILTER (length(word) > 1 AND length(regexp_replace(word, '[^\\p{{Lu}}]', '', 'g')) / length(word) >= 0.8) AS by_ratio, count(*) FILTER (length(regexp_replace(word, '[^A-Za-z]', '', 'g')) > 0 AND upper(regexp_replace(word, '[^A-Za-z]', '', 'g')) = regexp_replace(word, '[^A-Za-z]', '', 'g') AND length(word) <= 15) AS by_letters FROM {EXPLODED} GROUP BY doc_id")
def acronym_tests(spark: SparkSession, sf: str) -> DataFrame:
    w = mn.word_rows(documents(spark, sf, "text").where("text IS NOT NULL"), ["doc_id"])
    c = lambda e: F.count(F.when(e, 1))
    return w.groupBy("doc_id").agg(c(tx.is_acronym_ratio(F.col("word"))).alias("by_ratio"), c(tx.is_acronym_short(F.col("word"))).alias("by_letters"))


@query(f"SELECT doc_id, concat('PREVIOUSLY DEFINED ABBREVIATIONS:', chr(10), string_agg(concat('- ', term, ' (', abbr, ')'), chr(10) ORDER BY abbr, term)) AS context FROM (SELECT doc_id, abbr, arg_max(term, para_idx * 100000 + i) AS term FROM {_FOUND} WHERE term <> '' GROUP BY doc_id, abbr) GROUP BY doc_id")
def abbreviation_context(spark: SparkSession, sf: str) -> DataFrame:
    return mn.abbreviation_context(defined_abbreviations(spark, sf), "doc_id")


# ---- sessions

@query(f"SELECT session_id, batch_num, CAST(floor(length(coalesce(content, '')) * CAST(0.35 AS DECIMAL(4,2))) AS BIGINT) AS tokens, CAST(floor(floor(length(coalesce(content, '')) * CAST(0.35 AS DECIMAL(4,2))) * CAST(2.3 AS DECIMAL(4,2))) AS BIGINT) AS total FROM {BATCHES}")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    t = ss.token_estimate(F.col("content"))
    return batches(spark, sf).select("session_id", "batch_num", t.alias("tokens"), ss.total_estimate(t).alias("total"))


@query(f"SELECT session_id, batch_num FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY batch_num DESC) AS r FROM {BATCHES}) WHERE r <= 3")
def history_last3(spark: SparkSession, sf: str) -> DataFrame:
    return ss.last_messages(batches(spark, sf), "session_id", "batch_num", 3).select("session_id", "batch_num")


@query(f"SELECT session_id, batch_num, CAST(so AS BIGINT) AS tokens_so_far FROM (SELECT *, sum(floor(length(coalesce(content, '')) * CAST(0.35 AS DECIMAL(4,2)))) OVER (PARTITION BY session_id ORDER BY batch_num DESC ROWS UNBOUNDED PRECEDING) AS so FROM {BATCHES}) WHERE so <= 6000")
def history_trim(spark: SparkSession, sf: str) -> DataFrame:
    return ss.trimmed_history(batches(spark, sf), "session_id", "batch_num", "content", 6000).select("session_id", "batch_num", "tokens_so_far")


@query(f"SELECT session_id, batch_num, CAST(length(p) AS INTEGER) AS n, md5(p) AS digest FROM (SELECT session_id, batch_num, coalesce(string_agg(content, chr(10) || chr(10)) OVER (PARTITION BY session_id ORDER BY batch_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS p FROM {BATCHES})")
def previous_context(spark: SparkSession, sf: str) -> DataFrame:
    return ss.with_previous(batches(spark, sf), "session_id", "batch_num", "content").select("session_id", "batch_num", F.length("previous").alias("n"), F.md5("previous").alias("digest"))


_STATE = "regexp_extract(content, '(?s)^ACRONYM_STATE:(\\{.*?\\})\\n\\n(.*)$', 1)"
_OK = f"({_STATE} <> '' AND json_valid({_STATE}))"
@query(f"SELECT session_id, batch_num, CAST(CASE WHEN {_OK} THEN len(json_keys({_STATE})) END AS INTEGER) AS known, CAST(length(CASE WHEN {_OK} THEN regexp_extract(content, '(?s)^ACRONYM_STATE:(\\{{.*?\\}})\\n\\n(.*)$', 2) ELSE content END) AS INTEGER) AS n FROM {BATCHES} WHERE content IS NOT NULL")
def acronym_state_parse(spark: SparkSession, sf: str) -> DataFrame:
    b, c = batches(spark, sf).where("content IS NOT NULL"), F.col("content")
    s = ss.state_of(c)
    return b.select("session_id", "batch_num", F.when(s.isNotNull(), F.size(s)).alias("known"), F.length(ss.text_of(c)).alias("n"))


@query(f"SELECT session_id, acronym, min(batch_num) AS first_batch, count(*) AS batches FROM (SELECT session_id, batch_num, unnest(json_keys({_STATE})) AS acronym FROM {BATCHES} WHERE {_OK}) GROUP BY session_id, acronym")
def acronym_state_union(spark: SparkSession, sf: str) -> DataFrame:
    return ss.states_so_far(batches(spark, sf), "session_id", "batch_num", "content")


@query(f"SELECT session_id, batch_num FROM (SELECT session_id, batch_num, saved_at, max(saved_at) OVER (PARTITION BY session_id) AS newest FROM (SELECT DISTINCT session_id, batch_num, saved_at FROM context_cache)) WHERE epoch_us(newest) - epoch_us(saved_at) < 600 * 1000000")
def fresh_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Cached batches no older than ten minutes when their session's newest was saved."""
    b = table(spark, sf, "context_cache").select("session_id", "batch_num", "saved_at").distinct()
    newest = b.groupBy("session_id").agg(F.max("saved_at").alias("newest"))
    return ss.fresh(b.join(newest, "session_id"), F.col("saved_at"), F.col("newest"), 600).select("session_id", "batch_num")


@query(f"SELECT sha256(text) AS key, count(*) AS asked FROM {DOCS} WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM {DOCS} WHERE lang = 'fr' AND text IS NOT NULL) GROUP BY text")
def llm_cache_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """The texts that are left to ask about when the replies to those labelled fr are cached."""
    d = documents(spark, sf, "text", "lang").where("text IS NOT NULL")
    cache = d.where("lang = 'fr'").select(ss.cache_key(F.col("text")).alias("key"), F.lit("known").alias("response")).distinct()
    asked = d.groupBy(ss.cache_key(F.col("text")).alias("key")).agg(F.count("*").alias("asked"))
    return ss.missing_prompts(d, cache, "text").select("key").join(asked, "key")


@query("SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN concat('A', o_orderkey, '|b §FOOTNOTE:1§') WHEN 1 THEN concat('A', o_orderkey, '|B §FOOTNOTE:1§') ELSE concat('a', o_orderkey, '|b §FOOTNOTE:1§') END AS text FROM orders")
def segment_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    original = F.array(F.concat(F.lit("a"), k), F.lit("b §FOOTNOTE:1§"))
    reply = F.when(k % 3 == 0, F.concat(F.lit("A"), k, F.lit(" \n---\n\n---\nB §FOOTNOTE:2§"))).when(k % 3 == 1, F.concat(F.lit(" A"), k, F.lit("\n---\nB §FOOTNOTE:1§\n"))).otherwise(F.concat(F.lit("A"), k))
    return table(spark, sf, "orders").select(k.alias("k"), F.array_join(ss.reconciled(original, ss.reply_segments(reply)), "|").alias("text"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN concat('Text ', o_orderkey) END AS corrected, 'Be brief.' AS system, CASE WHEN o_orderkey % 2 = 0 THEN concat('{\"a\": [', o_orderkey, ']}') END AS body FROM orders")
def reply_parsing(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    r = F.when(k % 2 == 0, F.concat(F.lit("Sure!\nCorrected: \nText "), k, F.lit("\n"))).otherwise(F.lit("Text"))
    j = F.when(k % 2 == 0, F.concat(F.lit('Here: {"a": ['), k, F.lit("]} ok"))).otherwise(F.lit("Here: {a"))
    return table(spark, sf, "orders").select(k.alias("k"), ss.corrected_text(r).alias("corrected"), ss.split_prompt(F.lit("Be brief.\nInput text: {text}")).alias("system"), ss.json_object(j).alias("body"))


@query("SELECT o_orderkey AS k, CAST(1 + o_orderkey % 10 AS DOUBLE) AS usd, CAST(o_orderkey % 7 + 0.5 AS DOUBLE) AS eur FROM orders")
def fx_json(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    body = F.concat(F.lit('"usd": '), 1 + k % 10, F.lit(', "EUR": '), (k % 7).cast("string"), F.lit(".5"))
    m = ss.rate_map(F.when(k % 2 == 0, F.concat(F.lit("{"), body, F.lit("}"))).otherwise(F.concat(F.lit("Rates are "), body, F.lit(" today"))))
    return table(spark, sf, "orders").select(k.alias("k"), F.element_at(m, "USD").alias("usd"), F.element_at(m, "EUR").alias("eur"))


@query("""SELECT event_id, first_value(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gloss FROM events""")
def gloss_first_reused(spark: SparkSession, sf: str) -> DataFrame:
    """The gloss of a phrase's first occurrence is used for all: phrases are event types here, glosses the numbers in their JSON."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.first(F.get_json_object("props", "$.k").cast("long")).over(w).alias("gloss"))


_GLOSS = "results array<struct<id:int,items:array<struct<phrase:string,gloss:string>>>>"
@query("SELECT o_orderkey AS k, CAST(i AS INTEGER) AS item, concat('p', i) AS phrase, concat('*p', i, '* (g', o_orderkey, ')') AS shown FROM orders, range(6) t(i)")
def gloss_items(spark: SparkSession, sf: str) -> DataFrame:
    """A reply's glosses by paragraph, six at most, each as phrase in italics with its gloss."""
    k = F.col("o_orderkey")
    items = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(F.lit('{"phrase":"p'), i, F.lit('","gloss":"g'), k, F.lit('"}'))), ",")
    j = F.from_json(F.concat(F.lit('{"results":[{"id":1,"items":['), items, F.lit("]}]}")), _GLOSS)
    e = table(spark, sf, "orders").select(k.alias("k"), F.posexplode(F.slice(j["results"][0]["items"], 1, 6)).alias("item", "x"))
    return e.select("k", "item", "x.phrase", F.concat(F.lit("*"), "x.phrase", F.lit("* ("), "x.gloss", F.lit(")")).alias("shown"))


@query(f"SELECT doc_id, md5(CASE WHEN length(s) > 1000 THEN concat(substr(s, 1, 1000), '...') ELSE s END) AS digest FROM (SELECT doc_id, substr(array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), 1, 500), ' '), 1, 1500) AS s FROM {DOCS} WHERE text IS NOT NULL)")
def snippet_budget(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "text").where("text IS NOT NULL").select("doc_id", F.md5(ss.snippet(F.array("text"))).alias("digest"))


@query()
def rate_limit_minutes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.abs("value").alias("v")).select("event_id", "user_id", (F.col("us") / 1e6).alias("at"), F.floor(F.least("v", F.lit(39000)) * 100).cast("long").alias("tokens"))
    return ss.simulate_limiter(e, "user_id", "at", "tokens", 39000)


@query()
def oversized_batch_halving(spark: SparkSession, sf: str) -> DataFrame:
    p = paragraphs(spark, sf, "text").select("doc_id", "para_idx", ss.token_estimate(F.col("text")).alias("tokens"))
    return ss.halved_batches(p, ["doc_id"], "para_idx", "tokens", 2000)


@query()
def topic_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    return connectors.topic_scores(documents(spark, sf, "text"), ["doc_id"], "text")


@query(f"SELECT doc_id, kind, note_id, text AS corrected FROM {NOTES} WHERE text IS NOT NULL")
def corrected_notes(spark: SparkSession, sf: str) -> DataFrame:
    """The whole round of masking, asking, parsing and unmasking with a service that changes nothing gives the texts back."""
    n = notes(spark, sf, "text").where("text IS NOT NULL").withColumn("text", F.col("text"))
    cache = spark.createDataFrame([], "key string, response string")
    return connectors.corrected(n, "Correct the text.", connectors.Echo(), cache).select("doc_id", "kind", "note_id", "corrected")


@query(f"SELECT doc_id, kind, note_id, concat(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' Checked.') AS corrected FROM {NOTES} WHERE length(regexp_replace(text, '\\s+', '', 'g')) > 0")
def changed_notes(spark: SparkSession, sf: str) -> DataFrame:
    """The same round with a service that adds a word."""
    n = notes(spark, sf, "text").where(r"text RLIKE '\\S'")
    cache = spark.createDataFrame([], "key string, response string")
    return connectors.corrected(n, "Correct the text.", connectors.Rewriter(lambda t: t + " Checked."), cache).select("doc_id", "kind", "note_id", "corrected")


@query(f"""WITH p AS (SELECT doc_id, para_idx, text, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) - 1) // 4 AS INTEGER) AS batch FROM {PARAS} WHERE length(trim(text)) > 0),
    a AS (SELECT doc_id, w, min(batch) AS b FROM (SELECT doc_id, batch, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM p) WHERE regexp_matches(w, '^[A-Z]{{2,}}$') GROUP BY doc_id, w)
    SELECT p.doc_id, p.para_idx, p.batch, CAST((SELECT count(*) FROM a WHERE a.doc_id = p.doc_id AND a.b < p.batch) AS INTEGER) AS known, md5(regexp_replace(p.text, '^\\s+|\\s+$', '', 'g')) AS digest FROM p""")
def expansion_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs asked for in batches of four, each with the acronyms known before it; the service changes nothing."""
    cache = spark.createDataFrame([], "key string, response string")
    r = connectors.batched_expansion(paragraphs(spark, sf, "text"), "Expand the abbreviations.", connectors.Echo(), cache)
    return r.select("doc_id", "para_idx", "batch", "known", F.md5(F.regexp_replace("rewritten", r"^\s+|\s+$", "")).alias("digest"))


@query(f"SELECT doc_id, para_idx, md5(regexp_replace(text, '\\s+', '', 'g')) AS digest FROM {PARAS} WHERE length(trim(text)) > 0")
def batched_correction(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs cut at footnotes, asked for in batches of five, put together again: a service that changes nothing keeps every character but white space."""
    cache = spark.createDataFrame([], "key string, response string")
    r = connectors.batched_rewrite(paragraphs(spark, sf, "text"), "Correct the text.", connectors.Echo(), cache)
    return r.select("doc_id", "para_idx", F.md5(F.regexp_replace("rewritten", r"\s+", "")).alias("digest"))


@query("SELECT o_orderkey AS k, concat('https://x.org/', o_orderkey) AS url FROM orders")
def citation_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), connectors.citation_url(F.array(F.lit("http://dx.doi.org/1"), F.lit(None).cast("string"), F.concat(F.lit("https://x.org/"), "o_orderkey"), F.lit("https://y.org"))).alias("url"))


@query(f"""SELECT doc_id, kind, note_id, md5(f) AS digest, concat('rId', row_number() OVER (PARTITION BY doc_id, contains(f, 'https://') ORDER BY note_id)) AS rel_id FROM (SELECT doc_id, kind, note_id, CASE WHEN regexp_matches(f, 'https?://[^\\s)]+') THEN f ELSE concat(f, ' https://n.example/', note_id) END AS f FROM (SELECT doc_id, kind, note_id, concat('*T*, ', regexp_replace(split_part(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10), 1), '\\s+$', '')) AS f FROM {NOTES} WHERE note_id NOT IN (-1, 0) AND length(trim(text)) > 0))""")
def notes_reformatted(spark: SparkSession, sf: str) -> DataFrame:
    """Notes reformatted by a service, with an address each and its relationship."""
    n = notes(spark, sf, "text").where("note_id NOT IN (-1, 0) AND length(trim(text)) > 0").withColumn("url", F.concat(F.lit("https://n.example/"), "note_id"))
    cache = spark.createDataFrame([], "key string, response string")
    f = connectors.reformatted_notes(n, "Format the footnote.", connectors.Rewriter(lambda t: "Formatted Footnote:\n*T*, " + t), cache, ["doc_id", "kind", "note_id"], url="url")
    links = connectors.note_links(f, spark.createDataFrame([], "doc_id string, rel_id string")).select("doc_id", F.col("ord").alias("note_id"), "rel_id")
    return f.join(links, ["doc_id", "note_id"]).select("doc_id", "kind", "note_id", F.md5("formatted").alias("digest"), "rel_id")


@query("SELECT k, n FROM (SELECT l_orderkey AS k, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem WHERE l_partkey % 3 > 0) WHERE r <= 4")
def top_results(spark: SparkSession, sf: str) -> DataFrame:
    """The first four results of each search, here an order's lines, without those of two domains."""
    url = F.element_at(tx.lit_array(["https://www.skip.example/a", "https://keep.example/skip.example", "http://Other.example:80/"]), (F.col("l_partkey") % 3 + 1).cast("int"))
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), url.alias("url"))
    return connectors.top_results(r, ["k"], "n", "url", ("skip.example", "none.example")).select("k", "n")


@query(f"""SELECT doc_id, para_idx, md5(CASE WHEN contains(text, 'council') THEN concat(a, '*council* (a body)', b) ELSE text END) AS digest FROM (SELECT doc_id, para_idx, text, substr(text, 1, strpos(text, 'council') - 1) AS a, substr(text, strpos(text, 'council') + 7) AS b FROM {PARAS} WHERE text IS NOT NULL)""")
def paragraph_glosses(spark: SparkSession, sf: str) -> DataFrame:
    """Glosses joined by paragraph: the phrase in italics with the gloss that its document gave first."""
    p = paragraphs(spark, sf, "text").where("text IS NOT NULL")
    g = p.where("contains(text, 'council')").select("doc_id", "para_idx", F.lit("council").alias("phrase"), F.lit("a body").alias("gloss"))
    return connectors.with_glosses(p, connectors.first_glosses(g, "doc_id", ["para_idx"]), ["doc_id", "para_idx"]).select("doc_id", "para_idx", F.md5("text").alias("digest"))


QUERIES, ORACLE = query.queries, query.oracle
