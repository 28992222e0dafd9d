"""Queries of the text rules. Sentences are made from table columns, so that SQL can build the result without the rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import currency, house, numbers, protect, spelling
from ..functions import text as tx
from .base import LINE, PARAS, RUNS, Registry, lines, paragraphs, runs, sql_below_100, sql_below_1000, sql_small, table

query = Registry()


@query(f"SELECT k, n, concat('Line ', n, ' fell ', d, ' per cent and rose 3.25%, up ', q, ' per cent YoY.') AS text FROM {LINE}")
def percent_symbol(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("Line "), "n", F.lit(" fell "), "d", F.lit("% and rose 3.25%, up "), "q", F.lit("%YoY."))
    return lines(spark, sf).select("k", "n", numbers.percent_symbol(t).alias("text"))


@query(f"SELECT k, n, concat('It was ', d, ' per cent of ', q, '.5 per cent, not a percentage.') AS text FROM {LINE}")
def percent_word(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("It was "), "d", F.lit(" percent of "), "q", F.lit(".5Percent, not a percentage."))
    return lines(spark, sf).select("k", "n", numbers.percent_word(t).alias("text"))


@query(f"SELECT k, n, concat('Of these, ', pk % 100, ' per cent agreed.') AS text FROM {LINE}")
def percent_word_number(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("Of these, "), numbers.int_words(F.col("pk") % 100), F.lit(" percent agreed."))
    return lines(spark, sf).select("k", "n", numbers.percent_word_number(t).alias("text"))


@query(f"SELECT k, n, concat('Up ', {sql_small('n')}, ' to ', {sql_small('q')}, ' per cent over ', {sql_small('n')}, ' to ', {sql_small('q')}, ' years, 2019-', 20 + n, '.') AS text FROM {LINE}")
def range_to_words(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("Up "), "n", F.lit("-"), "q", F.lit("% over "), "n", F.lit(" – "), "q", F.lit(" years, 2019-"), F.col("n") + 20, F.lit("."))
    return lines(spark, sf).select("k", "n", numbers.ranges_to_words(t).alias("text"))


@query(f"SELECT k, n, concat('Paid US$', p, ' and £', q, ' million, HK$5.') AS text FROM {LINE}")
def currency_symbol(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("Paid usd "), "p", F.lit(" and GBP "), "q", F.lit("million, HK$5."))
    return lines(spark, sf).select("k", "n", currency.currency_symbols(t).alias("text"))


@query(f"SELECT k, n, concat('S$', q, ' million or €', d, '.5 billion') AS text FROM {LINE}")
def currency_scale_space(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("S$ "), "q", F.lit("million or € "), "d", F.lit(".5   billion"))
    return lines(spark, sf).select("k", "n", currency.currency_symbols(t).alias("text"))


ORDER = "(SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(12,2)) AS p, ['US$', '€', '£', '₹', 'S$'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS sign, ['USD', 'EUR', 'GBP', 'INR', 'SGD'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS code FROM orders)"


@query(f"""SELECT k, concat('The bill was ', sign, p, CASE WHEN code = 'SGD' THEN '' ELSE concat(' (S$', format('{{:,}}', CAST(floor(v) AS BIGINT)), '.', lpad(CAST(CAST((v - floor(v)) * 100 AS BIGINT) AS VARCHAR), 2, '0'), ')') END, ' in all, after €7  (S$ 9.80) before.') AS text
    FROM (SELECT o.*, round(p * to_sgd, 2) AS v FROM {ORDER} o LEFT JOIN fx USING (code))""")
def currency_to_sgd(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(12,2)").alias("p"), F.element_at(tx.lit_array(["US$", "€", "£", "₹", "S$"]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("sign"))
    t = F.concat(F.lit("The bill was "), "sign", "p", F.lit(" in all, after €7  (S$ 9.80) before."))
    return currency.add_sgd(o.withColumn("text", t), table(spark, sf, "fx")).select("k", "text")


@query("SELECT o_orderkey AS k, 'SGD,USD,EUR' AS codes FROM orders")
def currency_codes_in_order(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("S$5 and usd "), F.col("o_orderkey"), F.lit(", then €7, US$9 and EUR 3."))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.array_join(currency.codes_in(t), ",").alias("codes"))


@query("SELECT p_partkey AS k, concat('At ', p_size, ' Degree Celsius, then ', p_size, '.5 Degree Fahrenheit and -', p_size, ' Degree Celsius.') AS text, concat(p_size, CASE WHEN p_size = 1 THEN ' degree' ELSE ' degrees' END, ' Celsius') AS short FROM part")
def temperature_text(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("At "), "p_size", F.lit("°C, then "), "p_size", F.lit(".5 °F and -"), "p_size", F.lit("°c."))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), numbers.temperatures(t).alias("text"), numbers.temperatures(F.concat("p_size", F.lit("° C")), "degrees").alias("short"))


_N = "(p_partkey * 37 % 1000000)"
@query(f"""SELECT p_partkey AS k, {sql_below_100('(p_size % 100)')} AS w_hyphen, {sql_below_1000('(p_partkey % 1000)', '-', ' and ')} AS w_and,
    CASE WHEN {_N} < 1000 THEN {sql_below_1000(_N, ' ', ' ')} ELSE {sql_below_1000(f'({_N} // 1000)', ' ', ' ')} || ' thousand' || CASE WHEN {_N} % 1000 = 0 THEN '' ELSE ' ' || {sql_below_1000(f'({_N} % 1000)', ' ', ' ')} END END AS w_space,
    CASE WHEN {_N} = 0 THEN 'zero' ELSE concat_ws(' ', CASE WHEN {_N} >= 1000 THEN {sql_below_1000(f'({_N} // 1000)', '-', ' ')} || ' thousand' END, CASE WHEN {_N} % 1000 > 0 THEN {sql_below_1000(f'({_N} % 1000)', '-', ' ')} END) END AS w_long FROM part""")  # fmt: skip
def int_to_words(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey") * 37 % 1000000
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), numbers.int_words(F.col("p_size") % 100).alias("w_hyphen"), numbers.int_words(F.col("p_partkey") % 1000, "and").alias("w_and"), numbers.int_words(n, "space").alias("w_space"), numbers.int_words(n, "long").alias("w_long"))


@query(f"SELECT p_partkey AS k, concat({sql_below_100('(p_size % 100)')}, ' point ', {sql_small('(p_partkey % 10)')}, ' ', {sql_small('(p_size % 10)')}) AS words FROM part")
def decimal_to_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), numbers.decimal_words(F.concat(F.col("p_size") % 100, F.lit("."), F.col("p_partkey") % 10, F.col("p_size") % 10)).alias("words"))


@query("SELECT p_partkey AS k, CAST(p_size % 100 AS INTEGER) AS small, CAST(p_partkey * 37 % 1000000 AS INTEGER) AS large FROM part")
def words_to_int(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), numbers.words_to_int_99(numbers.int_words(F.col("p_size") % 100)).cast("int").alias("small"), numbers.words_to_int(numbers.int_words(F.col("p_partkey") * 37 % 1000000, "space")).cast("int").alias("large"))


@query(f"SELECT p_partkey AS k, concat('We saw ', CASE WHEN p_partkey % 1000 < 10 THEN {sql_small('(p_partkey % 1000)')} ELSE CAST(p_partkey % 1000 AS VARCHAR) END, ' ships.') AS text FROM part")
def words_to_numerals(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("We saw "), numbers.int_words(F.col("p_partkey") % 1000, "and"), F.lit(" ships."))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), numbers.words_to_numerals(t).alias("text"))


@query(f"SELECT k, n, concat('Team ', {sql_small('n')}, ' won ', {sql_small('q')}, ' of ', {sql_small('n')}, ', v1.', n, ' a-', n, ' ', n, '/', q, ' (', {sql_small('n')}, ')') AS text FROM {LINE}")
def digits_spelled(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("Team "), "n", F.lit(" won "), "q", F.lit(" of "), "n", F.lit(", v1."), "n", F.lit(" a-"), "n", F.lit(" "), "n", F.lit("/"), "q", F.lit(" ("), "n", F.lit(")"))
    return lines(spark, sf).select("k", "n", numbers.spell_digits(t).alias("text"))


_CAP = lambda e: f"upper(substr({e}, 1, 1)) || substr({e}, 2)"
@query(f"SELECT k, n, concat({_CAP(sql_below_100('q'))}, ' projects were funded. ', {_CAP(sql_below_100('n'))}, ' failed! In ', n, ' cases, 1,234 stayed.') AS text FROM {LINE}")
def sentence_start_number(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat("q", F.lit(" projects were funded. "), "n", F.lit(" failed! In "), "n", F.lit(" cases, 1,234 stayed."))
    return lines(spark, sf).select("k", "n", numbers.sentence_start_numbers(t).alias("text"))


@query(f"SELECT k, n, concat(n, '.5 metres of cable, 12.25 per cent, 0.5 litre and ', q, '.25 tonnes.') AS text FROM {LINE}")
def unit_plural(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat("n", F.lit(".5 metre of cable, 12.25 per cent, 0.5 litre and "), "q", F.lit(".25 tonnes."))
    return lines(spark, sf).select("k", "n", numbers.plural_units(t).alias("text"))


@query(f"SELECT k, n, concat('Here ', n, '.25 metres are needed; ', n, ' item ', CASE WHEN n > 1 THEN 'are' ELSE 'is' END, ' left and 0.5 litre is not.') AS text FROM {LINE}")
def fraction_verb(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("Here "), "n", F.lit(".25 metres is needed; "), "n", F.lit(" item is left and 0.5 litre is not."))
    return lines(spark, sf).select("k", "n", numbers.fraction_verb(t).alias("text"))


@query(f"SELECT k, n, concat('Rose ', {sql_below_100('q')}, ' point ', {sql_small('n')}, ' points, ', n, '.5% and ', n, '.5 per cent at ', n, '.5°C, v1.2.', n) AS text FROM {LINE}")
def decimals_in_text(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("Rose "), "q", F.lit("."), "n", F.lit(" points, "), "n", F.lit(".5% and "), "n", F.lit(".5 per cent at "), "n", F.lit(".5°C, v1.2."), "n")
    return lines(spark, sf).select("k", "n", numbers.decimals_to_words(t).alias("text"))


@query("SELECT p_partkey AS k, concat('The colour of ', p_brand, ' labour; ORGANISE the Realisation, capsize, prize. The World Trade Organization and the WHO organise ', p_size, ' centres.') AS text FROM part")
def uk_spelling(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("The color of "), "p_brand", F.lit(" labor; ORGANIZE the Realization, capsize, prize. The World Trade Organization and the WHO organize "), "p_size", F.lit(" centers."))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), spelling.british(t).alias("text"))


@query("SELECT p_partkey AS k, (p_size % 23) >= greatest(8, CAST(floor(greatest(1, p_partkey % 11) * 1.8) AS INTEGER)) AS keeps, concat(CASE WHEN (p_size % 23) >= greatest(8, CAST(floor(greatest(1, p_partkey % 11) * 1.8) AS INTEGER)) THEN 'organize colour' ELSE 'organise colour' END) AS text FROM part")
def ize_preference(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.expr("repeat('realize ', p_size % 23)"), F.expr("repeat('advise ', cast(p_partkey % 11 as int))"))
    keeps = spelling.prefers_ize(t)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), keeps.alias("keeps"), spelling.british(F.lit("organize color"), keeps).alias("text"))


@query("SELECT c_custkey AS k, concat('The Ulema met SHIA leaders and the shia of ', c_name, '; ulema.') AS text FROM customer")
def foreign_consistency(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("The Uluma met SHIAH leaders and the shi'a of "), "c_name", F.lit("; ulamaa."))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), spelling.consistent_foreign(t).alias("text"))


@query("SELECT c_custkey AS k, c_custkey % 3 = 0 AS near, c_custkey % 2 = 0 AS cue FROM customer")
def protected_name_and_cues(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.expr("repeat('x ', if(c_custkey % 3 = 0, 10, 60))"), F.lit("World Trade Organization"))
    c = F.concat(F.lit("A plan "), F.when(F.col("c_custkey") % 2 == 0, F.lit("of the Shura")).otherwise(F.lit("of the board")))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), spelling.near_protected_name(t, F.lit(0), F.lit(4)).alias("near"), spelling.looks_foreign(c).alias("cue"))


@query(f"SELECT doc_id, para_idx, run_idx, replace(replace(text, chr(8201), ' '), chr(160), ' ') AS text FROM {RUNS} WHERE contains(text, chr(8201)) OR contains(text, chr(160))")
def thin_spaces(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf, "text").where(F.col("text").contains("\u2009") | F.col("text").contains("\u00a0")).select("doc_id", "para_idx", "run_idx", tx.normalise_spaces(F.col("text")).alias("text"))


@query(f"SELECT doc_id, para_idx, regexp_matches(text, '[^\\x00-\\x7F]') AS foreign_chars FROM {PARAS} WHERE text IS NOT NULL")
def looks_foreign(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs(spark, sf, "text").where("text IS NOT NULL").select("doc_id", "para_idx", spelling.looks_foreign(F.col("text")).alias("foreign_chars"))


@query(f"SELECT doc_id, para_idx, len(regexp_extract_all(text, '§FOOTNOTE:[^§]+§')) AS placeholders, len(regexp_extract_all(text, '\"[^\"\\n]*\"|“[^”\\n]*”')) AS quotes, len(regexp_extract_all(text, '(?i)(?:US\\$|S\\$|€|£|¥|₹)\\s?\\d[\\d,]*(?:\\.\\d+)?(?:\\s+(?:million|billion))?')) AS amounts FROM {PARAS} WHERE text IS NOT NULL")
def protected_spans_count(spark: SparkSession, sf: str) -> DataFrame:
    c = protect.span_counts(F.col("text"))
    quotes = tx.count_matches(F.col("text"), r'"[^"\n]*"|“[^”\n]*”')
    return paragraphs(spark, sf, "text").where("text IS NOT NULL").select("doc_id", "para_idx", c["placeholder"].cast("long").alias("placeholders"), quotes.cast("long").alias("quotes"), c["currency"].cast("long").alias("amounts"))


_KINDS = ("code", "quote", "html", "image_tag", "heading", "md_image", "md_note", "placeholder", "starred", "par", "currency")
@query("SELECT p_partkey AS k, CAST(1 AS INTEGER) AS code, CAST(p_size % 4 AS INTEGER) AS quote, CAST(p_size % 3 AS INTEGER) AS html, CAST(p_size % 5 AS INTEGER) AS image_tag, CAST(1 AS INTEGER) AS heading, CAST(1 AS INTEGER) AS md_image, CAST(1 AS INTEGER) AS md_note, CAST(p_size % 6 AS INTEGER) AS placeholder, CAST(p_size % 2 AS INTEGER) AS starred, CAST(1 AS INTEGER) AS par, CAST(1 AS INTEGER) AS currency FROM part")
def protected_spans_kinds(spark: SparkSession, sf: str) -> DataFrame:
    rep = lambda s, m: F.expr(f"repeat('{s}', p_size % {m})")
    t = F.concat(F.lit("# Head\n```py\nx\n```\nIt's plain. ![i](u) "), rep('"q" ', 4), rep("<table a><b>t</b></table> ", 3), rep("<img src=x> ", 5), rep("§FOOTNOTE:7§ ", 6), rep("**b** ", 2), F.lit("<<par>> US$5 million\n[^1]: note\n  more\nend"))
    c = protect.span_counts(t)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), *[c[x].cast("int").alias(x) for x in _KINDS])


@query(f"SELECT k, n, concat('He said \"', d, '%\" and left ', d, ' per cent, ‘', q, '%’ too; it''s ', q, ' per cent.') AS text FROM {LINE}")
def outside_quotes_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit('He said "'), "d", F.lit('%" and left '), "d", F.lit("%, ‘"), "q", F.lit("%’ too; it's "), "q", F.lit("%."))
    return lines(spark, sf).select("k", "n", protect.outside_quotes(t, numbers.percent_symbol).alias("text"))


@query(f"SELECT k, n, concat('a §Q§a§ b ', q, ' §Q§b§ c') AS masked, CAST(2 AS INTEGER) AS spans, true AS back FROM {LINE}")
def mask_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit('a "x'), "n", F.lit('" b '), "q", F.lit(" “y” c"))
    masked, bucket = protect.mask(t, protect.QUOTED, "Q")
    return lines(spark, sf).select("k", "n", masked.alias("masked"), F.size(bucket).alias("spans"), (protect.unmask(masked, bucket, "Q") == t).alias("back"))


@query(f"SELECT k, n, CAST(4 + length(CAST(n AS VARCHAR)) AS INTEGER) AS first_end, CAST(2 AS INTEGER) AS merged, true AS inside, false AS outside FROM {LINE}")
def span_positions(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit('a "'), "n", F.lit('"“y” b "z"'))
    s = protect.spans(t, protect.QUOTED)
    m = protect.merge_spans(s)
    return lines(spark, sf).select("k", "n", s[0]["e"].alias("first_end"), F.size(m).alias("merged"), protect.contains_place(m, F.lit(3)).alias("inside"), protect.contains_place(m, F.lit(0)).alias("outside"))


@query(f"SELECT doc_id, count(*) AS table_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {PARAS} WHERE text IS NOT NULL) WHERE length(line) - length(replace(line, '|', '')) >= 2 OR length(line) - length(replace(line, chr(9), '')) >= 2 OR regexp_matches(line, '(?i)^\\s*(?:(?:Table|Figure|Chart|Exhibit)(?:$|[^\\p{{L}}\\p{{N}}_])|Fig\\.)') GROUP BY doc_id")
def table_figure_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = paragraphs(spark, sf, "text").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return e.where(protect.is_table_or_figure_line(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("table_lines"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, concat('On ', strftime(l_shipdate, '%-d %B %Y'), ', ', l_linenumber, ' left; CO2 in ', year(l_shipdate), '–', strftime(l_shipdate, '%y'), '.') AS text FROM lineitem")
def written_house_rules(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("On  "), F.date_format("l_shipdate", "d"), F.lit("th "), F.date_format("l_shipdate", "MMMM, yyyy"), F.lit(" , "), "l_linenumber", F.lit(" left ; CO₂ in "), F.date_format("l_shipdate", "yyyy"), F.lit("-"), F.date_format("l_shipdate", "yy"), F.lit("."))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), house.year_spans(house.plain_subscripts(house.dates(house.spacing(t)))).alias("text"))


@query("SELECT p_partkey AS k, p_size % 2 = 0 AS scientific FROM part")
def scientific_context(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("The value"), F.when(F.col("p_size") % 2 == 0, F.lit(" = ")).otherwise(F.lit(" is ")), F.lit("5C here and x ± y"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), house.in_scientific_context(t, F.instr(t, "5") - 1, F.instr(t, "5")).alias("scientific"))


def _styled(text: Column) -> Column:
    """All deterministic rules, outside protected spans, line by line."""
    t = protect.outside_protected(text, lambda s: protect.by_line(s, lambda x: numbers.spell_digits(numbers.percent_symbol(numbers.ranges_to_words(spelling.british(x))))))
    return numbers.sentence_start_numbers(currency.currency_symbols(t))


@query()
def style_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """All rules over all paragraphs."""
    p = paragraphs(spark, sf, "text", "style", "in_table").where("length(text) > 0")
    return p.select("doc_id", "para_idx", F.when(F.col("in_table"), F.col("text")).otherwise(_styled(F.col("text"))).alias("text"))


@query(f"""SELECT k, n, concat('The colour of ', {sql_small('n')}, ' harbours rose by ', {sql_small('q')}, ' per cent, "the color of 5%" aside.', chr(10), 'Table 5 | the color of 5% | x', chr(10), 'It cost US$', p, ' in the centre.') AS text FROM {LINE}""")
def style_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """All rules in one: spelling, percentages, digits and currency change, quotations and table lines don't."""
    t = F.concat(F.lit("The color of "), "n", F.lit(" harbors rose by "), "q", F.lit('%, "the color of 5%" aside.\nTable 5 | the color of 5% | x\nIt cost usd '), "p", F.lit(" in the center."))
    return lines(spark, sf).select("k", "n", _styled(t).alias("text"))


QUERIES, ORACLE = query.queries, query.oracle
