"""Queries of the training-data problems that live in this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import langid, leakage, lookalike, mixing, names, splitting


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return names.mention_groups(_read(spark, sf, "name_mentions"), _read(spark, sf, "synonym_dim"))


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each mention with its entity and the number of its links; p1_found gives the links one by one."""
    return names.with_links(_groups(spark, sf))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.mention_pairs(_groups(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = splitting.split_oversized(splitting.items_of(_read(spark, sf, "paragraphs"), _read(spark, sf, "context_cache")), _read(spark, sf, "size_limits"))
    return pieces.where("piece_no = 0 AND n_pieces > 1").select("item_kind", "owner_id", "item_idx").distinct()


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.once(splitting.split_oversized(splitting.items_of(_read(spark, sf, "paragraphs"), _read(spark, sf, "context_cache")), _read(spark, sf, "size_limits")))


def p3_rejoined(spark: SparkSession, sf: str) -> DataFrame:
    """What can be said of the pieces in SQL: no piece is over its limit, each begins an overlap before the last one's end, none is empty, and without the overlaps they give the item again."""
    limits = _read(spark, sf, "size_limits").select("item_kind", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("over"))
    each = p3_pieces(spark, sf).join(F.broadcast(limits.dropDuplicates(["item_kind"])), "item_kind")
    own = F.when(F.col("piece_no") == 0, F.col("text")).otherwise(F.col("text").substr(F.col("over") + 1, F.length("text")))
    g = each.groupBy("item_kind", "owner_id", "item_idx").agg(F.sort_array(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", own.alias("own")))).alias("x"), F.max(F.length("text") - F.col("max_chars")).alias("most"), F.min(F.length("text")).alias("least"), F.first("over").alias("over"))
    steps = F.forall(F.sequence(F.lit(1), F.size("x") - 1), lambda i: F.get("x", i)["start_pos"] == F.get("x", i - 1)["end_pos"] - F.col("over"))
    return g.select("item_kind", "owner_id", "item_idx", F.md5(F.array_join(F.transform("x", lambda p: p["own"]), "")).alias("digest"), (F.col("most") <= 0).alias("within"), (F.col("least") > 0).alias("full"), steps.alias("overlaps"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    runs = _read(spark, sf, "runs").select(F.lit("document").alias("xml_part"), "doc_id", F.col("para_idx").alias("item_idx"), "run_idx", "text")
    notes = _read(spark, sf, "notes").select(F.lit("footnotes").alias("xml_part"), "doc_id", F.col("note_id").alias("item_idx"), F.lit(-1).alias("run_idx"), "text")
    return runs.unionByName(notes)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.inconsistent_rows(_texts(spark, sf)).select("xml_part", "doc_id", "item_idx", "run_idx").distinct()


def p5_consistent(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.with_consistent(_texts(spark, sf)).drop("text").dropDuplicates(["xml_part", "doc_id", "item_idx", "run_idx"])


def p6_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(_read(spark, sf, "documents"), _read(spark, sf, "eval_items"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_leaks(spark, sf).select("doc_id", "item_id")


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    counts = mixing.token_counts(_read(spark, sf, "documents"))
    return mixing.mix_sources(counts, _read(spark, sf, "mix_targets"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(p7_mix(spark, sf), _read(spark, sf, "mix_targets"))


def p7_holds(spark: SparkSession, sf: str) -> DataFrame:
    """What can be said of the mix in SQL: which sources occur, that none is used too often, that shares are tokens over the sum, and that they meet the targets of the sources that occur but for two documents."""
    counts, targets = mixing.token_counts(_read(spark, sf, "documents")), _read(spark, sf, "mix_targets")
    largest = counts.where("tokens > 0").groupBy("source").agg(F.max("tokens").alias("largest"))
    r = mixing.mix_report(mixing.mix_sources(counts, targets), targets).join(largest, "source", "left")
    whole = Window.partitionBy()  # as many rows as targets
    has, all_ = F.col("largest").isNotNull(), F.sum("tokens").over(whole)
    target = F.col("target_share") / F.sum(F.when(has, F.col("target_share"))).over(whole)
    off = F.abs(F.col("tokens") - target * all_) <= 2 * F.max("largest").over(whole)
    return r.select("source", has.alias("has"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats"), (F.abs(F.col("share") - F.col("tokens") / all_) < 1e-9).alias("adds_up"), F.when(has, off).otherwise(F.col("share") == 0).alias("meets"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    documents = _read(spark, sf, "documents")
    return langid.unnamed_passages(documents, langid.train(documents))


def p8_segments(spark: SparkSession, sf: str) -> DataFrame:
    documents = _read(spark, sf, "documents")
    return langid.segments(documents, langid.train(documents)).dropDuplicates(["doc_id", "seg_no"])


def p8_documents(spark: SparkSession, sf: str) -> DataFrame:
    return langid.document_languages(p8_segments(spark, sf))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p3_found, p3_pieces, p3_rejoined, p5_found, p5_consistent, p6_found, p6_leaks, p7_mix, p7_shares, p7_holds, p8_found, p8_segments, p8_documents)}


ORACLE = {
    "p3_found": """
        SELECT DISTINCT item_kind, owner_id, item_idx FROM (
          SELECT 'paragraph' AS item_kind, doc_id AS owner_id, para_idx AS item_idx, length(text) AS n FROM paragraphs
          UNION ALL SELECT 'context', session_id, batch_num, length(content) FROM context_cache) JOIN size_limits USING (item_kind)
        WHERE n > max_chars""",
    "p3_rejoined": """
        SELECT DISTINCT item_kind, owner_id, item_idx, md5(text) AS digest, true AS within, true AS "full", true AS overlaps FROM (
          SELECT 'paragraph' AS item_kind, doc_id AS owner_id, para_idx AS item_idx, text FROM paragraphs
          UNION ALL SELECT 'context', session_id, batch_num, content FROM context_cache) JOIN size_limits USING (item_kind)
        WHERE length(text) > max_chars""",
    "p7_holds": """
        WITH t AS (SELECT regexp_replace(lower(trim(source)), '[ -]+', '_', 'g') AS source, sum(target_share) AS target_share FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 GROUP BY 1),
          d AS (SELECT DISTINCT regexp_replace(lower(trim(regexp_replace(source, '[\\s\\x{00A0}]+', ' ', 'g'))), '[ -]+', '_', 'g') AS source FROM documents WHERE length(text) > 0)
        SELECT t.source, d.source IS NOT NULL AS has, true AS repeats, true AS adds_up, true AS meets FROM t LEFT JOIN d ON t.source = d.source""",
}
