"""What query modules share: reading tables, keys once, registering queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import ONES, TENS

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def once(df: DataFrame, keys: list[str], columns: tuple[str, ...], loaded: str) -> DataFrame:
    """Each key once, as delivered last; of rows delivered together the greatest."""
    return df.groupBy(*keys).agg(F.max(F.struct(loaded, *columns)).alias("_r")).select(*keys, *[f"_r.{c}" for c in columns])


def paragraphs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Paragraphs once each, however often delivered."""
    return table(spark, sf, "paragraphs").transform(once, ["doc_id", "para_idx"], columns, "loaded_at")


def runs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "runs").transform(once, ["doc_id", "para_idx", "run_idx"], columns, "loaded_at")


def notes(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "notes").transform(once, ["doc_id", "kind", "note_id"], columns, "loaded_at")


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "documents").transform(once, ["doc_id"], columns, "loaded_at")


def batches(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "context_cache").transform(once, ["session_id", "batch_num"], ("content",), "saved_at")


PARAS = "(SELECT DISTINCT doc_id, para_idx, text, style, in_table, has_image, skip FROM paragraphs)"
RUNS = "(SELECT DISTINCT doc_id, para_idx, run_idx, text, bold, italic, superscript, kind FROM runs)"
NOTES = "(SELECT DISTINCT doc_id, kind, note_id, text FROM notes)"
DOCS = "(SELECT DISTINCT doc_id, text, lang, category FROM documents)"
BATCHES = "(SELECT DISTINCT session_id, batch_num, content FROM context_cache)"
#: Numbers of a lineitem as whole numbers; the same on both sides.
LINE = "(SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS INTEGER) AS q, CAST(round(l_discount * 100) AS INTEGER) AS d, l_partkey AS pk, CAST(l_extendedprice AS DECIMAL(12,2)) AS p FROM lineitem)"


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files have fewer splits than there are cores; larger tables are left alone. For rows that cost much more to work on than to move."""
    spark = df.sparkSession
    n, split = spark.sparkContext.defaultParallelism, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size / split < n // 2 else df


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_partkey", "l_extendedprice")).selectExpr("l_orderkey AS k", "l_linenumber AS n", "CAST(l_quantity AS INT) AS q", "CAST(round(l_discount * 100) AS INT) AS d", "l_partkey AS pk", "CAST(l_extendedprice AS DECIMAL(12,2)) AS p")


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sql_small(n: str) -> str:
    """A whole number below ten in words, else in digits, for DuckDB."""
    return f"(CASE WHEN {n} < 10 THEN {sql_list(ONES[:10])}[CAST({n} AS INTEGER) + 1] ELSE CAST({n} AS VARCHAR) END)"


def sql_below_100(n: str, join: str = "-") -> str:
    return f"(CASE WHEN {n} < 20 THEN {sql_list(ONES)}[CAST({n} AS INTEGER) + 1] ELSE {sql_list(TENS)}[CAST({n} // 10 AS INTEGER) + 1] || CASE WHEN {n} % 10 = 0 THEN '' ELSE '{join}' || {sql_list(ONES)}[CAST({n} % 10 AS INTEGER) + 1] END END)"


def sql_below_1000(n: str, join: str, after: str) -> str:
    return f"(CASE WHEN {n} < 100 THEN {sql_below_100(n, join)} ELSE {sql_list(ONES)}[CAST({n} // 100 AS INTEGER) + 1] || ' hundred' || CASE WHEN {n} % 100 = 0 THEN '' ELSE '{after}' || {sql_below_100(f'({n} % 100)', join)} END END)"
