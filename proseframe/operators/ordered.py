"""Numbers and carried values over long ordered groups, without putting a group into one task.

A document may hold a large share of all rows. Its rows are cut into blocks by their order column;
windows run within blocks, and what crosses a block is carried by one small row per block. Groups of
one block, nearly all, need nothing carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _block(order: str, block: int) -> Column:
    return F.coalesce(F.floor(F.col(order) / block), F.lit(-1))


def with_number(df: DataFrame, keys: list[str], order: str, out: str, block: int = BLOCK) -> DataFrame:
    """Adds out: 1, 2, .. by order within keys. order is a whole number, unique within keys; nulls come first."""
    d = df.withColumn("__block", _block(order, block))
    counts = d.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__before", F.sum("__n").over(w)).where("__before IS NOT NULL").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__block").alias("__b"), "__before")
    inner = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(order))
    on = (F.col("__block") == F.col("__b")) & _same(keys)
    j = d.withColumn("__in", inner).join(before, on, "left")
    return j.select(*df.columns, (F.col("__in") + F.coalesce("__before", F.lit(0))).cast("int").alias(out))


def _same(keys: list[str]) -> Column:
    c = F.lit(True)
    for k in keys:
        c = c & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return c


def with_last_before(df: DataFrame, keys: list[str], order: str, event: Column, out: str, block: int = BLOCK) -> DataFrame:
    """Adds out: the last value of event that isn't null among the rows before, by order within keys."""
    d = df.withColumn("__block", _block(order, block)).withColumn("__e", event)
    # a block takes the value of the nearest earlier block that has one
    blocks = d.groupBy(*keys, "__block").agg(F.max_by("__e", F.when(F.col("__e").isNotNull(), F.col(order))).alias("__last"))
    w = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("__carry", F.last("__last", True).over(w)).where("__carry IS NOT NULL").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__block").alias("__b"), "__carry")
    inner = F.last("__e", True).over(Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    j = d.withColumn("__in", inner).join(carried, (F.col("__block") == F.col("__b")) & _same(keys), "left")
    return j.select(*df.columns, F.coalesce("__in", "__carry").alias(out))
