"""Ordered-row functions over keys too large for one task.

Rows of a key are cut into blocks of time.  A window then runs inside each (key, block); what crosses a border - the last
row of the block before, a running count - is computed from one row per block and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_MS = 6 * 3600 * 1000


def with_block(df: DataFrame, at: str, block_ms: int = BLOCK_MS) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(at) / F.lit(block_ms)).cast("bigint"))


def previous(df: DataFrame, key: str, order: list[str], carry: list[str], out: str = "_prev") -> DataFrame:
    """Adds the struct (order, carry) of the row before within the key, null for its first row.  Needs ``_block``, and
    ``order`` to begin with the column the block comes from."""
    df = df.repartition(key, "_block")  # one exchange for the window, the last rows and the join
    row = F.struct(*order, *carry)
    inner = F.lag(row).over(Window.partitionBy(key, "_block").orderBy(*order))
    last = df.groupBy(key, "_block").agg(F.max(row).alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(key).orderBy("_block"))).select(F.col(key).alias("_k"), F.col("_block").alias("_b"), "_before")
    joined = df.join(before, (F.col(key) == F.col("_k")) & (F.col("_block") == F.col("_b")), "left").drop("_k", "_b")
    return joined.withColumn(out, F.coalesce(inner, "_before")).drop("_before")


def running_count(df: DataFrame, key: str, order: list[str], flag: Column, out: str) -> DataFrame:
    """Adds how many rows up to this one, within the key, have the flag."""
    n = flag.cast("bigint")
    inner = F.sum(n).over(Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per = df.groupBy(key, "_block").agg(F.sum(n).alias("_n"))
    base = per.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")))
    base = base.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), "_base")
    return df.withColumn(out, inner).join(base, (F.col(key) == F.col("_k")) & (F.col("_block") == F.col("_b"))).withColumn(out, F.col(out) + F.col("_base")).drop("_k", "_b", "_base")
