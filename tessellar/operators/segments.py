"""Gap segmentation of one-dimensional positions, without ever holding a whole key in one task.

Positions (timestamps, sequence numbers) of a key are cut into runs whose neighbours lie at most ``gap`` apart.
A plain ``lag`` window sends all rows of a key to one task.  Here the rows are first reduced, with map-side
combine, to *cells* of ``gap + 1`` positions: two positions of one cell are never more than ``gap`` apart, so a
cell belongs to one run as a whole.  A ``lag`` window then runs over the cells of a (key, block), and a second
one over the first and last run of each block only.  The largest task therefore depends on the span of the
positions divided by ``gap`` and by the block, never on the number of rows of the hottest key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _flag_and_number(df: DataFrame, by: list[str], start: str, end: str, gap: int, out: str) -> DataFrame:
    """lag over the previous end flags a gap; the running sum of the flags numbers the runs."""
    w = Window.partitionBy(*by).orderBy(start)
    before = F.lag(end).over(w)
    return df.withColumn("_new", F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0)).withColumn(
        out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )


def gap_segments(df: DataFrame, keys: list[str], pos: str, gap: int, cells_per_block: int = 4096, count: Column | None = None) -> DataFrame:
    """Runs of ``pos`` per key: columns ``keys``, ``seg_start``, ``seg_end``, ``seg_count``.

    A new run begins where a position is more than ``gap`` above the one before it.  Ties are one position with
    several rows; rows with a null key or position are the caller's to drop; an empty input gives no rows.
    ``count`` weights a row (default 1).
    """
    cell = F.floor(F.col(pos) / F.lit(gap + 1)).cast("bigint")
    n = F.count(F.lit(1)) if count is None else F.sum(count)
    cells = (
        df.select(*keys, F.col(pos).cast("bigint").alias("_pos"), *([count.alias("_n")] if count is not None else []), cell.alias("_cell"))
        .withColumn("_block", F.floor(F.col("_cell") / F.lit(cells_per_block)).cast("bigint"))
        .groupBy(*keys, "_block", "_cell")
        .agg(F.min("_pos").alias("_lo"), F.max("_pos").alias("_hi"), (n if count is None else F.sum("_n")).cast("bigint").alias("_rows"))
    )
    runs = (
        _flag_and_number(cells, [*keys, "_block"], "_lo", "_hi", gap, "_run")
        .groupBy(*keys, "_block", "_run")
        .agg(F.min("_lo").alias("seg_start"), F.max("_hi").alias("seg_end"), F.sum("_rows").alias("seg_count"))
    )
    in_block = Window.partitionBy(*keys, "_block")
    edge = (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(in_block))
    runs = runs.withColumn("_edge", edge)
    out = [*keys, "seg_start", "seg_end", "seg_count"]
    inner = runs.filter(~F.col("_edge")).select(*out)
    stitched = (
        _flag_and_number(runs.filter("_edge"), keys, "seg_start", "seg_end", gap, "_seg")
        .groupBy(*keys, "_seg")
        .agg(F.min("seg_start").alias("seg_start"), F.max("seg_end").alias("seg_end"), F.sum("seg_count").alias("seg_count"))
        .select(*out)
    )
    return inner.unionByName(stitched)
