"""Measuring retrieval: hits, strata, gates, votes, percentiles, streaks (AGG-11..15, AGG-25, JN-04, JN-05, WIN-10, WIN-11, SET-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.operators.blocks import running_count, with_block

SLACK = 1e-9


def hits(bank: DataFrame, results: DataFrame, lineage: DataFrame | None = None, display: int = 3, deep: int = 10) -> DataFrame:
    """JN-04, JN-05: ``bank`` (query_id, expected, ...) and ``results`` (query_id, id, rank): adds hit_display, hit_deep and
    hit_family - a displayed row, or its parent in ``lineage`` (child, parent), is the expected one."""
    r = results.select("query_id", "id", "rank")
    if lineage is not None:
        r = r.join(lineage.select(F.col("child").alias("id"), "parent"), "id", "left")
    else:
        r = r.withColumn("parent", F.lit(None).cast("string"))
    j = bank.join(r, "query_id", "left")
    same, kin = F.col("id") == F.col("expected"), F.col("parent") == F.col("expected")
    yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return j.groupBy(*bank.columns).agg(yes(same & (F.col("rank") <= display)).alias("hit_display"), yes(same & (F.col("rank") <= deep)).alias("hit_deep"), yes((same | kin) & (F.col("rank") <= display)).alias("hit_family"))


def rate(flag: Column, empty: float | None = None) -> Column:
    """Share of rows with the flag; ``empty`` for no rows."""
    return F.coalesce(F.avg(F.coalesce(flag, F.lit(False)).cast("double")), F.lit(empty).cast("double"))


def stratified(rows: DataFrame, by: str, flag: str) -> DataFrame:
    """AGG-11: passed, total and rate per stratum; null is the stratum 'null'."""
    return rows.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("null")).alias("stratum")).agg(F.count_if(flag).alias("passed"), F.count(F.lit(1)).alias("total"), rate(F.col(flag)).alias("rate"))


def bank_totals(rows: DataFrame, hit_floor: float = 0.7, pass_floor: float = 0.9) -> DataFrame:
    """AGG-13: rates of the whole bank (1 for an empty one) and whether both reach their floors."""
    t = rows.agg(F.count(F.lit(1)).alias("total"), rate(F.col("hit_display"), 1.0).alias("hit_rate"), rate(F.col("hit_family"), 1.0).alias("family_rate"), rate(F.col("hit_deep"), 1.0).alias("deep_rate"))
    return t.withColumn("ok", (F.col("hit_rate") + SLACK >= hit_floor) & (F.col("family_rate") + SLACK >= pass_floor))


def union_ranked(first: DataFrame, second: DataFrame) -> DataFrame:
    """SET-01: (query_id, id, rank) of both, each id once, first list before second, ranks anew."""
    both = first.select("query_id", "id", F.lit(0).alias("_s"), "rank").unionByName(second.select("query_id", "id", F.lit(1).alias("_s"), "rank"))
    once = both.groupBy("query_id", "id").agg(F.min(F.struct("_s", "rank")).alias("_o"))
    return once.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("_o", "id")).alias("rank"))


def vote_medians(votes: DataFrame, by: str, value: str, good: float) -> DataFrame:
    """AGG-15, CLS-06: median of the finite votes and whether it is good; a group without any has a null median and isn't."""
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    return votes.groupBy(by).agg(F.median(finite).alias("median"), F.count(finite).alias("votes")).withColumn("good", F.coalesce(F.col("median") + SLACK >= good, F.lit(False)))


def top_reasons(rows: DataFrame, reason: str, n: int = 8, size: int = 120) -> DataFrame:
    """AGG-12: the most frequent reasons, white space collapsed, cut to ``size``; a top-n report, ties by text."""
    r = F.trim(F.regexp_replace(F.coalesce(reason, F.lit("")), r"\s+", " "))
    cut = F.when(F.length(r) > size, F.concat(F.substring(r, 1, size - 3), F.lit("..."))).otherwise(r)
    return rows.select(cut.alias("reason")).filter("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("votes")).orderBy(F.desc("votes"), "reason").limit(n)


def summary(rows: DataFrame, value: str, by: str) -> DataFrame:
    """AGG-25: number, mean, nearest-rank percentiles, least and greatest."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    return rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.min(value).alias("low"), F.max(value).alias("high"))


def streaks(rows: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """WIN-10: runs of consecutive rows with the flag: key, first row number, length.

    ``order`` begins with a timestamp, or milliseconds; rows without it or the key are left out.  Rows are counted per block
    of time, so a key with a third of all rows is spread over its blocks.
    """
    at = F.unix_millis(F.col(order[0]).cast("timestamp")) if rows.schema[order[0]].dataType.typeName().startswith("timestamp") else F.col(order[0])
    e = with_block(rows.withColumn("_at", at).filter(F.col("_at").isNotNull() & F.col(key).isNotNull()), "_at")
    e = running_count(e, key, order, F.lit(True), "_i")
    e = running_count(e, key, order, F.coalesce(F.col(flag), F.lit(False)), "_c")
    return e.filter(flag).groupBy(key, (F.col("_i") - F.col("_c")).alias("_g")).agg(F.count(F.lit(1)).alias("length"), F.min("_i").alias("first_row")).select(key, "first_row", "length")


def append_unique(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-11: rows of ``new`` whose keys are new are appended, once each (the least row)."""
    once = new.groupBy(*keys).agg(F.min(F.struct(*new.columns)).alias("_r")).select("_r.*")
    return old.unionByName(once.join(old.select(*keys), keys, "left_anti").select(old.columns))


def accepted(before: DataFrame, after: DataFrame, by: str, flag: str) -> DataFrame:
    """AGG-14, CLS-04: per subset the rates before and after, and whether the later one is no worse."""
    a = before.groupBy(by).agg(rate(F.col(flag), 1.0).alias("rate_before"))
    b = after.groupBy(by).agg(rate(F.col(flag), 1.0).alias("rate_after"))
    return a.join(b, by, "full_outer").select(by, F.coalesce("rate_before", F.lit(1.0)).alias("rate_before"), F.coalesce("rate_after", F.lit(1.0)).alias("rate_after")).withColumn("no_worse", F.col("rate_after") + SLACK >= F.col("rate_before"))
