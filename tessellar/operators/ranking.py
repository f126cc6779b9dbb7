"""Fusing channels, boosting, diversity and the confidence gate (JN-02, RNK-*, WIN-08/09, SRT-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.config import SearchConfig
from tessellar.functions.numbers import confidence, min_max
from tessellar.functions.text import query_tokens


def collapse_channels(vector_hits: DataFrame, text_hits: DataFrame) -> DataFrame:
    """JN-02: full outer join on (query_id, id); the best cosine and the lowest bm25 of an id; absent channels are null."""
    v = vector_hits.groupBy("query_id", "id").agg(F.max("cosine").alias("cosine"))
    t = text_hits.groupBy("query_id", "id").agg(F.min("bm25").alias("bm25"))
    return v.join(t, ["query_id", "id"], "full_outer")


def fuse(hits: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """RNK-01..03: each channel to 0..1 over its query's batch, then weighted; a query with one channel only uses it alone."""
    w = Window.partitionBy("query_id")
    has_v, has_t = F.count("cosine").over(w) > 0, F.count("bm25").over(w) > 0
    nv = min_max(F.col("cosine"), F.min("cosine").over(w), F.max("cosine").over(w))
    nt = min_max(-F.col("bm25"), -F.max("bm25").over(w), -F.min("bm25").over(w))
    a = F.when(has_v & has_t, F.lit(cfg.alpha)).when(has_v, F.lit(1.0)).otherwise(F.lit(0.0))
    b = F.when(has_v & has_t, F.lit(cfg.beta)).when(has_t, F.lit(1.0)).otherwise(F.lit(0.0))
    return hits.withColumns({"score_cosine": nv, "score_bm25": nt}).withColumn("score", a * F.coalesce("score_cosine", F.lit(0.0)) + b * F.coalesce("score_bm25", F.lit(0.0)))


def named_verbs(words: DataFrame, known: DataFrame) -> DataFrame:
    """RNK-04: adds ``named`` to ``words`` (query_id, query, tokens): verbs a query names, as ``git x`` or as a verb of ``known``
    (v) among its tokens (also without its dashes).  A join, so the verbs may be any number."""
    empty = F.array().cast("array<string>")
    phrases = F.regexp_extract_all(F.lower(F.coalesce("query", F.lit(""))), F.lit(r"\bgit\s+([a-z0-9][-a-z0-9]*)"), F.lit(1))
    spelled = known.select("v", F.explode(F.array_distinct(F.array("v", F.replace("v", F.lit("-"), F.lit(""))))).alias("_token"))
    listed = words.select("query_id", "query", F.explode("tokens").alias("_token")).join(spelled, "_token").groupBy("query_id", "query").agg(F.collect_set("v").alias("_listed"))
    met = words.join(listed, ["query_id", "query"], "left")
    return met.withColumn("named", F.array_distinct(F.concat(phrases, F.coalesce("_listed", empty)))).drop("_listed")


def verb_boost(named: Column, tokens: Column, primary: Column, verbs: Column, cfg: SearchConfig = SearchConfig()) -> Column:
    """RNK-05, without the cap."""
    first = F.when((primary != "") & (F.array_contains(named, primary) | F.array_contains(tokens, primary)), F.lit(cfg.verb_boost)).otherwise(F.lit(0.0))
    covered = F.size(F.array_intersect(named, verbs))
    more = F.when((F.size(named) >= 2) & (F.size(verbs) >= 2), F.greatest(F.lit(0), covered - 1) * F.lit(cfg.coverage_boost)).otherwise(F.lit(0.0))
    return first + more


def ranked(hits: DataFrame, out: str = "rank") -> DataFrame:
    """SRT-03: score down, fewer steps, the steps' JSON, the id (binary order)."""
    return hits.withColumn(out, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "step_count", "steps_json", "id")))


def diversify(hits: DataFrame, key: str = "fingerprint", count: int | None = None) -> DataFrame:
    """WIN-08: the first row per key in rank order, up to ``count``; rows with an empty key all stay."""
    own = F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank"))
    kept = hits.withColumn("_own", F.when(F.coalesce(F.col(key), F.lit("")) == "", 1).otherwise(own)).filter("_own = 1").drop("_own")
    kept = kept.withColumn("display_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return kept if count is None else kept.filter(F.col("display_rank") <= count)


def head_scores(hits: DataFrame, key: str = "fingerprint") -> DataFrame:
    """WIN-09: per query the head row, the next score under another key (null if none) and the number of keys."""
    head = hits.filter("rank = 1").select("query_id", F.col(key).alias("_head"), F.col("score").alias("s1"), F.col("cosine").alias("c1"), F.col("bm25").alias("b1"), F.col("boost").alias("boost1"))
    other = F.when(F.col(key) != F.col("_head"), F.struct("rank", "score"))
    return hits.join(head, "query_id").groupBy("query_id").agg(
        *[F.first(c).alias(c) for c in ("s1", "c1", "b1", "boost1")], F.min(other).getField("score").alias("s2"), F.countDistinct(key).alias("n")
    )


def gate(heads: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """RNK-06..08: how many rows are shown and under which alert."""
    c = confidence(F.col("s1"), F.col("s2"))
    gap = F.when(F.col("s2").isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("s1") - F.col("s2")))
    weak = (F.coalesce("c1", F.lit(0.0)) < cfg.cosine_floor) & F.col("b1").isNull() & (F.col("boost1") <= 0)
    none = (F.col("n") == 0) | weak
    exact, narrow = (F.col("confidence") > cfg.very_high) & (F.col("gap") >= cfg.gap_exact), (F.col("confidence") > cfg.high) & (F.col("gap") >= cfg.gap_narrow)
    shown = F.when(none, 0).when(exact, 1).when(narrow, 2).otherwise(3)
    return (
        heads.withColumns({"confidence": c, "gap": gap})
        .withColumn("display_count", F.least(shown, F.lit(cfg.top_k), F.lit(3), F.col("n").cast("int")))
        .withColumn("alert", F.when(none, "red").when(exact, "none").when(narrow, "yellow").otherwise("orange"))
        .withColumn("status", F.when(F.col("display_count") == 0, "empty").otherwise("ok"))
    )
