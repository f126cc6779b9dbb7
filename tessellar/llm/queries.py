"""Registered queries of the llm operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.format_dups import collapse, sequence_key, set_of_sequences_key
from tessellar.llm.leakage import leaks
from tessellar.llm.mojibake import garbled
from tessellar.llm.near_dup import record_groups, record_pairs, similar_sets
from tessellar.llm.neighbors import nearest
from tessellar.llm.packing import invariants, pack, summary
from tessellar.llm.split_overlap import near_matches
from tessellar.llm.words import all_text, words


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _recipe_words(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "recipes").select("id", words(all_text(F.col("title"), F.col("description"), F.col("paraphrases"))).alias("words"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return record_pairs(similar_sets(_recipe_words(spark, d), "id", "words", 0.70))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return record_groups(similar_sets(_recipe_words(spark, d), "id", "words", 0.70))


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    g = _t(spark, d, "golden_report").select(F.struct(F.lit("golden_report").alias("origin"), F.col("report_id").alias("eval_id"), F.col("kind").alias("split"), "source").alias("eval_key"), words(F.col("query_text")).alias("words"))
    q = _t(spark, d, "queries").select(F.struct(F.lit("queries").alias("origin"), F.col("id").alias("eval_id"), F.lit("queries").alias("split"), "source").alias("eval_key"), words(F.col("query")).alias("words"))
    r = _t(spark, d, "recipes").select(F.col("id").alias("train_key"), F.explode("paraphrases").alias("p")).select("train_key", words(F.col("p")).alias("words"))
    return near_matches(g.unionByName(q), r, 0.70)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select("eval_key.origin", "eval_key.eval_id", F.col("train_key").alias("recipe_id")).distinct()


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping evaluation records per origin, split and source, and the recipes they meet."""
    o = _overlaps(spark, d).select("eval_key.*", "train_key").distinct()
    return o.groupBy("origin", "split", "source").agg(F.countDistinct("eval_id").alias("records"), F.countDistinct("train_key").alias("recipes"), F.count(F.lit(1)).alias("links"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs in which one vector is among the five nearest of the other, of both vector tables."""
    pairs = None
    for name in ("recipe_embeddings", "intent_embeddings"):
        n = nearest(_t(spark, d, name), "id", "embedding", k=5)
        p = n.select(F.least("id", "neighbor").alias("id_a"), F.greatest("id", "neighbor").alias("id_b")).distinct()
        pairs = p if pairs is None else pairs.unionByName(p)
    return pairs


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    g = collapse(_t(spark, d, "golden_report"), "report_id", sequence_key(F.col("query_text"))).withColumn("origin", F.lit("golden_report"))
    r = collapse(_t(spark, d, "recipes"), "id", set_of_sequences_key(F.col("paraphrases"))).withColumn("origin", F.lit("recipes"))
    return r.unionByName(g).filter("copies > 1").select("origin", "first_id", "copies")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """What each container of 2,048 tokens holds."""
    return pack(_t(spark, d, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return summary(pack(_t(spark, d, "documents"), "doc_id", "text"))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    return invariants(pack(_t(spark, d, "documents"), "doc_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(_t(spark, d, "documents"), "doc_id", "text", _t(spark, d, "eval_items"), "item_id", "text", words=12).select("doc_id", "item_id")


def p8_edited(spark: SparkSession, d: str) -> DataFrame:
    """Documents holding a passage of 12 words of an item with at most three character edits."""
    return leaks(_t(spark, d, "documents"), "doc_id", "text", _t(spark, d, "eval_items"), "item_id", "text", words=12, edits=3).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled(_t(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled(_t(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_counts": p3_counts, "p5_found": p5_found, "p6_found": p6_found, "p7_packed": p7_packed, "p7_containers": p7_containers, "p7_invariants": p7_invariants, "p8_found": p8_found, "p8_edited": p8_edited, "p9_found": p9_found, "p9_restored": p9_restored}

_W = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'))"
_LIKE = "(len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1}))))"
_PAIRS = f"""WITH r AS (SELECT id, {_W.format("concat_ws(' ', title, description, array_to_string(paraphrases, ' '))")} AS w FROM recipes)
SELECT a.id AS id_a, b.id AS id_b FROM r a JOIN r b ON a.id < b.id AND len(a.w) >= 0.69 * len(b.w) AND len(b.w) >= 0.69 * len(a.w) AND len(a.w) > 0
WHERE {_LIKE.format("a.w", "b.w")} >= 0.7"""
_OVER = f"""WITH e AS (SELECT 'golden_report' AS origin, report_id AS eval_id, kind AS split, source, {_W.format("query_text")} AS w FROM golden_report
           UNION ALL SELECT 'queries', id, 'queries', source, {_W.format("query")} FROM queries),
     t AS (SELECT id AS recipe_id, {_W.format("p")} AS w FROM (SELECT id, unnest(paraphrases) AS p FROM recipes)),
     m AS (SELECT DISTINCT origin, eval_id, split, source, recipe_id FROM e JOIN t ON len(e.w) > 0 AND len(t.w) > 0 AND len(e.w) >= 0.69 * len(t.w) AND len(t.w) >= 0.69 * len(e.w)
           AND {_LIKE.format("e.w", "t.w")} >= 0.7)"""

ORACLES = {
    # every document with text once and whole, no rule broken
    "p7_invariants": "SELECT 0 AS over_tokens, 0 AS over_documents, 0 AS over_cost, count(*) AS documents, 0 AS split_needlessly, 0 AS gaps FROM documents WHERE text <> ''",
    "p2_found": _PAIRS,
    "p2_groups": f"""WITH RECURSIVE r AS (SELECT id, {_W.format("concat_ws(' ', title, description, array_to_string(paraphrases, ' '))")} AS w FROM recipes),
  k AS (SELECT id, list_sort(w) AS w, min(id) OVER (PARTITION BY list_sort(w)) AS class_id FROM r WHERE len(w) > 0),
  c AS (SELECT class_id, any_value(w) AS w FROM k GROUP BY 1),
  l AS (SELECT a.class_id AS x, b.class_id AS y FROM c a JOIN c b ON a.class_id <> b.class_id AND len(a.w) >= 0.69 * len(b.w) AND len(b.w) >= 0.69 * len(a.w)
        WHERE {_LIKE.format("a.w", "b.w")} >= 0.7),
  reach AS (SELECT class_id AS v, class_id AS u FROM c UNION SELECT reach.v, l.y FROM reach JOIN l ON reach.u = l.x),
  g AS (SELECT v, min(u) AS group_id FROM reach GROUP BY v)
SELECT k.id, k.class_id, g.group_id, (SELECT count(*) FROM l WHERE l.x = k.class_id) AS links FROM k JOIN g ON g.v = k.class_id""",
    "p3_found": _OVER + " SELECT DISTINCT origin, eval_id, recipe_id FROM m",
    "p3_counts": _OVER + " SELECT origin, split, source, count(DISTINCT eval_id) AS records, count(DISTINCT recipe_id) AS recipes, count(*) AS links FROM m GROUP BY ALL",
    # a window of L characters with at most three edits keeps one of its four quarters: its first eight characters are looked up, then the place is compared
    "p8_edited": r"""WITH t AS (SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS s FROM eval_items),
  i AS (SELECT item_id, string_split(s, ' ') AS w FROM t WHERE s <> ''),
  win AS (SELECT item_id, k, ' ' || array_to_string(w[k:k + 11], ' ') || ' ' AS s FROM i, unnest(range(1, len(w) - 10)) AS u(k)),
  piece AS (SELECT item_id, k, s, length(s) AS n, q * (length(s) // 4) AS off, substr(s, q * (length(s) // 4) + 1, 8) AS g FROM win, unnest(range(0, 4)) AS v(q)),
  d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS s FROM documents WHERE text IS NOT NULL),
  gram AS (SELECT doc_id, p, substr(s, p, 8) AS g FROM d, unnest(range(1, length(s) - 6)) AS u(p)),
  place AS (SELECT DISTINCT doc_id, item_id, k, n, p - off AS pos FROM gram JOIN piece USING (g)),
  hit AS (SELECT DISTINCT doc_id, item_id, k, p.pos, p.n, w.s AS want, d.s AS txt FROM place p JOIN win w USING (item_id, k) JOIN d USING (doc_id)),
  done AS (SELECT DISTINCT doc_id, item_id FROM hit, unnest(range(-3, 4)) AS a(x), unnest(range(-3, 4)) AS b(y)
           WHERE pos + x >= 1 AND n + y > 0 AND abs(x) + abs(y) <= 6 AND levenshtein(substr(txt, pos + x, n + y), want) <= 3)
SELECT doc_id, item_id FROM done""",
    "p8_found": r"""WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
  d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
  si AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS s FROM i, unnest(range(1, len(w) - 10)) AS u(k)),
  sd AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS s FROM d, unnest(range(1, len(w) - 10)) AS u(k))
SELECT DISTINCT doc_id, item_id FROM sd JOIN si USING (s)""",
    "p6_found": r"""WITH g AS (SELECT 'golden_report' AS origin, report_id AS id, array_to_string(regexp_extract_all(lower(query_text), '[\p{L}\p{N}]+'), ' ') AS k FROM golden_report),
  s AS (SELECT id, unnest(paraphrases) AS p FROM recipes),
  f AS (SELECT DISTINCT id, array_to_string(regexp_extract_all(lower(p), '[\p{L}\p{N}]+'), ' ') AS k FROM s),
  r AS (SELECT 'recipes' AS origin, id, string_agg(k, chr(10) ORDER BY k) AS k FROM f WHERE k <> '' GROUP BY id)
SELECT origin, min(id) AS first_id, count(*) AS copies FROM (SELECT * FROM g UNION ALL SELECT * FROM r) WHERE k <> '' GROUP BY origin, k HAVING count(*) > 1""",
}
