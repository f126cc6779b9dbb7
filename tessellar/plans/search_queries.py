"""Queries of retrieval and ranking, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.config import SearchConfig
from tessellar.functions.numbers import cosine
from tessellar.functions.text import index_tokens
from tessellar.operators.fulltext import bm25, build_index, recipe_body, top
from tessellar.operators.ranking import collapse_channels, fuse
from tessellar.operators.vectors import knn
from tessellar.plans.hybrid import displayed, hybrid_search, load_catalog, open_catalog, save_catalog
from tessellar.plans.identity_sql import fingerprints_sql


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _q(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "queries").select(F.col("id").alias("query_id"), "query")


def _r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def text_index(spark: SparkSession, d: str) -> DataFrame:
    """Index statistics: documents, tokens and positions per term (TXT-03, SNK-04)."""
    postings, _ = build_index(_t(spark, d, "recipes"), "id", recipe_body())
    return postings.groupBy("term").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("occurrences"), F.sum("pos").alias("position_sum"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every query against every recipe, best 100 each (TXT-01, TXT-03..05, SRT-01)."""
    postings, sizes = build_index(_t(spark, d, "recipes"), "id", recipe_body())
    hits = bm25(_q(spark, d), postings, sizes)
    return _r6(top(hits.withColumn("bm25", F.round("bm25", 9)), ["query_id"], [F.asc("bm25"), F.asc("doc_id")], 100))


def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each recipe's primary verb as a query over all documents, separators instead of deletions."""
    docs = _t(spark, d, "documents")
    postings, sizes = build_index(docs, "doc_id", F.coalesce("text", F.lit("")))
    q = _t(spark, d, "recipes").select(F.col("taxonomy_leaf").alias("query_id")).filter("trim(query_id) <> ''").distinct().withColumn("query", F.concat(F.lit("git "), F.lower(F.trim("query_id"))))
    return _r6(top(bm25(q, postings, sizes, compat=False).withColumn("bm25", F.round("bm25", 9)), ["query_id"], [F.asc("bm25"), F.asc("doc_id")], 10))


def knn_topk_batched(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector as a query: the ten nearest others of all (VEC-03, SRT-02)."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    hits = knn(e.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), e, 11, dim=64).filter("query_id <> doc_id")
    return _r6(top(hits.drop("rank"), ["query_id"], [F.desc("cosine"), F.asc("doc_id")], 10))


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """VEC-01: each vector and the next one by id."""
    e = _t(spark, d, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def channels_fused(spark: SparkSession, d: str) -> DataFrame:
    """JN-02, RNK-01..03 over two channels of the telemetry: results ranked in responses, and text matches."""
    ev = _t(spark, d, "observe_events").filter("data.response.results is not null and data.query is not null")
    shown = ev.select(F.col("data.query").alias("query_id"), F.col("data.response.confidence").alias("c"), F.posexplode("data.response.results").alias("pos", "r")).select("query_id", F.col("r.command_id").alias("id"), (F.col("c") / (F.col("pos") + 1)).alias("cosine")).filter("id is not null and cosine is not null and not isnan(cosine)")
    gold = _t(spark, d, "golden_report").filter("command_id is not null and query_text is not null").select(F.col("query_text").alias("query_id"), F.col("command_id").alias("id"), (-F.size(index_tokens(F.col("query_text")))).cast("double").alias("bm25"))
    return _r6(fuse(collapse_channels(shown, gold), SearchConfig()))


def hybrid_ranked(spark: SparkSession, d: str) -> DataFrame:
    results, _ = hybrid_search(_q(spark, d), open_catalog(_t(spark, d, "recipes")))
    return _r6(results.select("query_id", "id", "rank", "score", "cosine", "bm25", "boost"))


def hybrid_gate(spark: SparkSession, d: str) -> DataFrame:
    return _r6(hybrid_search(_q(spark, d), open_catalog(_t(spark, d, "recipes")))[1])


def hybrid_displayed(spark: SparkSession, d: str) -> DataFrame:
    q = _q(spark, d)
    results, gates = hybrid_search(q, open_catalog(_t(spark, d, "recipes")))
    return _r6(displayed(results, gates, 2 * q.count() * SearchConfig().recall_k).select("query_id", "display_rank", "id", "score"))


def hybrid_from_tables(spark: SparkSession, d: str) -> DataFrame:
    """HLP-04, SNK-05: the catalog saved as tables, loaded with its checksums, and searched."""
    from tessellar.plans.storage_queries import scratch

    folder = scratch(spark)
    save_catalog(open_catalog(_t(spark, d, "recipes")), folder)
    results, _ = hybrid_search(_q(spark, d), load_catalog(spark, folder, strict=True))
    return _r6(results.select("query_id", "id", "rank", "score", "cosine", "bm25", "boost"))


QUERIES = {f.__name__: f for f in (text_index, bm25_topk, bm25_documents, knn_topk_batched, cosine_pairs, channels_fused, hybrid_ranked, hybrid_gate, hybrid_displayed, hybrid_from_tables)}

_TOK = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"
_BODY = """array_to_string(list_filter(list_concat([title, description], coalesce(tags, []), coalesce(paraphrases, []),
     flatten(list_transform(coalesce(commands, []), lambda s: [s.command, s.comment]))), lambda x: x IS NOT NULL AND trim(x) <> ''), chr(10))"""


def _bm25_sql(docs: str, queries: str, delete: str) -> str:
    """CTEs up to ``bm(query_id, doc_id, bm25)``; docs(doc_id, body), queries(query_id, query)."""
    return f"""docs AS ({docs}), qs AS ({queries}),
  tok AS (SELECT doc_id, {_TOK.format("body")} AS t FROM docs),
  tot AS (SELECT count(*) AS nd, avg(len(t)) AS avgdl FROM tok),
  post AS (SELECT doc_id, t[i] AS term, i AS pos, len(t) AS dl FROM tok, unnest(range(1, len(t) + 1)) AS u(i)),
  terms AS (SELECT query_id, list_filter(string_split_regex(regexp_replace(query, '["*^\\-():{{}}\\[\\]~]', '{delete}', 'g'), '\\s+'), lambda x: x <> '') AS ts FROM qs),
  ph AS (SELECT query_id, k, {_TOK.format("ts[k]")} AS p, len(ts) AS n_phrases FROM terms, unnest(range(1, len(ts) + 1)) AS u(k)),
  okq AS (SELECT query_id FROM ph GROUP BY query_id HAVING min(len(p)) > 0),
  dp AS (SELECT DISTINCT p FROM ph WHERE query_id IN (SELECT query_id FROM okq)),
  pt AS (SELECT p, o, p[o] AS term FROM dp, unnest(range(1, len(p) + 1)) AS u(o)),
  st AS (SELECT p, doc_id, any_value(dl) AS dl, pos - o AS s FROM pt JOIN post USING (term) GROUP BY p, doc_id, pos - o HAVING count(*) = len(p)),
  pf AS (SELECT p, doc_id, any_value(dl) AS dl, count(*) AS f FROM st GROUP BY p, doc_id),
  dfr AS (SELECT p, count(*) AS n FROM pf GROUP BY p),
  sc AS (SELECT p, doc_id, (CASE WHEN ln((nd - n + 0.5) / (n + 0.5)) > 0 THEN ln((nd - n + 0.5) / (n + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS part FROM pf JOIN dfr USING (p), tot),
  bm AS (SELECT query_id, doc_id, -sum(part) AS bm25 FROM ph JOIN okq USING (query_id) JOIN sc USING (p) GROUP BY query_id, doc_id, n_phrases HAVING count(*) = n_phrases)"""


_Q = "SELECT id AS query_id, query FROM queries WHERE query IS NOT NULL"
_R = f"SELECT id AS doc_id, {_BODY} AS body FROM recipes"
_EMB = """emb_src AS ({0}),
  et AS (SELECT key, CASE WHEN len(w) = 0 THEN ['empty'] ELSE w END AS w FROM (SELECT key, list_filter(string_split_regex(regexp_replace(lower(txt), '[^\\p{{L}}\\p{{N}}\\s-]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS w FROM emb_src)),
  ew AS (SELECT key, sha256(w[i]) AS h, len(w) AS n FROM et, unnest(range(1, len(w) + 1)) AS u(i)),
  ev AS (SELECT key, j, sum((('0x' || substr(h, 2 * j + 1, 2))::INT / 255.0) * 2 - 1) / any_value(n) AS v FROM ew, unnest(range(0, 32)) AS u(j) GROUP BY key, j),
  en AS (SELECT key, list(v ORDER BY j) AS v FROM ev GROUP BY key)"""
_CORE = f"""WITH {_bm25_sql(_R, "SELECT id AS query_id, trim(regexp_replace(query, '[\\s\\p{Z}]+', ' ', 'g')) AS query FROM queries WHERE query IS NOT NULL", "")},
  {_EMB.format('''SELECT 'q' || query_id AS key, query AS txt FROM qs WHERE query <> ''
     UNION ALL SELECT 'r' || id, array_to_string(list_filter(list_concat([description], coalesce(paraphrases, [])), lambda x: x IS NOT NULL AND trim(x) <> ''), chr(10)) FROM recipes''')},
  kn AS (SELECT substr(a.key, 2) AS query_id, substr(b.key, 2) AS id, round(list_cosine_similarity(a.v, b.v), 12) AS cosine FROM en a, en b WHERE a.key[1] = 'q' AND b.key[1] = 'r'),
  kt AS (SELECT * FROM kn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) <= 100),
  bt AS (SELECT query_id, doc_id AS id, bm25 FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25, doc_id) <= 100),
  co AS (SELECT query_id, id, cosine, bm25 FROM kt FULL JOIN bt USING (query_id, id)),
  mm AS (SELECT *, min(cosine) OVER w AS c0, max(cosine) OVER w AS c1, min(bm25) OVER w AS b0, max(bm25) OVER w AS b1 FROM co WINDOW w AS (PARTITION BY query_id)),
  nz AS (SELECT *, CASE WHEN cosine IS NULL THEN 0 WHEN c1 = c0 THEN 1 ELSE (cosine - c0) / (c1 - c0) END AS nc,
            CASE WHEN bm25 IS NULL THEN 0 WHEN b1 = b0 THEN 1 ELSE (b1 - bm25) / (b1 - b0) END AS nb FROM mm),
  fu AS (SELECT *, CASE WHEN c1 IS NOT NULL AND b1 IS NOT NULL THEN 0.55 * nc + 0.45 * nb WHEN c1 IS NOT NULL THEN nc ELSE nb END AS base FROM nz),
  rs AS (SELECT id, list_transform(coalesce(commands, []), lambda s: s.command) AS lines, greatest(len(coalesce(commands, [])), 1) AS step_count,
            '{{"commands":[' || array_to_string(list_transform(coalesce(commands, []), lambda s: '{{"command":' || to_json(s.command) || CASE WHEN s.comment IS NULL THEN '' ELSE ',"comment":' || to_json(s.comment) END || '}}'), ',') || ']}}' AS js FROM recipes),
  rv AS (SELECT id, lines, step_count, js, list_transform(lines, lambda x: CASE WHEN regexp_matches(x, '^\\s*git\\s+\\S') THEN lower(regexp_extract(x, '^\\s*git\\s+(\\S+)', 1)) ELSE '' END) AS vs FROM rs),
  rw AS (SELECT id, step_count, js, coalesce(vs[1], '') AS pv, list_distinct(list_filter(vs, lambda x: x <> '')) AS vs FROM rv),
  kv AS (SELECT list(DISTINCT v) AS known FROM (SELECT unnest(vs) AS v FROM rw)),
  qt AS (SELECT query_id, list_filter(string_split_regex(lower(query), '[^a-z0-9_+\\-]+'), lambda x: x <> '') AS toks, regexp_extract_all(lower(query), '\\bgit\\s+([a-z0-9][-a-z0-9]*)', 1) AS phr FROM qs),
  qn AS (SELECT query_id, toks, list_distinct(list_concat(phr, list_filter(known, lambda v: list_contains(toks, v) OR (contains(v, '-') AND list_contains(toks, replace(v, '-', '')))))) AS named FROM qt, kv),
  bo AS (SELECT fu.*, rw.js, rw.step_count, CASE WHEN cosine IS NULL THEN 0 ELSE
            (CASE WHEN pv <> '' AND (list_contains(named, pv) OR list_contains(toks, pv)) THEN 0.25 ELSE 0 END)
            + (CASE WHEN len(named) >= 2 AND len(vs) >= 2 THEN greatest(0, len(list_intersect(named, vs)) - 1) * 0.12 ELSE 0 END) END AS boost
         FROM fu JOIN rw USING (id) JOIN qn USING (query_id)),
  so AS (SELECT query_id, id, cosine, bm25, boost, round(CASE WHEN boost > 0 THEN least(1, base + boost) ELSE base END, 12) AS score,
            CASE WHEN cosine IS NULL THEN '{{"commands":[]}}' ELSE js END AS js, CASE WHEN cosine IS NULL THEN 1 ELSE step_count END AS step_count FROM bo),
  ra AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, step_count, js, id) AS rank, score, cosine, bm25, boost FROM so)"""

_GATE = f""", {fingerprints_sql()}, rf AS (SELECT ra.*, fingerprint FROM ra JOIN fp USING (id)),
  hd AS (SELECT query_id, fingerprint AS hf, score AS s1, cosine AS c1, bm25 AS b1, boost AS o1 FROM rf WHERE rank = 1),
  gg AS (SELECT query_id, s1, c1, b1, o1, arg_min(score, rank) FILTER (fingerprint <> hf) AS s2, count(DISTINCT fingerprint) AS n FROM rf JOIN hd USING (query_id) GROUP BY ALL),
  gc AS (SELECT *, CASE WHEN s2 IS NULL THEN greatest(0, least(1, s1)) ELSE least(1, s1 * (1 + greatest(0, s1 - s2))) END AS cf, CASE WHEN s2 IS NULL THEN 0 ELSE greatest(0, s1 - s2) END AS gap, coalesce(c1, 0) < 0.6 AND b1 IS NULL AND o1 <= 0 AS weak FROM gg),
  gs AS (SELECT *, least(CASE WHEN weak THEN 0 WHEN cf > 0.9 AND gap >= 0.2 THEN 1 WHEN cf > 0.75 AND gap >= 0.08 THEN 2 ELSE 3 END, 3, n) AS shown, CASE WHEN weak THEN 'red' WHEN cf > 0.9 AND gap >= 0.2 THEN 'none' WHEN cf > 0.75 AND gap >= 0.08 THEN 'yellow' ELSE 'orange' END AS alert FROM gc)"""

ORACLES = {
    "text_index": f"WITH d AS ({_R}), t AS (SELECT doc_id, {_TOK.format('body')} AS t FROM d), p AS (SELECT doc_id, t[i] AS term, i - 1 AS pos FROM t, unnest(range(1, len(t) + 1)) AS u(i)) SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences, sum(pos)::BIGINT AS position_sum FROM p GROUP BY term",
    "bm25_topk": f"WITH {_bm25_sql(_R, _Q, '')} SELECT query_id, doc_id, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), doc_id) AS rank FROM bm QUALIFY rank <= 100",
    "bm25_documents": f"WITH {_bm25_sql('SELECT doc_id, coalesce(text, chr(32)) AS body FROM documents', 'SELECT DISTINCT taxonomy_leaf AS query_id, chr(103) || chr(105) || chr(116) || chr(32) || lower(trim(taxonomy_leaf)) AS query FROM recipes WHERE trim(taxonomy_leaf) <> chr(32) AND length(trim(taxonomy_leaf)) > 0', ' ')} SELECT query_id, doc_id, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), doc_id) AS rank FROM bm QUALIFY rank <= 10",
    "knn_topk_batched": "SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY rank <= 10",
    "cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "channels_fused": f"""WITH s AS (SELECT data.query AS query_id, data.response.confidence AS c, data.response.results AS r FROM observe_events WHERE data.response.results IS NOT NULL AND data.query IS NOT NULL),
  v AS (SELECT query_id, r[i].command_id AS id, max(c / i) AS cosine FROM s, unnest(range(1, len(r) + 1)) AS u(i) WHERE r[i].command_id IS NOT NULL AND c IS NOT NULL AND NOT isnan(c) GROUP BY 1, 2),
  t AS (SELECT query_text AS query_id, command_id AS id, min(-len({_TOK.format("query_text")}))::DOUBLE AS bm25 FROM golden_report WHERE command_id IS NOT NULL AND query_text IS NOT NULL GROUP BY 1, 2),
  m AS (SELECT query_id, id, cosine, bm25, min(cosine) OVER w AS c0, max(cosine) OVER w AS c1, min(bm25) OVER w AS b0, max(bm25) OVER w AS b1 FROM v FULL JOIN t USING (query_id, id) WINDOW w AS (PARTITION BY query_id)),
  n AS (SELECT *, CASE WHEN cosine IS NULL THEN NULL WHEN c1 = c0 THEN 1.0 ELSE (cosine - c0) / (c1 - c0) END AS sc, CASE WHEN bm25 IS NULL THEN NULL WHEN b1 = b0 THEN 1.0 ELSE (b1 - bm25) / (b1 - b0) END AS sb FROM m)
SELECT query_id, id, round(cosine, 6) AS cosine, round(bm25, 6) AS bm25, round(sc, 6) AS score_cosine, round(sb, 6) AS score_bm25,
  round(CASE WHEN c1 IS NOT NULL AND b1 IS NOT NULL THEN 0.55 * coalesce(sc, 0) + 0.45 * coalesce(sb, 0) WHEN c1 IS NOT NULL THEN coalesce(sc, 0) ELSE coalesce(sb, 0) END, 6) AS score FROM n""",
    "hybrid_ranked": _CORE + " SELECT query_id, id, rank, round(score, 6) AS score, round(cosine, 6) AS cosine, round(bm25, 6) AS bm25, round(boost::DOUBLE, 6) AS boost FROM ra",
    "hybrid_gate": _CORE + _GATE + " SELECT query_id, round(cf, 6) AS confidence, coalesce(shown, 0) AS display_count, coalesce(alert, 'red') AS alert, CASE WHEN coalesce(shown, 0) = 0 THEN 'empty' ELSE 'ok' END AS status FROM (SELECT id AS query_id FROM queries) LEFT JOIN gs USING (query_id)",
    "hybrid_displayed": _CORE + _GATE + """, dv AS (SELECT query_id, id, score, rank FROM rf QUALIFY row_number() OVER (PARTITION BY query_id, fingerprint ORDER BY rank) = 1),
  dr AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS display_rank FROM dv) SELECT query_id, display_rank, id, round(score, 6) AS score FROM dr JOIN gs USING (query_id) WHERE display_rank <= shown""",
}
ORACLES["hybrid_from_tables"] = ORACLES["hybrid_ranked"]
