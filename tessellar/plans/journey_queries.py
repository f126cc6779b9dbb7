"""Queries of the telemetry pipeline, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions.numbers import fnv1a, sha_unit
from tessellar.operators.journeys import after_cursor, feeder_items, filter_events, holdout_split, journeys, judged, normalised, outcome, threads, version_votes, without_bursts
from tessellar.operators.sessions import observed_sessions
from tessellar.plans.general import _FIRST_SQL
from tessellar.session import cut_lineage


def _ev(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/observe_events.parquet")


def events_normalised(spark: SparkSession, d: str) -> DataFrame:
    return normalised(_ev(spark, d)).select("id", "name", "at_ms", "thread_key", "query", "catalog_version", "display_count")


def event_filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    """FLT-01..03, AGG-02."""
    return judged(normalised(_ev(spark, d))).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("events"))


def event_version_votes(spark: SparkSession, d: str) -> DataFrame:
    """FLT-04, AGG-03."""
    return version_votes(judged(normalised(_ev(spark, d))).filter("reason is null"))


def burst_dedup(spark: SparkSession, d: str) -> DataFrame:
    """WIN-02."""
    return without_bursts(cut_lineage(judged(normalised(_ev(spark, d))).filter("reason is null"))).filter("burst").select("id", "thread_key", "at_ms")


def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    """All drops of a batch, with the chosen version."""
    _, all_, version = filter_events(_ev(spark, d))
    return all_.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("events")).withColumn("catalog_version", F.lit(version))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return filter_events(_ev(spark, d))[0]


def session_threads(spark: SparkSession, d: str) -> DataFrame:
    """WIN-01 with the soft rule."""
    return threads(_kept(spark, d)).groupBy("thread_key", "segment").agg(F.min("at_ms").alias("start_ms"), F.max("at_ms").alias("end_ms"), F.count(F.lit(1)).alias("events"))


def outcome_labels(spark: SparkSession, d: str) -> DataFrame:
    """MTH-06."""
    return normalised(_ev(spark, d)).groupBy(outcome(F.col("status"), F.col("confidence"), F.col("display_count")).alias("label"), "name").agg(F.count(F.lit(1)).alias("events"))


def journey_rows(spark: SparkSession, d: str) -> DataFrame:
    """WIN-03..05."""
    return journeys(_kept(spark, d)).select("thread_key", "segment", "start_ms", "end_ms", "event_count", "catalog_version", "final_label", "miss_like")


def journey_feeder(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-11, STM-08: items of missed journeys with their split."""
    f = holdout_split(cut_lineage(feeder_items(journeys(_kept(spark, d)))))
    return f.select("thread_key", "segment", "query", F.array_join("displayed", ",").alias("displayed"), F.size("journey").alias("before"), F.array_join("event_ids", ",").alias("event_ids"), "final_label", "split")


def journey_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18, PIP-01: journeys per final label, and how many of their last events were answered."""
    j = journeys(_kept(spark, d))
    last = F.element_at("events", -1)
    return j.groupBy("final_label").agg(F.count(F.lit(1)).alias("journeys"), F.sum("event_count").alias("events"), F.count_if((last["confidence"] >= 0.4) & (F.size(last["displayed"]) > 0)).alias("answered"))


def holdout_hash(spark: SparkSession, d: str) -> DataFrame:
    """MTH-01, MTH-02."""
    g = spark.read.parquet(f"{d}/golden_report.parquet")
    return g.select("report_id", F.round(sha_unit(F.col("query_text")), 9).alias("unit"), fnv1a(F.col("command_id")).alias("fnv"), (F.pmod(fnv1a(F.col("command_id")), F.lit(1000)) < 700).alias("train"))


def cursor_slice(spark: SparkSession, d: str) -> DataFrame:
    """WIN-07: what came after the median instant."""
    e = normalised(_ev(spark, d)).select("id", "at_ms")
    cut = e.agg(F.percentile("at_ms", F.lit(0.5)).cast("bigint").alias("c")).first()["c"]
    return after_cursor(e, int(cut), "m")


def observe_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions per key: number, longest, events (general sessions, rolled up)."""
    return observed_sessions(_ev(spark, d)).groupBy("thread_key").agg(F.count(F.lit(1)).alias("sessions"), F.max("duration_ms").alias("longest_ms"), F.sum("event_count").alias("events"))


QUERIES = {
    f.__name__: f
    for f in (events_normalised, event_filter_reasons, event_version_votes, burst_dedup, drop_reasons, session_threads, outcome_labels, journey_rows, journey_feeder, journey_stats, holdout_hash, cursor_slice, observe_sessions)
}

_SP = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)"
_NORM = f"""WITH RECURSIVE {_FIRST_SQL},
  nrm AS (SELECT coalesce(id, 'delivery-' || delivery_id) AS id, coalesce(name, '') AS name, coalesce(ms, 0) AS at_ms,
      coalesce('sid:' || nullif(data.session_id, ''), 'ph:' || nullif(sessionid, ''), 'ph:' || nullif(distinctid, ''), 'anon:' || coalesce(id, '') || '|' || coalesce(ms, 0)) AS thread_key,
      trim(coalesce(data.query, ''), {_SP}) AS query, data.mock AS mock, nullif(data.catalog_version, '') AS catalog_version, data.response.status AS status, data.response.confidence AS confidence,
      coalesce(data.response.displaycount, len(data.response.results), 0) AS display_count, list_transform(coalesce(data.response.results, []), lambda r: r.command_id) AS displayed
    FROM ranked WHERE rn = 1),
  jd AS (SELECT *, CASE WHEN name NOT IN ('cli_search', 'web_cli_search') THEN 'not_search' WHEN lower(coalesce(mock, '')) = 'true' THEN 'mock'
      WHEN query = '' THEN 'empty' WHEN length(query) < 2 THEN 'too_short'
      WHEN regexp_matches(query, '^[\\W\\d_\\s]+$') AND NOT regexp_matches(query, '[a-zA-Z]{{2,}}') THEN 'non_text'
      WHEN regexp_matches(query, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}') THEN 'pii_email'
      WHEN regexp_matches(query, '\\b(ghp_[A-Za-z0-9]{{20,}}|github_pat_[A-Za-z0-9_]{{20,}}|sk-[A-Za-z0-9]{{20,}}|xox[baprs]-[A-Za-z0-9-]{{10,}})\\b') THEN 'pii_token'
      WHEN regexp_matches(query, '(?i)(/Users/[^/\\s]+|/home/[^/\\s]+|C:\\\\Users\\\\[^\\\\\\s]+)') THEN 'pii_home_path'
      WHEN regexp_matches(query, '(?i)https?://(localhost|127\\.0\\.0\\.1|192\\.168\\.|10\\.|.*\\.local)[^\\s]*') THEN 'pii_private_url'
      WHEN length(query) >= 9 AND replace(query, left(query, 1), '') = '' THEN 'spam_repeat' END AS reason FROM nrm)"""
_VOTES = _NORM + """,
  vv AS (SELECT catalog_version, count(*) AS votes, row_number() OVER (ORDER BY count(*) DESC, min({'at_ms': at_ms, 'id': id})) AS place FROM jd WHERE reason IS NULL AND catalog_version IS NOT NULL GROUP BY 1)"""
_BURST = _VOTES + """,
  fit AS (SELECT *, lag(query) OVER w AS pq, lag(at_ms) OVER w AS pa FROM jd WHERE reason IS NULL WINDOW w AS (PARTITION BY thread_key ORDER BY at_ms, id)),
  chn AS (SELECT *, sum(CASE WHEN pa IS NULL OR pq <> query OR at_ms - pa > 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY thread_key ORDER BY at_ms, id ROWS UNBOUNDED PRECEDING) AS c FROM fit),
  ptr AS (SELECT *, min(at_ms) OVER (PARTITION BY thread_key, c ORDER BY at_ms RANGE BETWEEN 1501 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
            min(at_ms) OVER (PARTITION BY thread_key, c) AS a0, row_number() OVER (PARTITION BY thread_key, c, at_ms ORDER BY id) AS same FROM chn),
  keep AS (SELECT thread_key, c, at_ms, nxt FROM ptr WHERE at_ms = a0 AND same = 1
           UNION SELECT p.thread_key, p.c, p.at_ms, p.nxt FROM keep k JOIN ptr p ON p.thread_key = k.thread_key AND p.c = k.c AND p.at_ms = k.nxt AND p.same = 1),
  bst AS (SELECT ptr.*, keep.at_ms IS NULL OR same > 1 AS burst FROM ptr LEFT JOIN keep USING (thread_key, c, at_ms)),
  kept AS (SELECT * FROM bst WHERE NOT burst AND (catalog_version IS NULL OR catalog_version = (SELECT catalog_version FROM vv WHERE place = 1)))"""
_TOKS = "list_distinct(list_filter(string_split_regex({0}, '\\s+'), lambda t: t <> ''))"
_THREADS = _BURST + f""",
  lg AS (SELECT *, lower(lag(query) OVER w) AS x, lower(query) AS y, at_ms - lag(at_ms) OVER w AS dt FROM (SELECT * EXCLUDE (pq, pa) FROM kept) WINDOW w AS (PARTITION BY thread_key ORDER BY at_ms, id)),
  sg AS (SELECT *, sum(CASE WHEN dt <= 45000 OR dt <= 90000 AND (x = y OR contains(x, y) OR contains(y, x)
             OR len(list_intersect({_TOKS.format("x")}, {_TOKS.format("y")})) >= 0.5 * len(list_distinct(list_concat({_TOKS.format("x")}, {_TOKS.format("y")})))
             OR greatest(length(x), length(y)) <= 64 AND levenshtein(x, y) <= 0.35 * greatest(length(x), length(y))) THEN 0 ELSE 1 END)
           OVER (PARTITION BY thread_key ORDER BY at_ms, id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM lg)"""
_LABEL = "CASE WHEN coalesce(status, '') IN ('error', 'empty') OR display_count = 0 THEN 'miss' WHEN confidence IS NULL OR isnan(confidence) THEN CASE WHEN display_count = 1 THEN 'satisfied' ELSE 'weak' END WHEN confidence > 0.75 THEN 'satisfied' WHEN confidence >= 0.4 THEN 'weak' ELSE 'miss' END"
_JOURNEYS = _THREADS + f""",
  lb AS (SELECT *, {_LABEL} AS label FROM sg),
  jr AS (SELECT thread_key, segment, count(*) AS event_count, min(at_ms) AS start_ms, max(at_ms) AS end_ms, arg_min(catalog_version, {{'at_ms': at_ms, 'id': id}}) FILTER (catalog_version IS NOT NULL) AS catalog_version,
     list(query ORDER BY at_ms, id) AS qs, list(id ORDER BY at_ms, id) AS ids, list(label ORDER BY at_ms, id) AS ls, list(confidence ORDER BY at_ms, id) AS cs, list(displayed ORDER BY at_ms, id) AS ds FROM lb GROUP BY 1, 2 HAVING count(*) <= 12 AND count(DISTINCT query) <= 8),
  jf AS (SELECT *, CASE WHEN ls[-1] IN ('miss', 'weak') THEN 'abandon' ELSE ls[-1] END AS final_label FROM jr)"""

ORACLES = {
    "events_normalised": _NORM + " SELECT id, name, at_ms, thread_key, query, catalog_version, display_count FROM nrm",
    "event_filter_reasons": _NORM + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS events FROM jd GROUP BY 1",
    "event_version_votes": _VOTES + " SELECT * FROM vv",
    "burst_dedup": _BURST + " SELECT id, thread_key, at_ms FROM bst WHERE burst",
    "drop_reasons": _BURST + """ SELECT reason, count(*) AS events, (SELECT catalog_version FROM vv WHERE place = 1) AS catalog_version FROM (SELECT reason FROM jd WHERE reason IS NOT NULL
        UNION ALL SELECT CASE WHEN burst THEN 'burst_repeat' WHEN catalog_version <> (SELECT catalog_version FROM vv WHERE place = 1) THEN 'catalog_version_mismatch' ELSE 'kept' END FROM bst) GROUP BY 1""",
    "session_threads": _THREADS + " SELECT thread_key, segment, min(at_ms) AS start_ms, max(at_ms) AS end_ms, count(*) AS events FROM sg GROUP BY 1, 2",
    "outcome_labels": _NORM + f" SELECT {_LABEL} AS label, name, count(*) AS events FROM nrm GROUP BY 1, 2",
    "journey_rows": _JOURNEYS + " SELECT thread_key, segment, start_ms, end_ms, event_count, catalog_version, final_label, final_label IN ('miss', 'abandon', 'weak') AS miss_like FROM jf",
    "journey_feeder": _JOURNEYS + """ SELECT thread_key, segment, qs[-1] AS query, array_to_string(list_filter(ds[-1], lambda x: x IS NOT NULL AND x <> ''), ',') AS displayed, event_count - 1 AS before, array_to_string(ids, ',') AS event_ids, final_label,
        CASE WHEN ('0x' || substr(sha256(qs[-1]), 1, 8))::BIGINT / 4294967295.0 < 0.2 THEN 'holdout' ELSE 'train' END AS split FROM jf WHERE final_label IN ('miss', 'abandon', 'weak')""",
    "journey_stats": _JOURNEYS + " SELECT final_label, count(*) AS journeys, sum(event_count)::BIGINT AS events, count(*) FILTER (cs[-1] >= 0.4 AND len(ds[-1]) > 0) AS answered FROM jf GROUP BY 1",
    "holdout_hash": """SELECT report_id, round(('0x' || substr(sha256(coalesce(query_text, '')), 1, 8))::BIGINT / 4294967295.0, 9) AS unit, f AS fnv, f % 1000 < 700 AS train
        FROM (SELECT *, CASE WHEN command_id IS NOT NULL THEN list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(command_id, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) END AS f FROM golden_report)""",
    "cursor_slice": _NORM + " SELECT id, at_ms FROM nrm WHERE at_ms > (SELECT CAST(floor(quantile_cont(at_ms, 0.5)) AS BIGINT) FROM nrm) OR at_ms = (SELECT CAST(floor(quantile_cont(at_ms, 0.5)) AS BIGINT) FROM nrm) AND id > 'm'",
    "observe_sessions": f"""WITH {_FIRST_SQL},
  e AS (SELECT thread_key, ms FROM ranked WHERE rn = 1 AND thread_key IS NOT NULL AND ms IS NOT NULL),
  f AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY thread_key ORDER BY ms) <= 45000 THEN 0 ELSE 1 END AS fresh FROM e),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY thread_key ORDER BY ms ROWS UNBOUNDED PRECEDING) AS n FROM f),
  g AS (SELECT thread_key, n, max(ms) - min(ms) AS d, count(*) AS c FROM s GROUP BY 1, 2)
SELECT thread_key, count(*) AS sessions, max(d) AS longest_ms, sum(c)::BIGINT AS events FROM g GROUP BY 1""",
}
