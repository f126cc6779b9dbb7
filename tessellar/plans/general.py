"""Queries of the general training-data operators: sessions (p1) and repeated deliveries (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.operators.delivery import repeats, uuid_text
from tessellar.operators.sessions import observed_sessions

ORDER = ["pulled_at", "delivery_id"]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/observe_events.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return observed_sessions(_events(spark, d)).select("thread_key", "start_ms", "end_ms", "event_count")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rep = repeats(_events(spark, d).select("id", *ORDER), "id", ORDER)
    text = F.when(F.col("_other").isNotNull(), F.col("_other")).when(
        F.length("_producer") == 17, uuid_text(F.concat("_producer", F.lpad(F.lower(F.hex("_number")), 15, "0")))
    )
    return rep.select(F.coalesce(text, F.concat(F.expr("substring(_producer, 2)"), F.col("_number").cast("string"))).alias("id"), "delivery_id")


QUERIES = {"p1_found": p1_found, "p4_found": p4_found}

_MS_SQL = r"""
    CASE WHEN regexp_full_match(trim(createdat), '\d{1,17}(\.\d+)?')
         THEN CAST(CASE WHEN CAST(trim(createdat) AS DECIMAL(28,6)) < 1000000000000 THEN CAST(trim(createdat) AS DECIMAL(28,6)) * 1000 ELSE CAST(trim(createdat) AS DECIMAL(28,6)) END AS BIGINT)
         WHEN regexp_full_match(trim(createdat), '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?')
         THEN epoch_ms(CAST(substr(replace(trim(createdat), 'T', ' '), 1, 10) || ' ' || regexp_extract(trim(createdat), '\d{2}:\d{2}:\d{2}(\.\d+)?') AS TIMESTAMP))
              - CASE WHEN regexp_matches(trim(createdat), '[+-]\d{2}:\d{2}$')
                     THEN (CASE WHEN substr(right(trim(createdat), 6), 1, 1) = '-' THEN -1 ELSE 1 END)
                          * (CAST(substr(right(trim(createdat), 6), 2, 2) AS BIGINT) * 60 + CAST(right(trim(createdat), 2) AS BIGINT)) * 60000
                     ELSE 0 END
    END"""
_HEX_SQL = "regexp_extract(regexp_replace(regexp_replace(lower(id), '^\\s*\\{?\\s*(urn:)?(uuid:)?', ''), '[-{}\\s]', '', 'g'), '^[0-9a-f]{32}$')"
_FIRST_SQL = f"""
  raw AS (SELECT *, {_HEX_SQL} AS hex, {_MS_SQL} AS ms,
            CASE WHEN starts_with(sessionid, 's_') OR starts_with(sessionid, 'd_') THEN sessionid
                 WHEN starts_with(distinctid, 's_') OR starts_with(distinctid, 'd_') THEN distinctid END AS thread_key
          FROM observe_events),
  ranked AS (SELECT *, CASE WHEN id IS NULL OR trim(id) = '' THEN 1
                       ELSE row_number() OVER (PARTITION BY coalesce(nullif(hex, ''), trim(id)) ORDER BY pulled_at, delivery_id) END AS rn FROM raw)"""

ORACLES = {
    "p1_found": f"""WITH {_FIRST_SQL},
  e AS (SELECT thread_key, ms FROM ranked WHERE rn = 1 AND thread_key IS NOT NULL AND ms IS NOT NULL),
  f AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY thread_key ORDER BY ms) <= 45000 THEN 0 ELSE 1 END AS fresh FROM e),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY thread_key ORDER BY ms ROWS UNBOUNDED PRECEDING) AS n FROM f)
SELECT thread_key, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS event_count FROM s GROUP BY thread_key, n""",
    "p4_found": f"""WITH {_FIRST_SQL}
SELECT CASE WHEN hex <> '' THEN substr(hex,1,8) || '-' || substr(hex,9,4) || '-' || substr(hex,13,4) || '-' || substr(hex,17,4) || '-' || substr(hex,21,12)
       ELSE trim(id) END AS id, delivery_id FROM ranked WHERE rn > 1""",
}
