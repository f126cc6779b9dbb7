"""Grouping activity into sessions separated by inactivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.functions.instants import instant_ms
from tessellar.operators.delivery import accept
from tessellar.operators.segments import gap_segments

SESSION_GAP_MS = 45_000


def real_key(*candidates: Column) -> Column:
    """The first candidate that is a real session (``s_``) or visitor (``d_``) key."""
    return F.coalesce(*[F.when(c.startswith("s_") | c.startswith("d_"), c) for c in candidates])


def sessions(events: DataFrame, key: str, at_ms: str, gap_ms: int = SESSION_GAP_MS) -> DataFrame:
    """One row per session: ``thread_key, start_ms, end_ms, duration_ms, event_count``.

    A session ends where the next event of the key comes more than ``gap_ms`` later; an event exactly ``gap_ms`` later
    still belongs to it.  Events with a null key or time are left out, events at one time are counted each, an empty
    table gives no sessions.  See :mod:`tessellar.operators.segments` for how hot keys are spread.
    """
    known = events.select(F.col(key).alias("thread_key"), F.col(at_ms).cast("bigint").alias("_at")).filter("thread_key is not null and _at is not null")
    return gap_segments(known, ["thread_key"], "_at", gap_ms).select(
        "thread_key",
        F.col("seg_start").alias("start_ms"),
        F.col("seg_end").alias("end_ms"),
        (F.col("seg_end") - F.col("seg_start")).alias("duration_ms"),
        F.col("seg_count").alias("event_count"),
    )


def observed_sessions(deliveries: DataFrame, gap_ms: int = SESSION_GAP_MS) -> DataFrame:
    """Sessions of raw telemetry deliveries: every event once, with the values of its first delivery."""
    slim = deliveries.select("id", "pulled_at", "delivery_id", real_key(F.col("sessionid"), F.col("distinctid")).alias("_key"), instant_ms(F.col("createdat")).alias("_ms"))
    events = accept(slim, "id", ["pulled_at", "delivery_id"], ["_key", "_ms"])
    return sessions(events, "_key", "_ms", gap_ms)
