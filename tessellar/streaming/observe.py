"""The telemetry steps over streams (STM-*): deduplication, hard-gap sessions, burst suppression, a durable feeder sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessellar.functions.instants import instant_ms
from tessellar.functions.text import junk_reason
from tessellar.operators.delivery import uuid_hex
from tessellar.operators.journeys import SEARCHES
from tessellar.operators.sessions import real_key


def event_times(deliveries: DataFrame) -> DataFrame:
    """Adds ``event_id`` (canonical), ``at`` (timestamp) and ``key``; rows without a readable time are left out, as they fit no watermark."""
    event_id = F.coalesce(uuid_hex(F.col("id")), F.trim("id"), F.concat(F.lit("delivery-"), F.col("delivery_id").cast("string")))
    return deliveries.withColumns({"event_id": event_id, "at": F.timestamp_millis(instant_ms(F.col("createdat"))), "key": real_key(F.col("sessionid"), F.col("distinctid"))}).filter("at is not null")


def once(deliveries: DataFrame, late: str = "1 hour") -> DataFrame:
    """STM-02: each event once; a repeat arriving later than the watermark can't be told."""
    return event_times(deliveries).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def hard_sessions(events: DataFrame, gap: str = "45 seconds") -> DataFrame:
    """STM-03: sessions by inactivity.  Needs a watermark on ``at``."""
    g = events.filter("key is not null").groupBy(F.session_window("at", gap).alias("w"), "key").agg(F.count(F.lit(1)).alias("event_count"), F.min("at").alias("start"), F.max("at").alias("end"))
    return g.select(F.col("key").alias("thread_key"), F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "event_count")


class Burst(StatefulProcessor):
    """STM-04: per thread the last kept query and its time; a repeat within ``window_ms`` is dropped."""

    def __init__(self, window_ms: int = 1500):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "query string, at_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at_ms", "event_id"])
        last = self.last.get() if self.last.exists() else (None, None)
        kept = []
        for r in batch.itertuples(index=False):
            if last[0] == r.query and r.at_ms - last[1] <= self.window_ms:
                continue
            last = (r.query, int(r.at_ms))
            kept.append((key[0], r.event_id, r.query, int(r.at_ms)))
        self.last.update(last)
        yield pd.DataFrame(kept, columns=["key", "event_id", "query", "at_ms"])

    def close(self) -> None:
        pass


def without_bursts(events: DataFrame, window_ms: int = 1500) -> DataFrame:
    """Searches fit to keep, bursts dropped.  Needs the RocksDB state store."""
    q = F.trim(F.coalesce("data.query", F.lit("")))
    fit = events.filter(F.col("name").isin(*SEARCHES) & junk_reason(q).isNull() & F.col("key").isNotNull())
    slim = fit.select("key", "event_id", q.alias("query"), F.unix_millis("at").alias("at_ms"))
    return slim.groupBy("key").transformWithStateInPandas(Burst(window_ms), outputStructType="key string, event_id string, query string, at_ms bigint", outputMode="append", timeMode="None")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """STM-01, STM-06, SNK-16: processes what is there and stops; the source's position is kept with the checkpoint, and is
    moved on only after the batch is written."""

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces its own folder
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def near_text(a: str | None, b: str | None) -> bool:
    """SIM-01 for one pair: equal, contained, half of the tokens shared, or short and a third of the characters edited at most."""
    x, y = (a or "").lower().strip(" "), (b or "").lower().strip(" ")
    if not x or not y:
        return False
    if x == y or x in y or y in x:
        return True
    p, q = set(x.split()), set(y.split())
    if len(p & q) >= 0.5 * len(p | q):
        return True
    longest = max(len(x), len(y))
    if longest > 64:
        return False
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        new = [i]
        for j, e in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return row[-1] <= 0.35 * longest


class SoftThreads(StatefulProcessor):
    """STM-03: per thread the last query, its time and the running segment; a new segment begins where neither rule joins."""

    def __init__(self, gap_ms: int, soft_gap_ms: int):
        self.gap_ms, self.soft_gap_ms = gap_ms, soft_gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "query string, at_ms bigint, segment bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at_ms", "id"])
        query, at, segment = self.last.get() if self.last.exists() else (None, None, 0)
        out = []
        for r in batch.itertuples(index=False):
            dt = None if at is None else int(r.at_ms) - at
            if dt is None or not (dt <= self.gap_ms or dt <= self.soft_gap_ms and near_text(query, r.query)):
                segment += 1
            query, at = r.query, int(r.at_ms)
            out.append((key[0], r.id, at, segment))
        self.last.update((query, at, segment))
        yield pd.DataFrame(out, columns=["thread_key", "id", "at_ms", "segment"])

    def close(self) -> None:
        pass


def soft_threads(events: DataFrame, gap_ms: int = 45_000, soft_gap_ms: int = 90_000) -> DataFrame:
    """STM-03: ``events`` (thread_key, id, query, at_ms) with ``segment``; rows of a thread must not arrive before earlier ones
    of another batch.  Needs the RocksDB state store."""
    return events.groupBy("thread_key").transformWithStateInPandas(SoftThreads(gap_ms, soft_gap_ms), outputStructType="thread_key string, id string, at_ms bigint, segment bigint", outputMode="append", timeMode="None")
