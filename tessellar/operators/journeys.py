"""From search telemetry to labelled journeys (FLT-01..04, WIN-01..07, MTH-06, PRJ-11, STM-08)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tessellar.config import JourneyConfig
from tessellar.functions.instants import instant_ms
from tessellar.functions.numbers import sha_unit
from tessellar.functions.text import junk_reason, near_edit, trimmed
from tessellar.operators.blocks import previous, running_count, with_block
from tessellar.operators.delivery import accept
from tessellar.session import cut_lineage

SEARCHES = ("cli_search", "web_cli_search")
ORDER = ["at_ms", "id"]


def filled(c: Column) -> Column:
    return F.when(c != "", c)


def thread_key(session: Column, session_id: Column, distinct_id: Column, id_: Column, at: Column) -> Column:
    """HLP-08: the payload's session, else session, else visitor, else the event alone."""
    return F.coalesce(
        F.concat(F.lit("sid:"), filled(session)),
        F.concat(F.lit("ph:"), filled(session_id)),
        F.concat(F.lit("ph:"), filled(distinct_id)),
        F.concat(F.lit("anon:"), F.coalesce(id_, F.lit("")), F.lit("|"), at.cast("string")),
    )


def normalised(deliveries: DataFrame) -> DataFrame:
    """SRC-13, DAT-01, WIN-06: one row per event (its first delivery), flat; unreadable times are 0."""
    payload = F.struct("id", "name", "createdat", "sessionid", "distinctid", "data")
    slim = deliveries.select("id", "pulled_at", "delivery_id", payload.alias("_event"))
    e = accept(slim, "id", ["pulled_at", "delivery_id"], ["_event"]).select("_event.*", "delivery_id")
    at = F.coalesce(instant_ms(F.col("createdat")), F.lit(0).cast("bigint"))
    response = F.col("data.response")
    return e.select(
        F.coalesce("id", F.concat(F.lit("delivery-"), F.col("delivery_id").cast("string"))).alias("id"),
        F.coalesce("name", F.lit("")).alias("name"),
        at.alias("at_ms"),
        thread_key(F.col("data.session_id"), F.col("sessionid"), F.col("distinctid"), F.col("id"), at).alias("thread_key"),
        trimmed(F.coalesce("data.query", F.lit(""))).alias("query"),
        F.col("data.mock").alias("mock"),
        filled(F.col("data.catalog_version")).alias("catalog_version"),
        response.getField("status").alias("status"),
        response.getField("confidence").alias("confidence"),
        F.coalesce(response.getField("displaycount"), F.size(response.getField("results")).cast("bigint"), F.lit(0)).alias("display_count"),
        F.transform(F.coalesce(response.getField("results"), F.array().cast("array<struct<command_id:string>>")), lambda r: r["command_id"]).alias("displayed"),
    )


def judged(events: DataFrame) -> DataFrame:
    """FLT-01..03: adds ``reason``, the first for which an event is dropped, null if it stays."""
    reason = F.when(~F.col("name").isin(*SEARCHES), "not_search").when(F.lower(F.coalesce("mock", F.lit(""))) == "true", "mock").otherwise(junk_reason(F.col("query")))
    return events.withColumn("reason", reason)


def without_bursts(events: DataFrame, cfg: JourneyConfig = JourneyConfig()) -> DataFrame:
    """WIN-02: adds ``burst``: the query equals that of the last kept event of the thread, at most ``burst_ms`` before.

    Only rows of one query that follow each other closely can suppress each other: such chains are found by a lag, and the
    fold that keeps a row, then the first one more than ``burst_ms`` later, jumps through the sorted instants of a chain.
    """
    e = previous(with_block(events, "at_ms"), "thread_key", ORDER, ["query"])
    fresh = F.col("_prev").isNull() | (F.col("_prev.query") != F.col("query")) | (F.col("at_ms") - F.col("_prev.at_ms") > cfg.burst_ms)
    e = cut_lineage(running_count(e, "thread_key", ORDER, fresh, "_chain").drop("_prev", "_block"))
    # only chains of several rows are folded: their instants, each once, so a chain is bounded by its span, not by its rows
    chains = e.groupBy("thread_key", "_chain").agg(F.count(F.lit(1)).alias("_n"), F.collect_set("at_ms").alias("_ats")).filter("_n > 1")
    chains = cut_lineage(chains.select("thread_key", "_chain", kept_instants(F.col("_ats"), F.lit(cfg.burst_ms)).alias("_kept")))
    kept = chains.select("thread_key", "_chain", F.explode("_kept").alias("at_ms"), F.lit(True).alias("_keep"))
    e = e.join(chains.select("thread_key", "_chain", F.lit(True).alias("_many")), ["thread_key", "_chain"], "left").join(kept, ["thread_key", "_chain", "at_ms"], "left")
    # of rows at one kept instant the first stays
    ids = e.filter("_keep").groupBy("thread_key", "_chain", "at_ms").agg(F.min("id").alias("_first"))
    e = e.join(ids, ["thread_key", "_chain", "at_ms"], "left")
    stays = F.col("_many").isNull() | (F.col("_keep") & (F.col("id") == F.col("_first")))
    return e.withColumn("burst", ~F.coalesce(stays, F.lit(False))).drop("_many", "_keep", "_first", "_chain")


@F.pandas_udf(ArrayType(LongType()))
def kept_instants(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Of the instants of a chain the first, and each time the first one more than the window behind the last one kept."""
    for ats, window in batches:
        out = []
        for a, w in zip(ats, window, strict=True):
            t = np.sort(np.asarray(a, dtype=np.int64))
            kept, i = [], 0
            while i < len(t):
                kept.append(t[i])
                i = int(np.searchsorted(t, t[i] + w, "right"))
            out.append(kept)
        yield pd.Series(out, dtype=object)


def version_votes(events: DataFrame) -> DataFrame:
    """AGG-03: votes per catalog version, in the order in which the mode is chosen (ties: first seen)."""
    votes = events.filter("catalog_version is not null").groupBy("catalog_version").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct(*ORDER)).alias("_first"))
    return votes.select("catalog_version", "votes", F.row_number().over(Window.orderBy(F.desc("votes"), "_first")).alias("place"))


def filter_events(deliveries: DataFrame, cfg: JourneyConfig = JourneyConfig(), version: str | None = None) -> tuple[DataFrame, DataFrame, str | None]:
    """(kept events of the chosen catalog version or of none, all events with ``reason``, the version)."""
    all_ = cut_lineage(judged(normalised(deliveries)))  # read by every step below
    fit = all_.filter("reason is null")
    if version is None:
        top = version_votes(fit).filter("place = 1").first()  # versions are few
        version = top["catalog_version"] if top else None
    marked = without_bursts(fit, cfg)
    wrong = F.lit(False) if version is None else F.coalesce(F.col("catalog_version") != version, F.lit(False))
    marked = cut_lineage(marked.withColumn("reason", F.when(F.col("burst"), "burst_repeat").when(wrong, "catalog_version_mismatch")).drop("burst"))
    return marked.filter("reason is null").drop("reason", "mock"), all_.filter("reason is not null").unionByName(marked), version


def outcome(status: Column, confidence: Column, shown: Column, cfg: JourneyConfig = JourneyConfig()) -> Column:
    """MTH-06."""
    bare = F.when(shown == 1, "satisfied").otherwise("weak")
    rated = F.when(confidence > cfg.satisfied_above, "satisfied").when(confidence >= cfg.weak_from, "weak").otherwise("miss")
    return F.when(F.coalesce(status, F.lit("")).isin("error", "empty") | (shown == 0), "miss").when(confidence.isNull() | F.isnan(confidence), bare).otherwise(rated)


def threads(events: DataFrame, cfg: JourneyConfig = JourneyConfig()) -> DataFrame:
    """WIN-01: adds ``segment``: a new one unless the event before is at most ``gap_ms`` back, or ``soft_gap_ms`` with a nearly equal query."""
    e = previous(with_block(events, "at_ms"), "thread_key", ORDER, ["query"])
    dt = F.col("at_ms") - F.col("_prev.at_ms")
    joined = (dt <= cfg.gap_ms) | ((dt <= cfg.soft_gap_ms) & near_edit(F.col("_prev.query"), F.col("query")))
    e = e.withColumn("_new", ~F.coalesce(joined, F.lit(False))).drop("_prev")
    return running_count(e, "thread_key", ORDER, F.col("_new"), "segment").drop("_new", "_block")


def journeys(events: DataFrame, cfg: JourneyConfig = JourneyConfig()) -> DataFrame:
    """One row per journey: ordered events with labels, the last one 'abandon' if it ended in a miss or weakly.

    Oversized segments (WIN-03) are dropped before their events are gathered, so a row never holds more than ``max_events``.
    """
    e = threads(events, cfg).withColumn("label", outcome(F.col("status"), F.col("confidence"), F.col("display_count"), cfg))
    seg = ["thread_key", "segment"]
    fit = e.groupBy(*seg).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= cfg.max_events)
    rows = F.array_sort(F.collect_list(F.struct("at_ms", "id", "query", "label", "confidence", "displayed", "catalog_version")))
    j = e.join(fit.select(*seg), seg).groupBy(*seg).agg(rows.alias("events"))
    j = j.filter(F.size(F.array_distinct("events.query")) <= cfg.max_queries)
    last = F.element_at("events", -1)
    final = F.when(last["label"].isin("miss", "weak"), "abandon").otherwise(last["label"])
    return j.select(
        *seg,
        "events",
        F.get("events", 0)["at_ms"].alias("start_ms"),
        last["at_ms"].alias("end_ms"),
        F.size("events").alias("event_count"),
        F.get(F.filter("events", lambda x: x["catalog_version"].isNotNull()), 0)["catalog_version"].alias("catalog_version"),
        final.alias("final_label"),
        F.coalesce(final.isin("miss", "abandon", "weak"), F.lit(False)).alias("miss_like"),
    )


def feeder_items(j: DataFrame) -> DataFrame:
    """PRJ-11, HLP-09: what a missed journey hands on."""
    last = F.element_at("events", -1)
    return j.filter("miss_like").select(
        "thread_key",
        "segment",
        last["query"].alias("query"),
        F.filter(last["displayed"], lambda x: F.coalesce(x, F.lit("")) != "").alias("displayed"),
        last["confidence"].alias("confidence"),
        F.transform(F.slice("events", F.lit(1), F.size("events") - 1), lambda x: x["query"]).alias("journey"),
        F.col("events.id").alias("event_ids"),
        "catalog_version",
        "final_label",
    )


def holdout_split(items: DataFrame, text: str = "query", rate: float = 0.2) -> DataFrame:
    """MTH-01, STM-08: adds ``split`` by the hash of the text; if five or more items all fell on one side, the first by text are held out."""
    marked = items.withColumn("_out", sha_unit(F.col(text)) < rate)
    n = marked.agg(F.count(F.lit(1)).alias("n"), F.count_if("_out").alias("o")).first()
    if n["n"] >= 5 and n["o"] in (0, n["n"]):
        cut = max(1, int(n["n"] * rate))
        first = marked.select(F.struct(text, F.monotonically_increasing_id().alias("_i")).alias("_s")).orderBy("_s").limit(cut).agg(F.max("_s").alias("s")).first()["s"][text]
        marked = marked.withColumn("_out", F.col(text) <= first)
    return marked.withColumn("split", F.when(F.col("_out"), "holdout").otherwise("train")).drop("_out")


def after_cursor(events: DataFrame, at: int, last_id: str, strict: bool = True) -> DataFrame:
    """WIN-07: rows strictly behind the cursor in (at, id).  Not ``strict``: all rows if the cursor's row isn't there."""
    behind = (F.col("at_ms") > at) | ((F.col("at_ms") == at) & (F.col("id") > last_id))
    if not strict and events.filter((F.col("at_ms") == at) & (F.col("id") == last_id)).isEmpty():
        return events
    return events.filter(behind)
