import random

import pytest
from pyspark.sql import functions as F

from tessellar.functions.instants import instant_ms
from tessellar.operators.segments import gap_segments
from tessellar.operators.sessions import observed_sessions, sessions


def brute(rows, gap):
    by = {}
    for k, p in rows:
        by.setdefault(k, []).append(p)
    out = set()
    for k, ps in by.items():
        ps.sort()
        start, n = ps[0], 1
        for a, b in zip(ps, ps[1:]):
            if b - a > gap:
                out.add((k, start, a, n))
                start, n = b, 0
            n += 1
        out.add((k, start, ps[-1], n))
    return out


@pytest.mark.parametrize("seed,gap,block", [(1, 5, 1), (2, 5, 2), (3, 1, 3), (4, 50, 1), (5, 0, 4)])
def test_segments_match_brute_force(spark, seed, gap, block):
    rng = random.Random(seed)
    rows = [(rng.choice("aaaab"), rng.randrange(-200, 400)) for _ in range(160)]
    df = spark.createDataFrame(rows, "k string, p bigint")
    got = {tuple(r) for r in gap_segments(df, ["k"], "p", gap, cells_per_block=block).select("k", "seg_start", "seg_end", "seg_count").collect()}
    assert got == brute(rows, gap)


def test_segments_weighted_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 3)], "k string, p bigint, n bigint")
    assert [tuple(r) for r in gap_segments(df, ["k"], "p", 1, count=F.col("n")).collect()] == [("a", 1, 2, 5)]
    assert gap_segments(df.limit(0), ["k"], "p", 1).count() == 0


def test_session_border_is_inclusive(spark):
    df = spark.createDataFrame([("k", 0), ("k", 45_000), ("k", 90_001), (None, 3), ("k", None)], "thread_key string, at_ms bigint")
    rows = sorted(map(tuple, sessions(df, "thread_key", "at_ms").collect()))
    assert rows == [("k", 0, 45_000, 45_000, 2), ("k", 90_001, 90_001, 0, 1)]


@pytest.mark.parametrize(
    "raw,ms",
    [
        ("1970-01-01T00:00:01Z", 1000), ("1970-01-01 00:00:01.5", 1500), ("1970-01-01T01:00:00+01:00", 0), ("1970-01-01T00:00:00-0130", 5_400_000), ("12", 12_000), ("1000000000000", 10**12),
        ("999999999999", 999999999999000), ("1970-01-02", 86_400_000), (" 5 ", 5000), ("NaN", None), ("n/a", None), ("", None), (None, None), ("Invalid Date", None), ("1970-13-01T00:00:00Z", None), ("12:30", None), ("1970-01-01T00:00:00+02", -7_200_000),
    ],
)
def test_instants(spark, raw, ms):
    assert spark.createDataFrame([(raw,)], "x string").select(instant_ms(F.col("x"))).first()[0] == ms


def test_observed_sessions_count_first_deliveries(spark):
    uid = "8f7b5c92-25e7-4f3e-8204-00c69fa0edf1"
    rows = [
        (1, uid, "1970-01-01T00:00:10Z", "s_a", None, 1), (2, "{" + uid.upper() + "}", "1970-01-01T09:00:00Z", "s_b", None, 2),
        (3, None, "20", " ", "d_x", 1), (4, None, "50", "null", "d_x", 1), (5, "x", "30", "undefined", "anonymous", 1), (6, "y", "n/a", "s_a", None, 1),
    ]
    df = spark.createDataFrame(rows, "delivery_id bigint, id string, createdat string, sessionid string, distinctid string, pulled_at bigint").withColumn("thread_key", F.lit("clash"))
    got = sorted(map(tuple, observed_sessions(df).collect()))
    assert got == [("d_x", 20_000, 50_000, 30_000, 2), ("s_a", 10_000, 10_000, 0, 1)]
    assert observed_sessions(df.limit(0)).count() == 0
