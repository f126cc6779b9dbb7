import random

from pyspark.sql import functions as F

from tessellar.config import JourneyConfig
from tessellar.operators.blocks import previous, running_count, with_block
from tessellar.operators.journeys import after_cursor, feeder_items, filter_events, holdout_split, journeys, outcome, without_bursts

RAW = "delivery_id bigint, id string, name string, createdat string, sessionid string, distinctid string, data struct<query:string,mock:string,catalog_version:string,session_id:string,response:struct<status:string,confidence:double,displaycount:bigint,results:array<struct<command_id:string>>>>, pulled_at bigint"


def raw(spark, rows):
    """rows: (seconds, query, extra)"""
    out = []
    for k, (s, q, x) in enumerate(rows):
        resp = x.get("response", ("ok", 0.5, 2, [("r1",), ("r2",)]))
        out.append((k, x.get("id", f"e{k:03}!"), x.get("name", "cli_search"), str(int(1.7e12 + s * 1000)), x.get("session", "s_1"), None, (q, x.get("mock"), x.get("version", "5"), None, resp), 1))
    return spark.createDataFrame(out, RAW)


def test_filter_counts_reasons(spark):
    ev = raw(spark, [(0, "undo it", {}), (100, "undo it", {"mock": "true"}), (200, " ", {}), (300, "undo it", {"name": "cli_opt_in"}), (400, "other thing", {"version": "4"}), (500, "none", {"version": ""})])
    kept, all_, version = filter_events(ev)
    assert version == "5" and sorted(r["query"] for r in kept.collect()) == ["none", "undo it"]
    assert {r["reason"]: r["count"] for r in all_.groupBy("reason").count().collect()} == {None: 2, "mock": 1, "empty": 1, "not_search": 1, "catalog_version_mismatch": 1}


def brute_burst(rows):
    last, gone = {}, set()
    for k, q, at, i in sorted(rows, key=lambda r: (r[2], r[3])):
        if k in last and last[k][0] == q and at - last[k][1] <= 1500:
            gone.add(i)
        else:
            last[k] = (q, at)
    return gone


def test_bursts_match_the_fold(spark):
    rng = random.Random(7)
    rows = [(rng.choice("kkkl"), rng.choice("ab"), rng.randrange(0, 40_000_000 if n % 3 else 9000), f"i{n:03}") for n in range(200)]
    rows += [("k", "a", 5 * 21_600_000 + d, f"z{d:04}") for d in range(-3000, 3000, 700)]
    df = spark.createDataFrame(rows, "thread_key string, query string, at_ms bigint, id string")
    assert {r["id"] for r in without_bursts(df).filter("burst").collect()} == brute_burst(rows)


def test_previous_and_running_count_cross_blocks(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(1000), f"{n:03}") for n in range(120)]
    df = with_block(spark.createDataFrame(rows, "k string, t bigint, id string"), "t", 50)
    got = {r["id"]: r for r in running_count(previous(df, "k", ["t", "id"], []), "k", ["t", "id"], F.col("t") % 2 == 0, "n").collect()}
    for key in "ab":
        own, n = sorted((t, i) for k, t, i in rows if k == key), 0
        for j, (t, i) in enumerate(own):
            n += t % 2 == 0
            assert got[i]["n"] == n and (got[i]["_prev"]["id"] if got[i]["_prev"] else None) == (own[j - 1][1] if j else None)


def test_journeys_split_merge_and_drop(spark):
    ev = raw(spark, [(0, "undo last commit", {}), (30, "create a branch", {}), (200, "show log", {"response": ("ok", 0.9, 1, [("r1",)])})] + [(1000 + k, f"word {k}", {"session": "s_2"}) for k in range(15)] + [(5000, "undo last commit", {"session": "s_3"}), (5060, "undo last commit keep files", {"session": "s_3"})])
    kept, _, _ = filter_events(ev)
    j = sorted(journeys(kept).collect(), key=lambda r: r["start_ms"])
    assert [(r["thread_key"], r["event_count"], r["final_label"]) for r in j] == [("ph:s_1", 2, "abandon"), ("ph:s_1", 1, "satisfied"), ("ph:s_3", 2, "abandon")]
    items = feeder_items(journeys(kept)).collect()
    assert {i["query"] for i in items} == {"create a branch", "undo last commit keep files"} and all(i["displayed"] == ["r1", "r2"] for i in items)


def test_outcomes(spark):
    cases = [("ok", 0.9, 1, "satisfied"), ("ok", 0.5, 2, "weak"), ("empty", 0.0, 0, "miss"), ("ok", None, 1, "satisfied"), ("ok", None, 2, "weak"), ("error", 0.9, 3, "miss"), ("ok", 0.1, 1, "miss"), (None, 0.75, 1, "weak")]
    df = spark.createDataFrame(cases, "s string, c double, n bigint, want string").withColumn("got", outcome(F.col("s"), F.col("c"), F.col("n"), JourneyConfig()))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_split_and_cursor(spark):
    df = spark.createDataFrame([(f"q{k}",) for k in range(200)], "query string")
    n = {r["split"]: r["count"] for r in holdout_split(df).groupBy("split").count().collect()}
    assert 15 < n["holdout"] < 70
    all_train = spark.createDataFrame([("q1",)] * 0 + [(q,) for q in [r["query"] for r in holdout_split(df).filter("split = 'train'").limit(6).collect()]], "query string")
    assert holdout_split(all_train).filter("split = 'holdout'").count() == 1
    e = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "at_ms bigint, id string")
    assert [r["id"] for r in after_cursor(e, 1, "b").collect()] == ["c"] and after_cursor(e, 1, "zz", strict=False).count() == 3
