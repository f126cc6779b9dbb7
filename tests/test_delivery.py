import random

from pyspark.sql import functions as F

from tessellar.operators.delivery import BLOCK, accept, accept_all, keep_one, merge_blocks, merge_ranges, parse_identifier, repeats, stitch, uncovered, uuid_hex, uuid_text

U = "8f7b5c92-25e7-4f3e-8204-00c69fa0edf1"
SPELLED = [U, U.upper(), "{" + U + "}", " " + U, "urn:uuid:" + U, U.replace("-", ""), "URN:UUID:" + U.upper()]


def test_spellings_of_a_uuid(spark):
    df = spark.createDataFrame([(x,) for x in SPELLED], "id string")
    assert {r[0] for r in df.select(uuid_text(uuid_hex(F.col("id")))).collect()} == {U}
    assert df.select(uuid_hex(F.lit("zz" + U[2:]))).first()[0] is None


def test_identifier_kinds(spark):
    df = spark.createDataFrame([("w-7:0042",), ("42",), ("odd id!",), (" ",), (None,), (U,)], "id string")
    got = {r["id"]: (r["_producer"], r["_number"], r["_other"]) for r in parse_identifier(df, "id").collect()}
    assert got["w-7:0042"] == ("#w-7:", 42, None) and got["42"] == ("#", 42, None) and got["odd id!"] == (None, None, "odd id!")
    assert got[" "] == (None, None, None) and got[None] == (None, None, None)
    assert got[U][0] == U.replace("-", "")[:17] and got[U][1] == int(U.replace("-", "")[17:], 16)


def test_one_copy_of_each_and_the_rest_are_repeats(spark):
    rng = random.Random(3)
    ids = [*SPELLED, "p:1", "p:01", "p:2", "q", "q ", None, "", "hot"]
    rows = [(rng.choice([*ids, "hot", "hot"]), rng.randrange(5), k) for k in range(300)]
    rows += rows[-3:]  # delivered with the same order: copies of a row
    df = spark.createDataFrame(rows, "id string, pulled_at bigint, delivery_id bigint").withColumn("_producer", F.lit("clash")).withColumn("_first", F.lit(1))
    canon = lambda x: None if not (x or "").strip() else ("u" if x in SPELLED else "p:1" if x == "p:01" else x.strip())
    first = {}
    for i, p, k in rows:
        if canon(i):
            first[canon(i)] = min(first.get(canon(i), (9, 9)), (p, k))
    kept = keep_one(df, "id", ["pulled_at", "delivery_id"]).collect()
    named = [r for r in kept if canon(r["id"])]
    assert {canon(r["id"]): (r["pulled_at"], r["delivery_id"]) for r in named} == first and len(named) == len(first)
    assert len(kept) - len(named) == sum(not canon(r[0]) for r in rows)
    assert kept[0].asDict().keys() == set(df.columns)
    rep = repeats(df.select("id", "pulled_at", "delivery_id"), "id", ["pulled_at", "delivery_id"])
    assert rep.count() == sum(bool(canon(r[0])) for r in rows) - len(first)
    assert keep_one(df.limit(0), "id", ["pulled_at"]).count() == 0 and repeats(df.limit(0).select("id", "pulled_at"), "id", ["pulled_at"]).count() == 0


def test_ranges_follow_what_was_accepted(spark):
    nums = [1, 2, 3, 7, 9, 10, BLOCK - 1, BLOCK, BLOCK + 1]
    n = spark.createDataFrame([("a", x) for x in nums] + [("b", 5)], "_producer string, _number bigint")
    r = merge_ranges(n)
    assert sorted(map(tuple, r.collect())) == [("a", 1, 3), ("a", 7, 7), ("a", 9, 10), ("a", BLOCK - 1, BLOCK + 1), ("b", 5, 5)]
    more = spark.createDataFrame([("a", 2), ("a", 4), ("a", BLOCK), ("b", 2), ("c", 1)], "_producer string, _number bigint")
    fresh = uncovered(more, r)
    assert sorted(map(tuple, fresh.collect())) == [("a", 4), ("b", 2), ("c", 1)]
    assert sorted(map(tuple, merge_ranges(fresh, r).collect())) == [("a", 1, 4), ("a", 7, 7), ("a", 9, 10), ("a", BLOCK - 1, BLOCK + 1), ("b", 2, 2), ("b", 5, 5), ("c", 1, 1)]


def test_second_batch_against_the_first(spark):
    d1 = spark.createDataFrame([("p:1", 1), ("p:2", 2), ("weird", 3)], "id string, o bigint")
    a1 = accept(d1, "id", ["o"], [])
    seen = merge_ranges(a1.filter("_producer is not null"))
    other = a1.filter("_other is not null").select(F.col("_other").alias("other"))
    d2 = spark.createDataFrame([("p:2", 4), ("p:3", 5), ("weird", 6), ("weird2!", 7), (None, 8)], "id string, o bigint")
    assert sorted(r["o"] for r in accept(d2, "id", ["o"], [], seen, other).collect()) == [5, 7, 8]


def test_batches_against_ranges_give_the_same_repeats(spark):
    rng = random.Random(9)
    rows = [(rng.choice([f"w-{rng.randrange(3)}:{rng.randrange(200)}", "odd!", f"9:{BLOCK - 5 + rng.randrange(10)}"]), rng.randrange(40), k) for k in range(900)]
    df = spark.createDataFrame(rows, "id string, pulled_at bigint, delivery_id bigint")
    got = [sorted(map(tuple, repeats(df, "id", ["pulled_at", "delivery_id"], epochs=e).collect()), key=str) for e in (1, 2, 5)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows) - len({r[0] for r in rows})
    taken, seen, other = accept_all(parse_identifier(df, "id"), ["pulled_at", "delivery_id"], epochs=4)
    assert taken.count() == len({r[0] for r in rows}) and other.count() == 1
    covered = seen.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0]
    last = uncovered(taken.filter("_producer is not null"), seen).count()
    assert seen.count() < covered == taken.count() - 1 - last


def test_ranges_of_many_blocks_are_stitched(spark):
    n = spark.range(3 * BLOCK - 2, 6 * BLOCK + 3).select(F.lit("a").alias("_producer"), F.col("id").alias("_number"))
    n = n.unionByName(spark.createDataFrame([("a", 7 * BLOCK), ("a", 7 * BLOCK - 1), ("b", BLOCK)], n.schema))
    state = merge_blocks(n)
    assert state.count() == 8
    assert sorted(map(tuple, stitch(state).collect())) == [("a", 3 * BLOCK - 2, 6 * BLOCK + 2), ("a", 7 * BLOCK - 1, 7 * BLOCK), ("b", BLOCK, BLOCK)]
