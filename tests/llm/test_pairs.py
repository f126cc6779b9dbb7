import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.llm.format_dups import collapse, sequence_key, set_of_sequences_key
from tessellar.llm.near_dup import record_groups, record_pairs, similar_sets
from tessellar.llm.split_overlap import banded_edits, near_matches
from tessellar.llm.words import words

VOCAB = [f"w{k}" for k in range(30)] + ["the", "git", "to"]


def texts(seed, n, lo=4, hi=14):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        if out and rng.random() < 0.5:
            w = list(rng.choice(out)[1].split())
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            rng.shuffle(w)
        else:
            w = rng.sample(VOCAB, rng.randrange(lo, hi)) + ["the", "git"]
        out.append((f"r{k:03}", " ".join(w)))
    return out


def likeness(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("seed,t", [(1, 0.7), (2, 0.8), (3, 0.5), (4, 0.95)])
def test_near_duplicates_match_brute_force(spark, seed, t):
    rows = texts(seed, 120) + [("e1", ""), ("e2", None), ("p", "?!"), ("one", "w1"), ("one2", "W1.")]
    df = spark.createDataFrame(rows, "id string, t string").withColumn("words", words(F.col("t"))).withColumns({"class_id": F.lit(1), "n": F.lit("x"), "digest": F.lit(0)})
    found = similar_sets(df, "id", "words", t)
    sets = {i: set((x or "").lower().replace(".", "").split()) for i, x in rows if (x or "").strip(" ?!")}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if likeness(sets[a], sets[b]) >= t}
    assert {tuple(r) for r in record_pairs(found).collect()} == want
    groups = {r["id"]: r for r in record_groups(found).collect()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in want:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {i: r["group_id"] for i, r in groups.items()} == {i: root(i) for i in sets}
    assert groups["one"]["class_id"] == groups["one2"]["class_id"] == "one"


def test_near_duplicates_of_copies_and_long_texts(spark):
    long = " ".join(f"x{k}" for k in range(3000))
    rows = [(f"c{k:02}", "same words here") for k in range(40)] + [("c01", "same words here"), (None, "same words here"), ("l1", long), ("l2", long + " extra")]
    df = spark.createDataFrame(rows, "id string, t string").withColumn("words", words(F.col("t")))
    found = similar_sets(df, "id", "words", 0.8)
    assert found.pairs.count() == 1 and record_pairs(found).count() == 40 * 39 // 2 + 1
    assert record_pairs(similar_sets(df.limit(0), "id", "words", 0.8)).count() == 0 and record_groups(similar_sets(df.limit(0), "id", "words")).count() == 0


def test_banded_edits():
    rng = random.Random(5)
    a = [[rng.randrange(6) for _ in range(rng.randrange(0, 9))] for _ in range(300)]
    b = [[rng.randrange(6) for _ in range(rng.randrange(0, 9))] for _ in range(300)]

    def indel(x, y):
        d = np.zeros((len(x) + 1, len(y) + 1), int)
        d[:, 0], d[0, :] = np.arange(len(x) + 1), np.arange(len(y) + 1)
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] if x[i - 1] == y[j - 1] else 99)
        return d[-1, -1]

    for band in (1, 3, 6):
        got = banded_edits(a, b, band)
        for x, y, g in zip(a, b, got):
            w = indel(x, y)
            assert g == w if w <= band else g > band


@pytest.mark.parametrize("seed,t,span,rows_a_list", [(11, 0.7, 1, 4000), (12, 0.8, 1, 2), (13, 0.6, 1, 4000), (14, 0.8, 4, 4000), (15, 0.7, 2, 1), (16, 0.4, 3, 4000)])
def test_split_overlap_matches_brute_force(spark, seed, t, span, rows_a_list):
    rows = texts(seed, 140, 3, 9)
    ev, tr = rows[:70] + [("x", None), ("y", "..."), ("z", rows[0][1])], [(i, x.upper() + "!") for i, x in rows[70:]] + [("r0", rows[1][1]), ("r0", rows[2][1]), ("n", None)]
    d = lambda r, k: spark.createDataFrame(r, f"{k} string, t string").select(k, words(F.col("t")).alias("words"), F.lit(1).alias("e"), F.lit(2).alias("seq"))
    got = {(r["eval_key"], r["train_key"]) for r in near_matches(d(ev, "eval_key"), d(tr, "train_key"), t, span, rows_a_list).collect()}
    s = lambda x: set((x or "").lower().replace("!", "").replace(".", "").split())
    assert got == {(a, b) for a, x in ev for b, y in tr if s(x) and s(y) and likeness(s(x), s(y)) >= t}
    assert near_matches(d(ev, "eval_key").limit(0), d(tr, "train_key"), t).count() == 0 and near_matches(d(ev, "eval_key"), d(tr, "train_key").limit(0), t).count() == 0


def test_format_duplicates(spark):
    rows = [("b", "Undo  the COMMIT!"), ("a", "undo-the commit"), ("c", "undo commit the"), ("d", "?"), ("e", None), ("f", ""), (None, "undo the commit"), ("g", "x " * 5000), ("h", "X " * 5000)]
    rows += [(f"z{k:03}", "Hot, key") for k in range(200)]
    df = spark.createDataFrame(rows, "id string, q string").withColumns({"_key": F.lit(1), "copies": F.lit(2)})
    got = {(r["first_id"], r["copies"]) for r in collapse(df, "id", sequence_key(F.col("q")), hot_share=10, salts=4).collect()}
    assert got == {("a", 3), ("c", 1), ("g", 2), ("z000", 200)}
    assert collapse(df.limit(0), "id", sequence_key(F.col("q"))).count() == 0
    by = {(r["k"], r["copies"]) for r in collapse(df.withColumn("k", F.col("id").isNull()), "id", sequence_key(F.col("q")), by=["k"]).collect()}
    assert by == {(False, 2), (True, 1), (False, 1), (False, 200)}


def test_order_of_lists_does_not_count(spark):
    rows = [(1, ["A b", "c!"]), (2, ["c", "a B", "C"]), (3, ["c", None, "", "?"]), (4, ["c"]), (5, []), (6, None)]
    df = spark.createDataFrame(rows, "id int, p array<string>")
    assert Counter((r["first_id"], r["copies"]) for r in collapse(df, "id", set_of_sequences_key(F.col("p"))).collect()) == {(1, 2): 1, (3, 2): 1}
