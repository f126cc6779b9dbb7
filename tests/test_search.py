import random
import sqlite3
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessellar.config import SearchConfig
from tessellar.operators.fulltext import bm25, build_index
from tessellar.operators.ranking import collapse_channels, diversify, fuse, gate, head_scores
from tessellar.operators.vectors import knn
from tessellar.plans.hybrid import displayed, hybrid_search, load_catalog, open_catalog, save_catalog

RECIPES = [
    ("r-undo", "Soft reset last commit", "undo last commit keep files", ["undo"], "undo", [], "synthetic", True, [("git reset --soft HEAD~1", "keep staged")], "", 0.4),
    ("r-status", "Show status", "show working tree status", ["inspect"], "inspect", [], "synthetic", True, [("git status", "show tree")], "", 0.05),
    ("r-stash", "Stash untracked", "stash untracked changes", ["stash"], "stash", [], "synthetic", True, [("git stash push -u", "stash dirty")], "", 0.2),
]
SCHEMA = "id string, title string, description string, tags array<string>, taxonomy_leaf string, paraphrases array<string>, provenance string, validated boolean, commands array<struct<command:string,comment:string>>, initial_state string, risk double"


def test_hybrid_finds_the_recipe(spark):
    cat = open_catalog(spark.createDataFrame(RECIPES, SCHEMA))
    q = spark.createDataFrame([("a", "undo last  commit keep files"), ("b", "reset --soft"), ("c", "   "), ("d", None), ("e", "git status")], "query_id string, query string")
    results, gates = hybrid_search(q, cat)
    rows = results.collect()
    for k in "ab":
        assert "r-undo" in [r["id"] for r in rows if r["query_id"] == k and r["rank"] <= 3]
    g = {r["query_id"]: r for r in gates.collect()}
    assert set(g) == set("abcde") and g["c"]["status"] == "empty" and g["d"]["alert"] == "red" and g["a"]["status"] == "ok"
    assert next(r for r in rows if r["query_id"] == "e" and r["rank"] == 1)["id"] == "r-status"
    assert all(r["display_rank"] <= 3 for r in displayed(results, gates).collect())


def test_bm25_equals_sqlite(spark):
    try:
        con = sqlite3.connect(":memory:")
        con.execute("create virtual table t using fts5(id unindexed, body, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("sqlite without FTS5")
    rng = random.Random(1)
    vocab = ["undo", "last", "commit", "file.txt", "Café", "head", "the", "git", "file", "txt"]
    docs = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 30)))) for k in range(60)]
    con.executemany("insert into t values (?, ?)", docs)
    queries = [(0, ["undo"]), (1, ["last", "commit"]), (2, ["file.txt"]), (3, ["cafe", "the", "git"]), (4, ["nothing"]), (5, ["the", "the"])]
    d = spark.createDataFrame(docs, "id bigint, body string")
    got = {(r["query_id"], r["doc_id"]): r["bm25"] for r in bm25(spark.createDataFrame([(k, " ".join(t)) for k, t in queries], "query_id int, query string"), *build_index(d, "id", F.col("body"))).collect()}
    want = {(k, r[0]): r[1] for k, t in queries for r in con.execute("select id, bm25(t) from t where t match ?", [" AND ".join(f'"{x}"' for x in t)])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_query_of_punctuation_matches_nothing(spark):
    d = spark.createDataFrame([(1, "a b")], "id bigint, body string")
    q = spark.createDataFrame([(1, "***"), (2, "a ?"), (3, "")], "query_id int, query string")
    assert bm25(q, *build_index(d, "id", F.col("body"))).count() == 0


def test_knn_ties_and_bad_vectors(spark):
    v = [("a", [0.0, 1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [0.5, 0.5, 0.0]), ("d", [2.0, 0.0, 0.0]), ("z", [0.0, 0.0, 0.0]), ("s", [1.0]), ("n", None), (None, [1.0, 0.0, 0.0])]
    c = spark.createDataFrame(v, "id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])], "query_id int, embedding array<double>")
    assert [(r["doc_id"], r["rank"]) for r in knn(q, c, 3, dim=3).orderBy("rank").collect()] == [("b", 1), ("d", 2), ("c", 3)]
    assert knn(q.limit(0), c, 3, dim=3).count() == 0 and knn(q, c.limit(0), 3, dim=3).count() == 0


def test_fusion_of_channels(spark):
    v = spark.createDataFrame([("q", "r1", 0.5), ("q", "r1", 0.9), ("q", "r2", 0.1), ("p", "x", 0.3)], "query_id string, id string, cosine double")
    t = spark.createDataFrame([("q", "r7", -3.5), ("q", "r1", -7.0)], "query_id string, id string, bm25 double")
    got = {(r["query_id"], r["id"]): r for r in fuse(collapse_channels(v, t)).collect()}
    assert len(got) == 4 and got["q", "r7"]["cosine"] is None and got["q", "r1"]["cosine"] == 0.9
    assert abs(got["q", "r1"]["score"] - 1.0) < 1e-12 and got["q", "r2"]["score"] == 0.0 and got["p", "x"]["score"] == 1.0


def test_diversity_and_heads(spark):
    h = spark.createDataFrame([("q", "1", 1, 0.7, "f"), ("q", "2", 2, 0.58, "f"), ("q", "3", 3, 0.4, "g"), ("p", "1", 1, 0.9, "f"), ("p", "2", 2, 0.8, "f")], "query_id string, id string, rank int, score double, fingerprint string")
    assert sorted((r["query_id"], r["id"]) for r in diversify(h, count=2).collect()) == [("p", "1"), ("q", "1"), ("q", "3")]
    s = {r["query_id"]: (r["s1"], r["s2"], r["n"]) for r in head_scores(h.withColumns({"cosine": F.lit(0.9), "bm25": F.lit(None).cast("double"), "boost": F.lit(0.0)})).collect()}
    assert s == {"q": (0.7, 0.4, 2), "p": (0.9, None, 1)}


@pytest.mark.parametrize(
    "s1,s2,n,c1,b1,boost,count,alert",
    [(0.95, 0.7, 5, 0.9, -1.0, 0.0, 1, "none"), (0.8, 0.7, 5, 0.9, None, 0.0, 2, "yellow"), (0.5, 0.4, 5, 0.9, None, 0.0, 3, "orange"), (0.95, 0.2, 5, 0.4, None, 0.0, 0, "red"), (0.95, 0.2, 5, None, None, 0.25, 1, "none"), (1.0, 1.0, 5, 0.9, None, 0.0, 3, "orange"), (0.8, None, 1, 0.9, None, 0.0, 1, "orange")],
)
def test_gate(spark, s1, s2, n, c1, b1, boost, count, alert):
    h = spark.createDataFrame([("q", s1, c1, b1, boost, s2, n)], "query_id string, s1 double, c1 double, b1 double, boost1 double, s2 double, n bigint")
    g = gate(h, SearchConfig()).first()
    assert (g["display_count"], g["alert"]) == (count, alert)


@pytest.mark.parametrize("repeats", [1, 6])
def test_knn_in_lots_equals_brute_force(spark, monkeypatch, repeats):
    from tessellar.operators import vectors

    dim, k = 12, 7
    rng = np.random.default_rng(repeats)
    m = np.tile(rng.integers(-2, 3, (300, dim // repeats)), repeats).astype(float)
    q = np.tile(rng.integers(-2, 3, (40, dim // repeats)), repeats).astype(float)
    c = spark.createDataFrame([(f"d{i:03d}", v.tolist()) for i, v in enumerate(m)], "id string, embedding array<double>").repartition(2)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, embedding array<double>")
    for name, value in (("BLOCK_BYTES", 8 * dim * 9), ("PART_BYTES", 8 * dim * 4), ("LOT_BYTES", 1), ("SCORES", 500)):
        monkeypatch.setattr(vectors, name, value)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["cosine"]) for r in knn(qs, c, k, dim=dim).collect()}
    want = {}
    for i, v in enumerate(q):
        if v.any():
            score = sorted((-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 12), f"d{j:03d}") for j, w in enumerate(m) if w.any())
            want.update({(i, n + 1): (name, -s) for n, (s, name) in enumerate(score[:k])})
    assert got == want


def test_knn_holds_few_scores(spark, monkeypatch):
    taken, original = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, *a, **b: taken.append(f) or original(self, f, *a, **b))
    rng = np.random.default_rng(3)
    q = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(2000, 8)).tolist())], "query_id int, embedding array<double>")
    knn(q, spark.createDataFrame([], "id bigint, embedding array<double>"), 5, dim=8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(rng.normal(size=(10_000, 8)).tolist())], names=["key", "v"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in taken[-1](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all scores of the batch would be 160 MB
    assert rows == 10_000 and peak < 100e6


def test_knn_sorts_after_the_exchange_only(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "id int, embedding array<double>")
    plan = knn(v.withColumnRenamed("id", "query_id"), v, 3, dim=2)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning(query_id") :]
    assert "MapInArrow" in below and "Sort [" not in below and "WindowGroupLimit" not in below


def test_saved_catalog_is_searched_in_little_memory(spark, monkeypatch, tmp_path):
    save_catalog(open_catalog(spark.createDataFrame(RECIPES, SCHEMA)), str(tmp_path))
    cat = load_catalog(spark, str(tmp_path), strict=True)
    taken, original = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, *a, **b: taken.append(f) or original(self, f, *a, **b))
    _, gates = hybrid_search(spark.range(2000).selectExpr("id as query_id", "concat('undo commit ', id) as query"), cat)
    assert gates.count() == 2000
    flat = np.tile(np.random.default_rng(4).normal(size=(8000, 32)), 12).ravel()
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(8000)]), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 384), pa.int32()), pa.array(flat))], names=["key", "v"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in taken[-1](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all scores of the batch would be 128 MB
    assert rows == 2000 * 100 and peak < 100e6


@pytest.mark.parametrize("repeats", [1, 6])
def test_knn_of_many_queries_sends_few_rows(spark, monkeypatch, repeats):
    from tessellar.operators import vectors

    dim, k = 12, 7
    rng = np.random.default_rng(10 + repeats)
    m = np.tile(rng.integers(-2, 3, (300, dim // repeats)), repeats).astype(float)
    q = np.tile(rng.integers(-2, 3, (90, dim // repeats)), repeats).astype(float)
    c = spark.createDataFrame([(f"d{i:03d}", v.tolist()) for i, v in enumerate(m)], "id string, embedding array<double>").repartition(5)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, embedding array<double>")
    for name, value in (("PART_BYTES", 8 * dim * 4), ("SCORES", 500), ("PAIRS", 5000)):
        monkeypatch.setattr(vectors, name, value)
    want = {}
    for i, v in enumerate(q):
        if v.any():
            score = sorted((-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 12), f"d{j:03d}") for j, w in enumerate(m) if w.any())
            want.update({(i, n + 1): (name, -s) for n, (s, name) in enumerate(score[:k])})
    sent, original = [], vectors.top
    monkeypatch.setattr(vectors, "top", lambda df, *a: sent.append(df) or original(df, *a))
    # one block, then several
    for size, blocks in ((64 << 20, 1), (8 * dim * 100 // repeats, 3)):
        monkeypatch.setattr(vectors, "BLOCK_BYTES", size)
        assert {(r["query_id"], r["rank"]): (r["doc_id"], r["cosine"]) for r in knn(qs, c, k, dim=dim).collect()} == want
        assert len(want) <= sent[-1].count() <= 2 * blocks * len(want)
        if blocks == 1:
            assert sent[-1].count() == len(want)


def test_displayed_rows_of_many_queries_come_of_few_sent(spark, monkeypatch):
    from tessellar.operators import vectors
    from tessellar.operators.fulltext import embed_text

    recipes = spark.createDataFrame([(f"r{i:03d}", *RECIPES[0][1:2], f"undo commit {i}", *RECIPES[0][3:]) for i in range(120)], SCHEMA)
    cat = open_catalog(recipes, recipes.select("id", vectors.embed(embed_text()).alias("embedding")).repartition(4))
    sent, original = [], vectors.top
    monkeypatch.setattr(vectors, "top", lambda df, *a: sent.append(df) or original(df, *a))
    shown = displayed(*hybrid_search(spark.range(5).selectExpr("cast(id as string) as query_id", "concat('undo commit ', id) as query"), cat))
    assert {r["query_id"] for r in shown.collect()} == set("01234")
    # four tasks that each send their best would send all 120 a query
    assert sent[-1].count() == 5 * 100


def test_search_sorts_a_bounded_number_of_rows_a_task(spark, monkeypatch):
    from tessellar import session
    from tessellar.operators import fulltext
    from tessellar.plans import hybrid

    recipes = spark.createDataFrame([(f"r{i:03d}", f"notes.v{i % 7} for file.txt", f"undo commit {i}", *RECIPES[0][3:]) for i in range(120)], SCHEMA)
    q = spark.range(12).selectExpr("cast(id as string) as query_id", "concat('undo file.txt notes.v', id) as query")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = [rows(df) for df in hybrid_search(q, open_catalog(recipes))]
    kept = []
    for module in (fulltext, hybrid):
        monkeypatch.setattr(module, "cut_lineage", lambda df, original=module.cut_lineage: kept.append(original(df)) or kept[-1])
    monkeypatch.setattr(session, "TASK_ROWS", 60, raising=False)
    got = hybrid_search(q, open_catalog(recipes))
    assert [rows(df) for df in got] == want and len(want[0]) >= 1200
    # postings of terms in phrases, hits of phrases, results: 120 texts of 15 words or more, 12 queries with up to 200 hits
    of = {tuple(df.columns): df.rdd.getNumPartitions() for df in kept}
    assert of[tuple(got[0].columns)] >= 40 and of["phrase", "doc_id", "f"] >= 30 and of["term", "doc_id", "pos"] >= 30


def test_vectors_without_a_recipe_are_no_hits(spark):
    recipes = spark.createDataFrame(RECIPES, SCHEMA)
    cat = open_catalog(recipes)
    more = open_catalog(recipes, cat.vectors.unionByName(cat.vectors.filter("id = 'r-stash'").withColumn("id", F.lit("gone"))))
    q = spark.createDataFrame([("a", "stash untracked changes"), ("b", "git status")], "query_id string, query string")
    rows = lambda c: sorted(map(tuple, hybrid_search(q, c)[0].collect()))
    assert rows(more) == rows(cat)
