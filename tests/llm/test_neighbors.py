import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.llm import neighbors as N


def table(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(max(1, n // 20), dim))
    return (centers[rng.integers(len(centers), size=n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)


def brute(ids, m, k):
    u = N.unit(m)
    order = np.argsort(np.array(ids))
    u, ids = u[order], [ids[i] for i in order]
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {ids[i]: [ids[j] for j in top[i]] for i in range(len(ids))}


def frame(spark, ids, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, m)], "id string, embedding array<float>")


@pytest.mark.parametrize("list_rows", [4000, 15])
def test_recall(spark, list_rows):
    m = table(1200, 32)
    ids = [f"v{k:05}" for k in range(len(m))]
    got = {}
    for r in N.nearest(frame(spark, ids, m), "id", "embedding", k=5, dim=32, parts=8, rerank=32, list_rows=list_rows).collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    true = brute(ids, m, 5)
    assert got.keys() == true.keys() and all(len(v) == 5 and k not in v for k, v in got.items())
    assert sum(len(set(got[i]) & set(true[i])) for i in true) / (5 * len(true)) >= 0.93


def test_recall_at_full_width(spark):
    m = table(2500, 384, 5)
    ids = [f"v{k:05}" for k in range(len(m))]
    got = {}
    for r in N.nearest(frame(spark, ids, m), "id", "embedding").collect():
        got.setdefault(r["id"], set()).add(r["neighbor"])
    true = brute(ids, m, 5)
    assert sum(len(got[i] & set(true[i])) for i in true) / (5 * len(true)) >= 0.95


def test_copies_bad_vectors_and_ties(spark):
    m = table(40, 8, 1)
    ids = [f"v{k:02}" for k in range(40)]
    df = frame(spark, [*ids, *[f"c{k:02}" for k in range(30)]], np.concatenate([m, np.repeat(m[:1], 30, axis=0)]))
    bad = spark.createDataFrame([("n", None), ("e", []), ("s", [1.0]), ("l", [1.0] * 9), ("z", [0.0] * 8), ("i", [float("inf")] * 8), ("q", [float("nan")] * 8), ("h", [None] * 8), (None, [1.0] * 8)], "id string, embedding array<float>")
    got = {}
    for r in N.nearest(df.unionByName(bad).withColumn("d", F.lit(1)), "id", "embedding", k=3, dim=8, parts=4).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbor"]
    assert set(got) == {*ids, *[f"c{k:02}" for k in range(30)]}
    assert got["c00"] == {1: "c01", 2: "c02", 3: "c03"} and got["c29"] == {1: "c00", 2: "c01", 3: "c02"} and got["v00"] == {1: "c00", 2: "c01", 3: "c02"}
    assert N.nearest(df.limit(0), "id", "embedding", dim=8, parts=4).count() == 0
    assert N.nearest(bad, "id", "embedding", dim=8, parts=4).count() == 0
    assert {r["neighbor"] for r in N.nearest(df.filter("id in ('v01', 'v02')"), "id", "embedding", dim=8, parts=4).collect()} == {"v01", "v02"}


def test_packing_loses_nothing():
    rng = np.random.default_rng(3)
    m = np.concatenate([np.round(rng.normal(size=(5, 16)), 4), rng.normal(size=(4, 16)), 1e9 * rng.normal(size=(2, 16))]).astype(np.float32)
    assert (N.unpack(N.pack(m)) == m).all() and N.unpack(N.pack(m[:0])).shape == (0, 16)


def test_unit_of_extreme_lengths():
    u = N.unit(np.array([[3e38, 3e38], [1e-38, 0.0]], dtype=np.float32))
    assert np.allclose((u * u).sum(axis=1), 1)
