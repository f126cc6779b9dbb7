import random

import numpy as np

from tessellar.operators import similarity as sim
from tessellar.operators import vectors
from tessellar.operators.vectors import close_pairs
from tessellar.plans.catalog_queries import leader_clusters


def test_leader_clusters_of_a_dense_group(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(150, 64))
    v[::2] = v[0] + 0.1 * rng.normal(size=(75, 64))
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(150, None), (151, [0.0] * 64), (None, v[0].tolist())]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = np.round(u @ u.T, 12) >= 0.3
    pairs = close_pairs(spark.createDataFrame(rows, "id bigint, embedding array<double>"), 0.3, dim=64)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(a, b) for a in range(150) for b in range(a + 1, 150) if near[a, b]]
    leader = {}
    for k in range(150):
        leader[k] = next((j for j in range(k) if leader[j] == j and near[j, k]), k)
    sizes = {j: sum(x == j for x in leader.values()) for j in set(leader.values())}
    assert {(r["leader"], r["members"]) for r in leader_clusters(spark, str(tmp_path)).collect()} == {(j, n) for j, n in sizes.items() if n >= 3}
    assert sizes[0] >= 75


def test_close_pairs_over_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 8 * 2 * 3)
    monkeypatch.setattr(vectors, "SCORES", 4)
    df = spark.createDataFrame([(f"k{k}", [1.0, float(k % 2)]) for k in range(10)], "id string, embedding array<double>")
    got = sorted((r["a"], r["b"]) for r in close_pairs(df, 0.9, dim=2).collect())
    assert got == [(f"k{a}", f"k{b}") for a in range(10) for b in range(a + 1, 10) if a % 2 == b % 2]
    assert close_pairs(df.limit(0), 0.9, dim=2).count() == 0


def in_order(ids, links):
    near = {k: set() for k in ids}
    for a, b in links:
        near[max(a, b)].add(min(a, b))
    leader = {}
    for k in sorted(ids):
        leader[k] = min((j for j in near[k] if j != k and leader[j] == j), default=k)
    return {k: (j == k, j) for k, j in leader.items()}


def test_greedy_keep_on_a_chain_in_id_order(spark):
    ids = list(range(1, 301))
    links = list(zip(ids, ids[1:]))
    got = sim.greedy_keep(spark.createDataFrame([(k,) for k in ids], "id bigint"), spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r["id"]: (r["kept"], r["leader"]) for r in got.collect()} == in_order(ids, links)


def test_greedy_keep_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(sim, "RANGE_LINKS", 150)
    rng = random.Random(8)
    ids = [f"k{k:03}" for k in range(200)]
    links = list(zip(ids, ids[1:])) + [tuple(rng.sample(ids, 2)) for _ in range(300)] + [("k007", "k007")]
    got = sim.greedy_keep(spark.createDataFrame([(k,) for k in [*ids, "z"]], "id string"), spark.createDataFrame(links, "a string, b string"))
    assert {r["id"]: (r["kept"], r["leader"]) for r in got.collect()} == in_order([*ids, "z"], links)
    assert sim.greedy_keep(got.select("id"), spark.createDataFrame([], "a string, b string")).filter("kept").count() == 201
