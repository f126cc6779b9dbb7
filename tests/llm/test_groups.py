import itertools
import random

import pytest

from tessellar.llm.near_dup import Similar, component_labels, record_groups, record_pairs, similar_sets


def test_groups_of_a_randomly_numbered_chain(spark):
    n = 1000
    ids = random.Random(6).sample(range(n), n)
    chain = list(zip(ids, ids[1:]))
    pairs = spark.createDataFrame([(min(p), max(p), 0.8) for p in chain] + [(2000, 2001, 1.0)], "class_a bigint, class_b bigint, likeness double")
    members = spark.createDataFrame([(k, k) for k in [*range(n), 2000, 2001, 3000]], "id bigint, class_id bigint")
    got = {r["id"]: (r["group_id"], r["links"]) for r in record_groups(Similar(members, pairs)).collect()}
    ends = {ids[0], ids[-1]}
    assert got == {k: (0, 1 if k in ends else 2) for k in range(n)} | {2000: (2000, 1), 2001: (2000, 1), 3000: (3000, 0)}


def test_labels_match_union_find(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    parent = {x: x for p in links for x in p if p[0] != p[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = component_labels(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()
    assert len(got) == len(parent) and {r["v"]: r["label"] for r in got} == {x: root(x) for x in parent}


@pytest.mark.parametrize("k,list_rows", [(64, 2000), (24, 5)])
def test_sketches_of_large_sets_lose_no_pair(spark, k, list_rows):
    rng = random.Random(8)
    common = [f"c{j}" for j in range(60)]
    rows = []
    for g in range(25):
        core = [f"g{g}w{j}" for j in range(rng.randrange(30, 300))] + rng.sample(common, 30)
        for v in range(6):
            w = [x for x in core if rng.random() > rng.choice([0.02, 0.1, 0.18])]
            rows.append((f"{g:02}-{v}", w + [f"n{g}{v}{j}" for j in range(rng.randrange(0, len(core) // 6))]))
    sets = {i: set(w) for i, w in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    found = similar_sets(spark.createDataFrame(rows, "id string, words array<string>"), "id", "words", 0.7, k=k, list_rows=list_rows)
    got = {tuple(r) for r in record_pairs(found).collect()}
    assert len(want) > 80 and got <= want and len(got) >= 0.99 * len(want)
