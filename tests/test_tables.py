import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.operators import catalog as cat
from tessellar.operators import coverage as cov
from tessellar.operators import evaluation as ev
from tessellar.operators import similarity as sim
from tessellar.operators import taxonomy as tax
from tessellar.sources import readers, writers
from tessellar.streaming import observe

DATA = "/root/testdata/sf0.001"


def test_merge_folds_donors(spark):
    rows = [("k", "a", "short", "T1", ["p1"], ["x"], True), ("k", "b", "a much longer description", "T2", ["p2", "p1"], ["y", None], False), ("m", "c", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "key string, id string, description string, title string, paraphrases array<string>, tags array<string>, validated boolean")
    got = {r["key"]: r for r in cat.merge_groups(df, ["key"]).collect()}
    assert got["k"]["id"] == "a" and got["k"]["records"] == 2 and got["k"]["description"] == "a much longer description"
    assert got["k"]["paraphrases"] == ["T2", "p1", "p2", "short"] and got["k"]["tags"] == ["x", "y"]
    assert got["m"]["records"] == 1 and got["m"]["paraphrases"] == []


def test_upsert_and_append(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, ver int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "id int, v string, ver int")
    assert sorted(map(tuple, cat.upsert(old, new, "id", "ver").collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    df = spark.createDataFrame([(["a"], " b "), (["a"], "a"), (None, "x"), (["a"], None)], "l array<string>, v string")
    assert [r[0] for r in df.select(cat.append_absent(F.col("l"), F.col("v"))).collect()] == [["a", "b"], ["a"], ["x"], ["a"]]


def test_greedy_keep_is_order_dependent(spark):
    nodes = spark.createDataFrame([(k,) for k in range(1, 8)], "id bigint")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (6, 7), (5, 7)], "a bigint, b bigint")
    got = {r["id"]: (r["kept"], r["leader"]) for r in sim.greedy_keep(nodes, links).collect()}
    assert got == {1: (True, 1), 2: (False, 1), 3: (True, 3), 4: (False, 3), 5: (True, 5), 6: (False, 5), 7: (False, 5)}
    assert [tuple(r) for r in sim.clusters(sim.greedy_keep(nodes, links)).collect()] == [(5, 3)]


def test_token_links_match_brute_force(spark):
    import itertools
    import random

    rng = random.Random(4)
    words = ["undo", "last", "commit", "branch", "merge", "the", "file", "stash"]
    rows = [(k, " ".join(rng.sample(words, rng.randrange(3, 8)))) for k in range(60)] + [(100, None), (101, "a b")]
    got = {(r["a"], r["b"]) for r in sim.token_links(spark.createDataFrame(rows, "id bigint, t string"), "id", "t", 0.7).collect()}
    sets = {k: {w for w in (t or "").split() if len(w) > 2} for k, t in rows}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}


def test_coverage_helpers(spark):
    need = spark.createDataFrame([("n1", ["a", "b"]), ("n2", ["z"]), ("n3", [])], "need_id string, verbs array<string>")
    have = spark.createDataFrame([("h1", ["a", "b", "c"]), ("h2", ["a"]), ("h3", ["b", "a", "a"])], "have_id string, verbs array<string>")
    assert [tuple(r) for r in cov.covered_sets(need, have).collect()] == [("n1", 2)]
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 1)], "id int, parent int")
    assert sorted(r["id"] for r in cov.childless(rows, "id", "parent").collect()) == [2, 3]
    req = spark.createDataFrame([("x",)], "verb string")
    c = spark.createDataFrame([("x", True)], "verb string, saturated boolean")
    assert cov.all_saturated(req, c).first()[0] is True and cov.all_saturated(req.limit(0), c).first()[0] is False and cov.all_saturated(req, c.limit(0)).first()[0] is False


def test_evaluation_conventions(spark):
    empty = spark.createDataFrame([], "query_id string, hit_display boolean, hit_family boolean, hit_deep boolean")
    assert ev.bank_totals(empty).first()["hit_rate"] == 1.0 and ev.bank_totals(empty).first()["total"] == 0
    v = spark.createDataFrame([("a", 0.8), ("a", float("nan")), ("a", 0.9), ("b", None)], "q string, u double")
    assert {r["q"]: (r["median"] and round(r["median"], 9), r["good"]) for r in ev.vote_medians(v, "q", "u", 0.8).collect()} == {"a": (0.85, True), "b": (None, False)}
    bank = spark.createDataFrame([("q", "x"), ("p", "y")], "query_id string, expected string")
    res = spark.createDataFrame([("q", "c", 1), ("q", "x", 4)], "query_id string, id string, rank int")
    lin = spark.createDataFrame([("c", "x")], "child string, parent string")
    assert {r["query_id"]: (r["hit_display"], r["hit_deep"], r["hit_family"]) for r in ev.hits(bank, res, lin).collect()} == {"q": (False, True, True), "p": (False, False, False)}


def test_taxonomy(spark):
    text = "intro  line\nMain Porcelain Commands\n   add      Add contents\n   commit   Record  changes\n\nAncillary Commands / Manipulators\n   config   Get options\n   x\nInteracting with Others\n   archimport  Import\n"
    lines = spark.createDataFrame([("d", k, x) for k, x in enumerate(text.split("\n"))], "doc string, line_no int, line string")
    assert [(r["section"][:4], r["name"]) for r in tax.parse_help_listing(lines).orderBy("name").collect()] == [("Main", "add"), ("Main", "commit"), ("Anci", "config")]
    n = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("d", None, "D")], "id string, parent_id string, name string")
    assert {r["id"]: (r["path"], r["is_leaf"]) for r in tax.tree_paths(n).collect()} == {"a": ("A", False), "b": ("A/B", False), "c": ("A/B/C", True), "d": ("D", True)}
    assert sorted(r["id"] for r in tax.without_subtrees(n, n.filter("id = 'b'")).collect()) == ["a", "d"]
    s = spark.createDataFrame([(1, "Add files"), (2, "add  FILES!"), (3, "--")], "k int, n string")
    assert [r["slug"] for r in tax.unique_slugs(s, "k", "n").orderBy("k").collect()] == ["add-files", "add-files-2", "node"]


def test_sources(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"report_id":"1","query_text":"a"}\nbroken\n{"report_id":"2"}\n')
    assert readers.read_jsonl(spark, str(p), readers.BANK).count() == 2
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), readers.BANK).count() == 0
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(p), readers.BANK, strict=True).collect()
    recipe = {"id": "r", "title": "t", "commands": [{"command": "git log"}]}
    for k, doc in enumerate(([recipe], {"recipes": [recipe]})):
        f = tmp_path / f"c{k}.json"
        f.write_text(json.dumps(doc))
        assert readers.read_catalog_json(spark, str(f)).select("id", F.size("commands")).collect() == [("r", 1)]
    with pytest.raises(ValueError):
        f = tmp_path / "e.json"
        f.write_text("[]")
        readers.read_catalog_json(spark, str(f))
    t = spark.createDataFrame([('{"columns":["uuid","event"],"results":[["u1","cli_search"],["u2",null]]}',)], "j string")
    assert [tuple(r) for r in t.select(F.inline(readers.rows_from_tuples(F.col("j"), ["event", "uuid", "other"]))).collect()] == [("cli_search", "u1", None), (None, "u2", None)]
    q = spark.createDataFrame([('{"a":"1"}',), ("[1]",), ("x",), (None,)], "p string")
    assert [r[0]["a"] for r in q.select(readers.properties(F.col("p"), "struct<a:string>")).collect()] == ["1", None, None, None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    root = str(tmp_path / "cat")
    assert writers.publish(df, root) == 1 and writers.publish(df.limit(1), root) == 2
    assert writers.read_version(spark, root).count() == 1 and writers.read_version(spark, root, 1).count() == 2
    assert writers.checksum(df) == writers.checksum(df.orderBy(F.desc("id")).repartition(3)) and writers.verify(df, "x") == "mismatch" and writers.verify(df, None) == "missing_checksum"
    meta = str(tmp_path / "meta")
    writers.put_meta(spark, meta, {"schema_version": "9", "x": None})
    writers.put_meta(spark, meta, {"x": "1"})
    assert writers.read_meta(spark, meta) == {"schema_version": "9", "x": "1"}
    writers.require_version({"schema_version": "9"}, "schema_version", "9")
    with pytest.raises(ValueError):
        writers.require_version({}, "schema_version", "9")
    v = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [1.0]), ("c", None)], "id string, e array<float>")
    back = readers.decode_vectors(writers.encode_vectors(v, "e"), "vec", 2)
    assert [(r["id"], list(np.round(r["embedding"], 3))) for r in back.collect()] == [("a", [1.0, 2.0])]
    writers.append_routed(df, str(tmp_path / "m"), str(tmp_path / "o"), F.col("v").isNull())
    assert spark.read.json(str(tmp_path / "m")).count() == 1 and spark.read.json(str(tmp_path / "o")).count() == 1
    assert "| a | 1 |" in writers.stats_markdown({"a": 1}, "t")


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_streams(spark, tmp_path):
    src = spark.read.parquet(f"{DATA}/observe_events.parquet")
    folder = tmp_path / "in"
    src.coalesce(1).write.parquet(str(folder))
    stream = lambda: observe.once(spark.readStream.schema(src.schema).parquet(str(folder)), "3650 days")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        observe.run_to_table(stream().select("event_id", "key"), str(tmp_path / "once"), str(tmp_path / "ck1")).awaitTermination()
        ids = observe.event_times(src).select("event_id").distinct().count()
        assert spark.read.parquet(str(tmp_path / "once")).count() == ids
        observe.run_to_table(observe.without_bursts(stream()), str(tmp_path / "kept"), str(tmp_path / "ck2")).awaitTermination()
        assert 0 < spark.read.parquet(str(tmp_path / "kept")).count() < ids
        observe.run_to_table(observe.hard_sessions(observe.event_times(spark.readStream.schema(src.schema).parquet(str(folder))).withWatermark("at", "1 hour")), str(tmp_path / "sess"), str(tmp_path / "ck3")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "sess")).count() > 0
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_covered_sets_meets_each_set_once(spark):
    import re

    need = spark.range(2000).selectExpr("id as need_id", "if(id % 2 = 0, array('a', 'b'), array('b', 'a', 'z')) as verbs")
    have = spark.range(2000).selectExpr("id div 2 as have_id", "if(id % 2 = 0, array('a', 'c', 'b'), array('b')) as verbs")
    got = cov.covered_sets(need, have).collect()
    assert sorted(r["need_id"] for r in got) == list(range(0, 2000, 2)) and {r["covering"] for r in got} == {1000}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    metrics = store.executionMetrics(store.executionsList().last().executionId()).values().mkString(";").split(";")
    # two million pairs of rows share an element
    assert max(int(m.replace(",", "")) for m in metrics if re.fullmatch(r"[\d,]+", m)) < 100_000


def test_covered_sets_nulls_and_repeats(spark):
    need = spark.createDataFrame([("n1", ["a", None]), ("n2", ["b", "a", "b"]), ("n3", None), ("n4", ["a"])], "need_id string, verbs array<string>")
    have = spark.createDataFrame([("h1", ["a", None, "b"]), ("h2", ["a"]), ("h2", ["a"]), (None, ["b", "a"]), ("h3", None), ("h4", [])], "have_id string, verbs array<string>")
    assert sorted(tuple(r) for r in cov.covered_sets(need, have).collect()) == [("n2", 2), ("n4", 4)]
