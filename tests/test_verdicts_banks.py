import random

import pytest
from pyspark.sql import functions as F

from tessellar.functions.commands import needs_placeholders, placeholder_line
from tessellar.functions.text import near_edit
from tessellar.operators import banks as B
from tessellar.operators import projections as P
from tessellar.operators import verdicts as V
from tessellar.sources.readers import open_table
from tessellar.streaming.observe import near_text

CASE = "id int, expected_ids array<string>, commands array<string>, examples array<string>, simplest string, prefer_simplest boolean, actual_id string, actual_command string, actual_example string"


def test_grades(spark):
    ok = (["git log"], ["git log -1", "git log -n 1"], "git log -1", True)
    rows = [
        (1, ["r1"], *ok, "r1", "", ""),
        (2, None, *ok, None, None, None),
        (3, None, *ok, "x", "git log -1", "git log -1"),
        (4, None, *ok, "x", "git log -n 1", "git log -n 1"),
        (5, None, ok[0], ok[1], ok[2], False, "x", "git log -n 1", "git log -n 1"),
        (6, None, *ok, "x", "git log --all", "git log --all"),
        (7, None, *ok, "x", "git push", "git push"),
        (8, None, None, None, None, None, "x", "git push", "git push"),
    ]
    g = V.grade(spark.createDataFrame(rows, CASE).withColumn("clash", F.lit(1)))
    assert {r["id"]: (r["score"], r["passed"]) for r in g.collect()} == {1: (5, True), 2: (1, False), 3: (5, True), 4: (4, False), 5: (5, True), 6: (3, False), 7: (1, False), 8: (1, False)}
    assert V.suite(g).first().asDict() == {"cases": 8, "passed": 3, "pass_rate": 3 / 8, "mean_score": 25 / 8}
    assert V.suite(g.limit(0)).first().asDict() == {"cases": 0, "passed": 0, "pass_rate": 0.0, "mean_score": 0.0}


def test_miss_classes(spark):
    rows = [
        (1, "q", "log", "log", True, None, True, "ok", 1.0, True),
        (2, "q", "log", None, False, None, False, "miss", None, True),
        (3, "undo it", "revert", "reset", True, None, False, "ko", 0.1, True),
        (4, "git log then git push", "log", "log", True, None, False, "ko", 0.1, False),
        (5, "q", "log", "push", True, None, False, "ko", 0.1, None),
        (6, "list and delete", "log", "show", True, "flag", False, "ko", 0.1, True),
        (7, "plain", "log", "log", True, None, False, "ko", 0.5, True),
        (8, None, None, None, True, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, query_text string, expected string, shown string, displayed boolean, mutation_kind string, passed boolean, via string, utility double, covered boolean")
    edges = spark.createDataFrame([("log", "show"), ("show", "log")], "verb string, kin string")
    got = V.miss_class(df, edges)
    assert {r["id"]: r["miss_class"] for r in got.collect()} == {1: "other", 2: "retrieval_sibling", 3: "destructive_alt", 4: "coverage_gap", 5: "retrieval_sibling", 6: "over_ask", 7: "partial_multistep", 8: "other"}
    counts = {r["class"]: r["rows"] for r in V.by_class(got.unionByName(got.limit(1).withColumn("miss_class", F.lit("odd"))), "miss_class").collect()}
    assert counts == {"partial_multistep": 1, "over_ask": 1, "retrieval_sibling": 2, "destructive_alt": 1, "coverage_gap": 1, "other": 3}
    assert V.regression_accuracy(df.select(F.col("id").alias("query_id"), F.lit("x").alias("expected")).limit(0), *[spark.createDataFrame([], "query_id int, id string, rank int")] * 2).first().asDict() == {"total": 0, "hits": 0, "accuracy": 1.0, "ok": False}
    assert V.observed_hit_rate(spark.createDataFrame([], "s string, c double, n int"), "s", "c", "n").first()["hit_rate"] is None


@pytest.mark.parametrize("text,value", [('{"a": [1, 2]}', {"a": [1, 2]}), ('say ```json\n{"a": 1}\n``` ok', {"a": 1}), ('{"a": 1, "b": [1, 2, {"c": "x', {"a": 1, "b": [1, 2, {"c": "x"}]} ), ('[{"a": "q\\"}"}, {"b', [{"a": 'q"}'}, {}]), ('{"a": "b", "c', {"a": "b"}), ("no json", None), ("", None), (None, None), ("{", {})])
def test_loose_json(text, value):
    got = P.loose_json(text)
    if text and text.endswith('"x'):
        assert got in (value, {"a": 1, "b": [1, 2, {}]})
    else:
        assert got == value


def test_stored_form():
    assert placeholder_line("git commit -m 'a b' notes.txt") == "git commit -m <message> <file>"
    assert placeholder_line("git reset HEAD") == "git reset <branch>" and placeholder_line("git -c x.y=1 Log") == "git -c <config> Log"
    assert placeholder_line(None) == "" and placeholder_line("git config User.Email me@example.com") == "git config User.Email <email>"
    assert needs_placeholders("git switch main") and not needs_placeholders("git  switch   <branch>") and not needs_placeholders(None)


def test_near_text_is_near_edit(spark):
    rng = random.Random(4)
    words = ["undo", "the", "last", "commit", "commits", "undoo", "x", ""]
    pairs = [(" ".join(rng.choice(words) for _ in range(rng.randrange(4))), " ".join(rng.choice(words) for _ in range(rng.randrange(4)))) for _ in range(300)] + [(None, "a"), ("a" * 70, "a" * 69 + "b")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", near_edit(F.col("a"), F.col("b")).alias("n"))
    assert all(near_text(r["a"], r["b"]) == r["n"] for r in df.collect())


def test_diverse_picks(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("abc"), rng.choice("uvwxyz")) for k in range(60)]
    left, picks, fx, vs = list(rows), [], set(), set()
    while left and len(picks) < 14:
        i = next((i for i, r in enumerate(left) if r[1] not in fx and r[2] not in vs), None)
        i = next((i for i, r in enumerate(left) if r[2] not in vs), 0) if i is None else i
        r = left.pop(i)
        picks.append(r[0])
        fx.add(r[1])
        vs.add(r[2])
    df = spark.createDataFrame(rows, "id int, f string, v string")
    assert [r["id"] for r in B.diverse(df, "f", "v", "id", 14).orderBy("pick").collect()] == picks
    assert B.diverse(df.limit(0), "f", "v", "id", 3).count() == 0 and B.diverse(df, "f", "v", "id", 100).count() == 60


def test_patches_cells_and_sets(spark):
    nodes = spark.createDataFrame([("r", None, "root", None), ("a", "r", "A", ["x", "y"]), ("b", "r", "B", ["y", "z"]), ("c", "b", "C", ["w"]), ("d", "r", "D", None)], "id string, parent_id string, name string, commands array<string>")
    merges = spark.createDataFrame([("a", "b", 1), ("d", "b", 2), ("gone", "zz", 3)], "keep_id string, drop_id string, place int")
    got = {r["id"]: (r["name"], r["commands"]) for r in B.patched(nodes, spark.createDataFrame([("r", "Root")], "id string, name string"), merges, 2).collect()}
    assert got == {"r": ("Root", None), "a": ("A", ["x", "y"]), "d": ("D", ["y", "z"])}
    marks = spark.createDataFrame([("p", "q", "skipped"), ("p", "q", "filled"), ("p", "z", "filled"), ("s", "q", "skipped"), (None, "q", "filled")], "a string, b string, st string")
    cells = B.cell_states(marks, ["p", "s"], ["q", "t"], "a", "b", "st")
    assert B.cell_totals(cells).first().asDict() == {"filled": 1, "skipped": 1, "empty": 2, "total": 4, "all_decided": False}
    ids = spark.createDataFrame([("[1, 2 2, x]",), ("7",), (None,)], "v string").select(B.id_set(F.col("v")).alias("i")).collect()
    assert [r["i"] for r in ids] == [[1, 2], [7], []]
    late = spark.createDataFrame([(1, 10), (1, 20), (2, 15), (2, None), (3, 30)], "b int, ms bigint")
    assert {r["b"]: (r["rows"], r["late"]) for r in B.late_rows(late, "b", "ms").collect()} == {1: (2, 0), 2: (2, 1), 3: (1, 0)}
    assert B.lookback_ms(10 * 86_400_000, "nonsense") == 3 * 86_400_000 and B.lookback_ms(0, "1970-01-02T00:00:00Z") == 86_400_000


def test_acceptance_and_adapters(spark):
    rows = spark.createDataFrame([(1, "log", ["log"]), (2, "show the history now", ["log"]), (3, "log of the newest commits", ["log"]), (4, "LOG of the newest commits!", ["cherry-pick"]), (5, "please cherry pick one commit over", ["cherry-pick"]), (6, "find what introduced a specific string", []), (7, None, [])], "id int, text string, verbs array<string>")
    prior = spark.createDataFrame([("log of the newest commits",), ("please, cherry pick one commit over here",), (None,)], "text string")
    got = {r["id"]: r["reason"] for r in B.acceptance(rows, prior).collect()}
    assert got == {1: "too_short", 2: "missing_verb_token", 3: "exact_dup", 4: "missing_verb_token", 5: "near_dup", 6: "generic_template", 7: "too_short"}
    with pytest.raises(ValueError):
        open_table(spark, "nothing", "", "")
    with pytest.raises(ValueError):
        B.active_bank({}, "text")


def test_miss_classes_of_a_bank_that_names_one_command(spark, tmp_path):
    import re

    import __spark_entry__ as entry

    n = 1500
    step = "array(named_struct('command', 'git commit -m x', 'comment', ''), named_struct('command', 'git push', 'comment', ''))"
    spark.range(n).selectExpr("concat('r', id) as id", f"{step} as commands", "0.1d as risk").write.parquet(f"{tmp_path}/recipes.parquet")
    spark.range(n).selectExpr("concat('g', id) as report_id", "concat('git commit and git push ', id) as query_text", "concat('r', id) as command_id", "if(id % 2 = 0, 'golden', 'extended') as kind", "cast(null as string) as mutation_kind", "'git commit' as primary_verb").write.parquet(f"{tmp_path}/golden_report.parquet")
    assert {r["miss_class"] for r in entry.queries()["miss_classes"](spark, str(tmp_path)).collect()} == {"other"}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    metrics = store.executionMetrics(store.executionsList().last().executionId()).values().mkString(";").split(";")
    assert max(int(m.replace(",", "")) for m in metrics if re.fullmatch(r"[\d,]+", m)) < 100_000
