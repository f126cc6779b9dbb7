from pyspark.sql import functions as F

from tessellar.operators import intents as I


def test_families(spark):
    f = spark.createDataFrame([("checkout", ["switch", "branch"]), ("log", [])], "canonical string, aliases array<string>")
    e = {(r["verb"], r["kin"]) for r in I.family_edges(f).collect()}
    assert ("switch", "checkout") in e and ("checkout", "branch") in e and ("switch", "switch") in e and ("switch", "branch") not in e
    t = spark.createDataFrame([("switch the branch",), ("checkout it",), (None,)], "q string")
    assert [r[0] for r in I.distinguished(f, t, "q").collect()] == ["checkout"]
    m = I.merge_families(f, spark.createDataFrame([("Checkout", ["restore"]), ("tag", None)], "canonical string, aliases array<string>"))
    assert {r["canonical"]: r["aliases"] for r in m.collect()} == {"checkout": ["branch", "restore", "switch"], "log": [], "tag": []}


def test_faithful_intents(spark):
    rows = [("r", ["add", "commit"], k, t) for k, t in enumerate(["git add", "add and commit", "ADD and commit", " ", None, "commit then push", "nothing here", "add; commit", "lost and commit"])]
    df = spark.createDataFrame(rows, "id string, verbs array<string>, pos int, text string")
    traps = spark.createDataFrame([("reflog", "lost and")], "verb string, needle string")
    assert [r["text"] for r in I.faithful_intents(df, traps).orderBy("place").collect()] == ["add and commit", "commit then push"]
    assert I.faithful_intents(df, cap=1).count() == 1 and I.faithful_intents(df.limit(0), traps).count() == 0


def test_split_moves_the_last_id(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("",)], "id string")
    for mille in (0, 1000):
        got = {(r["id"], r["split"]) for r in I.split_by_id(df, "id", mille).collect()}
        assert len(got) == 2 and len({s for _, s in got}) == 2
    assert I.split_by_id(df.filter("id = 'a'"), "id", 0).filter("split = 'train'").count() == 0


def test_flags_and_scramble(spark):
    p = lambda f, a, d: spark.range(1).select(I.flag_problem(F.array(*map(F.lit, f)), F.array(*map(F.lit, a)) if a else F.array().cast("array<string>"), F.array(*map(F.lit, d)))).first()[0]
    assert p(["-f", "-x"], ["-f"], ["-x"]) == "denied" and p(["-f"], [], ["-x"]) == "not_allowed" and p(["-f"], ["-f"], ["-x"]) is None
    df = spark.createDataFrame([("undo the last commit", 3.0), (None, 1.0)], "t string, s double")
    assert [len(r[0]) for r in df.select(I.scrambled("t", "s")).collect()] == [20, 0]
