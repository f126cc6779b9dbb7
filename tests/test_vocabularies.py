from tessellar.plans.hybrid import hybrid_search, open_catalog
from tessellar.plans.intent_queries import flag_verdicts

SCHEMA = "id string, title string, description string, tags array<string>, taxonomy_leaf string, paraphrases array<string>, provenance string, validated boolean, commands array<struct<command:string,comment:string>>, initial_state string, risk double"


def test_any_number_of_verbs(spark):
    verbs = [f"verb{k:04}" for k in range(4200)] + ["very-last"]
    rows = [(v, "Title", "text", [], "leaf", [], "p", True, [(f"git {v}", "")], "", 0.1) for v in verbs]
    unit = [1.0] + [0.0] * 383
    vectors = spark.createDataFrame([("verb4199", unit), ("very-last", unit)], "id string, embedding array<double>")
    q = spark.createDataFrame([(1, "please verb4199 it"), (2, "please verylast it"), (3, "please")], "query_id int, query string")
    qv = spark.createDataFrame([(k, unit) for k in (1, 2, 3)], "query_id int, embedding array<double>")
    results, _ = hybrid_search(q, open_catalog(spark.createDataFrame(rows, SCHEMA), vectors), query_vectors=qv)
    got = {(r["query_id"], r["id"]): r["boost"] for r in results.filter("cosine is not null").collect()}
    assert {k for k, b in got.items() if b > 0} == {(1, "verb4199"), (2, "very-last")} and len(got) == 6


def test_any_number_of_flags(spark, tmp_path):
    line = "git x " + " ".join(f"--flag{k}" for k in range(4100))
    rows = [(f"r{k}", [(line, "")]) for k in range(5)] + [("few", [("git x --own --flag1", "")]), ("no", [("git x --hard", "")]), ("none", None)]
    spark.createDataFrame(rows, "id string, commands array<struct<command:string,comment:string>>").write.parquet(f"{tmp_path}/recipes.parquet")
    got = {r["id"]: r["verdict"] for r in flag_verdicts(spark, str(tmp_path)).collect()}
    assert got == {f"r{k}": "ok" for k in range(5)} | {"few": "not_allowed", "no": "denied", "none": "ok"}
