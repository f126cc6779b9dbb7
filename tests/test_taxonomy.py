import pytest

from tessellar.operators import taxonomy as tax


def test_deep_trees(spark):
    rows = [(f"n{k}", f"n{k - 1}" if k else None, str(k)) for k in range(13)]
    n = spark.createDataFrame(rows, "id string, parent_id string, name string")
    got = {r["id"]: (r["depth"], r["path"], r["is_leaf"]) for r in tax.tree_paths(n).collect()}
    assert got == {f"n{k}": (k, "/".join(map(str, range(k + 1))), k == 12) for k in range(13)}
    assert [r["id"] for r in tax.without_subtrees(n, n.filter("id = 'n1'").select("id")).collect()] == ["n0"]


def test_cycles(spark):
    n = spark.createDataFrame([("a", None, "A"), ("a", "b", "A"), ("b", "a", "B"), ("c", None, "C")], "id string, parent_id string, name string")
    with pytest.raises(ValueError):
        tax.tree_paths(n)
    assert [r["id"] for r in tax.without_subtrees(n, n.filter("id = 'b'").select("id")).collect()] == ["c"]
