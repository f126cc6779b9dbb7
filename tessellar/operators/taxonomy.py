"""Trees of goals and help listings (ARR-03, SET-07, SRC-10, HLP-19, STR-05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions.text import slug
from tessellar.session import cut_lineage

#: Sections of the help listing that count.
SECTIONS = ["Main Porcelain Commands", "Ancillary Commands / Manipulators", "Ancillary Commands / Interrogators"]


def tree_paths(nodes: DataFrame) -> DataFrame:
    """ARR-03: ``nodes`` (id, parent_id, name) -> ``id, depth, path, is_leaf``; roots have no parent.  A level a round, until
    there is none; a walk deeper than there are nodes is a cycle and raises."""
    n = cut_lineage(nodes.select("id", "parent_id", "name"))
    most = n.count()
    front = n.filter("parent_id is null").select("id", F.lit(0).alias("depth"), F.col("name").alias("path"))
    walk, depth = front, 0
    while True:
        above = front.select(F.col("id").alias("parent_id"), F.col("path").alias("_above"))
        front = cut_lineage(n.join(above, "parent_id").select("id", F.lit(depth + 1).alias("depth"), F.concat("_above", F.lit("/"), "name").alias("path")))
        if front.isEmpty():
            break
        depth += 1
        if depth >= most:
            raise ValueError("tree_paths: the nodes hold a cycle")
        walk = walk.unionByName(front)
    parents = n.select(F.col("parent_id").alias("id")).distinct().withColumn("_p", F.lit(True))
    return walk.join(parents, "id", "left").select("id", "depth", "path", F.col("_p").isNull().alias("is_leaf"))


def without_subtrees(nodes: DataFrame, dropped: DataFrame) -> DataFrame:
    """SET-07: nodes that are not among, or below, the ``dropped`` ids, at any depth; a cycle is walked once."""
    links = cut_lineage(nodes.select("id", "parent_id"))
    gone = front = cut_lineage(dropped.select("id").distinct())
    while not front.isEmpty():
        below = links.join(front.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id").distinct()
        front = cut_lineage(below.join(gone, "id", "left_anti"))
        gone = cut_lineage(gone.unionByName(front))
    return nodes.join(gone, "id", "left_anti")


def unique_slugs(rows: DataFrame, key: str, name: str) -> DataFrame:
    """STR-05: a slug per row; repeated ones get -2, -3, ... in order of the key."""
    s = F.coalesce(F.nullif(slug(F.col(name), 48), F.lit("")), F.lit("node"))
    n = F.row_number().over(Window.partitionBy("_s").orderBy(key))
    return rows.withColumn("_s", s).withColumn("slug", F.when(n == 1, F.col("_s")).otherwise(F.concat_ws("-", "_s", n))).drop("_s")


def parse_help_listing(lines: DataFrame, sections: list[str] = SECTIONS, stop: str = "Interacting with Others") -> DataFrame:
    """SRC-10: ``lines`` (doc, line_no, line) of help listings -> ``doc, section, name, summary``; rows before the first known
    section and from the stop line on don't count."""
    t = F.trim(F.regexp_replace("line", r"\s+$", ""))
    w = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stopped = F.max(((t == stop) | t.startswith("Low-level Commands")).cast("int")).over(w)
    section = F.last(F.when(t.isin(*sections), t), ignorenulls=True).over(w)
    m = r"(?i)^([a-z][a-z0-9._-]*)\s{2,}(.+)$"
    rows = lines.withColumns({"_t": t, "_stop": stopped, "section": section}).filter("_stop = 0 and section is not null").filter(F.col("_t").rlike(m) & ~F.col("_t").isin(*sections))
    return rows.select("doc", "section", F.regexp_extract("_t", m, 1).alias("name"), F.trim(F.regexp_extract("_t", m, 2)).alias("summary"))
