"""Catalog tables: lookup, validation, upsert, merge, tags (SRC-*, SNK-*, FLT-*, DED-02, AGG-22..24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions.commands import primary_command, verb

EMPTY = "array<string>"


def lookup(table: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """SRC-04: rows whose key is among the ids; each row once however often an id is asked for."""
    return table.join(ids.select(F.col(id_col).alias(key)), key, "left_semi")


def hydrate(ids: DataFrame, id_col: str, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """JN-03, PRJ-17: ids with the table's columns, null where there is no row."""
    right = table.select(F.col(key).alias("_key"), *columns)
    return ids.join(right, ids[id_col] == right["_key"], "left").drop("_key")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """SNK-01, SNK-02: new rows replace old ones of the same key; of several new rows the one with the highest ``version``
    stays, then the greatest by all comparable columns."""
    order = F.struct(*([version] if version else []), *[c for c, t in new.dtypes if not t.startswith(("map", "variant"))])
    last = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("_r")).select("_r.*")
    return old.join(last.select(key), key, "left_anti").unionByName(last.select(old.columns))


def append_absent(values: Column, value: Column) -> Column:
    """SNK-03: the trimmed value added unless blank or there."""
    v = F.trim(value)
    base = F.coalesce(values, F.array().cast(EMPTY))
    return F.when((F.coalesce(v, F.lit("")) == "") | F.array_contains(base, v), base).otherwise(F.array_append(base, v))


def command_problem(line: Column, allowed: list[str] | None = None) -> Column:
    """FLT-11: why a command line is refused, first reason in order; null if it isn't."""
    c = F.trim(F.coalesce(line, F.lit("")))
    second = F.get(F.split(c, r"\s+"), 1)
    listed = F.lit(False) if allowed is None else second.isNotNull() & ~second.startswith("-") & ~second.isin(*allowed)
    return F.when(c == "", "schema").when(F.length(c) > 512, "length").when(c.rlike(r"[;&|`$<>\n]"), "shell_meta").when(~c.rlike(r"^git(\s|$)"), "allowlist").when(listed, "allowlist")


def example_problem(line: Column, allowed: list[str] | None = None) -> Column:
    """FLT-11: the further reasons of an example line."""
    c = F.trim(F.coalesce(line, F.lit("")))
    return F.coalesce(command_problem(line, allowed), F.when(c.rlike("<[^>]+>"), "placeholder").when(F.size(F.split(c, r"\s+")) > 14, "prose").when(c.contains("#"), "inline_comment"))


def validate_recipes(recipes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT-12, FLT-13: (good rows, bad rows with ``problem``), by shape alone."""
    long = lambda c, n: F.length(F.coalesce(c, F.lit(""))) > n
    problem = (
        F.when(F.col("id").isNull() | (F.trim("id") == ""), "id")
        .when(F.coalesce(F.trim("title"), F.lit("")) == "", "title")
        .when(long("title", 120), "title_length")
        .when(F.coalesce(F.trim("description"), F.lit("")) == "", "description")
        .when(long("description", 4000), "description_length")
        .when(F.coalesce(F.size("commands"), F.lit(0)) <= 0, "commands")
        .when(F.exists("commands", lambda s: F.coalesce(F.trim(s["command"]), F.lit("")) == ""), "blank_command")
        .when(F.col("risk").isNull() | F.isnan("risk") | ~F.col("risk").between(0, 1), "risk")
    )
    marked = recipes.withColumn("problem", problem)
    return marked.filter("problem is null").drop("problem"), marked.filter("problem is not null")


def dangling(rows: DataFrame, ref: str, table: DataFrame, key: str) -> DataFrame:
    """FLT-12, FLT-22: rows whose reference has no row; null references count as dangling."""
    return rows.join(table.select(F.col(key).alias(ref)), ref, "left_anti")


def keeper_score() -> Column:
    """DED-02: which record of a group is kept."""
    return F.coalesce(F.col("validated"), F.lit(False)).cast("int") * 500 + F.greatest(F.size(F.coalesce("paraphrases", F.array().cast(EMPTY))), F.lit(0)) * 10 + F.least(F.length(F.coalesce("description", F.lit(""))), F.lit(500))


def merge_groups(recipes: DataFrame, keys: list[str], ratio: float = 1.2) -> DataFrame:
    """DED-02, AGG-28: one row per group of ``keys``: the keeper's id, all tags and paraphrases, and the description.

    Donors are folded in by falling keeper score, then id: their paraphrases, tags, and their description and title where
    they differ from the keeper's, are added; a description more than ``ratio`` times as long takes the place of the
    current one.  Only rows longer than all before them can do that, so the fold sees those alone, and a group that holds
    a third of all rows is never gathered as a whole but for its distinct strings.
    """
    r = recipes.withColumn("_order", F.struct((-keeper_score()).alias("s"), F.col("id").alias("i"))).withColumn("_desc", F.trim(F.coalesce("description", F.lit("")))).withColumn("_title", F.trim(F.coalesce("title", F.lit(""))))
    heads = r.groupBy(*keys).agg(F.min(F.struct("_order", "_desc", "_title")).alias("_head"), F.count(F.lit(1)).alias("records"))
    # of each length the first row; it is longer than all before it if every longer row comes later.  The window sees a
    # group's distinct lengths, not its rows
    lengths = r.groupBy(*keys, F.length("_desc").alias("_len")).agg(F.min(F.struct("_order", "_desc")).alias("_m"))
    longer = F.min("_m._order").over(Window.partitionBy(*keys).orderBy(F.desc("_len")).rowsBetween(Window.unboundedPreceding, -1))
    kept = lengths.withColumn("_longer", longer).filter(F.col("_longer").isNull() | (F.col("_m._order") < F.col("_longer")))
    records = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_m._order").alias("_order"), F.col("_m._desc").alias("d")))).alias("_records"))
    take = lambda cur, x: F.when(F.length(x["d"]) > F.length(cur) * ratio, x["d"]).otherwise(cur)
    folded = records.select(*keys, F.aggregate(F.slice("_records", 2, 1 << 30), F.get("_records", 0)["d"], take).alias("description"))
    strings = lambda c: F.coalesce(F.col(c), F.array().cast(EMPTY))
    texts = r.select(*keys, F.explode(F.concat(strings("paraphrases"), F.array("_desc", "_title"))).alias("t"), F.col("_order.i").alias("_i"))
    said = texts.filter("t is not null and t <> ''").groupBy(*keys, "t").agg(F.min("_i").alias("_i"))
    para = said.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("paraphrases"))
    tags = r.select(*keys, F.explode(strings("tags")).alias("t")).filter("t is not null").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("tags"))
    out = heads.join(folded, keys).join(para, keys, "left").join(tags, keys, "left")
    keep = F.filter(F.coalesce("paraphrases", F.array().cast(EMPTY)), lambda t: (t != F.col("description")) & (t != F.col("_head._title")))
    return out.select(*keys, F.col("_head._order.i").alias("id"), "records", "description", keep.alias("paraphrases"), F.coalesce("tags", F.array().cast(EMPTY)).alias("tags"))


def tag_counts(recipes: DataFrame) -> DataFrame:
    """AGG-23: recipes per distinct tag, and those with several steps."""
    return (
        recipes.select(F.size(F.coalesce("commands", F.array().cast("array<struct<command:string,comment:string>>"))).alias("_n"), F.explode(F.array_distinct(F.coalesce("tags", F.array().cast(EMPTY)))).alias("tag"))
        .filter("trim(coalesce(tag, '')) <> ''")
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("recipes"), F.count_if(F.col("_n") >= 2).alias("multi_step"))
        .withColumn("multi_pct", F.floor(F.col("multi_step") * 100 / F.col("recipes") + 0.5).cast("bigint"))
    )


def verbs_of(recipes: DataFrame) -> DataFrame:
    """AGG-24: distinct verbs of all steps."""
    return recipes.select(F.explode("commands").alias("s")).select(verb(F.col("s.command")).alias("verb")).filter("verb <> ''").distinct()


def family(recipes: DataFrame) -> DataFrame:
    """PRJ-07: id, number of steps, family (verb of the first step) and primary command."""
    return recipes.select("id", F.greatest(F.size("commands"), F.lit(1)).alias("step_count"), verb(primary_command(F.col("commands"))).alias("family"), primary_command(F.col("commands")).alias("command"))
