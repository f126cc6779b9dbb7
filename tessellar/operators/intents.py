"""Intents, verb families and banks (FLT-06..14, JN-06/14/15, SET-08, DED-05/06, STM-09, HLP-13/17/18, PRJ-09)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessellar.functions.commands import scramble
from tessellar.functions.numbers import fnv1a
from tessellar.functions.text import is_command_like, query_tokens


def mentioned(text: Column, verbs: Column) -> Column:
    """How many of the bare verbs a text names, as tokens."""
    return F.size(F.array_intersect(query_tokens(text), verbs))


def covers_composition(text: Column, verbs: Column) -> Column:
    """FLT-07: names two of the verbs, or one and a word that joins steps; a recipe of one verb needs neither."""
    n = mentioned(text, verbs)
    return (F.size(verbs) < 2) | (n >= 2) | ((n >= 1) & F.coalesce(text.rlike(r"(?i)\b(and|then)\b"), F.lit(False)))


def faithful_intents(rows: DataFrame, traps: DataFrame | None = None, cap: int = 8) -> DataFrame:
    """FLT-06: ``rows`` (id, verbs, pos, text): trimmed, not command-like, each wording once per id (first wins), covering a
    composition, and the first ``cap`` of an id.  A text holding a needle of ``traps`` (verb, needle) is dropped unless it
    names that verb; needles are matched through their first word, not against every text."""
    t = F.trim("text")
    r = rows.withColumn("text", t).filter((F.coalesce("text", F.lit("")) != "") & ~is_command_like(F.col("text")) & covers_composition(F.col("text"), F.col("verbs")))
    if traps is not None:
        n = traps.select(F.lower("verb").alias("_verb"), F.lower(F.trim("needle")).alias("_needle")).filter("_needle <> ''").withColumn("_first", F.get(query_tokens(F.col("_needle")), 0))
        each = r.select("id", "pos", "text", F.explode(F.array_distinct(query_tokens(F.col("text")))).alias("_first")).join(n, "_first")
        caught = each.filter(F.contains(F.lower("text"), F.col("_needle")) & ~F.array_contains(query_tokens(F.col("text")), F.col("_verb"))).select("id", "pos").distinct()
        r = r.join(caught, ["id", "pos"], "left_anti")
    own = F.row_number().over(Window.partitionBy("id", F.lower("text")).orderBy("pos"))
    r = r.withColumn("_own", own).filter("_own = 1").drop("_own")
    return r.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).filter(F.col("place") <= cap)


def first_of_wording(rows: DataFrame, text: str, order: str) -> DataFrame:
    """DED-05, DED-06: of rows with the same text, case and outer blanks aside, the first; blank texts are left out."""
    key = F.lower(F.trim(text))
    # an aggregate instead of a window: a wording may hold a third of all rows
    first = rows.filter(F.coalesce(key, F.lit("")) != "").groupBy(key.alias("_key")).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("_r"))
    return first.select("_r.*")


def family_edges(families: DataFrame) -> DataFrame:
    """JN-06, MAP-02: ``families`` (canonical, aliases) -> (verb, kin): itself, and canonical and alias both ways; two aliases aren't kin."""
    pairs = families.select(F.lower("canonical").alias("a"), F.explode("aliases").alias("b")).select("a", F.lower("b").alias("b"))
    every = pairs.select("a").union(pairs.select("b")).distinct()
    return pairs.select(F.col("a").alias("verb"), F.col("b").alias("kin")).union(pairs.select("b", "a")).union(every.select("a", "a")).distinct()


def merge_families(old: DataFrame, new: DataFrame) -> DataFrame:
    """SET-08: by canonical verb, aliases united."""
    every = old.unionByName(new).select(F.lower("canonical").alias("canonical"), F.explode_outer("aliases").alias("alias")).distinct()
    return every.groupBy("canonical").agg(F.array_sort(F.collect_set(F.lower("alias"))).alias("aliases"))


def distinguished(families: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """HLP-13: families of which some text names two members."""
    member = families.select(F.lower("canonical").alias("canonical"), F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("m")).select("canonical", F.lower("m").alias("m")).distinct()
    numbered = texts.select(F.monotonically_increasing_id().alias("_i"), F.array_distinct(query_tokens(F.col(text))).alias("_t"))
    tokens = numbered.select("_i", F.explode("_t").alias("m"))
    return tokens.join(member, "m").groupBy("_i", "canonical").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("canonical").distinct()


def known_command(rows: DataFrame, token: str, commands: DataFrame) -> DataFrame:
    """HLP-18: adds ``command``: the known command equal to the token, case aside, else the first with the same verb, else null."""
    c = commands.select(F.col("command"), F.lower("command").alias("_low"), F.lower(F.get(F.split("command", r"\s+"), 1)).alias("_verb"))
    exact = c.groupBy("_low").agg(F.min("command").alias("_exact"))
    byverb = c.filter("_verb is not null").groupBy("_verb").agg(F.min("command").alias("_byverb"))
    r = rows.withColumn("_low", F.lower(F.trim(token))).withColumn("_verb", F.get(F.split(F.regexp_replace("_low", r"^git\s+", ""), r"\s+"), 0))
    return r.join(exact, "_low", "left").join(byverb, "_verb", "left").withColumn("command", F.coalesce("_exact", "_byverb")).drop("_low", "_verb", "_exact", "_byverb")


def coverage_parents(needs: DataFrame, recipes: DataFrame, longest: int = 7) -> DataFrame:
    """JN-15: per need (need_id, verbs) the recipe (id, verbs, steps, primary) that shares most verbs without covering all:
    10 per shared verb, less a point per step, 5 for a primary verb that is needed; ties to the smaller id."""
    n = needs.select("need_id", F.array_distinct("verbs").alias("need"))
    each = n.select("need_id", F.size("need").alias("n"), F.explode("need").alias("v"))
    shared = each.join(recipes.filter(F.col("steps") < longest).select("id", "steps", "primary", F.explode(F.array_distinct("verbs")).alias("v")), "v")
    g = shared.groupBy("need_id", "n", "id", "steps", "primary").agg(F.count(F.lit(1)).alias("k")).filter("k < n")
    g = g.join(each.select("need_id", F.col("v").alias("primary"), F.lit(5).alias("bonus")), ["need_id", "primary"], "left")
    score = 10 * F.col("k") - F.col("steps") + F.coalesce("bonus", F.lit(0))
    return g.withColumn("score", score).groupBy("need_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("m")).select("need_id", "m.id", (-F.col("m.s")).alias("score"))


def flag_problem(flags: Column, allowed: Column, denied: Column) -> Column:
    """FLT-14: 'denied' before 'not_allowed'; an empty list of allowed flags allows none."""
    return F.when(F.arrays_overlap(flags, denied), "denied").when(F.size(F.array_except(flags, allowed)) > 0, "not_allowed")


def rare_flags(rows: DataFrame, flags: str, least: int) -> DataFrame:
    """FLT-14: adds ``rare``: whether a row has a flag of fewer than ``least`` rows.  Joins, so the flags may be any number."""
    each = rows.select(flags, F.explode(flags).alias("_flag"))
    few = each.groupBy("_flag").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < least)
    sets = each.join(few, "_flag", "left_semi").select(flags).distinct().withColumn("_rare", F.lit(True))
    return rows.join(sets, flags, "left").withColumn("rare", F.coalesce("_rare", F.lit(False))).drop("_rare")


def split_by_id(rows: DataFrame, id_col: str, train_per_mille: int = 700) -> DataFrame:
    """STM-09: adds ``split`` by the FNV hash of the id, all rows of an id on one side; rows without id are left out.  If all ids
    fall on one side the last of two or more ids changes it."""
    r = rows.filter(F.coalesce(F.col(id_col), F.lit("")) != "").withColumn("_train", F.pmod(fnv1a(F.col(id_col)), F.lit(1000)) < train_per_mille)
    s = r.agg(F.min("_train").alias("lo"), F.max("_train").alias("hi"), F.max(id_col).alias("last"), F.min(id_col).alias("first")).first()
    if s["lo"] is not None and s["lo"] == s["hi"] and s["first"] != s["last"]:
        r = r.withColumn("_train", F.when(F.col(id_col) == s["last"], ~F.col("_train")).otherwise(F.col("_train")))
    return r.withColumn("split", F.when(F.col("_train"), "train").otherwise("holdout")).drop("_train")


@F.pandas_udf(StringType())
def scrambled(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """PRJ-09, STR-16: text and seed -> disturbed text."""
    for text, seed in batches:
        yield pd.Series([scramble(t, s) for t, s in zip(text, seed, strict=True)])


# What a working copy must hold for a list of commands, first match in order.
FIXTURES = [
    (r"\bgit clone\b", "bare_workdir"),
    (r"\bgit init\b", "bare_workdir"),
    (r"\b(push|pull|fetch)\b", "with_remote"),
    (r"\b(rm|mv)\b", "with_tracked_file"),
    (r"\bcommit\b", "staged_changes"),
    (r"\bmerge\b", "two_branches"),
    (r"\brebase\b", "with_history"),
    (r"\b(status|diff|add)\b", "dirty_worktree"),
    (r"\b(log|show|checkout|switch|branch|reset|tag)\b", "with_commit"),
]


def fixture_hint(commands: Column) -> Column:
    """STR-11: kind of working copy a list of commands asks for."""
    j = F.lower(F.array_join(commands, " "))
    return F.coalesce(*[F.when(j.rlike(pattern), F.lit(name)) for pattern, name in FIXTURES], F.lit("inited"))
