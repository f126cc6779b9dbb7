"""Verdicts on searches: grades, kinds of misses, accuracy of banks, and what they are computed from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.functions import commands as C
from tessellar.functions.text import query_tokens

#: Kinds of misses, and words that follow "git" in plain language without being a command.
MISS_CLASSES = ["partial_multistep", "over_ask", "retrieval_sibling", "destructive_alt", "coverage_gap", "other"]
NOT_COMMANDS = ["repository", "repo", "history", "command", "commands", "workflow", "project", "working", "tree", "index", "object", "objects", "file", "files"]


def family_of(line: Column) -> Column:
    """The first two words of a line."""
    return F.array_join(F.slice(F.split(line, r"\s+"), 1, 2), " ")


def grade(cases: DataFrame) -> DataFrame:
    """CLS-03: adds ``score`` (5, 4, 3, 1), ``passed`` and ``rationale``.

    ``cases``: ``expected_ids``, ``commands``, ``examples`` (arrays of what is right), ``simplest`` (text or ''),
    ``prefer_simplest``, and ``actual_id``, ``actual_command``, ``actual_example`` ('' for none).
    """
    x = {c: F.coalesce(c, F.lit("")) for c in ("actual_id", "actual_command", "actual_example", "simplest")}
    ids, cmds, examples = (F.coalesce(c, F.array().cast("array<string>")) for c in ("expected_ids", "commands", "examples"))
    got, kin = x["actual_command"], family_of(x["actual_command"])
    same_id = (x["actual_id"] != "") & F.array_contains(ids, x["actual_id"])
    example = F.array_contains(examples, x["actual_example"])
    plain = (x["simplest"] == "") | (x["actual_example"] == x["simplest"])
    close = F.exists(cmds, lambda c: (got == c) | got.startswith(c) | c.startswith(kin) | (family_of(c) == kin))
    prefer = F.coalesce("prefer_simplest", F.lit(False))
    verdict = (
        F.when(same_id, "id")
        .when((got == "") & (x["actual_example"] == ""), "empty")
        .when(example & prefer & ~plain, "not_simplest")
        .when(example & plain, "simplest")
        .when(example, "acceptable")
        .when(close, "family")
        .otherwise("wrong")
    )
    score = F.when(F.col("rationale").isin("id", "simplest", "acceptable"), 5).when(F.col("rationale") == "not_simplest", 4).when(F.col("rationale") == "family", 3).otherwise(1)
    return cases.withColumn("rationale", verdict).withColumn("score", score).withColumn("passed", F.col("rationale").isin("id", "simplest", "acceptable"))


def suite(graded: DataFrame) -> DataFrame:
    """AGG-19: cases, passed, pass rate and mean score; a case without verdict counts as score 1, not passed; no cases give rates of 0."""
    total = F.count(F.lit(1))
    return graded.agg(
        total.alias("cases"),
        F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"),
        (F.count_if(F.coalesce("passed", F.lit(False))) / F.greatest(total, F.lit(1))).alias("pass_rate"),
        (F.coalesce(F.sum(F.coalesce("score", F.lit(1))), F.lit(0)) / F.greatest(total, F.lit(1))).alias("mean_score"),
    )


def named_commands(text: Column) -> Column:
    """Distinct bare verbs a text names as ``git <verb>``, lower-case git only, nouns of plain language left out."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\bgit\s+([A-Za-z0-9][-A-Za-z0-9]*)"), F.lit(1)), lambda v: F.lower(v))
    return F.array_distinct(F.filter(found, lambda v: ~v.isin(NOT_COMMANDS)))


def asks_for_several(text: Column) -> Column:
    """Whether a text asks for more than one action."""
    q = F.lower(F.coalesce(text, F.lit("")))
    return q.rlike(r"\band\b|\bthen\b|\blist\b.+\bdelete\b|\bcreate\b.+\bbranch\b") | (F.size(named_commands(q)) >= 2)


def miss_class(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """CLS-01: adds ``miss_class``, the first that holds.

    ``rows``: ``query_text``, ``expected`` and ``shown`` (bare verbs or null), ``displayed`` (anything shown at all),
    ``mutation_kind``, ``passed``, ``via``, ``utility``, ``covered`` (whether some recipe has all commands the text names;
    null if that isn't known).  ``edges`` (verb, kin) are the verb families.
    """
    kin = edges.select(F.col("verb").alias("expected"), F.col("kin").alias("shown"), F.lit(True).alias("_kin")).distinct()
    r = rows.join(kin, ["expected", "shown"], "left")
    shown, expected = F.col("shown").isNotNull(), F.col("expected").isNotNull()
    inside = shown & expected & (F.coalesce("_kin", F.lit(False)) | (F.col("shown") == F.col("expected")))
    several = asks_for_several(F.col("query_text"))
    kind = F.coalesce("mutation_kind", F.lit(""))
    by_kind = F.when(kind == "composition", "retrieval_sibling").when(kind == "flag", "over_ask")
    c = (
        F.when(F.coalesce("passed", F.lit(False)), "other")
        .when(~F.coalesce("displayed", F.lit(False)), "retrieval_sibling")
        .when((F.col("expected") == "revert") & F.col("shown").isin("reset", "clean"), "destructive_alt")
        .when(several & (F.size(named_commands(F.col("query_text"))) >= 2) & (F.col("covered") == F.lit(False)), "coverage_gap")
        .when(shown & expected & ~inside, "retrieval_sibling")
        .when(several & inside, F.coalesce(by_kind, F.lit("partial_multistep")))
        .when(inside & F.col("via").isin("ko", "miss") & (F.col("utility") < 0.9), "partial_multistep")
        .when(several & by_kind.isNotNull(), by_kind)
        .otherwise("other")
    )
    return r.withColumn("miss_class", c).drop("_kin")


def by_class(rows: DataFrame, column: str, classes: list[str] = MISS_CLASSES) -> DataFrame:
    """MAP-01: rows per class, every class once; an unknown or null class is 'other'."""
    known = rows.select(F.when(F.col(column).isin(classes), F.col(column)).otherwise("other").alias("class"))
    every = rows.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    return every.join(known.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("rows"))


def misses(rows: DataFrame) -> DataFrame:
    """FLT-21: not passed and not skipped."""
    return rows.filter(~F.coalesce("passed", F.lit(False)) & (F.coalesce("via", F.lit("")) != "skipped"))


def miss_count(rows: DataFrame) -> DataFrame:
    """FLT-21: number of rows not passed; here the skipped ones count."""
    return rows.agg(F.count_if(~F.coalesce("passed", F.lit(False))).alias("misses"))


def is_ambiguous(label: Column) -> Column:
    """FLT-20."""
    return F.coalesce(label.isin("weak", "abandon"), F.lit(False))


def verb_lookup(recipes: DataFrame, id_col: str = "id") -> DataFrame:
    """PRJ-10: ``id``, ``verb`` of the recipes whose first command has one."""
    return recipes.select(F.col(id_col).alias("id"), C.verb(C.primary_command(F.col("commands"))).alias("verb")).filter("verb <> '' and id is not null")


def lineage(rows: DataFrame, child: str, parent: str) -> DataFrame:
    """PRJ-10: ``child``, ``parent`` where both are numbers and the parent is above 0."""
    n = lambda c: F.col(c).try_cast("bigint")
    return rows.select(n(child).alias("child"), n(parent).alias("parent")).filter("child is not null and parent > 0")


def hit_verbs(hits: DataFrame, lookup: DataFrame, text: str) -> DataFrame:
    """HLP-11: adds ``verbs``: the looked-up verb of a hit's id, else the distinct ``git <verb>`` of its text."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\bgit\s+([A-Za-z0-9][-A-Za-z0-9]*)"), F.lit(1)), lambda v: F.concat(F.lit("git "), v)))
    return hits.join(lookup.select("id", F.col("verb").alias("_v")), "id", "left").withColumn("verbs", F.when(F.col("_v").isNotNull(), F.array("_v")).otherwise(found)).drop("_v")


def verb_tokens(verbs: Column) -> Column:
    """HLP-12: bare lower-case tokens of a list of verbs, blank ones left out, each once."""
    bare = F.transform(F.coalesce(verbs, F.array().cast("array<string>")), lambda v: F.trim(F.regexp_replace(F.lower(F.coalesce(v, F.lit(""))), r"^git\s+", "")))
    return F.array_distinct(F.filter(bare, lambda v: v != ""))


def fallback_question(line: Column) -> Column:
    """HLP-12: the question that stands in where no better one is at hand."""
    return F.concat(F.lit("how do I use git "), F.coalesce(F.nullif(F.regexp_replace(C.verb(F.trim(line)), "^git ", ""), F.lit("")), F.lit("status")))


def promote_report(recipes: DataFrame, verbs: DataFrame, least: int = 3, warn_below: float = 0.8) -> DataFrame:
    """AGG-10: share of ``verbs`` (verb) with at least ``least`` recipes (id, verb), whether that is too few, and the sparse ones."""
    n = recipes.groupBy("verb").agg(F.count_distinct("id").alias("n"))
    each = verbs.select("verb").distinct().join(n, "verb", "left").withColumn("_ok", F.coalesce("n", F.lit(0)) >= least)
    total, good = F.count(F.lit(1)), F.count_if("_ok")
    t = each.agg(total.alias("verbs"), good.alias("with_least"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("_ok"), F.col("verb")))), ",").alias("sparse"))
    share = F.when(F.col("verbs") > 0, F.col("with_least") / F.col("verbs")).otherwise(1.0)
    return t.withColumn("share", share).withColumn("warn", F.col("share") + 1e-9 < warn_below)


def heldout_accuracy(rows: DataFrame, hit: str) -> DataFrame:
    """AGG-16: share of hits; 0 without rows."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.coalesce(F.col(hit), F.lit(False)).cast("double")), F.lit(0.0)).alias("accuracy"))


def regression_accuracy(bank: DataFrame, shown: DataFrame, results: DataFrame, deep: int = 10, floor: float = 0.95, least: int = 1) -> DataFrame:
    """AGG-17: a row of ``bank`` (query_id, expected) is hit if the expected id is among those displayed or the first ``deep``
    results (both query_id, id, rank); without rows the accuracy is 1 but not good."""
    pool = shown.select("query_id", "id").unionByName(results.filter(F.col("rank") <= deep).select("query_id", "id")).distinct()
    hit = bank.join(pool.select("query_id", F.col("id").alias("expected"), F.lit(True).alias("_hit")), ["query_id", "expected"], "left")
    t = hit.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("_hit", F.lit(False))).alias("hits"))
    acc = F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(1.0)
    return t.withColumn("accuracy", acc).withColumn("ok", (F.col("total") >= least) & (F.col("accuracy") >= floor))


def observed_hit_rate(rows: DataFrame, status: str, confidence: str, shown: str, least: float = 0.4) -> DataFrame:
    """AGG-18: share of searches that ended ok, confident enough and with something shown; null without rows."""
    hit = (F.col(status) == "ok") & (F.coalesce(confidence, F.lit(0.0)) >= least) & (F.coalesce(shown, F.lit(0)) > 0)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("hit_rate"))


def copies_reason(needle: Column, reason: Column) -> Column:
    """STR-18: whether a needle only repeats a judge's words: one contains the other, or they share three tokens of four
    letters; needles under four characters never do."""
    n, r = F.trim(F.lower(F.coalesce(needle, F.lit("")))), F.trim(F.lower(F.coalesce(reason, F.lit(""))))
    long = lambda s: F.filter(F.split(s, r"\W+"), lambda t: F.length(t) >= 4)
    shared = F.size(F.filter(long(r), lambda t: F.array_contains(long(n), t)))
    return (F.length(n) >= 4) & (r != "") & (F.contains(r, n) | F.contains(n, r) | (shared >= 3))


def skill_profile(query: Column, verbs: Column, soft: list[str]) -> Column:
    """RNK-10: the level a query speaks at and the weights of the channels: flags tell an expert, known verbs an intermediate,
    ``soft`` words a beginner."""
    q = F.coalesce(query, F.lit(""))
    tokens = query_tokens(q)
    known = F.arrays_overlap(tokens, verbs) | F.exists(tokens, lambda t: (t != "git") & F.array_contains(verbs, F.regexp_replace(t, "^git", "")))
    level = F.when(q.rlike(r"(?:^|\s)--?[A-Za-z]"), "expert").when(F.arrays_overlap(tokens, verbs), "intermediate").when(F.arrays_overlap(tokens, F.array(*[F.lit(s) for s in soft])), "beginner").when(known, "intermediate").otherwise("nontechnical")
    alpha = F.when(level.isin("nontechnical", "beginner"), 0.7).otherwise(0.3)
    return F.struct(level.alias("level"), alpha.alias("alpha"), (1 - alpha).alias("beta"))


def run_suite(cases: DataFrame, search: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame] = grade) -> DataFrame:
    """UDF-04: cases through an injected search (cases -> cases with what was found) and an injected judge (-> score, passed)."""
    return suite(judge(search(cases)))


def picked_intent(hits: DataFrame) -> DataFrame:
    """HLP-06: of the hits of a query with one recipe (``recipe_id``, else ``command_id``, else ``id``) the most similar; the
    similarity is ``forced``, else ``score``, else 0; hits without any id are left out."""
    who = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("recipe_id", "command_id", "id")])
    h = hits.withColumn("_who", who).filter("_who is not null").withColumn("_cos", F.coalesce("forced", "score", F.lit(0.0)))
    best = h.groupBy("query_id", F.col("_who").alias("recipe")).agg(F.min(F.struct((-F.col("_cos")).alias("d"), "text")).alias("_b"))
    return best.select("query_id", "recipe", F.col("_b.text").alias("text"), (-F.col("_b.d")).alias("cosine"))


def slim_results(rows: DataFrame, shown: str, most: int = 3) -> DataFrame:
    """HLP-10, HLP-26: a result as it is logged: id, verdict, and the ids of the first displayed hits."""
    return rows.select("query_id", F.coalesce("passed", F.lit(False)).alias("passed"), F.coalesce("via", F.lit("miss")).alias("via"), F.slice(F.coalesce(F.col(shown), F.array().cast("array<string>")), 1, most).alias("displayed"))
