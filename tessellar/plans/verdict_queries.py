"""Queries over verdicts on searches, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions import commands as C
from tessellar.operators import verdicts as V
from tessellar.operators.coverage import covered_sets
from tessellar.operators.evaluation import hits as measured
from tessellar.operators.intents import family_edges
from tessellar.plans.catalog_queries import _RES, _eval
from tessellar.plans.intent_queries import _BV, _EDGE, FAMILIES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Words that tell a beginner.
SOFT = [
    "commit", "commits", "branch", "branches", "merge", "merged", "push", "pull", "clone", "repo", "repository", "stage", "staged", "staging", "unstage", "checkout",
    "revert", "undo", "history", "remote", "upstream", "conflict", "conflicts", "diff", "log", "tag", "tags", "stash", "rebase", "cherry", "pick", "reset",
    "head", "origin", "working", "tree", "index",
]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _cases(spark, d):
    """Every bank record as a case: what is right comes from its recipe, the answer from the recipe with the same title and the smallest id."""
    r = _t(spark, d, "recipes")
    lines = F.transform(F.coalesce("commands", F.array().cast(C.STEPS)), lambda s: s["command"])
    right = r.select(F.col("id").alias("command_id"), "title", lines.alias("examples"), F.transform(lines, lambda x: V.family_of(x)).alias("commands"), F.coalesce(F.get(lines, 0), F.lit("")).alias("simplest"))
    head = r.select(F.lower(F.substring("title", 1, 12)).alias("_k"), "id", F.coalesce(F.element_at(lines, -1), F.lit("")).alias("last")).filter("_k is not null")
    answer = head.groupBy("_k").agg(F.min_by(F.struct("id", "last"), "id").alias("a"))
    g = _t(spark, d, "golden_report").select("report_id", "kind", "command_id").join(right, "command_id", "left").withColumn("_k", F.lower(F.substring("title", 1, 12))).join(answer, "_k", "left")
    return g.select("report_id", "kind", F.when(F.col("kind") == "golden", F.array("command_id")).alias("expected_ids"), "commands", "examples", "simplest", (F.col("kind") == "extended").alias("prefer_simplest"), F.col("a.id").alias("actual_id"), F.col("a.last").alias("actual_command"), F.col("a.last").alias("actual_example"))


_FAM2 = r"array_to_string(string_split_regex({0}, '\s+')[1:2], ' ')"
_GRADED = f"""r AS (SELECT id, lower(substr(title, 1, 12)) AS k, list_transform(coalesce(commands, []), lambda s: s.command) AS ex FROM recipes),
  a AS (SELECT k, min(id) AS id, coalesce(arg_min(coalesce(ex[-1], ''), id), '') AS last FROM r WHERE k IS NOT NULL GROUP BY k),
  c AS (SELECT g.report_id, g.kind, g.command_id, coalesce(r.ex, []) AS ex, list_transform(coalesce(r.ex, []), lambda x: {_FAM2.format("x")}) AS cm, coalesce(r.ex[1], '') AS simplest, coalesce(a.id, '') AS aid, coalesce(a.last, '') AS act
        FROM golden_report g LEFT JOIN r ON r.id = g.command_id LEFT JOIN a ON a.k = r.k),
  v AS (SELECT *, CASE WHEN kind = 'golden' AND aid <> '' AND aid = command_id THEN 'id' WHEN act = '' THEN 'empty' WHEN list_contains(ex, act) AND kind = 'extended' AND NOT (simplest = '' OR act = simplest) THEN 'not_simplest'
        WHEN list_contains(ex, act) AND (simplest = '' OR act = simplest) THEN 'simplest' WHEN list_contains(ex, act) THEN 'acceptable'
        WHEN len(list_filter(cm, lambda x: act = x OR starts_with(act, x) OR starts_with(x, {_FAM2.format("act")}) OR {_FAM2.format("x")} = {_FAM2.format("act")})) > 0 THEN 'family' ELSE 'wrong' END AS rationale FROM c),
  s AS (SELECT *, CASE WHEN rationale IN ('id', 'simplest', 'acceptable') THEN 5 WHEN rationale = 'not_simplest' THEN 4 WHEN rationale = 'family' THEN 3 ELSE 1 END AS score, rationale IN ('id', 'simplest', 'acceptable') AS passed FROM v)"""


@query(f"WITH {_GRADED} SELECT report_id, rationale, score, passed FROM s")
def graded_cases(spark, d):
    """CLS-03."""
    return V.grade(_cases(spark, d)).select("report_id", "rationale", "score", "passed")


@query(f"WITH {_GRADED} SELECT count(*) AS cases, count(*) FILTER (passed) AS passed, round(avg(passed::INT), 6) AS pass_rate, round(avg(score), 6) AS mean_score FROM s")
def suite_totals(spark, d):
    """AGG-19."""
    return _r6(V.suite(V.grade(_cases(spark, d))))


def _miss_rows(spark, d):
    """Bank records as judged searches: shown is the recipe of the next record's id, votes come from risk."""
    r = _t(spark, d, "recipes").select(F.col("id").alias("sid"), F.nullif(C.bare_verb(C.primary_command(F.col("commands"))), F.lit("")).alias("shown"), "risk")
    g = _t(spark, d, "golden_report")
    head = g.groupBy(F.lower(F.trim("query_text")).alias("_q")).agg(F.max("command_id").alias("sid")).filter("_q is not null")
    rows = g.withColumn("_q", F.lower(F.trim("query_text"))).join(head, "_q", "left").join(r, "sid", "left")
    verb = F.nullif(F.regexp_replace(F.lower(F.trim("primary_verb")), r"^git\s+", ""), F.lit(""))
    text = F.concat_ws(" ", "query_text", F.when(F.col("kind") == "extended", F.concat(F.lit("using git "), F.coalesce(verb, F.lit("repo")), F.lit(" or git "), F.coalesce("shown", F.lit("log")))))
    rows = rows.select("report_id", text.alias("query_text"), verb.alias("expected"), "shown", F.col("sid").isNotNull().alias("displayed"), "mutation_kind", (F.col("sid") == F.col("command_id")).alias("passed"), F.when(F.col("kind") == "scrambled", "ko").otherwise("judge").alias("via"), F.col("risk").alias("utility"))
    recipes = _t(spark, d, "recipes").select(F.col("id").alias("have_id"), F.transform(C.step_verbs(F.coalesce("commands", F.array().cast(C.STEPS))), lambda v: F.lower(F.substring(v, 5, 1000))).alias("verbs"))
    needs = rows.select(F.col("report_id").alias("need_id"), V.named_commands(F.col("query_text")).alias("verbs"))
    return rows.join(covered_sets(needs, recipes).select(F.col("need_id").alias("report_id"), F.lit(True).alias("c")), "report_id", "left").withColumn("covered", F.coalesce("c", F.lit(False))).drop("c")


_NAMED = "list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '\\bgit\\s+([A-Za-z0-9][-A-Za-z0-9]*)', 1), lambda v: lower(v)), lambda v: NOT list_contains([" + ", ".join(f"'{w}'" for w in V.NOT_COMMANDS) + "], v)))"
_MISS = f"""{_EDGE}, r AS (SELECT id, nullif({_BV.format("coalesce(commands[1].command, '')")}, '') AS shown, risk, list_distinct(list_filter(list_transform(coalesce(commands, []), lambda s: {_BV.format("s.command")}), lambda v: v <> '')) AS vs FROM recipes),
  h AS (SELECT lower(trim(query_text)) AS q, max(command_id) AS sid FROM golden_report GROUP BY 1),
  w AS (SELECT g.report_id, g.query_text, g.kind, g.mutation_kind, g.command_id, h.sid, r.shown, r.risk, nullif(regexp_replace(lower(trim(g.primary_verb)), '^git\\s+', ''), '') AS expected FROM golden_report g LEFT JOIN h ON h.q = lower(trim(g.query_text)) LEFT JOIN r ON r.id = h.sid),
  x AS (SELECT *, concat_ws(' ', query_text, CASE WHEN kind = 'extended' THEN 'using git ' || coalesce(expected, 'repo') || ' or git ' || coalesce(shown, 'log') END) AS t FROM w),
  y AS (SELECT *, {_NAMED.format("t")} AS named, {_NAMED.format("lower(t)")} AS low FROM x),
  z AS (SELECT y.*, regexp_matches(lower(t), '\\band\\b|\\bthen\\b|\\blist\\b.+\\bdelete\\b|\\bcreate\\b.+\\bbranch\\b') OR len(low) >= 2 AS several, len(named) > 0 AND EXISTS (SELECT 1 FROM r WHERE list_has_all(vs, named)) AS covered,
        shown IS NOT NULL AND expected IS NOT NULL AND (shown = expected OR EXISTS (SELECT 1 FROM edge WHERE edge.verb = expected AND edge.kin = shown)) AS inside FROM y),
  k AS (SELECT report_id, CASE WHEN coalesce(sid = command_id, false) THEN 'other' WHEN sid IS NULL THEN 'retrieval_sibling' WHEN expected = 'revert' AND shown IN ('reset', 'clean') THEN 'destructive_alt' WHEN several AND len(named) >= 2 AND NOT covered THEN 'coverage_gap'
        WHEN shown IS NOT NULL AND expected IS NOT NULL AND NOT inside THEN 'retrieval_sibling' WHEN several AND inside THEN CASE mutation_kind WHEN 'composition' THEN 'retrieval_sibling' WHEN 'flag' THEN 'over_ask' ELSE 'partial_multistep' END
        WHEN inside AND kind = 'scrambled' AND risk < 0.9 THEN 'partial_multistep' WHEN several AND mutation_kind = 'composition' THEN 'retrieval_sibling' WHEN several AND mutation_kind = 'flag' THEN 'over_ask' ELSE 'other' END AS miss_class FROM z)"""


def _families(spark):
    return family_edges(spark.createDataFrame(FAMILIES, "canonical string, aliases array<string>"))


@query(f"WITH {_MISS} SELECT report_id, miss_class FROM k")
def miss_classes(spark, d):
    """CLS-01."""
    return V.miss_class(_miss_rows(spark, d), _families(spark)).select("report_id", "miss_class")


@query(f"WITH {_MISS} SELECT c AS class, (SELECT count(*) FROM k WHERE miss_class = c) AS \"rows\" FROM unnest(['partial_multistep', 'over_ask', 'retrieval_sibling', 'destructive_alt', 'coverage_gap', 'other']) AS u(c)")
def misses_by_class(spark, d):
    """MAP-01."""
    return V.by_class(V.miss_class(_miss_rows(spark, d), _families(spark)), "miss_class")


@query("WITH e AS (SELECT data.response.status AS s, data.response.displaycount AS n FROM observe_events) SELECT count(*) FILTER (NOT coalesce(n > 0, false) AND coalesce(s, '') <> 'skipped') AS collected, count(*) FILTER (NOT coalesce(n > 0, false)) AS counted FROM e")
def miss_totals(spark, d):
    """FLT-21: collecting leaves out what was skipped, counting doesn't."""
    e = _t(spark, d, "observe_events").select((F.col("data.response.displaycount") > 0).alias("passed"), F.col("data.response.status").alias("via"))
    one = F.lit(1).alias("_one")
    return V.misses(e).agg(F.count(F.lit(1)).alias("collected")).select("*", one).join(V.miss_count(e).select(F.col("misses").alias("counted"), one), "_one").drop("_one")


@query("SELECT count(*) FILTER (coalesce(kind IN ('weak', 'abandon'), false)) AS ambiguous, count(*) AS total FROM (SELECT CASE WHEN data.response.confidence > 0.75 THEN 'satisfied' WHEN data.response.confidence >= 0.4 THEN 'weak' WHEN data.response.confidence IS NOT NULL THEN 'abandon' END AS kind FROM observe_events)")
def ambiguous_labels(spark, d):
    """FLT-20."""
    c = F.col("data.response.confidence")
    label = F.when(c > 0.75, "satisfied").when(c >= 0.4, "weak").when(c.isNotNull(), "abandon")
    return _t(spark, d, "observe_events").agg(F.count_if(V.is_ambiguous(label)).alias("ambiguous"), F.count(F.lit(1)).alias("total"))


_VERB = r"CASE WHEN regexp_matches({0}, '^\s*git\s+\S') THEN 'git ' || regexp_extract({0}, '^\s*git\s+(\S+)', 1) ELSE '' END"


@query(f"SELECT id, v AS verb FROM (SELECT id, {_VERB.format(chr(34) + 'c0' + chr(34))} AS v FROM (SELECT id, coalesce(commands[1].command, '') AS c0 FROM recipes)) WHERE v <> '' AND id IS NOT NULL")
def verbs_of_recipes(spark, d):
    """PRJ-10."""
    return V.verb_lookup(_t(spark, d, "recipes"))


@query("SELECT delivery_id AS child, batch_no AS parent FROM observe_events WHERE batch_no > 0")
def lineage_pairs(spark, d):
    """PRJ-10 over numeric ids: a delivery and its batch."""
    return V.lineage(_t(spark, d, "observe_events"), "delivery_id", "batch_no")


@query(f"""WITH l AS (SELECT id, {_VERB.format(chr(34) + 'c0' + chr(34))} AS v FROM (SELECT id, coalesce(commands[1].command, '') AS c0 FROM recipes WHERE validated)),
  h AS (SELECT g.report_id, r.id, concat_ws(chr(10), g.query_text, array_to_string(list_transform(coalesce(r.commands, []), lambda s: s.command), chr(10))) AS t FROM golden_report g LEFT JOIN recipes r ON r.id = g.command_id)
SELECT report_id, array_to_string(CASE WHEN l.id IS NOT NULL THEN [l.v] ELSE list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(t, ''), '\\bgit\\s+([A-Za-z0-9][-A-Za-z0-9]*)', 1), lambda v: 'git ' || v))) END, ',') AS verbs FROM h LEFT JOIN l ON l.id = h.id AND l.v <> ''""")
def hit_verbs(spark, d):
    """HLP-11: only validated recipes are in the lookup."""
    r = _t(spark, d, "recipes")
    text = F.concat_ws("\n", F.col("query_text"), F.array_join(F.transform(F.coalesce("commands", F.array().cast(C.STEPS)), lambda s: s["command"]), "\n"))
    h = _t(spark, d, "golden_report").join(r.select(F.col("id"), "commands"), F.col("command_id") == F.col("id"), "left").select("report_id", "id", text.alias("text"))
    return V.hit_verbs(h, V.verb_lookup(r.filter("validated")), "text").select("report_id", F.array_join(F.array_sort("verbs"), ",").alias("verbs"))


@query("""SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat([taxonomy_leaf], coalesce(tags, [])), lambda v: trim(regexp_replace(lower(coalesce(v, '')), '^git\\s+', ''))), lambda v: v <> ''))), ',') AS tokens,
  'how do I use git ' || coalesce(nullif(regexp_extract(trim(coalesce(commands[1].command, '')), '^git\\s+(\\S+)', 1), ''), 'status') AS fallback FROM recipes""")
def verb_token_lists(spark, d):
    """HLP-12."""
    r = _t(spark, d, "recipes")
    tokens = V.verb_tokens(F.concat(F.array("taxonomy_leaf"), F.coalesce("tags", F.array().cast("array<string>"))))
    return r.select("id", F.array_join(F.array_sort(tokens), ",").alias("tokens"), V.fallback_question(C.primary_command(F.col("commands"))).alias("fallback"))


@query(f"""WITH r AS (SELECT id, {_VERB.format(chr(34) + 'c0' + chr(34))} AS v FROM (SELECT id, coalesce(commands[1].command, '') AS c0 FROM recipes)), n AS (SELECT v, count(DISTINCT id) AS n FROM r WHERE v <> '' GROUP BY v),
  w AS (SELECT DISTINCT lower(trim(primary_verb)) AS v FROM golden_report WHERE primary_verb IS NOT NULL), e AS (SELECT w.v, coalesce(n, 0) >= 3 AS ok FROM w LEFT JOIN n USING (v))
SELECT count(*) AS verbs, count(*) FILTER (ok) AS with_least, coalesce(string_agg(v, ',' ORDER BY v) FILTER (NOT ok), '') AS sparse, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (ok) / count(*) ELSE 1 END, 6) AS share, CASE WHEN count(*) > 0 THEN count(*) FILTER (ok) / count(*) ELSE 1 END + 1e-9 < 0.8 AS warn FROM e""")
def promote_coverage(spark, d):
    """AGG-10."""
    verbs = _t(spark, d, "golden_report").filter("primary_verb is not null").select(F.lower(F.trim("primary_verb")).alias("verb"))
    return _r6(V.promote_report(V.verb_lookup(_t(spark, d, "recipes")), verbs))


@query(f"WITH {_RES} SELECT count(*) AS n, round(coalesce(avg(hit_family::INT), 0), 6) AS accuracy FROM ht WHERE query_id IN (SELECT report_id FROM golden_report WHERE kind = 'scrambled')")
def heldout_accuracy(spark, d):
    """AGG-16."""
    return _r6(V.heldout_accuracy(measured(*_eval(spark, d)).filter("kind = 'scrambled'"), "hit_family"))


@query(f"WITH {_RES} SELECT count(*) AS total, count(*) FILTER (hit_deep) AS hits, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (hit_deep) / count(*) ELSE 1 END, 6) AS accuracy, count(*) >= 1 AND count(*) FILTER (hit_deep) / count(*) >= 0.95 AS ok FROM ht")
def regression_accuracy(spark, d):
    """AGG-17."""
    bank, results, _ = _eval(spark, d)
    return _r6(V.regression_accuracy(bank, results.filter("rank <= 3"), results))


@query("SELECT count(*) AS n, count(*) FILTER (h) AS hits, round(avg(h::INT), 6) AS hit_rate FROM (SELECT coalesce(data.response.status = 'ok' AND coalesce(data.response.confidence, 0) >= 0.4 AND coalesce(data.response.displaycount, 0) > 0, false) AS h FROM observe_events)")
def observed_hit_rate(spark, d):
    """AGG-18."""
    e = _t(spark, d, "observe_events").select("data.response.status", "data.response.confidence", "data.response.displaycount")
    return _r6(V.observed_hit_rate(e, "status", "confidence", "displaycount"))


@query(r"""WITH r AS (SELECT id, lower(trim(coalesce(title, ''))) AS n, lower(trim(coalesce(description, ''))) AS r FROM recipes)
SELECT id, length(n) >= 4 AND r <> '' AND (contains(r, n) OR contains(n, r) OR len(list_filter(list_filter(string_split_regex(r, '\W+'), lambda t: length(t) >= 4), lambda t: list_contains(list_filter(string_split_regex(n, '\W+'), lambda u: length(u) >= 4), t))) >= 3) AS copied FROM r""")
def copied_reasons(spark, d):
    """STR-18: titles as needles, descriptions as reasons."""
    return _t(spark, d, "recipes").select("id", V.copies_reason(F.col("title"), F.col("description")).alias("copied"))


_TK = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9_+\-]+'), lambda x: x <> '')"


@query(f"""WITH v AS (SELECT list(DISTINCT x) AS vs FROM (SELECT {_BV.format("c0")} AS x FROM (SELECT coalesce(commands[1].command, '') AS c0 FROM recipes)) WHERE x <> ''), q AS (SELECT report_id, coalesce(query_text, '') AS q, {_TK.format("query_text")} AS t FROM golden_report),
  l AS (SELECT report_id, CASE WHEN regexp_matches(q, '(?:^|\\s)--?[A-Za-z]') THEN 'expert' WHEN list_has_any(t, vs) THEN 'intermediate' WHEN list_has_any(t, [{", ".join(repr(s) for s in SOFT)}]) THEN 'beginner'
        WHEN len(list_filter(t, lambda x: x <> 'git' AND list_contains(vs, regexp_replace(x, '^git', '')))) > 0 THEN 'intermediate' ELSE 'nontechnical' END AS level FROM q, v)
SELECT report_id, level, CASE WHEN level IN ('nontechnical', 'beginner') THEN 0.7 ELSE 0.3 END::DOUBLE AS alpha FROM l""")
def skill_profiles(spark, d):
    """RNK-10.  The verb list is an aggregate of one row, joined on a constant."""
    v = V.verb_lookup(_t(spark, d, "recipes")).agg(F.collect_set(F.lower(F.substring("verb", 5, 1000))).alias("vs")).withColumn("_one", F.lit(1))
    q = _t(spark, d, "golden_report").select("report_id", "query_text").withColumn("_one", F.lit(1)).join(v, "_one")
    return q.select("report_id", V.skill_profile(F.col("query_text"), F.col("vs"), SOFT).alias("p")).select("report_id", "p.level", F.round("p.alpha", 6).alias("alpha"))


@query(f"WITH {_GRADED} SELECT count(*) AS cases, count(*) FILTER (kind = 'golden' AND aid <> '' AND aid = command_id) AS passed FROM s")
def injected_suite(spark, d):
    """UDF-04: a search that gives the recipe alone, and a judge that looks at ids only."""
    judge = lambda c: c.withColumn("passed", F.coalesce(F.array_contains("expected_ids", F.col("actual_id")), F.lit(False))).withColumn("score", F.when(F.col("passed"), 5).otherwise(1))
    return V.run_suite(_cases(spark, d), lambda c: c.withColumn("actual_command", F.lit("")), judge).select("cases", "passed")


@query("""WITH h AS (SELECT coalesce(primary_verb, '?') AS query_id, coalesce(nullif(trim(command_id, ' '), ''), nullif(trim(report_id, ' '), '')) AS recipe, query_text AS t, CASE WHEN kind = 'golden' THEN 0.9 ELSE 0 END AS c FROM golden_report)
SELECT query_id, recipe, arg_min(coalesce(t, ''), {'d': -c, 't': coalesce(t, '')}) AS text, round(max(c), 6)::DOUBLE AS cosine FROM h WHERE recipe IS NOT NULL GROUP BY 1, 2""")
def picked_intents(spark, d):
    """HLP-06: bank records as hits of their verb."""
    g = _t(spark, d, "golden_report")
    h = g.select(F.coalesce("primary_verb", F.lit("?")).alias("query_id"), F.lit(None).cast("string").alias("recipe_id"), "command_id", F.col("report_id").alias("id"), F.coalesce("query_text", F.lit("")).alias("text"), F.lit(None).cast("double").alias("forced"), F.when(F.col("kind") == "golden", F.lit(0.9)).alias("score"))
    return V.picked_intent(h).select("query_id", "recipe", "text", F.round("cosine", 6).alias("cosine"))


@query("SELECT delivery_id AS query_id, coalesce(data.response.displaycount > 0, false) AS passed, coalesce(data.response.status, 'miss') AS via, array_to_string(list_transform(coalesce(data.response.results, []), lambda r: r.command_id)[1:3], '|') AS displayed FROM observe_events")
def slim_results(spark, d):
    """HLP-10, HLP-26."""
    e = _t(spark, d, "observe_events").select(F.col("delivery_id").alias("query_id"), (F.col("data.response.displaycount") > 0).alias("passed"), F.col("data.response.status").alias("via"), F.transform("data.response.results", lambda r: r["command_id"]).alias("shown"))
    return V.slim_results(e, "shown").withColumn("displayed", F.array_join("displayed", "|"))
