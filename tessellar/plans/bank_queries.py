"""Queries over projections, banks, taxonomy patches, picks and cells, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions import commands as C
from tessellar.functions.instants import instant_ms
from tessellar.operators import banks as B
from tessellar.operators import projections as P
from tessellar.operators.intents import fixture_hint
from tessellar.operators.sessions import real_key
from tessellar.operators.vectors import knn
from tessellar.plans.general import _MS_SQL
from tessellar.plans.intent_queries import _BV
from tessellar.plans.verdict_queries import _VERB

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register



def _steps():
    return F.coalesce("commands", F.array().cast(C.STEPS))


@query("""SELECT delivery_id, to_json({'status': coalesce(r.status, CASE WHEN len(coalesce(r.results, [])) > 0 THEN 'ok' ELSE 'empty' END), 'query': q, 'confidence': floor(r.confidence * 100 + 0.5)::BIGINT,
  'alert': CASE WHEN coalesce(r.status, CASE WHEN len(coalesce(r.results, [])) > 0 THEN 'ok' ELSE 'empty' END) = 'empty' THEN 'red' ELSE 'none' END, 'results': list_transform(coalesce(r.results, []), lambda x: {'id': x.command_id})})::VARCHAR AS body
  FROM (SELECT delivery_id, data.response AS r, regexp_replace(data.query, '[^a-z0-9 ]', '', 'g') AS q FROM observe_events)""")
def result_bodies(spark, d):
    """SNK-17: confidence in per cent, so that both sides write the same number."""
    e = _t(spark, d, "observe_events").select("delivery_id", F.col("data.response").alias("r"), F.regexp_replace("data.query", "[^a-z0-9 ]", "").alias("q"))
    shown = F.transform("r.results", lambda x: F.struct(x["command_id"].alias("id")))
    return e.select("delivery_id", P.result_json(F.col("r.status"), F.col("q"), F.floor(F.col("r.confidence") * 100 + 0.5), F.lit(None).cast("string"), shown).alias("body"))


_SITE = """s AS (SELECT coalesce(nullif(id, ''), p) AS id, coalesce(nullif(title, ''), p) AS title, array_to_string(string_split_regex(p, '\\s+')[1:2], ' ') AS command, p AS "primary", coalesce(nullif(taxonomy_leaf, ''), 'git') AS topic, coalesce(risk, 0) AS risk,
  greatest(len(coalesce(commands, [])), 1) AS step_count, CASE WHEN len(coalesce(commands, [])) > 0 THEN array_to_string(list_transform(commands, lambda c: c.command || CASE WHEN coalesce(c.comment, '') <> '' THEN '  # ' || c.comment ELSE '' END), chr(10)) ELSE p END AS lines
  FROM (SELECT *, coalesce(commands[1].command, '') AS p FROM recipes))"""


@query(f"WITH {_SITE} SELECT id, title, command, \"primary\", topic, round(risk, 6) AS risk, step_count FROM s")
def site_recipes(spark, d):
    """SRC-16."""
    return P.site_recipes(_t(spark, d, "recipes")).select("id", "title", "command", "primary", "topic", F.round("risk", 6).alias("risk"), "step_count")


@query(f"WITH {_SITE} SELECT 'all' AS tag, count(*) AS recipes FROM s UNION ALL SELECT 'multi', count(*) FILTER (step_count >= 2) FROM s UNION ALL SELECT 'single', count(*) FILTER (step_count < 2) FROM s UNION ALL SELECT 'rebase', count(*) FILTER (lower(topic) = 'rebase') FROM s")
def tag_views(spark, d):
    """FLT-18."""
    site = P.site_recipes(_t(spark, d, "recipes"))
    out = None
    for tag in ("all", "multi", "single", "rebase"):
        v = P.for_tag(site, tag).agg(F.count(F.lit(1)).alias("recipes")).select(F.lit(tag).alias("tag"), "recipes")
        out = v if out is None else out.unionByName(v)
    return out


@query(f"WITH {_SITE} SELECT id, title, topic, step_count, lines FROM s")
def recipe_cards(spark, d):
    """PRJ-15."""
    return P.cards(P.site_recipes(_t(spark, d, "recipes")))


@query(r"""WITH r AS (SELECT id, coalesce(commands[1].command, '') AS ex, array_to_string(list_filter(coalesce(paraphrases, []), lambda x: x IS NOT NULL), chr(10)) AS u FROM recipes),
  l AS (SELECT *, list_filter(list_transform(string_split(u, chr(10)), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS ls FROM r),
  o AS (SELECT *, len(ls) >= 2 OR regexp_matches(coalesce(ls[1], ''), '^git(\s|$)') AS own FROM l)
SELECT id, CASE WHEN own THEN ls[1] ELSE ex END AS line, CASE WHEN len(ls) >= 2 THEN array_to_string(ls[2:], ' ') WHEN own THEN '' ELSE coalesce(ls[1], '') END AS blurb FROM o""")
def usage_lines(spark, d):
    """STR-14: paraphrases as usage text."""
    r = _t(spark, d, "recipes").select("id", P.usage_parts(F.array_join(F.coalesce("paraphrases", F.array().cast("array<string>")), "\n"), C.primary_command(F.col("commands"))).alias("u"))
    return r.select("id", "u.line", "u.blurb")


@query("SELECT id, CASE WHEN trim(coalesce(description, '')) <> '' THEN '[command] ' || coalesce(commands[1].command, '') || chr(10) || trim(description) ELSE '[command] ' || coalesce(commands[1].command, '') END AS anchor FROM recipes")
def command_anchors(spark, d):
    """STR-23."""
    return _t(spark, d, "recipes").select("id", P.command_anchor(C.primary_command(F.col("commands")), F.col("description")).alias("anchor"))


@query("SELECT delivery_id, coalesce(data.response.status, 'error') AS status, CASE WHEN data.response.status IS NOT NULL THEN len(coalesce(data.response.results, [])) END AS display_count, CASE WHEN data.response.status IS NULL THEN 'unknown' END AS error FROM observe_events")
def search_responses(spark, d):
    """PRJ-13."""
    r = P.search_response(F.col("data.response.status"), F.col("data.response.confidence"), F.col("data.response.results"), F.lit(None).cast("string"))
    return _t(spark, d, "observe_events").select("delivery_id", r.alias("r")).select("delivery_id", "r.status", "r.display_count", "r.error")


@query("SELECT id, array_to_string(CASE WHEN len(coalesce(tags, [])) > 0 THEN tags ELSE coalesce(paraphrases, []) END[1:2], '|') AS first FROM recipes")
def first_candidates(spark, d):
    """PRJ-14: tags as results, paraphrases as what was displayed instead."""
    return _t(spark, d, "recipes").select("id", F.array_join(P.candidates(F.col("tags"), F.col("paraphrases"), 2), "|").alias("first"))


@query("SELECT report_id, coalesce(command_id, '') AS expected_id, coalesce(command_id, '') <> '' AND coalesce(NOT report_only, true) AS correct_exists, false AS hit, 'observe' AS source FROM golden_report")
def feeder_failures(spark, d):
    """PRJ-12."""
    g = _t(spark, d, "golden_report").select("report_id", F.col("command_id").alias("expected_id"), (~F.col("report_only")).alias("correct_exists"))
    return P.failures(g).select("report_id", "expected_id", "correct_exists", "hit", "source")


_PLAIN = "trim(regexp_replace(translate(trim(replace(replace(coalesce({0}, ''), '<file>', 'notes.txt'), '<branch>', 'feature')), '“”‘’', '\"\"'''''), '[\\s\\p{{Z}}]+', ' ', 'g'))"
_F2 = r"array_to_string(string_split_regex({0}, '\s+')[1:2], ' ')"


@query(f"""WITH r AS (SELECT id, commands[1].command AS command, description AS example, list_transform(coalesce(commands, []), lambda c: c.command) AS cs, paraphrases AS es FROM recipes)
SELECT id, CASE WHEN contains(command, '<') THEN {_F2.format(_PLAIN.format("command"))} ELSE {_F2.format("command")} END AS command, {_PLAIN.format("coalesce(nullif(example, ''), command)")} AS example,
  array_to_string(list_transform(list_filter(cs, lambda c: coalesce(c, '') <> ''), lambda c: {_F2.format(_PLAIN.format("c"))}), '|') AS commands,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(coalesce(es, []), cs), lambda e: {_PLAIN.format("e")}), lambda e: e <> ''))), '|') AS examples FROM r""")
def migrated_cases(spark, d):
    """PRJ-16."""
    lines = F.transform(_steps(), lambda s: s["command"])
    r = _t(spark, d, "recipes").select("id", F.get(lines, 0).alias("command"), F.col("description").alias("example"), lines.alias("commands"), F.col("paraphrases").alias("examples"), F.lit(None).cast("string").alias("simplest"), F.lit(None).cast("boolean").alias("prefer_simplest"))
    m = P.migrated_cases(r, {"file": "notes.txt", "branch": "feature"})
    return m.select("id", "command", "example", F.array_join("commands", "|").alias("commands"), F.array_join(F.array_sort("examples"), "|").alias("examples"))


@query(r"""WITH j AS (SELECT report_id, regexp_replace(query_text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t, command_id, trim(regexp_replace(translate(trim(coalesce(commands[1].command, '')), '“”‘’', '""'''''), '[\s\p{Z}]+', ' ', 'g')) AS ex, coalesce(taxonomy_leaf, 'git') AS topic FROM golden_report JOIN recipes ON id = command_id)
SELECT report_id AS intent_id, t AS text, command_id AS recipe_id, array_to_string(string_split_regex(ex, '\s+')[1:2], ' ') AS command, topic FROM j
WHERE coalesce(t, '') <> '' AND NOT regexp_matches(t, '(?i)^\s*git\b') AND NOT regexp_matches(t, '&&|\|\||;|`') AND (ex = '' OR lower(trim(regexp_replace(translate(t, '“”‘’', '""'''''), '[\s\p{Z}]+', ' ', 'g'))) <> lower(ex))""")
def evaluation_intents(spark, d):
    """PRJ-17, JN-16."""
    g = _t(spark, d, "golden_report").select(F.col("report_id").alias("intent_id"), F.col("query_text").alias("text"), F.col("command_id").alias("recipe_id"))
    return B.evaluation_intents(g, _t(spark, d, "recipes")).select("intent_id", "text", "recipe_id", "command", "topic")


_PQ = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_TOKS = "list_distinct(list_filter(string_split({0}, ' '), lambda t: length(t) >= 3))"


@query(f"""WITH v AS (SELECT id, list_distinct(list_filter(list_transform(coalesce(commands, []), lambda s: {_BV.format("s.command")}), lambda v: v <> '')) AS vs FROM recipes),
  g AS (SELECT report_id, {_PQ.format("query_text")} AS q, coalesce(vs, []) AS vs FROM golden_report LEFT JOIN v ON v.id = command_id), p AS (SELECT DISTINCT {_PQ.format("query")} AS q FROM queries WHERE {_PQ.format("query")} <> ''),
  pt AS (SELECT q, {_TOKS.format("q")} AS t FROM p), gt AS (SELECT report_id, q, {_TOKS.format("q")} AS t FROM g),
  n AS (SELECT DISTINCT report_id FROM gt JOIN pt ON len(gt.t) > 0 AND len(pt.t) > 0 AND len(list_intersect(gt.t, pt.t)) / (len(gt.t) + len(pt.t) - len(list_intersect(gt.t, pt.t))) >= 0.85),
  s AS (SELECT g.*, CASE WHEN length(q) < 6 THEN 'too_short' WHEN len(vs) > 0 AND len(list_filter(vs, lambda v: contains(' ' || q || ' ', ' ' || v || ' ') OR contains(' ' || q || ' ', ' ' || replace(v, '-', ' ') || ' ') OR contains(' ' || q || ' ', ' ' || replace(v, '-', '') || ' '))) = 0 THEN 'missing_verb_token'
    WHEN contains(q, 'introduced a specific string') AND NOT list_has_any(vs, ['log', 'grep', 'blame']) THEN 'generic_template' WHEN q IN (SELECT q FROM p) THEN 'exact_dup' WHEN report_id IN (SELECT report_id FROM n) THEN 'near_dup' END AS reason FROM g)
SELECT report_id, reason FROM s""")
def bank_acceptance(spark, d):
    """FLT-08: the bank against the hold-out queries."""
    r = _t(spark, d, "recipes").select(F.col("id").alias("command_id"), F.array_distinct(F.filter(F.transform(_steps(), lambda s: C.bare_verb(s["command"])), lambda v: v != "")).alias("verbs"))
    g = _t(spark, d, "golden_report").join(r, "command_id", "left").select(F.col("report_id").alias("id"), F.col("query_text").alias("text"), F.coalesce("verbs", F.array().cast("array<string>")).alias("verbs"))
    return B.acceptance(g, _t(spark, d, "queries").select(F.col("query").alias("text"))).withColumnRenamed("id", "report_id")


@query(r"SELECT report_id, kind FROM golden_report WHERE kind IN ('golden', 'scrambled') AND NOT (kind = 'golden' AND coalesce(regexp_matches(query_text, '(?i)^how do i use git\s+\S+'), false))")
def active_bank(spark, d):
    """FLT-10."""
    g = _t(spark, d, "golden_report")
    return B.active_bank({k: g.filter(F.col("kind") == k) for k in B.KINDS}, "query_text", ["golden", "scrambled"]).select("report_id", "kind")


def _command_list(spark, d):
    """Commands of the recipes with an availability and a runner."""
    c = _t(spark, d, "recipes").select(F.explode("commands").alias("s"), "validated", "provenance").select(F.col("s.command").alias("command"), F.col("validated").alias("available"), F.when(F.col("provenance") == "llm", "git").otherwise("standalone").alias("runner"))
    return c.filter("command is not null")


_CMD = "c AS (SELECT s.command AS command, validated AS available, CASE WHEN provenance = 'llm' THEN 'git' ELSE 'standalone' END AS runner FROM (SELECT unnest(commands) AS s, validated, provenance FROM recipes) WHERE s.command IS NOT NULL)"


@query(f"WITH {_CMD} SELECT command, count(*) AS times FROM c WHERE coalesce(available, true) AND NOT regexp_matches(lower(command), '\\bverify-(commit|tag)\\b') GROUP BY 1")
def groundable_commands(spark, d):
    """FLT-16."""
    return B.groundable(_command_list(spark, d)).groupBy("command").agg(F.count(F.lit(1)).alias("times"))


@query(f"WITH {_CMD} SELECT DISTINCT trim(command) AS command FROM c WHERE coalesce(available, true) AND trim(command) <> ''")
def listed_commands(spark, d):
    """FLT-17."""
    return B.listed(_command_list(spark, d)).distinct()


@query(f"WITH {_CMD} SELECT count(*) FILTER (coalesce(available, true)) AS available, count(*) FILTER (NOT coalesce(available, true)) AS unavailable, count(*) FILTER (runner = 'standalone') AS standalone, count(*) AS total FROM c")
def availability_totals(spark, d):
    """HLP-20."""
    return B.availability(_command_list(spark, d))


@query(f"WITH m AS (SELECT DISTINCT taxonomy_leaf AS leaf, {_VERB.format('x')} AS command FROM (SELECT taxonomy_leaf, unnest(commands).command AS x FROM recipes WHERE validated AND taxonomy_leaf IS NOT NULL)), a AS (SELECT DISTINCT {_VERB.format('x')} AS command FROM (SELECT unnest(commands).command AS x FROM recipes) UNION SELECT DISTINCT lower(trim(primary_verb)) FROM golden_report WHERE primary_verb IS NOT NULL) SELECT leaf, command FROM m WHERE command <> '' UNION ALL SELECT 'backfill ' || command, command FROM a WHERE command <> '' AND command NOT IN (SELECT command FROM m WHERE command <> '')")
def backfilled_leaves(spark, d):
    """HLP-19, JN-08, JN-09, SET-04: leaves of validated recipes; commands of the others and of the bank are left over."""
    each = lambda r: r.select(F.col("taxonomy_leaf").alias("leaf"), F.explode("commands").alias("s")).select("leaf", C.verb(F.col("s.command")).alias("command")).filter("command <> ''").distinct()
    r = _t(spark, d, "recipes")
    bank = _t(spark, d, "golden_report").filter("primary_verb is not null").select(F.lower(F.trim("primary_verb")).alias("command")).filter("command <> ''")
    return B.with_backfill(each(r.filter("validated and taxonomy_leaf is not null")), each(r).select("command").unionByName(bank))


def _forest(spark, d):
    """Nations under regions, customers' segments as commands; merges of nations with the same first letter into the smallest key."""
    n = _t(spark, d, "nation")
    r = _t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"), F.array().cast("array<string>").alias("commands"))
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"), F.array(F.lower(F.substring("n_name", 1, 2)), F.lower(F.substring("n_name", 1, 1))).alias("commands"))
    below = n.select(F.concat(F.lit("c"), "n_nationkey").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("parent_id"), F.lit("child").alias("name"), F.lit(None).cast("array<string>").alias("commands"))
    first = n.groupBy(F.substring("n_name", 1, 1).alias("l")).agg(F.min("n_nationkey").alias("k"))
    merges = n.withColumn("l", F.substring("n_name", 1, 1)).join(first, "l").filter("n_nationkey <> k").select(F.concat(F.lit("n"), "k").alias("keep_id"), F.concat(F.lit("n"), "n_nationkey").alias("drop_id"), F.col("n_nationkey").alias("place"))
    return r.unionByName(nodes).unionByName(below), merges


@query("""WITH f AS (SELECT substr(n_name, 1, 1) AS l, min(n_nationkey) AS k FROM nation GROUP BY 1), x AS (SELECT n.*, k FROM nation n JOIN f ON f.l = substr(n_name, 1, 1)),
  m AS (SELECT k, list(lower(substr(n_name, 1, 2)) ORDER BY n_nationkey) AS two, any_value(lower(substr(n_name, 1, 1))) AS one, count(*) AS n FROM x GROUP BY k),
  o AS (SELECT k, [two[1], one] || two[2:] AS cs FROM m), u AS (SELECT k, u.c AS c, min(u.i) AS i FROM (SELECT k, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM o) u GROUP BY 1, 2),
  s AS (SELECT k, string_agg(c, ',' ORDER BY i) AS cs FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS r FROM u) WHERE r <= 6 GROUP BY k)
SELECT 'n' || k AS id, CASE WHEN k = 0 THEN 'renamed' ELSE n_name END AS name, cs AS commands FROM s JOIN nation ON n_nationkey = k
UNION ALL SELECT 'c' || k, 'child', '' FROM s UNION ALL SELECT 'r' || r_regionkey, r_name, '' FROM region""")
def patched_forest(spark, d):
    """SET-07: rename, merge and prune."""
    nodes, merges = _forest(spark, d)
    renames = spark.createDataFrame([("n0", "renamed"), ("n1", ""), ("zz", "nobody")], "id string, name string")
    return B.patched(nodes, renames, merges).select("id", "name", F.coalesce(F.array_join("commands", ","), F.lit("")).alias("commands"))


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 8")
def capped_children(spark, d):
    """ARR-01, SRT-07: eight orders of a customer at most, dearest first."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", (-F.col("o_totalprice")).alias("_p"))
    return B.fan_out(o, "o_custkey", ["_p", "o_orderkey"]).select("o_orderkey", "o_custkey")


_WORDS = r"list_filter(string_split_regex(trim(s.command), '\s+'), lambda t: t <> '')"


@query(f"""WITH r AS (SELECT id, commands AS cs FROM recipes WHERE len(coalesce(commands, [])) > 0), k AS (SELECT id, len(cs) AS steps, list_sum(list_transform(cs, lambda s: len(list_filter({_WORDS}, lambda t: regexp_matches(t, '^--?[A-Za-z]'))))) AS flags, list_sum(list_transform(cs, lambda s: len({_WORDS}))) AS words,
  array_to_string(list_transform(cs, lambda s: coalesce(nullif({_VERB.format("s.command")}, ''), array_to_string({_WORDS}[1:2], ' ')) || '|' || array_to_string(list_sort(list_transform(list_filter({_WORDS}, lambda t: regexp_matches(t, '^--?[A-Za-z]')), lambda t: lower(t))), ',')), '||') AS fp FROM r)
SELECT fp AS fingerprint, count(*) AS recipes, min(steps) AS steps, arg_min(flags, (steps, flags, words)) AS flags, arg_min(words, (steps, flags, words)) AS words FROM k GROUP BY fp""")
def simplest_recipes(spark, d):
    """SRT-05, DED-04: the key of the simplest recipe of each loose fingerprint."""
    r = _t(spark, d, "recipes")
    best = B.simplest_each(r, "id", "commands")
    s = r.select("id", B.simplicity(_steps()).alias("s"))
    return best.join(s, "id").select("fingerprint", "recipes", "s.steps", F.col("s.flags").cast("bigint").alias("flags"), F.col("s.words").cast("bigint").alias("words"))


@query()
def stored_commands(spark, d):
    """DED-03: commands whose stored form differs, by a state machine over quoted tokens."""
    r = _t(spark, d, "recipes").select("id", C.placeholder_lines(F.transform(_steps(), lambda s: s["command"])).alias("stored"), F.transform(_steps(), lambda s: s["command"]).alias("given"))
    return r.select("id", F.array_join("stored", "\n").alias("stored"), (F.col("stored") != F.col("given")).alias("rewritten"))


_FIX = """CASE WHEN regexp_matches(j, '\\bgit clone\\b') OR regexp_matches(j, '\\bgit init\\b') THEN 'bare_workdir' WHEN regexp_matches(j, '\\b(push|pull|fetch)\\b') THEN 'with_remote' WHEN regexp_matches(j, '\\b(rm|mv)\\b') THEN 'with_tracked_file' WHEN regexp_matches(j, '\\bcommit\\b') THEN 'staged_changes'
  WHEN regexp_matches(j, '\\bmerge\\b') THEN 'two_branches' WHEN regexp_matches(j, '\\brebase\\b') THEN 'with_history' WHEN regexp_matches(j, '\\b(status|diff|add)\\b') THEN 'dirty_worktree' WHEN regexp_matches(j, '\\b(log|show|checkout|switch|branch|reset|tag)\\b') THEN 'with_commit' ELSE 'inited' END"""


@query(f"""WITH RECURSIVE r AS (SELECT id, {_FIX} AS fx, v FROM (SELECT id, lower(array_to_string(list_transform(coalesce(commands, []), lambda s: s.command), ' ')) AS j, {_BV.format("coalesce(commands[1].command, '')")} AS v FROM recipes)),
  w AS (SELECT 0 AS n, ''::VARCHAR AS id, []::VARCHAR[] AS ids, []::VARCHAR[] AS fs, []::VARCHAR[] AS vs UNION ALL
        SELECT n + 1, b.id, list_append(ids, b.id), list_append(fs, b.fx), list_append(vs, b.v) FROM w, LATERAL (SELECT id, fx, v FROM r WHERE NOT list_contains(w.fs, fx) AND NOT list_contains(w.vs, v) ORDER BY id LIMIT 1) b WHERE n < 12),
  e AS (SELECT id, n FROM w WHERE n > 0), q AS (SELECT vs FROM w ORDER BY n DESC LIMIT 1), f AS (SELECT v, min(id) AS id FROM r, q WHERE NOT list_contains(q.vs, v) GROUP BY v)
SELECT id, pick FROM (SELECT r.id, row_number() OVER (ORDER BY CASE WHEN e.id IS NOT NULL THEN 0 WHEN f.id IS NOT NULL THEN 1 ELSE 2 END, e.n, r.id) AS pick FROM r LEFT JOIN e ON e.id = r.id LEFT JOIN f ON f.id = r.id) WHERE pick <= 12""")
def diverse_recipes(spark, d):
    """WIN-13: a report of twelve."""
    r = _t(spark, d, "recipes").select("id", fixture_hint(F.transform(_steps(), lambda s: s["command"])).alias("fixture"), C.bare_verb(C.primary_command(F.col("commands"))).alias("verb"))
    return B.diverse(r, "fixture", "verb", "id", 12).select("id", "pick")


@query("""WITH h AS (SELECT o_custkey AS q, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rank, CASE WHEN o_orderpriority LIKE '1%' THEN 2 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 0 END AS k FROM orders QUALIFY rank <= 20),
  n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY k DESC, rank, id) AS near FROM h), f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY (near <= 2)::INT, k DESC, rank DESC, id DESC) AS far FROM n),
  p AS (SELECT *, CASE WHEN near <= 2 THEN 'near' WHEN far <= 2 THEN 'far' ELSE 'fill' END AS part FROM f)
SELECT q AS query_id, id, part, row_number() OVER (PARTITION BY q ORDER BY CASE part WHEN 'near' THEN 0 WHEN 'far' THEN 1 ELSE 2 END, k DESC, rank, id) AS place FROM p QUALIFY place <= 10""")
def example_mixes(spark, d):
    """SRT-06: a customer's twenty cheapest orders as hits, their priority as kind."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    k = F.when(F.col("o_orderpriority").startswith("1"), 2).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(0)
    h = _t(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.row_number().over(w).alias("rank"), k.alias("k")).filter("rank <= 20")
    return B.example_mix(h, "k").select("query_id", "id", "part", "place")


@query(f"""WITH e AS (SELECT CASE WHEN starts_with(sessionid, 's_') OR starts_with(sessionid, 'd_') THEN sessionid WHEN starts_with(distinctid, 's_') OR starts_with(distinctid, 'd_') THEN distinctid END AS k, {_MS_SQL} AS ms, name, delivery_id FROM observe_events),
  s AS (SELECT k, name, coalesce(ms - lag(ms) OVER (PARTITION BY k ORDER BY ms, delivery_id), 0) AS spent FROM e WHERE k IS NOT NULL AND ms IS NOT NULL)
SELECT k AS "key", coalesce(name, '?') AS phase, sum(spent)::BIGINT AS elapsed, count(*) AS marks FROM s GROUP BY 1, 2""")
def phase_times(spark, d):
    """WIN-14: deliveries of a thread as marks, event names as phases."""
    e = _t(spark, d, "observe_events").select(real_key(F.col("sessionid"), F.col("distinctid")).alias("key"), instant_ms(F.col("createdat")).alias("ms"), F.coalesce("name", F.lit("?")).alias("phase"), "delivery_id")
    return B.phase_times(e.filter("key is not null and ms is not null"), "key", "ms", "phase", "delivery_id")


@query("""WITH c AS (SELECT a, b FROM unnest(['golden', 'extended', 'scrambled', 'other']) AS x(a), unnest(['flag', 'state', 'composition', 'none']) AS y(b)),
  m AS (SELECT kind AS a, coalesce(mutation_kind, 'none') AS b, max(CASE WHEN NOT report_only THEN 2 WHEN primary_verb IS NOT NULL THEN 1 ELSE 0 END) AS r FROM golden_report GROUP BY 1, 2)
SELECT count(*) FILTER (coalesce(r, 0) = 2) AS filled, count(*) FILTER (coalesce(r, 0) = 1) AS skipped, count(*) FILTER (coalesce(r, 0) = 0) AS empty, count(*) AS total, count(*) FILTER (coalesce(r, 0) = 0) = 0 AS all_decided FROM c LEFT JOIN m USING (a, b)""")
def matrix_totals(spark, d):
    """AGG-21, HLP-15: kinds by mutation kinds, 16 cells."""
    g = _t(spark, d, "golden_report").select("kind", F.coalesce("mutation_kind", F.lit("none")).alias("mutation"), F.when(~F.col("report_only"), "filled").when(F.col("primary_verb").isNotNull(), "skipped").otherwise("empty").alias("status"))
    return B.cell_totals(B.cell_states(g, ["golden", "extended", "scrambled", "other"], ["flag", "state", "composition", "none"], "kind", "mutation", "status"))


@query(r"SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(coalesce(description, ''), '[\s,\[\]]+'), lambda p: try_cast(CASE WHEN regexp_full_match(p, '[+-]?\d+') THEN p END AS BIGINT)), lambda n: n IS NOT NULL))), ',') AS ids FROM (SELECT id, '[' || regexp_replace(id, '\D', ' ', 'g') || ', 7 7 x' || ']' AS description FROM recipes)")
def excluded_ids(spark, d):
    """SET-06."""
    raw = F.concat(F.lit("["), F.regexp_replace("id", r"\D", " "), F.lit(", 7 7 x]"))
    return _t(spark, d, "recipes").select("id", F.array_join(F.array_sort(B.id_set(raw)).cast("array<string>"), ",").alias("ids"))


@query("SELECT delivery_id AS query_id, id, coalesce(data.query, '') AS text, round(coalesce(data.response.confidence, 1 - data.response.displaycount / 10.0, 0), 6)::DOUBLE AS similarity FROM observe_events")
def foreign_neighbours(spark, d):
    """HLP-16: confidence as score, the number shown as distance."""
    h = _t(spark, d, "observe_events").select(F.col("delivery_id").alias("query_id"), "id", F.col("data.query").alias("text"), F.col("data.response.confidence").alias("score"), (F.col("data.response.displaycount") / 10).alias("distance"))
    return B.foreign_neighbours(h, "score", "distance").withColumn("similarity", F.round("similarity", 6))


@query(r"""SELECT id, lower(coalesce(taxonomy_leaf, '')) IN ('rebase', 'stash') OR lower(trim(regexp_replace(trim(coalesce(commands[1].command, '')), '\s+', ' ', 'g'))) = 'git status' AS both, lower(coalesce(taxonomy_leaf, '')) IN ('rebase', 'stash') AS topic_only FROM recipes""")
def focus_matches(spark, d):
    """HLP-24."""
    c = C.primary_command(F.col("commands"))
    return _t(spark, d, "recipes").select("id", B.in_focus(F.col("taxonomy_leaf"), c, ["Rebase", "stash"], ["git status"]).alias("both"), B.in_focus(F.col("taxonomy_leaf"), c, ["rebase", "stash"], []).alias("topic_only"))


@query(r"""SELECT DISTINCT 'topic' AS area, v AS "value" FROM (SELECT unnest(tags) AS v FROM recipes) WHERE coalesce(v, '') <> '' AND v <> 'generated' AND NOT starts_with(v, 'cycle-')
UNION ALL SELECT DISTINCT 'command', v FROM (SELECT trim(regexp_replace(translate(trim(unnest(commands).command), '“”‘’', '""'''''), '[\s\p{Z}]+', ' ', 'g')) AS v FROM recipes) WHERE coalesce(v, '') <> ''""")
def covered_areas(spark, d):
    """AGG-24."""
    return B.covered_areas(_t(spark, d, "recipes").select("tags", F.transform("commands", lambda s: s["command"]).alias("commands")))


@query(f"SELECT delivery_id, ms FROM (SELECT delivery_id, name, {_MS_SQL} AS ms FROM observe_events) WHERE ms >= 1767600000000 AND name IN (SELECT name FROM observe_events GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 2) ORDER BY ms, delivery_id LIMIT 2000")
def event_page(spark, d):
    """SRC-11, DAT-02: a page of 2,000 from a given instant on, of the two most frequent event names (the page is the feature)."""
    e = _t(spark, d, "observe_events").select("delivery_id", "name", instant_ms(F.col("createdat")).alias("ms"))
    names = [r["name"] for r in e.filter("name is not null").groupBy("name").count().orderBy(F.desc("count"), "name").limit(2).collect()]
    return B.pulled(e, "ms", "delivery_id", "name", names, B.lookback_ms(1_768_204_800_000, "2026-01-05T08:00:00Z"), 2000).select("delivery_id", "ms")


@query(f"""WITH e AS (SELECT batch_no, {_MS_SQL} AS ms FROM observe_events), t AS (SELECT batch_no, max(ms) OVER (ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM (SELECT batch_no, max(ms) AS ms FROM e GROUP BY 1))
SELECT batch_no, count(*) AS "rows", count(*) FILTER (ms < c) AS late FROM e JOIN t USING (batch_no) GROUP BY 1""")
def late_deliveries(spark, d):
    """STM-05."""
    return B.late_rows(_t(spark, d, "observe_events").select("batch_no", instant_ms(F.col("createdat")).alias("ms")), "batch_no", "ms")


@query("SELECT strftime(pulled_at, '%Y-%m-%d') AS day, count(*) AS deliveries, min(strftime(pulled_at, '%Y-%m-%dT%H-%M-%S') || '-000Z') AS first_run FROM observe_events GROUP BY 1")
def days_of_pulls(spark, d):
    """DAT-03."""
    e = _t(spark, d, "observe_events").select(B.day_key(F.col("pulled_at")).alias("day"), B.run_stamp(F.col("pulled_at")).alias("run"))
    return e.groupBy("day").agg(F.count(F.lit(1)).alias("deliveries"), F.min("run").alias("first_run"))


@query(f"""SELECT id, array_to_string(list_transform(vs, lambda v: lower(v)), ',') AS verbs, len(coalesce(tags, [])) AS tags FROM (SELECT id, tags, list_distinct(list_filter(list_transform(coalesce(commands, []), lambda s: {_VERB.format("s.command")}), lambda v: v <> '')) AS u, list_sort(u) AS vs FROM recipes)""")
def verb_lists_in_json(spark, d):
    """JSN-01, ARR-02: written and read again; text that is no array gives none."""
    verbs = C.step_verbs(_steps())
    tags = F.coalesce(F.to_json("tags"), F.lit("no array"))
    return _t(spark, d, "recipes").select("id", F.array_join(P.verbs_of_json(P.verbs_json(verbs)), ",").alias("verbs"), F.size(P.json_array(tags)).alias("tags"))


@query("SELECT id, len(coalesce(tags, [])) AS tags FROM recipes")
def loose_json(spark, d):
    """SRC-17: recipes as fenced JSON with its end cut off; ids and tags come back."""
    body = F.to_json(F.struct("id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.struct(F.coalesce("title", F.lit("")).alias("title"), F.lit("some longer text, \"quoted\" {").alias("text")).alias("more")))
    text = F.concat(F.lit("Here it is:\n```json\n"), F.substring(body, 1, 1 << 30).substr(F.lit(1), F.length(body) - 9))
    r = _t(spark, d, "recipes").select(P.loose_json_text(text).alias("j"))
    return r.select(F.from_json("j", "id string, tags array<string>").alias("v")).select("v.id", F.size("v.tags").alias("tags"))


@query("""WITH h AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, arg_max(doc_id, c) AS nearest, round(max(c), 6) AS cosine FROM h WHERE c >= 0.3 GROUP BY 1""")
def nearest_above(spark, d):
    """SIM-03: the closest other vector at or above a threshold, of every twentieth vector against all."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    h = knn(e.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), e, 2, dim=64).filter("query_id <> doc_id and cosine >= 0.3")
    return h.groupBy("query_id").agg(F.max_by("doc_id", "cosine").alias("nearest"), F.round(F.max("cosine"), 6).alias("cosine"))


