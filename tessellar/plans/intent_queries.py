"""Queries over intents, families and banks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions import commands as C
from tessellar.functions.instants import instant_ms
from tessellar.operators import intents as I
from tessellar.operators.delivery import accept
from tessellar.operators.sessions import real_key
from tessellar.plans.general import ORACLES as _GENERAL

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


#: Verbs that stand for each other.
FAMILIES = [("checkout", ["switch", "branch"]), ("reset", ["revert", "restore"]), ("fetch", ["pull"]), ("log", ["show", "reflog"]), ("stash", []), ("rebase", ["cherry-pick"])]


def _families(spark):
    return spark.createDataFrame(FAMILIES, "canonical string, aliases array<string>")


_FAM = "fam AS (SELECT unnest([" + ", ".join(f"{{'c': '{c}', 'a': {a!r}::VARCHAR[]}}" for c, a in FAMILIES) + "], recursive := true))"
_EDGE = _FAM + ", fp AS (SELECT c, unnest(a) AS b FROM fam), edge AS (SELECT c AS verb, b AS kin FROM fp UNION SELECT b, c FROM fp UNION SELECT c, c FROM fp UNION SELECT b, b FROM fp)"
_BV = r"CASE WHEN regexp_matches({0}, '^\s*git\s+\S') THEN lower(regexp_extract({0}, '^\s*git\s+(\S+)', 1)) ELSE '' END"


def _recipe_verbs(spark, d):
    steps = F.coalesce("commands", F.array().cast(C.STEPS))
    verbs = F.array_distinct(F.filter(F.transform(steps, lambda s: C.bare_verb(s["command"])), lambda v: v != ""))
    return _t(spark, d, "recipes").select("id", verbs.alias("verbs"), F.size(steps).alias("steps"), C.bare_verb(C.primary_command(F.col("commands"))).alias("primary"), "paraphrases", "commands")


_RV = f"rv AS (SELECT id, paraphrases, list_distinct(list_filter(list_transform(coalesce(commands, []), lambda s: {_BV.format('s.command')}), lambda v: v <> '')) AS verbs, len(coalesce(commands, [])) AS steps, {_BV.format(chr(34) + 'c0' + chr(34))} AS prim FROM (SELECT *, coalesce(commands[1].command, '') AS c0 FROM recipes))"
_QT = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9_+\-]+'), lambda x: x <> '')"


@query(f"""WITH {_RV}, p AS (SELECT id, verbs, i - 1 AS pos, trim(paraphrases[i]) AS txt FROM rv, unnest(range(1, len(paraphrases) + 1)) AS u(i)),
  k AS (SELECT *, len(list_intersect({_QT.format("txt")}, verbs)) AS n FROM p WHERE coalesce(txt, '') <> '' AND NOT regexp_matches(txt, '(?i)^\\s*git\\b') AND NOT regexp_matches(txt, '&&|\\|\\||;|`')),
  c AS (SELECT * FROM k WHERE len(verbs) < 2 OR n >= 2 OR n >= 1 AND regexp_matches(txt, '(?i)\\b(and|then)\\b')),
  t AS (SELECT * FROM c WHERE NOT (contains(lower(txt), 'lost commit') AND NOT list_contains({_QT.format("txt")}, 'reflog')) AND NOT (contains(lower(txt), 'another base') AND NOT list_contains({_QT.format("txt")}, 'rebase'))),
  o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY id, lower(txt) ORDER BY pos) = 1)
SELECT id, txt AS "text", row_number() OVER (PARTITION BY id ORDER BY pos) AS place FROM o QUALIFY place <= 8""")
def faithful_intents(spark, d):
    """FLT-05..07, STR-22, JN-14."""
    rows = _recipe_verbs(spark, d).select("id", "verbs", F.posexplode("paraphrases").alias("pos", "text"))
    traps = spark.createDataFrame([("reflog", "lost commit"), ("rebase", "another base")], "verb string, needle string")
    return I.faithful_intents(rows, traps).select("id", "text", "place")


@query("SELECT arg_min(report_id, report_id) AS report_id, arg_min(query_text, report_id) AS query_text FROM golden_report WHERE trim(coalesce(query_text, '')) <> '' GROUP BY lower(trim(query_text))")
def first_wordings(spark, d):
    """DED-05, DED-06, WIN-06."""
    return I.first_of_wording(_t(spark, d, "golden_report").select("report_id", "query_text"), "query_text", "report_id")


@query(f"WITH {_EDGE} SELECT report_id, kin FROM (SELECT report_id, regexp_replace(lower(trim(primary_verb)), '^git\\s+', '') AS v FROM golden_report) JOIN edge ON edge.verb = v")
def verb_kin(spark, d):
    """JN-06, MAP-02."""
    g = _t(spark, d, "golden_report").select("report_id", F.regexp_replace(F.lower(F.trim("primary_verb")), r"^git\s+", "").alias("verb"))
    return g.join(I.family_edges(_families(spark)), "verb").select("report_id", "kin")


@query(f"""WITH {_FAM}, n AS (SELECT lower(leaf) AS c, lower(tag) AS b FROM (SELECT taxonomy_leaf AS leaf, unnest(tags) AS tag FROM recipes) WHERE leaf IS NOT NULL AND tag IS NOT NULL UNION SELECT c, unnest(a) FROM fam), k AS (SELECT DISTINCT lower(taxonomy_leaf) AS c FROM recipes WHERE taxonomy_leaf IS NOT NULL UNION SELECT c FROM fam)
SELECT k.c AS canonical, coalesce((SELECT string_agg(DISTINCT b, ',' ORDER BY b) FROM n WHERE n.c = k.c), '') AS aliases FROM k""")
def merged_families(spark, d):
    """SET-08: leaves as families of their tags, put together with the fixed ones."""
    leaf = _t(spark, d, "recipes").filter("taxonomy_leaf is not null").select(F.col("taxonomy_leaf").alias("canonical"), F.coalesce("tags", F.array().cast("array<string>")).alias("aliases"))
    return I.merge_families(_families(spark), leaf).select("canonical", F.array_join("aliases", ",").alias("aliases"))


@query(f"""WITH {_FAM}, m AS (SELECT c, c AS m FROM fam UNION SELECT c, unnest(a) FROM fam), t AS (SELECT report_id, unnest(list_distinct({_QT.format("query_text")})) AS m FROM golden_report)
SELECT DISTINCT c AS canonical FROM (SELECT report_id, c FROM t JOIN m USING (m) GROUP BY 1, 2 HAVING count(*) > 1)""")
def distinguished_families(spark, d):
    """HLP-13."""
    return I.distinguished(_families(spark), _t(spark, d, "golden_report"), "query_text")


@query(f"""WITH c AS (SELECT DISTINCT 'git ' || v AS command, v FROM (SELECT {_BV.format("x")} AS v FROM (SELECT unnest(commands).command AS x FROM recipes)) WHERE v <> ''),
  g AS (SELECT report_id, lower(trim(primary_verb)) AS low FROM golden_report)
SELECT report_id, coalesce((SELECT min(command) FROM c WHERE lower(command) = low), (SELECT min(command) FROM c WHERE v = split_part(regexp_replace(low, '^git\\s+', ''), ' ', 1))) AS command FROM g""")
def known_commands(spark, d):
    """HLP-18, HLP-21."""
    c = _recipe_verbs(spark, d).select(F.explode("verbs").alias("v")).distinct().select(F.concat(F.lit("git "), "v").alias("command"))
    return I.known_command(_t(spark, d, "golden_report").select("report_id", "primary_verb"), "primary_verb", c).select("report_id", "command")


@query(f"""WITH {_RV}, n AS (SELECT DISTINCT list_sort(verbs) AS need FROM rv WHERE len(verbs) > 1), s AS (SELECT need, id, 10 * len(list_intersect(need, verbs)) - steps + CASE WHEN list_contains(need, prim) THEN 5 ELSE 0 END AS score FROM n, rv WHERE steps < 7 AND len(list_intersect(need, verbs)) BETWEEN 1 AND len(need) - 1)
SELECT array_to_string(need, ',') AS need_id, arg_min(id, {{'s': -score, 'i': id}}) AS id, max(score) AS score FROM s GROUP BY need""")
def coverage_parents(spark, d):
    """JN-15."""
    r = _recipe_verbs(spark, d)
    needs = r.filter("size(verbs) > 1").select(F.array_sort("verbs").alias("verbs")).distinct().withColumn("need_id", F.array_join("verbs", ","))
    return I.coverage_parents(needs, r).withColumn("score", F.col("score").cast("bigint"))


@query(r"""WITH f AS (SELECT id, list_distinct(flatten(list_transform(coalesce(commands, []), lambda z: list_transform(list_filter(list_filter(string_split_regex(trim(z.command), '\s+'), lambda t: t <> '')[3:], lambda t: regexp_matches(t, '^--|^-[a-zA-Z]')), lambda t: CASE WHEN starts_with(t, '--') THEN regexp_replace(t, '=.*$', '') ELSE t END)))) AS fl FROM recipes),
  n AS (SELECT fl AS flag, count(*) AS n FROM (SELECT unnest(fl) AS fl FROM f) GROUP BY 1), a AS (SELECT coalesce(list(flag) FILTER (n >= 5), []) AS ok FROM n)
SELECT id, CASE WHEN list_has_any(fl, ['--hard', '--force']) THEN 'denied' WHEN NOT list_has_all(ok, fl) THEN 'not_allowed' ELSE 'ok' END AS verdict FROM f, a""")
def flag_verdicts(spark, d):
    """FLT-14: flags of fewer than five recipes aren't allowed."""
    r = _t(spark, d, "recipes").select("id", F.array_distinct(F.flatten(F.transform(F.coalesce("commands", F.array().cast(C.STEPS)), lambda s: C.flags(s["command"])))).alias("fl"))
    verdict = F.when(F.arrays_overlap("fl", F.array(F.lit("--hard"), F.lit("--force"))), "denied").when(F.col("rare"), "not_allowed").otherwise("ok")
    return I.rare_flags(r, "fl", 5).select("id", verdict.alias("verdict"))


@query("""WITH f AS (SELECT report_id, list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(command_id, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS f FROM golden_report WHERE coalesce(command_id, '') <> '')
SELECT report_id, CASE WHEN f % 1000 < 700 THEN 'train' ELSE 'holdout' END AS split FROM f""")
def split_by_command(spark, d):
    """STM-09."""
    return I.split_by_id(_t(spark, d, "golden_report").select("report_id", "command_id"), "command_id").select("report_id", "split")


_NEXT = "((({0} * 1103515245.0 + 12345.0)::HUGEINT & 4294967295) & 2147483647)::DOUBLE"


@query(rf"""WITH g AS (SELECT report_id, query_text AS q, regexp_extract(report_id, '(\d+)$', 1)::DOUBLE AS s0, regexp_extract_all(query_text, '[\s\p{{Z}}]+|[^\s\p{{Z}}]+') AS p FROM golden_report WHERE query_text IS NOT NULL),
  d1 AS (SELECT *, {_NEXT.format("s0")} AS s1 FROM g), d2 AS (SELECT *, {_NEXT.format("s1")} AS s2 FROM d1), d3 AS (SELECT *, {_NEXT.format("s2")} AS s3 FROM d2), d4 AS (SELECT *, {_NEXT.format("s3")} AS s4 FROM d3),
  k AS (SELECT report_id, p, list_transform([s1, s2, s3, s4], lambda v: v / 2147483647.0) AS u, list_filter(range(1, len(p) + 1), lambda i: NOT regexp_full_match(p[i], '[\s\p{{Z}}]+')) AS w FROM d4),
  a AS (SELECT *, CASE WHEN len(w) < 2 THEN 0 WHEN u[1] > 0.3 THEN 2 ELSE 1 END AS used, floor(u[2] * (len(w) - 1))::INT + 1 AS j FROM k),
  b AS (SELECT *, CASE WHEN used = 2 THEN w[j] END AS x, CASE WHEN used = 2 THEN coalesce(w[j + 1], w[1]) END AS y FROM a),
  c AS (SELECT *, array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i = x THEN p[y] WHEN i = y THEN p[x] ELSE p[i] END), '') AS t FROM b),
  e AS (SELECT *, least(floor(u[used + 1] * length(t))::INT, length(t) - 1) AS at0 FROM c)
SELECT report_id, 'scrambled' AS kind, CASE WHEN length(t) > 4 AND regexp_full_match(substr(t, at0 + 1, 1), '[A-Za-z0-9_]') THEN substr(t, 1, at0) || chr(97 + floor(u[used + 2] * 26)::INT) || substr(t, at0 + 2) ELSE t END AS query_text FROM e""")
def scrambled_bank(spark, d):
    """PRJ-09, STR-16."""
    g = _t(spark, d, "golden_report").filter("query_text is not null")
    return g.select("report_id", F.lit("scrambled").alias("kind"), I.scrambled(F.col("query_text"), F.regexp_extract("report_id", r"(\d+)$", 1).cast("double")).alias("query_text"))


_FX = r"""CASE WHEN regexp_matches(j, '\bgit (clone|init)\b') THEN 'bare_workdir' WHEN regexp_matches(j, '\b(push|pull|fetch)\b') THEN 'with_remote' WHEN regexp_matches(j, '\b(rm|mv)\b') THEN 'with_tracked_file' WHEN regexp_matches(j, '\bcommit\b') THEN 'staged_changes' WHEN regexp_matches(j, '\bmerge\b') THEN 'two_branches'
  WHEN regexp_matches(j, '\brebase\b') THEN 'with_history' WHEN regexp_matches(j, '\b(status|diff|add)\b') THEN 'dirty_worktree' WHEN regexp_matches(j, '\b(log|show|checkout|switch|branch|reset|tag)\b') THEN 'with_commit' ELSE 'inited' END"""


@query(f"SELECT id, {_FX} AS fixture FROM (SELECT id, lower(array_to_string(list_transform(coalesce(commands, []), lambda s: s.command), ' ')) AS j FROM recipes)")
def fixtures(spark, d):
    """STR-11."""
    return _t(spark, d, "recipes").select("id", I.fixture_hint(F.transform(F.coalesce("commands", F.array().cast(C.STEPS)), lambda s: s["command"])).alias("fixture"))


@query("SELECT id, substr(sha256(coalesce(taxonomy_leaf, '') || chr(10) || array_to_string(list_transform(coalesce(commands, []), lambda s: s.command), chr(10)) || chr(10) || coalesce(title, '')), 1, 24) AS stable_id FROM recipes")
def stable_ids(spark, d):
    """HLP-17 over the plain steps."""
    lines = F.array_join(F.transform(F.coalesce("commands", F.array().cast(C.STEPS)), lambda s: s["command"]), "\n")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return _t(spark, d, "recipes").select("id", F.substring(F.sha2(F.concat(blank("taxonomy_leaf"), F.lit("\n"), lines, F.lit("\n"), blank("title")), 256), 1, 24).alias("stable_id"))


@query("SELECT count(*) FILTER (kind = 'golden') AS golden, count(*) FILTER (mutation_kind = 'composition') AS compositions, count(*) >= 150 AND count(*) FILTER (mutation_kind = 'composition') >= 30 AS ok FROM golden_report")
def bank_floors(spark, d):
    """AGG-20."""
    g = _t(spark, d, "golden_report")
    n = F.count_if(F.col("mutation_kind") == "composition")
    return g.agg(F.count_if(F.col("kind") == "golden").alias("golden"), n.alias("compositions"), ((F.count(F.lit(1)) >= 150) & (n >= 30)).alias("ok"))


@query(_GENERAL["p1_found"])
def session_window_hard_gap(spark, d):
    """STM-03 in batch: Spark's own session window, which joins events exactly a gap apart."""
    e = _t(spark, d, "observe_events").select("id", "pulled_at", "delivery_id", real_key(F.col("sessionid"), F.col("distinctid")).alias("thread_key"), instant_ms(F.col("createdat")).alias("ms"))
    first = accept(e, "id", ["pulled_at", "delivery_id"], ["thread_key", "ms"]).filter("thread_key is not null and ms is not null").withColumn("at", F.timestamp_millis("ms"))
    w = first.groupBy(F.session_window("at", "45 seconds").alias("w"), "thread_key").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.count(F.lit(1)).alias("event_count"))
    return w.drop("w")
