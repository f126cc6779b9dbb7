"""Queries over catalog, coverage, evaluation, similarity and taxonomy operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions import commands as C
from tessellar.functions import text as T
from tessellar.functions.numbers import distance_to_similarity, min_count_for_rate
from tessellar.operators import catalog as cat
from tessellar.operators import coverage as cov
from tessellar.operators import evaluation as ev
from tessellar.operators import similarity as sim
from tessellar.operators import taxonomy as tax
from tessellar.operators.fulltext import embed_text, recipe_body
from tessellar.operators.vectors import close_pairs, knn
from tessellar.plans.identity_sql import fingerprints_sql


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- scans and projections -------------------------------------------------------------------------------------------


@query("SELECT id, title, taxonomy_leaf, risk FROM recipes WHERE taxonomy_leaf = 'branch'")
def recipes_by_leaf(spark, d):
    """SRC-01, SRC-02."""
    return _t(spark, d, "recipes").filter("taxonomy_leaf = 'branch'").select("id", "title", "taxonomy_leaf", "risk")


@query("SELECT id, title FROM recipes WHERE id IN (SELECT command_id FROM golden_report)")
def recipe_multi_get(spark, d):
    """SRC-03, SRC-04."""
    return cat.lookup(_t(spark, d, "recipes"), "id", _t(spark, d, "golden_report"), "command_id").select("id", "title")


_LINE = "CASE WHEN coalesce(s.comment, '') <> '' THEN s.command || '  # ' || s.comment ELSE s.command END"


@query(f"""SELECT id, array_to_string(list_transform(coalesce(commands, []), lambda s: {_LINE}), chr(10)) AS snippet, coalesce(commands[1].command, '') AS command,
  greatest(len(coalesce(commands, [])), 1) AS step_count, CASE WHEN regexp_matches(trim(coalesce(commands[1].command, '')), '^git\\s+\\S') THEN 'git ' || regexp_extract(trim(commands[1].command), '^git\\s+(\\S+)', 1) ELSE '' END AS family FROM recipes""")
def recipe_snippets(spark, d):
    """PRJ-02, PRJ-04, PRJ-07, HLP-27."""
    r = _t(spark, d, "recipes").withColumn("commands", F.coalesce("commands", F.array().cast(C.STEPS)))
    return cat.family(r).join(r.select("id", C.snippet(F.col("commands")).alias("snippet")), "id")


@query("SELECT id, n AS steps, n AS parsed, n AS legacy, lines FROM (SELECT id, len(coalesce(commands, [])) AS n, array_to_string(list_transform(coalesce(commands, []), lambda s: s.command), chr(10)) AS lines FROM recipes)")
def steps_round_trip(spark, d):
    """PRJ-01, PRJ-03, ARR-02: steps written as JSON in the current and in the older form and read back."""
    r = _t(spark, d, "recipes").select("id", F.coalesce("commands", F.array().cast(C.STEPS)).alias("c"))
    old = F.to_json(F.transform("c", lambda s: F.struct(s["command"].alias("run"), s["comment"].alias("comment"))))
    return r.select("id", F.size("c").alias("steps"), F.size(C.parse_steps(C.steps_json(F.col("c")))).alias("parsed"), F.size(C.parse_steps(old)).alias("legacy"), F.array_join(F.transform(C.parse_steps(C.steps_json(F.col("c"))), lambda s: s["command"]), "\n").alias("lines"))


@query("""SELECT id, array_to_string(list_filter(list_concat([title, description], coalesce(tags, []), coalesce(paraphrases, []), flatten(list_transform(coalesce(commands, []), lambda s: [s.command, s.comment]))), lambda x: x IS NOT NULL AND trim(x) <> ''), chr(10)) AS body,
  array_to_string(list_filter(list_concat([description], coalesce(paraphrases, [])), lambda x: x IS NOT NULL AND trim(x) <> ''), chr(10)) AS embed FROM recipes""")
def recipe_bodies(spark, d):
    """PRJ-05, PRJ-06."""
    return _t(spark, d, "recipes").select("id", recipe_body().alias("body"), embed_text().alias("embed"))


@query(r"""SELECT report_id, trim(regexp_replace(query_text, '[\s\p{Z}]+', ' ', 'g')) AS collapsed, trim(regexp_replace(regexp_replace(lower(query_text), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS plain,
  left(regexp_replace(regexp_replace(lower(query_text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS slug, ceil(length(coalesce(query_text, '')) / 4.0)::BIGINT AS tokens,
  coalesce(trim(query_text) = '', true) OR regexp_matches(query_text, '(?i)^\s*git\b') OR regexp_matches(query_text, '&&|\|\||;|`') AS command_like, coalesce(regexp_matches(query_text, '(?i)^how do i use git\s+\S+'), false) AS fallback,
  array_to_string(list_filter(string_split_regex(lower(coalesce(query_text, '')), '[^a-z0-9_+\-]+'), lambda x: x <> ''), ' ') AS tokens_text FROM golden_report""")
def text_normalizers(spark, d):
    """STR-01, STR-02, STR-04, STR-17, FLT-05, FLT-09, MTH-05."""
    q = F.col("query_text")
    return _t(spark, d, "golden_report").select(
        "report_id", T.collapse_space(q).alias("collapsed"), T.plain_query(q).alias("plain"), T.slug(q).alias("slug"), T.estimated_tokens(q).alias("tokens"), T.is_command_like(q).alias("command_like"), T.is_fallback_question(q).alias("fallback"), F.array_join(T.query_tokens(q), " ").alias("tokens_text")
    )


@query(r"""WITH x AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\b\d+\.\d+\b') AS v FROM documents), e AS (SELECT doc_id, unnest(v) AS v FROM x)
SELECT doc_id, arg_max(v, {'a': split_part(v, '.', 1)::BIGINT, 'b': split_part(v, '.', 2)::BIGINT, 'v': v}) AS latest, count(*) AS versions FROM e GROUP BY doc_id""")
def semver_order(spark, d):
    """STR-20: the latest version number each document names."""
    e = _t(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b(\d+\.\d+)\b"), F.lit(1))).alias("v"))
    return e.groupBy("doc_id").agg(F.max_by("v", F.struct(T.semver_key(F.col("v")), "v")).alias("latest"), F.count(F.lit(1)).alias("versions"))


@query(r"""WITH s AS (SELECT id, unnest(commands).command AS line FROM recipes), w AS (SELECT id, list_filter(string_split_regex(trim(line), '\s+'), lambda t: t <> '') AS w FROM s),
  f AS (SELECT id, unnest(list_transform(list_filter(w[3:], lambda t: regexp_matches(t, '^--|^-[a-zA-Z]')), lambda t: CASE WHEN starts_with(t, '--') THEN regexp_replace(t, '=.*$', '') ELSE t END)) AS flag, CASE WHEN len(w) >= 2 AND w[1] = 'git' THEN 'git ' || w[2] ELSE '' END AS verb FROM w)
SELECT verb, flag, count(DISTINCT id) AS recipes FROM f GROUP BY 1, 2""")
def flags_by_verb(spark, d):
    """STR-07, STR-08."""
    s = _t(spark, d, "recipes").select("id", F.explode("commands").alias("s")).select("id", C.verb(F.col("s.command")).alias("verb"), F.explode(C.flags(F.col("s.command"))).alias("flag"))
    return s.groupBy("verb", "flag").agg(F.count_distinct("id").alias("recipes"))


_BUCKET = r"""CASE WHEN regexp_matches(s, 'detach|checkout\s+[0-9a-f]{7,}|reset\s+--hard\s+head~\d+|branch.*diverg|merge-base') THEN 'detached_or_diverged' WHEN regexp_matches(s, 'remote|fetch\s+origin') THEN 'with_remote'
  WHEN regexp_matches(s, 'echo\s+.*>|printf\s+|dirty|untracked|git\s+add|working tree|modify') AND NOT regexp_matches(s, 'commit\s+--allow-empty') AND regexp_matches(s, 'echo\s+|printf\s+|>>|>\s+\w+|git\s+add') THEN 'dirty_worktree'
  WHEN regexp_matches(s, 'echo\s+|printf\s+|>>|\btouch\b') THEN 'dirty_worktree' ELSE 'minimal' END"""


@query(f"SELECT bucket, count(*) AS recipes FROM (SELECT {_BUCKET} AS bucket FROM (SELECT lower(coalesce(initial_state, '')) AS s FROM recipes)) GROUP BY 1")
def state_buckets(spark, d):
    """STR-10."""
    return _t(spark, d, "recipes").groupBy(C.state_bucket(F.col("initial_state")).alias("bucket")).agg(F.count(F.lit(1)).alias("recipes"))


@query(f"WITH {fingerprints_sql()} SELECT id, fingerprint FROM fp")
def structural_fingerprints(spark, d):
    """DED-01."""
    return _t(spark, d, "recipes").select("id", C.fingerprint(F.transform(F.coalesce("commands", F.array().cast(C.STEPS)), lambda s: s["command"])).alias("fingerprint"))


@query("SELECT a.vec_id, round(greatest(0, least(1, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS similarity, greatest(0, ceil(a.label * 0.3 - 1e-9))::BIGINT AS least_n FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def similarity_of_distance(spark, d):
    """PRJ-08, MTH-03."""
    from tessellar.functions.numbers import cosine

    e = _t(spark, d, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", F.round(distance_to_similarity(1 - cosine(F.col("embedding"), F.col("other"))), 6).alias("similarity"), min_count_for_rate(F.col("label"), F.lit(0.3)).alias("least_n"))


# --- filters, joins, tables ------------------------------------------------------------------------------------------


@query("""SELECT id, CASE WHEN id IS NULL OR trim(id) = '' THEN 'id' WHEN coalesce(trim(title), '') = '' THEN 'title' WHEN length(title) > 120 THEN 'title_length' WHEN coalesce(trim(description), '') = '' THEN 'description'
  WHEN length(description) > 4000 THEN 'description_length' WHEN coalesce(len(commands), 0) = 0 THEN 'commands' WHEN len(list_filter(commands, lambda s: coalesce(trim(s.command), '') = '')) > 0 THEN 'blank_command'
  WHEN risk IS NULL OR isnan(risk) OR risk < 0 OR risk > 1 THEN 'risk' END AS problem FROM recipes WHERE problem IS NOT NULL""")
def recipe_problems(spark, d):
    """FLT-12, FLT-13."""
    return cat.validate_recipes(_t(spark, d, "recipes"))[1].select("id", "problem")


@query("SELECT report_id, command_id FROM golden_report WHERE command_id IS NULL OR command_id NOT IN (SELECT id FROM recipes)")
def fk_dangling(spark, d):
    """FLT-12, FLT-22."""
    return cat.dangling(_t(spark, d, "golden_report"), "command_id", _t(spark, d, "recipes"), "id").select("report_id", "command_id")


@query(r"""SELECT problem, count(*) AS steps FROM (SELECT CASE WHEN c = '' THEN 'schema' WHEN length(c) > 512 THEN 'length' WHEN regexp_matches(c, '[;&|`$<>\n]') THEN 'shell_meta' WHEN NOT regexp_matches(c, '^git(\s|$)') THEN 'allowlist'
  WHEN regexp_matches(c, '<[^>]+>') THEN 'placeholder' WHEN len(string_split_regex(c, '\s+')) > 14 THEN 'prose' WHEN contains(c, '#') THEN 'inline_comment' ELSE 'ok' END AS problem FROM (SELECT trim(coalesce(unnest(commands).command, ''), ' ') AS c FROM recipes UNION ALL SELECT trim(unnest(paraphrases), ' ') FROM recipes UNION ALL SELECT trim('git ' || unnest(paraphrases), ' ') FROM recipes) WHERE c IS NOT NULL) GROUP BY 1""")
def command_checks(spark, d):
    """FLT-11: commands, paraphrases, and paraphrases as arguments."""
    r = _t(spark, d, "recipes")
    s = r.select(F.explode("commands").alias("s")).select(F.coalesce("s.command", F.lit("")).alias("c"))
    p = r.select(F.explode("paraphrases").alias("c")).filter("c is not null")
    s = s.unionByName(p).unionByName(p.select(F.concat(F.lit("git "), "c").alias("c")))
    return s.groupBy(F.coalesce(cat.example_problem(F.col("c")), F.lit("ok")).alias("problem")).agg(F.count(F.lit(1)).alias("steps"))


@query("SELECT g.report_id, g.command_id, r.title, r.taxonomy_leaf FROM golden_report g LEFT JOIN recipes r ON r.id = g.command_id")
def left_hydrate(spark, d):
    """JN-01, JN-03, PRJ-17."""
    return cat.hydrate(_t(spark, d, "golden_report").select("report_id", "command_id"), "command_id", _t(spark, d, "recipes"), "id", ["title", "taxonomy_leaf"])


@query("""WITH n AS (SELECT command_id AS id, max(query_text) AS title FROM golden_report WHERE command_id IS NOT NULL AND query_text IS NOT NULL GROUP BY 1)
SELECT id, title FROM recipes WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, title FROM n""")
def upsert_keep_latest(spark, d):
    """SNK-01, SNK-02: golden queries put over the recipes' titles, the greatest one winning."""
    new = _t(spark, d, "golden_report").filter("command_id is not null and query_text is not null").select(F.col("command_id").alias("id"), F.col("query_text").alias("title"))
    return cat.upsert(_t(spark, d, "recipes").select("id", "title"), new, "id", "title")


@query("SELECT id, CASE WHEN coalesce(trim(title), '') = '' OR list_contains(coalesce(paraphrases, []), trim(title)) THEN len(coalesce(paraphrases, [])) ELSE len(coalesce(paraphrases, [])) + 1 END AS n FROM recipes")
def append_paraphrase(spark, d):
    """SNK-03."""
    return _t(spark, d, "recipes").select("id", F.size(cat.append_absent(F.col("paraphrases"), F.col("title"))).cast("bigint").alias("n"))


@query("""WITH r AS (SELECT *, coalesce(taxonomy_leaf, '') || '::' || lower(array_to_string(list_transform(coalesce(commands, []), lambda s: s.command), chr(10))) AS k,
    coalesce(validated, false)::INT * 500 + len(coalesce(paraphrases, [])) * 10 + least(length(coalesce(description, '')), 500) AS score FROM recipes),
  h AS (SELECT k, arg_min(id, {'s': -score, 'i': id}) AS id, count(*) AS records, count(DISTINCT id) AS ids FROM r GROUP BY k),
  t AS (SELECT DISTINCT k, t FROM (SELECT k, unnest(tags) AS t FROM r) WHERE t IS NOT NULL), tt AS (SELECT k, count(*) AS n FROM t GROUP BY k)
SELECT h.k AS merge_key, h.id, records, coalesce(tt.n, 0) AS tags FROM h LEFT JOIN tt USING (k)""")
def fingerprint_merge(spark, d):
    """DED-02, AGG-28, SET-03 on the plain text of the steps."""
    key = F.concat(F.coalesce("taxonomy_leaf", F.lit("")), F.lit("::"), F.lower(F.array_join(F.transform(F.coalesce("commands", F.array().cast(C.STEPS)), lambda s: s["command"]), "\n")))
    return cat.merge_groups(_t(spark, d, "recipes").withColumn("merge_key", key), ["merge_key"]).select("merge_key", "id", "records", F.size("tags").cast("bigint").alias("tags"))


@query(f"""WITH {fingerprints_sql()}, r AS (SELECT coalesce(taxonomy_leaf, '') AS leaf, fingerprint, id, trim(coalesce(description, ''), ' ') AS de, trim(coalesce(title, ''), ' ') AS ti, coalesce(paraphrases, []) AS pa,
    coalesce(validated, false)::INT * 500 + len(coalesce(paraphrases, [])) * 10 + least(length(coalesce(description, '')), 500) AS score FROM recipes JOIN fp USING (id)),
  g AS (SELECT leaf, fingerprint, count(*) AS records, list(id ORDER BY -score, id) AS ids, list(ti ORDER BY -score, id) AS tis, list(de ORDER BY -score, id) AS des, list_distinct(list_filter(flatten(list(pa || [de, ti])), lambda x: coalesce(x, '') <> '')) AS said FROM r GROUP BY ALL),
  f AS (SELECT *, list_reduce(des, lambda cur, x: CASE WHEN length(x) > length(cur) * 1.2 THEN x ELSE cur END) AS description FROM g)
SELECT leaf, fingerprint, ids[1] AS id, records, description, len(list_filter(said, lambda x: x <> description AND x <> tis[1])) AS paraphrases FROM f""")
def structural_merge(spark, d):
    """DED-01 with DED-02: groups by structural fingerprint within a leaf, descriptions and paraphrases folded."""
    fp = C.fingerprint(F.transform(F.coalesce("commands", F.array().cast(C.STEPS)), lambda s: s["command"]))
    r = _t(spark, d, "recipes").withColumn("fingerprint", fp).withColumn("leaf", F.coalesce("taxonomy_leaf", F.lit("")))
    return cat.merge_groups(r, ["leaf", "fingerprint"]).select("leaf", "fingerprint", "id", "records", "description", F.size("paraphrases").alias("paraphrases"))


@query("WITH t AS (SELECT len(coalesce(commands, [])) AS n, unnest(list_distinct(coalesce(tags, []))) AS tag FROM recipes) SELECT tag, count(*) AS recipes, count(*) FILTER (n >= 2) AS multi_step, floor(count(*) FILTER (n >= 2) * 100.0 / count(*) + 0.5)::BIGINT AS multi_pct FROM t WHERE trim(coalesce(tag, '')) <> '' GROUP BY tag")
def tag_counts(spark, d):
    """AGG-23."""
    return cat.tag_counts(_t(spark, d, "recipes"))


@query("SELECT provenance, validated, count(*) AS recipes FROM recipes GROUP BY ALL")
def provenance_counts(spark, d):
    """AGG-01, AGG-22."""
    return _t(spark, d, "recipes").groupBy("provenance", "validated").agg(F.count(F.lit(1)).alias("recipes"))


_V = r"CASE WHEN regexp_matches({0}, '^\s*git\s+\S') THEN 'git ' || regexp_extract({0}, '^\s*git\s+(\S+)', 1) ELSE '' END"


@query(f"SELECT DISTINCT v AS verb FROM (SELECT {_V.format('c')} AS v FROM (SELECT unnest(commands).command AS c FROM recipes)) WHERE v <> ''")
def verb_vocabulary(spark, d):
    """AGG-24: verbs."""
    return cat.verbs_of(_t(spark, d, "recipes"))


# --- coverage --------------------------------------------------------------------------------------------------------

_FLAGSQL = r"list_sort(list_distinct(flatten(list_transform(list_filter(coalesce(commands, []), lambda z: {1}), lambda z: list_transform(list_filter(list_filter(string_split_regex(trim(z.command), '\s+'), lambda t: t <> '')[3:], lambda t: regexp_matches(t, '^--|^-[a-zA-Z]')), lambda t: CASE WHEN starts_with(t, '--') THEN regexp_replace(t, '=.*$', '') ELSE t END)))))".replace("{1}", _V.format("z.command") + " = v")
_COVER = f"""WITH b AS (SELECT *, {_V.format("coalesce(commands[1].command, '')")} AS v, lower(coalesce(initial_state, '')) AS s, greatest(1, least(7, len(commands))) AS n FROM recipes),
  r AS (SELECT id, v, n, {_BUCKET} AS st, CASE WHEN len({_FLAGSQL}) = 0 THEN '(none)' ELSE array_to_string({_FLAGSQL}, ' ') END AS f FROM b WHERE v <> ''),
  g AS (SELECT v AS verb, count(DISTINCT id) AS records, count(DISTINCT st) AS states, count(DISTINCT f) AS flag_sets, count(*) FILTER (n = 1) AS len1, count(*) FILTER (n IN (2, 3)) AS len23, count(*) FILTER (n >= 4) AS len47 FROM r GROUP BY v),
  p AS (SELECT *, least(1.0, states / 3.0) AS state_p, least(1.0, flag_sets / 3.0) AS flag_p, least(1.0, (least(len1, 1) + least(len23, 3) + least(len47, 2)) / 6.0) AS comp_p, least(1.0, records / 24.0) AS count_p FROM g),
  c AS (SELECT *, (state_p + flag_p + comp_p + count_p) / 4 AS score, records >= 24 AND states >= 3 AND flag_sets >= 3 AND len1 >= 1 AND len23 >= 3 AND len47 >= 2 AS saturated,
      CASE WHEN state_p <= flag_p AND state_p <= comp_p THEN 'state' WHEN flag_p <= comp_p THEN 'flag' ELSE 'composition' END AS weakest FROM p)"""


@query(_COVER + " SELECT verb, records, states, flag_sets, len1, len23, len47, round(state_p, 6) AS state_p, round(flag_p, 6) AS flag_p, round(comp_p, 6) AS comp_p, round(count_p, 6) AS count_p, round(score, 6) AS score, saturated, weakest FROM c")
def verb_coverage(spark, d):
    """AGG-04, AGG-05, SRT-04."""
    return _r6(cov.verb_coverage(_t(spark, d, "recipes")))


@query(_COVER + ", q AS (SELECT DISTINCT 'git ' || lower(replace(primary_verb, 'git ', '')) AS verb FROM golden_report WHERE primary_verb IS NOT NULL) SELECT coalesce(bool_and(coalesce(saturated, false)), false) AS all_saturated FROM q LEFT JOIN c USING (verb)")
def all_saturated(spark, d):
    """AGG-06."""
    need = _t(spark, d, "golden_report").filter("primary_verb is not null").select(F.concat(F.lit("git "), F.lower(F.replace("primary_verb", F.lit("git "), F.lit("")))).alias("verb"))
    return cov.all_saturated(need, cov.verb_coverage(_t(spark, d, "recipes")))


@query(_COVER + f""", s AS (SELECT DISTINCT taxonomy_leaf AS leaf, nullif({_V.format("x")}, '') AS verb FROM (SELECT taxonomy_leaf, unnest(CASE WHEN len(coalesce(commands, [])) = 0 THEN [NULL] ELSE list_transform(commands, lambda s: s.command) END) AS x FROM recipes) WHERE taxonomy_leaf IS NOT NULL),
  m AS (SELECT leaf, min(coalesce(score, 0)) AS priority, min(coalesce(state_p, 0)) AS s, min(coalesce(flag_p, 0)) AS f, min(coalesce(comp_p, 0)) AS c FROM s LEFT JOIN c USING (verb) WHERE verb IS NOT NULL OR leaf NOT IN (SELECT leaf FROM s WHERE verb IS NOT NULL) GROUP BY leaf)
SELECT leaf, round(priority, 6) AS priority, CASE WHEN s <= f AND s <= c THEN 'state' WHEN f <= c THEN 'flag' ELSE 'composition' END AS kind FROM m""")
def leaf_priority(spark, d):
    """AGG-07, AGG-08."""
    r = _t(spark, d, "recipes").filter("taxonomy_leaf is not null")
    leaves = r.select(F.col("taxonomy_leaf").alias("leaf"), F.explode_outer(C.step_verbs(F.coalesce("commands", F.array().cast(C.STEPS)))).alias("v")).groupBy("leaf").agg(F.collect_set("v").alias("verbs"))
    return _r6(cov.leaf_priority(leaves, cov.verb_coverage(_t(spark, d, "recipes"))))


@query("SELECT DISTINCT taxonomy_leaf FROM recipes WHERE taxonomy_leaf IS NOT NULL AND taxonomy_leaf NOT IN (SELECT taxonomy_leaf FROM documents WHERE taxonomy_leaf IS NOT NULL)")
def unmapped_leaves(spark, d):
    """JN-08, JN-09, SET-04."""
    return cov.unmapped(_t(spark, d, "recipes").filter("taxonomy_leaf is not null"), _t(spark, d, "documents"), "taxonomy_leaf")


@query(f"""WITH n AS (SELECT lower(trim(taxonomy_leaf)) AS node, count(*) AS times FROM (SELECT DISTINCT taxonomy_leaf FROM documents WHERE taxonomy_leaf IS NOT NULL) GROUP BY 1),
  m AS (SELECT DISTINCT lower(trim(taxonomy_leaf)) AS node, {_V.format("x")} AS command FROM (SELECT taxonomy_leaf, unnest(commands).command AS x FROM recipes) WHERE taxonomy_leaf IS NOT NULL), k AS (SELECT * FROM m WHERE command <> ''), p AS (SELECT n.node, times, count(command) AS c FROM n LEFT JOIN k USING (node) GROUP BY ALL)
SELECT count(*) AS nodes, count(*) FILTER (c = 0) AS empty, count(*) FILTER (times > 1) AS repeated, count(*) FILTER (c > 6) AS over_mapped, (SELECT count(DISTINCT command) FROM k) AS commands FROM p""")
def taxonomy_coverage(spark, d):
    """AGG-09."""
    nodes = _t(spark, d, "documents").select("taxonomy_leaf").filter("taxonomy_leaf is not null").distinct().select(F.lower(F.trim("taxonomy_leaf")).alias("node"))
    m = _t(spark, d, "recipes").filter("taxonomy_leaf is not null").select(F.lower(F.trim("taxonomy_leaf")).alias("node"), F.explode("commands").alias("s")).select("node", C.verb(F.col("s.command")).alias("command")).filter("command <> ''")
    return cov.mapping_report(nodes, m)


_HAVE = f"SELECT id, list_distinct(list_filter(list_transform(coalesce(commands, []), lambda s: {_V.format('s.command')}), lambda v: v <> '')) AS v FROM recipes"


@query(f"WITH h AS ({_HAVE}), n AS (SELECT DISTINCT list_sort(v) AS v FROM h WHERE len(v) > 1) SELECT array_to_string(n.v, ',') AS need, count(*) AS covering FROM n JOIN h ON list_has_all(h.v, n.v) GROUP BY 1")
def set_containment_cover(spark, d):
    """JN-12."""
    h = _t(spark, d, "recipes").select(F.col("id").alias("have_id"), C.step_verbs(F.coalesce("commands", F.array().cast(C.STEPS))).alias("verbs"))
    need = h.filter("size(verbs) > 1").select("verbs").distinct().withColumn("need_id", F.array_join("verbs", ","))
    return cov.covered_sets(need, h).withColumnRenamed("need_id", "need")


@query("""WITH p AS (SELECT id, coalesce(risk, 0) AS risk, len(coalesce(paraphrases, [])) AS pr FROM recipes ORDER BY pr, risk, id LIMIT 60),
  a AS (SELECT *, row_number() OVER (ORDER BY risk, pr, id) - 1 AS r, count(*) OVER () AS n FROM p), b AS (SELECT *, CASE WHEN r < ceil(n / 3.0) THEN 0 WHEN r < ceil(2 * n / 3.0) THEN 1 ELSE 2 END AS t FROM a),
  c AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY r) AS i FROM b) SELECT id, row_number() OVER (ORDER BY i, t) AS pick FROM c QUALIFY pick <= 20""")
def tercile_round_robin(spark, d):
    """WIN-12: twenty recipes to extend, fewest paraphrases first, spread over the risk (a sampling operator)."""
    r = _t(spark, d, "recipes").select("id", F.coalesce("risk", F.lit(0.0)).alias("risk"), F.size(F.coalesce("paraphrases", F.array().cast("array<string>"))).alias("pr"))
    return cov.tercile_pick(r, "pr", "risk", "id", 20).select("id", "pick")


# --- evaluation ------------------------------------------------------------------------------------------------------
# A deterministic stand-in for a searcher: the ten lowest-risk recipes of the verb the record names.

_RES = f"""r AS (SELECT id, lower({_V.format("coalesce(commands[1].command, '')")}) AS v, coalesce(risk, 0) AS risk, title FROM recipes),
  tp AS (SELECT v, id, row_number() OVER (PARTITION BY v ORDER BY risk, id) AS rank FROM r WHERE v <> '' QUALIFY rank <= 10),
  bank AS (SELECT report_id AS query_id, command_id AS expected, kind, mutation_kind, lower(trim(coalesce(primary_verb, ''))) AS v FROM golden_report),
  res AS (SELECT query_id, id, rank FROM bank JOIN tp USING (v)), lin AS (SELECT id AS child, min(id) OVER (PARTITION BY title) AS parent FROM r),
  ht AS (SELECT b.query_id, any_value(b.expected) AS expected, any_value(b.kind) AS kind, any_value(b.mutation_kind) AS mutation_kind, coalesce(bool_or(id = expected AND rank <= 3), false) AS hit_display, coalesce(bool_or(id = expected AND rank <= 10), false) AS hit_deep,
     coalesce(bool_or((id = expected OR parent = expected) AND rank <= 3), false) AS hit_family FROM bank b LEFT JOIN res USING (query_id) LEFT JOIN lin ON lin.child = res.id GROUP BY b.query_id)"""


def _eval(spark, d):
    r = _t(spark, d, "recipes").select("id", "title", F.lower(C.verb(C.primary_command(F.col("commands")))).alias("v"), F.coalesce("risk", F.lit(0.0)).alias("risk"))
    from tessellar.operators.fulltext import top

    best = top(r.filter("v <> ''"), ["v"], [F.asc("risk"), F.asc("id")], 10).select("v", "id", "rank")
    g = _t(spark, d, "golden_report").select(F.col("report_id").alias("query_id"), F.col("command_id").alias("expected"), "kind", "mutation_kind", F.lower(F.trim(F.coalesce("primary_verb", F.lit("")))).alias("v"))
    results = g.select("query_id", "v").join(best, "v").select("query_id", "id", "rank")
    lineage = r.groupBy("title").agg(F.min("id").alias("parent"))
    lineage = r.join(lineage, r["title"].eqNullSafe(lineage["title"])).select(F.col("id").alias("child"), "parent")
    return g.drop("v"), results, lineage


@query(f"WITH {_RES} SELECT query_id, hit_display, hit_deep, hit_family FROM ht")
def hit_at_k(spark, d):
    """JN-04, JN-05, HLP-10."""
    bank, results, lineage = _eval(spark, d)
    return ev.hits(bank, results, lineage).select("query_id", "hit_display", "hit_deep", "hit_family")


@query(f"WITH {_RES} SELECT coalesce(mutation_kind, 'null') AS stratum, count(*) FILTER (hit_deep) AS passed, count(*) AS total, round(avg(hit_deep::INT), 6) AS rate FROM ht GROUP BY 1")
def stratified_rate(spark, d):
    """AGG-11."""
    return _r6(ev.stratified(ev.hits(*_eval(spark, d)), "mutation_kind", "hit_deep"))


@query(f"WITH {_RES} SELECT count(*) AS total, round(avg(hit_display::INT), 6) AS hit_rate, round(avg(hit_family::INT), 6) AS family_rate, round(avg(hit_deep::INT), 6) AS deep_rate, avg(hit_display::INT) + 1e-9 >= 0.7 AND avg(hit_family::INT) + 1e-9 >= 0.9 AS ok FROM ht")
def bank_totals(spark, d):
    """AGG-13, AGG-16, AGG-17."""
    return _r6(ev.bank_totals(ev.hits(*_eval(spark, d))))


@query("""WITH a AS (SELECT data.query AS query_id, r[i].command_id AS id, 0 AS s, min(i) AS rank FROM (SELECT data, data.response.results AS r FROM observe_events), unnest(range(1, len(r) + 1)) AS u(i) WHERE data.query IS NOT NULL AND r[i].command_id IS NOT NULL GROUP BY 1, 2),
  b AS (SELECT query_text AS query_id, command_id AS id, 1 AS s, 1 AS rank FROM golden_report WHERE query_text IS NOT NULL AND command_id IS NOT NULL),
  c AS (SELECT query_id, id, min({'s': s, 'r': rank}) AS o FROM (SELECT query_id, id, s, rank FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY o, id) AS rank FROM c""")
def ordered_union_distinct(spark, d):
    """SET-01, SET-02: results shown for a query, then what the bank expects."""
    e = _t(spark, d, "observe_events").select(F.col("data.query").alias("query_id"), F.posexplode("data.response.results").alias("p", "r")).select("query_id", F.col("r.command_id").alias("id"), (F.col("p") + 1).alias("rank")).filter("query_id is not null and id is not null")
    g = _t(spark, d, "golden_report").filter("query_text is not null and command_id is not null").select(F.col("query_text").alias("query_id"), F.col("command_id").alias("id"), F.lit(1).alias("rank"))
    return ev.union_ranked(e, g)


@query("SELECT name, round(median(c), 6) AS median, count(c) AS votes, coalesce(median(c) + 1e-9 >= 0.6, false) AS good FROM (SELECT name, CASE WHEN isfinite(data.response.confidence) THEN data.response.confidence END AS c FROM observe_events) GROUP BY name")
def median_votes(spark, d):
    """AGG-15."""
    return _r6(ev.vote_medians(_t(spark, d, "observe_events").select("name", F.col("data.response.confidence").alias("c")), "name", "c", 0.6))


@query(r"""SELECT reason, count(*) AS votes FROM (SELECT CASE WHEN length(r) > 120 THEN left(r, 117) || '...' ELSE r END AS reason FROM (SELECT trim(regexp_replace(coalesce(data.query, ''), '\s+', ' ', 'g')) AS r FROM observe_events)) WHERE reason <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
def judge_reasons_topn(spark, d):
    """AGG-12 over the queries (a top-8 report)."""
    return ev.top_reasons(_t(spark, d, "observe_events").select(F.col("data.query").alias("q")), "q")


@query("SELECT name, count(*) AS n, round(avg(c), 6) AS mean, quantile_disc(c, 0.5) AS p50, quantile_disc(c, 0.95) AS p95, min(c) AS low, max(c) AS high FROM (SELECT name, data.response.confidence AS c FROM observe_events) WHERE c IS NOT NULL AND NOT isnan(c) GROUP BY name")
def latency_percentiles(spark, d):
    """AGG-25 over confidences."""
    return _r6(ev.summary(_t(spark, d, "observe_events").select("name", F.col("data.response.confidence").alias("c")), "c", "name"))


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type = 'view' AS f FROM events), g AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM e WHERE f)
SELECT user_id, min(i) AS first_row, count(*) AS length FROM g GROUP BY user_id, g""")
def streaks(spark, d):
    """WIN-10."""
    e = _t(spark, d, "events").withColumn("f", F.col("event_type") == "view")
    return ev.streaks(e, "user_id", ["ts", "event_id"], "f").select("user_id", F.col("first_row").cast("bigint"), "length")


@query("SELECT id, query FROM queries UNION ALL SELECT min(report_id), query_text FROM golden_report WHERE query_text IS NOT NULL AND query_text NOT IN (SELECT query FROM queries WHERE query IS NOT NULL) GROUP BY query_text")
def append_unique_rows(spark, d):
    """WIN-11."""
    new = _t(spark, d, "golden_report").filter("query_text is not null").select(F.col("report_id").alias("id"), F.col("query_text").alias("query"))
    return ev.append_unique(_t(spark, d, "queries").select("id", "query"), new, ["query"])


@query(f"WITH {_RES}, x AS (SELECT kind, avg(hit_display::INT) AS a, avg(hit_deep::INT) AS b FROM ht GROUP BY kind) SELECT kind, round(a, 6) AS rate_before, round(b, 6) AS rate_after, b + 1e-9 >= a AS no_worse FROM x")
def accept_attempt(spark, d):
    """AGG-14, CLS-04: three shown against ten."""
    h = ev.hits(*_eval(spark, d))
    return _r6(ev.accepted(h.select("kind", F.col("hit_display").alias("f")), h.select("kind", F.col("hit_deep").alias("f")), "kind", "f"))


# --- similarity, taxonomy --------------------------------------------------------------------------------------------


def _links(spark, d, least):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return e, close_pairs(e, least, dim=64).select("a", "b")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS n, embedding::DOUBLE[] AS v FROM embeddings),
  l AS MATERIALIZED (SELECT b.id, list(a.id) AS before FROM e a JOIN e b ON a.id < b.id AND list_cosine_similarity(a.v, b.v) >= 0.3 GROUP BY b.id),
  o AS MATERIALIZED (SELECT e.id, e.n, coalesce(before, []) AS before FROM e LEFT JOIN l USING (id)),
  w AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL SELECT w.n + 1, CASE WHEN list_has_any(kept, before) THEN kept ELSE list_append(kept, id) END FROM w JOIN o ON o.n = w.n + 1),
  k AS (SELECT kept FROM w ORDER BY n DESC LIMIT 1), m AS (SELECT CASE WHEN list_contains(kept, id) THEN id ELSE list_min(list_intersect(before, kept)) END AS leader FROM o, k)
SELECT leader, count(*) AS members FROM m GROUP BY 1 HAVING count(*) >= 3""")
def leader_clusters(spark, d):
    """SIM-03, SIM-04, SIM-06."""
    e, links = _links(spark, d, 0.3)
    return sim.clusters(sim.greedy_keep(e, links))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS n, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 1),
  s AS MATERIALIZED (SELECT DISTINCT e.id FROM e JOIN embeddings x ON x.vec_id % 2 = 0 AND list_cosine_similarity(e.v, x.embedding::DOUBLE[]) >= 0.3),
  l AS MATERIALIZED (SELECT b.id, list(a.id) AS before FROM e a JOIN e b ON a.id < b.id AND list_cosine_similarity(a.v, b.v) >= 0.3 GROUP BY b.id),
  o AS MATERIALIZED (SELECT e.id, e.n, coalesce(before, []) AS before, s.id IS NOT NULL AS old FROM e LEFT JOIN l USING (id) LEFT JOIN s USING (id)),
  w AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL SELECT w.n + 1, CASE WHEN old OR list_has_any(kept, before) THEN kept ELSE list_append(kept, id) END FROM w JOIN o ON o.n = w.n + 1),
  k AS (SELECT kept FROM w ORDER BY n DESC LIMIT 1)
SELECT id, CASE WHEN old THEN 'existing' WHEN NOT list_contains(kept, id) THEN 'batch' END AS near FROM o, k""")
def novel_vectors(spark, d):
    """SIM-07: odd vectors as a batch against even ones."""
    e, links = _links(spark, d, 0.3)
    return sim.novel(e.filter("id % 2 = 1"), e.filter("id % 2 = 0"), links)


_TK = r"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) >= 3))"


@query(f"WITH t AS (SELECT report_id AS id, {_TK.format('query_text')} AS w FROM golden_report WHERE query_text IS NOT NULL) SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard FROM t a JOIN t b ON a.id < b.id AND len(a.w) > 0 AND len(a.w) >= 0.84 * len(b.w) AND len(b.w) >= 0.84 * len(a.w) WHERE jaccard >= 0.85")
def near_dup_jaccard_pairs(spark, d):
    """SIM-05, FLT-08, SET-05."""
    return _r6(sim.token_links(_t(spark, d, "golden_report"), "report_id", "query_text"))


@query("""WITH p AS (SELECT a.vec_id AS q, b.vec_id AS doc, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS c, b.label AS l, a.label AS own FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY c DESC, b.vec_id) <= 8)
SELECT q AS query_id, arg_min(doc, {'d': -c, 'k': doc}) AS doc_id, round(max(c), 6) AS cosine FROM p WHERE l <> own AND c >= 0.3 GROUP BY q""")
def foreign_collision(spark, d):
    """JN-07, SIM-08: of every twentieth vector, among its eight nearest of all, the closest of another label."""
    e = _t(spark, d, "embeddings")
    near = knn(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding"), 9, dim=64).filter("query_id <> doc_id")
    from tessellar.operators.fulltext import top

    near = top(near.drop("rank"), ["query_id"], [F.desc("cosine"), F.asc("doc_id")], 8)
    label = e.select("vec_id", "label")
    near = near.join(label.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("l")), "doc_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    # the owner of a vector is its label
    other = near.filter("l <> own").withColumn("own_id", F.lit(-1).cast("bigint"))
    return _r6(sim.foreign_collisions(other, 0.3))


_NODES = "SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier"


def _nodes(spark, d):
    r = _t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    n = _t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"))
    s = _t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent_id"), F.col("s_name").alias("name"))
    return r.unionByName(n).unionByName(s)


@query(f"WITH RECURSIVE n AS ({_NODES}), w AS (SELECT id, 0 AS depth, name AS path FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, depth + 1, path || '/' || n.name FROM w JOIN n ON n.parent_id = w.id) SELECT id, depth, path, id NOT IN (SELECT parent_id FROM n WHERE parent_id IS NOT NULL) AS is_leaf FROM w")
def collect_leaves(spark, d):
    """ARR-03."""
    return tax.tree_paths(_nodes(spark, d))


@query(f"WITH n AS ({_NODES}) SELECT id, name FROM n WHERE id NOT IN ('r1', 'n3') AND coalesce(parent_id, '') NOT IN ('r1', 'n3') AND coalesce(parent_id, '') NOT IN (SELECT id FROM n WHERE parent_id = 'r1')")
def prune_subtrees(spark, d):
    """SET-07: prune."""
    n = _nodes(spark, d)
    return tax.without_subtrees(n, n.filter("id in ('r1', 'n3')").select("id")).select("id", "name")


@query(r"""WITH b AS (SELECT id, coalesce(nullif(left(regexp_replace(regexp_replace(lower(taxonomy_leaf), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48), ''), 'node') AS s FROM recipes),
  c AS (SELECT id, s, row_number() OVER (PARTITION BY s ORDER BY id) AS n FROM b) SELECT id, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS slug FROM c""")
def slugs(spark, d):
    """STR-04, STR-05."""
    return tax.unique_slugs(_t(spark, d, "recipes").select("id", "taxonomy_leaf"), "id", "taxonomy_leaf").select("id", "slug")
