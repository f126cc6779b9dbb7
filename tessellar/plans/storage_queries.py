"""Queries over sources, sinks and streams: tables are written, read back and compared.

Everything is written below the shared checkpoint folder, under a name of its own per call.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions import commands as C
from tessellar.functions import text as T
from tessellar.operators.coverage import childless
from tessellar.operators.taxonomy import SECTIONS, parse_help_listing
from tessellar.plans.general import _FIRST_SQL
from tessellar.plans.journey_queries import ORACLES as _JOURNEYS
from tessellar.plans.journey_queries import _kept
from tessellar.session import ensure_checkpoint_dir
from tessellar.sources import readers as R
from tessellar.sources import writers as W
from tessellar.streaming import observe as O

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables-{uuid.uuid4().hex}"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("SELECT id, title, description, array_to_string(tags, '|') AS tags, taxonomy_leaf, array_to_string(paraphrases, '|') AS paraphrases, validated, len(coalesce(commands, [])) AS steps, round(risk, 6) AS risk FROM recipes")
def jsonl_round_trip(spark, d):
    """SRC-08, SNK-09, SNK-14."""
    path = f"{scratch(spark)}/recipes"
    W.write_jsonl(_t(spark, d, "recipes"), path)
    r = R.read_jsonl(spark, path, R.RECIPE, strict=True)
    return r.select("id", "title", "description", F.array_join("tags", "|").alias("tags"), "taxonomy_leaf", F.array_join("paraphrases", "|").alias("paraphrases"), "validated", F.size(F.coalesce("commands", F.array().cast(C.STEPS))).alias("steps"), F.round("risk", 6).alias("risk"))


@query("SELECT 'missing' AS file, 0 AS \"rows\" UNION ALL SELECT 'damaged', count(*) FROM golden_report")
def jsonl_tolerance(spark, d):
    """SRC-08: a missing file is an empty table; bad lines are left out."""
    base = scratch(spark)
    g = _t(spark, d, "golden_report")
    lines = g.select(F.to_json(F.struct("*")).alias("value"))
    lines.unionByName(lines.limit(1).select(F.lit("{broken").alias("value"))).write.text(f"{base}/damaged")
    none = R.read_jsonl(spark, f"{base}/nothing", R.BANK).agg(F.count(F.lit(1)).alias("rows"))
    some = R.read_jsonl(spark, f"{base}/damaged", R.BANK).agg(F.count(F.lit(1)).alias("rows"))
    return none.select(F.lit("missing").alias("file"), "rows").unionByName(some.select(F.lit("damaged").alias("file"), "rows"))


@query("SELECT id, title, len(coalesce(paraphrases, [])) AS paraphrases FROM recipes")
def catalog_documents(spark, d):
    """SRC-07, SRC-09: documents of some 500 recipes, one in two an object with ``recipes``, the others arrays."""
    path = f"{scratch(spark)}/catalog"
    r = _t(spark, d, "recipes")
    files = max(2, -(-r.count() // 500))
    docs = r.groupBy(F.pmod(F.xxhash64("id"), F.lit(files)).alias("k")).agg(F.collect_list(F.struct("*")).alias("recipes"))
    docs.repartition(files, "k").select(F.when(F.col("k") % 2 == 0, F.to_json("recipes")).otherwise(F.to_json(F.struct("recipes"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return R.read_catalog_json(spark, path).select("id", "title", F.size(F.coalesce("paraphrases", F.array().cast("array<string>"))).alias("paraphrases"))


@query("SELECT 2 AS latest, 'ok' AS check_latest, 'mismatch' AS check_first, 'missing_checksum' AS check_none, count(*) AS recipes FROM recipes")
def versioned_export(spark, d):
    """SNK-07, SNK-08, SNK-11, SNK-12: two versions published, the latest read and verified."""
    root = f"{scratch(spark)}/recipes"
    r = _t(spark, d, "recipes")
    W.publish(r.filter("validated"), root)
    W.publish(r, root)
    want = W.checksum(r)
    latest = W.read_version(spark, root)
    verdicts = (W.versions(spark, root)[-1], W.verify(latest, want), W.verify(W.read_version(spark, root, 1), want), W.verify(latest, None))
    return latest.agg(F.count(F.lit(1)).alias("recipes")).select(F.lit(verdicts[0]).alias("latest"), F.lit(verdicts[1]).alias("check_latest"), F.lit(verdicts[2]).alias("check_first"), F.lit(verdicts[3]).alias("check_none"), "recipes")


@query("SELECT CASE WHEN kind = 'scrambled' THEN 'other' ELSE 'main' END AS file, count(*) AS \"rows\", count(DISTINCT report_id) AS ids FROM golden_report GROUP BY 1")
def routed_banks(spark, d):
    """SNK-13: scrambled rows go to a file of their own."""
    base = scratch(spark)
    W.append_routed(_t(spark, d, "golden_report"), f"{base}/main", f"{base}/other", F.col("kind") == "scrambled")
    read = lambda f: R.read_jsonl(spark, f"{base}/{f}", R.BANK).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("report_id").alias("ids")).select(F.lit(f).alias("file"), "rows", "ids")
    return read("main").unionByName(read("other")).filter("rows > 0")


@query("SELECT * FROM (VALUES ('layout', '9'), ('note', ''), ('recipes', (SELECT count(*)::VARCHAR FROM recipes))) AS t(\"key\", \"value\")")
def metadata_round_trip(spark, d):
    """SNK-05, SNK-06, HLP-01, HLP-02."""
    path = f"{scratch(spark)}/meta"
    W.put_meta(spark, path, {"layout": "8", "note": None})
    W.put_meta(spark, path, {"layout": "9", "recipes": str(_t(spark, d, "recipes").count())})
    meta = W.read_meta(spark, path)
    W.require_version(meta, "layout", "9")
    return spark.createDataFrame(sorted(meta.items()), "key string, value string")


@query(r"SELECT lower(trim(taxonomy_leaf)) AS doc_leaf, regexp_extract(commands[1].command, '^git\s+([a-z][a-z0-9._-]*)', 1) AS name, count(*) AS times FROM recipes WHERE taxonomy_leaf IS NOT NULL AND regexp_matches(coalesce(commands[1].command, ''), '^git\s+[a-z][a-z0-9._-]*(\s|$)') GROUP BY 1, 2")
def help_listings(spark, d):
    """SRC-10: a listing per recipe with a head, an unknown section, a known one and a tail; only the known one's row counts."""
    path = f"{scratch(spark)}/help"
    r = _t(spark, d, "recipes").filter("taxonomy_leaf is not null").select(F.lower(F.trim("taxonomy_leaf")).alias("leaf"), "id", F.regexp_extract(C.primary_command(F.col("commands")), r"^git\s+([a-z][a-z0-9._-]*)(?:\s|$)", 1).alias("name")).filter("name <> ''")
    listing = F.concat_ws("\n", F.lit("usage: tool"), F.lit("   early      before any section"), F.lit(SECTIONS[0]), F.concat(F.lit("   "), "name", F.lit("      leaf "), "leaf"), F.lit(""), F.lit("Interacting with Others"), F.lit("   late       behind the stop line"))
    lines = r.select(F.col("id").alias("doc"), F.posexplode(F.split(listing, "\n")).alias("line_no", "line"))
    lines.write.parquet(path)
    found = parse_help_listing(spark.read.parquet(path))
    return found.groupBy(F.regexp_replace("summary", "^leaf ", "").alias("doc_leaf"), "name").agg(F.count(F.lit(1)).alias("times"))


@query("SELECT delivery_id, id, name, coalesce(nullif(trim(coalesce(data.query, '')), ''), '') <> '' AS has_query FROM observe_events")
def tuple_payloads(spark, d):
    """SRC-12, SRC-14: rows as a payload of columns and tuples, and properties as JSON text."""
    e = _t(spark, d, "observe_events")
    payload = F.to_json(F.struct(F.array(F.lit("uuid"), F.lit("event"), F.lit("properties")).alias("columns"), F.array(F.array("id", "name", F.to_json(F.struct(F.coalesce("data.query", F.lit("")).alias("query"))))).alias("results")))
    rows = e.select("delivery_id", F.explode(R.rows_from_tuples(payload, ["uuid", "event", "properties", "absent"])).alias("r"))
    p = R.properties(F.col("r.properties"), "query string")
    return rows.select("delivery_id", F.col("r.uuid").alias("id"), F.col("r.event").alias("name"), (F.trim(F.coalesce(p["query"], F.lit(""))) != "").alias("has_query"))


@query("SELECT id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM recipe_embeddings WHERE embedding IS NOT NULL AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0")
def vector_packs(spark, d):
    """SRC-15, SNK-10, VEC-02: vectors as blobs and back."""
    path = f"{scratch(spark)}/pack"
    v = _t(spark, d, "recipe_embeddings").filter("embedding is not null and size(embedding) = 384").filter(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    W.encode_vectors(v.select("id", "embedding"), "embedding").write.parquet(path)
    back = R.decode_vectors(spark.read.parquet(path), "vec", 384)
    return back.select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT '# counts' || repeat(chr(10), 2) || '| measure | value |' || chr(10) || '| --- | --- |' || chr(10) || '| events | ' || (SELECT count(*) FROM observe_events) || ' |' || chr(10) || '| recipes | ' || (SELECT count(*) FROM recipes) || ' |' || chr(10) AS page")
def stats_page(spark, d):
    """SNK-15."""
    page = W.stats_markdown({"recipes": _t(spark, d, "recipes").count(), "events": _t(spark, d, "observe_events").count()}, "counts")
    return spark.createDataFrame([(page,)], "page string")


@query(r"""SELECT report_id, CASE WHEN len(w) > 0 THEN array_to_string(list_transform(w, lambda x: '"' || x || '"'), ' AND ') END AS expression FROM (SELECT report_id, list_filter(string_split_regex(regexp_replace(coalesce(query_text, ''), '["*^\-():{}\[\]~]', '', 'g'), '\s+'), lambda x: x <> '') AS w FROM golden_report)""")
def match_expressions(spark, d):
    """TXT-02."""
    return _t(spark, d, "golden_report").select("report_id", T.match_expression(F.col("query_text")).alias("expression"))


@query("WITH p AS (SELECT DISTINCT n_regionkey AS k FROM nation) SELECT 'r' || r_regionkey AS id FROM region WHERE r_regionkey NOT IN (SELECT k FROM p) UNION ALL SELECT 'n' || n_nationkey FROM nation")
def childless_nodes(spark, d):
    """JN-10."""
    r = _t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    n = _t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return childless(r.unionByName(n), "id", "parent").select("id")


@query(r"""SELECT id, array_to_string(list_filter(string_split_regex(trim(coalesce(commands[1].command, '')), '\s+'), lambda x: x <> ''), '|') AS words, trim(regexp_replace(translate(trim(coalesce(title, '')), '“”‘’', '""'''''), '[\s\p{Z}]+', ' ', 'g')) AS plain, replace(coalesce(commands[1].command, ''), '<file>', 'notes.txt') AS filled FROM recipes""")
def line_tokens(spark, d):
    """STR-03, STR-06, STR-12, STR-13: tokens of lines whose words carry no quotes, plain titles, filled placeholders, colours taken off."""
    line = C.primary_command(F.col("commands"))
    tokens = F.pandas_udf(lambda s: s.map(C.argv), "array<string>")
    coloured = F.concat(F.lit("\u001b[1;32m"), line, F.lit("\u001b[0m"))
    return _t(spark, d, "recipes").select("id", F.array_join(tokens(T.strip_ansi(coloured)), "|").alias("words"), T.straight_quotes(F.coalesce("title", F.lit(""))).alias("plain"), C.fill_placeholders(line, {"file": "notes.txt"}).alias("filled"))


@query("SELECT DISTINCT 'f' || lower(substr(id, length(id), 1)) AS flag FROM recipes WHERE id IS NOT NULL UNION SELECT 'quiet' UNION SELECT 'no-quiet'")
def help_flags(spark, d):
    """STR-09: flags of help texts made from ids."""
    text = F.concat(F.lit("usage: tool [--[no-]quiet]\n  --f"), F.lower(F.substring("id", -1, 1)), F.lit("=<n>   a flag\n"))
    return _t(spark, d, "recipes").filter("id is not null").select(F.explode(C.flags_from_help(text)).alias("f")).filter("f rlike '^--'").select(F.substring("f", 3, 100).alias("flag")).distinct()


@query("SELECT canonical, 'file' AS source FROM (VALUES ('stash'), ('log')) AS t(canonical) UNION ALL SELECT 'reset', 'fallback'")
def dimension_files(spark, d):
    """HLP-14."""
    base = scratch(spark)
    spark.createDataFrame([("\ufeff" + '[{"canonical":"stash"},{"canonical":"log"}]',)], "value string").coalesce(1).write.text(f"{base}/families")
    here = R.read_dimension(spark, f"{base}/families", "canonical string")
    gone = R.read_dimension(spark, f"{base}/none", "canonical string", [("reset",)])
    return here.withColumn("source", F.lit("file")).unionByName(gone.withColumn("source", F.lit("fallback")))


@query("SELECT 'parquet' AS kind, count(*) AS \"rows\" FROM recipes UNION ALL SELECT 'view', count(*) FROM queries")
def adapter_tables(spark, d):
    """UDF-03: two adapters."""
    name = f"v{uuid.uuid4().hex}"
    _t(spark, d, "queries").createOrReplaceTempView(f"{name}_queries")
    try:
        tables = {"parquet": R.open_table(spark, "parquet", d, "recipes"), "view": R.open_table(spark, "view", name, "queries")}
    finally:
        spark.catalog.dropTempView(f"{name}_queries")
    out = None
    for kind, df in tables.items():
        n = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(kind).alias("kind"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


# --- streams -----------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, rows: DataFrame, base: str) -> DataFrame:
    rows.write.parquet(f"{base}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{base}/in")


def _with_rocksdb(spark: SparkSession, run) -> None:
    """Runs a stateful stream with the state store it needs, and gives the session its setting back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run()
    finally:
        spark.conf.set(name, before)


@query(f"WITH {_FIRST_SQL} SELECT DISTINCT coalesce(nullif(hex, ''), nullif(trim(id), ''), 'delivery-' || delivery_id) AS event_id FROM raw WHERE ms IS NOT NULL")
def stream_once(spark, d):
    """STM-01, STM-02, STM-06, SNK-16: deliveries as a stream, each event once within a horizon longer than the table."""
    base = scratch(spark)
    s = _stream(spark, _t(spark, d, "observe_events").select("id", "delivery_id", "createdat", "sessionid", "distinctid"), base)
    O.run_to_table(O.once(s, "36500 days").select("event_id"), f"{base}/out", f"{base}/pos").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id")


@query(f"""WITH {_FIRST_SQL}, e AS (SELECT thread_key, ms, delivery_id AS k FROM raw WHERE thread_key IS NOT NULL AND ms IS NOT NULL),
  f AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY thread_key ORDER BY ms, k) <= 45000 THEN 0 ELSE 1 END AS fresh FROM e),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY thread_key ORDER BY ms, k ROWS UNBOUNDED PRECEDING) AS n FROM f)
SELECT thread_key, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS event_count FROM s GROUP BY thread_key, n""")
def stream_sessions(spark, d):
    """STM-03, the hard gap: deliveries as a stream, sessions as they stand at its end."""
    base = scratch(spark)
    s = _stream(spark, _t(spark, d, "observe_events").select("id", "delivery_id", "createdat", "sessionid", "distinctid"), base)
    O.run_to_table(O.hard_sessions(O.event_times(s).withWatermark("at", "36500 days")), f"{base}/out", f"{base}/pos", "complete").awaitTermination()
    last = spark.read.parquet(f"{base}/out").agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{base}/out").filter(F.col("batch") == last).drop("batch")


@query(_JOURNEYS.get("session_threads"))
def stream_threads(spark, d):
    """STM-03 with the soft rule: kept events as a stream, segments by the gap and by nearly equal queries."""
    base = scratch(spark)
    s = _stream(spark, _kept(spark, d).select("thread_key", "id", "query", "at_ms"), base)
    _with_rocksdb(spark, lambda: O.run_to_table(O.soft_threads(s), f"{base}/out", f"{base}/pos").awaitTermination())
    return spark.read.parquet(f"{base}/out").groupBy("thread_key", "segment").agg(F.min("at_ms").alias("start_ms"), F.max("at_ms").alias("end_ms"), F.count(F.lit(1)).alias("events"))


@query()
def stream_bursts(spark, d):
    """STM-04: searches fit to keep as a stream, bursts dropped by keyed state."""
    base = scratch(spark)
    s = _stream(spark, _t(spark, d, "observe_events").select("id", "delivery_id", "createdat", "sessionid", "distinctid", "name", "data"), base)
    _with_rocksdb(spark, lambda: O.run_to_table(O.without_bursts(O.event_times(s)), f"{base}/out", f"{base}/pos").awaitTermination())
    return spark.read.parquet(f"{base}/out").drop("batch")
