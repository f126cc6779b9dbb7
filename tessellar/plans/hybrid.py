"""Batched hybrid search (RNK-09): recall by text and by vector, fusion, boost, order, hydration, gate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.config import SearchConfig
from tessellar.functions.commands import STEPS, bare_verb, fingerprint, primary_command, steps_json
from tessellar.functions.text import collapse_space, query_tokens
from tessellar.operators.fulltext import bm25, build_index, embed_text, recipe_body, top
from tessellar.operators.ranking import collapse_channels, diversify, fuse, gate, head_scores, named_verbs, ranked, verb_boost
from tessellar.operators.vectors import embed, knn
from tessellar.session import cut_lineage, spread
from tessellar.sources.writers import checksum, put_meta, read_meta, require_version, verify

#: Layout of saved catalogs; another one is refused.
LAYOUT = "1"


@dataclass(frozen=True)
class Ports:
    """UDF-01, UDF-02: what a search is made of: ``embed`` (text -> vector), ``by_vector`` (queries (query_id, embedding), vectors
    (id, embedding), k -> query_id, doc_id, cosine), ``by_text`` (queries, postings, sizes -> query_id, doc_id, bm25)."""

    embed: Callable[[Column], Column] = embed
    by_vector: Callable[[DataFrame, DataFrame, int], DataFrame] = knn
    by_text: Callable[..., DataFrame] = bm25


@dataclass
class Catalog:
    """What a search needs, as tables: recipes with derived columns, postings, document sizes, vectors, known verbs."""

    recipes: DataFrame
    postings: DataFrame
    sizes: DataFrame
    vectors: DataFrame
    verbs: DataFrame


def save_catalog(catalog: Catalog, folder: str) -> None:
    """SNK-05, SNK-12: the index tables as Parquet below a folder, with their checksums and layout, to be searched again and again."""
    spark = catalog.recipes.sparkSession
    meta: dict[str, str | None] = {"layout": LAYOUT}
    for f in fields(catalog):
        getattr(catalog, f.name).write.mode("overwrite").parquet(f"{folder}/{f.name}")
        meta[f"checksum.{f.name}"] = checksum(spark.read.parquet(f"{folder}/{f.name}"))
    put_meta(spark, f"{folder}/meta", meta)


def load_catalog(spark: SparkSession, folder: str, strict: bool = False) -> Catalog:
    """HLP-04, HLP-01: a saved catalog.  The layout must fit; ``strict`` also demands every checksum."""
    meta = read_meta(spark, f"{folder}/meta")
    require_version(meta, "layout", LAYOUT)
    tables = {f.name: spark.read.parquet(f"{folder}/{f.name}") for f in fields(Catalog)}
    for name, df in tables.items() if strict else ():
        if (found := verify(df, meta.get(f"checksum.{name}"))) != "ok":
            raise ValueError(f"{name}: {found}")
    return Catalog(**tables)


def open_catalog(recipes: DataFrame, vectors: DataFrame | None = None) -> Catalog:
    """SNK-05: derives the index tables of a recipe table.  ``vectors`` (id, embedding) default to the offline embedder's."""
    empty = F.array().cast("array<string>")
    steps = F.coalesce("commands", F.array().cast(STEPS))
    derived = recipes.withColumns(
        {
            "steps_json": steps_json(F.col("commands")),
            "step_count": F.greatest(F.size(steps), F.lit(1)),
            "primary_verb": bare_verb(primary_command(F.col("commands"))),
            "verbs": F.coalesce(F.array_distinct(F.filter(F.transform(steps, lambda s: bare_verb(s["command"])), lambda v: v != "")), empty),
            "fingerprint": fingerprint(F.transform(steps, lambda s: s["command"])),
        }
    ).select("id", "steps_json", "step_count", "primary_verb", "verbs", "fingerprint")
    # index tables are made once and read by every search
    derived = cut_lineage(derived)
    postings, sizes = build_index(recipes, "id", recipe_body())
    vectors = cut_lineage(recipes.select("id", embed(embed_text()).alias("embedding"))) if vectors is None else vectors
    verbs = cut_lineage(derived.select(F.explode("verbs").alias("v")).distinct())
    return Catalog(derived, postings, sizes, vectors, verbs)


def hybrid_search(queries: DataFrame, catalog: Catalog, cfg: SearchConfig = SearchConfig(), query_vectors: DataFrame | None = None, ports: Ports = Ports()) -> tuple[DataFrame, DataFrame]:
    """``queries`` (query_id, query) -> (results: a row per query and hit, in rank order; gates: a row per query).

    A query without any hit has no result row and a gate with status 'empty' and alert 'red'.
    """
    q = queries.select("query_id", collapse_space(F.coalesce("query", F.lit(""))).alias("query"))
    qv = q.filter("query <> ''").select("query_id", ports.embed(F.col("query")).alias("embedding")) if query_vectors is None else query_vectors
    by_vector = ports.by_vector(qv, catalog.vectors, cfg.recall_k).select("query_id", F.col("doc_id").alias("id"), "cosine")
    by_text = top(ports.by_text(q, catalog.postings, catalog.sizes, compat=cfg.compat_terms), ["query_id"], [F.asc("bm25"), F.asc("doc_id")], cfg.recall_k).select("query_id", F.col("doc_id").alias("id"), "bm25")
    rows = 2 * q.count() * cfg.recall_k
    # recipes come before the fusion, so that all that follows stays with its query; vectors without a recipe are no hits
    known = catalog.recipes.withColumn("_known", F.lit(True))
    hits = spread(collapse_channels(by_vector, by_text), rows, "id").join(known, "id", "left")
    hits = hits.withColumn("cosine", F.when(F.col("_known"), F.col("cosine"))).filter("_known or bm25 is not null")
    hits = fuse(spread(hits, rows, "query_id"), cfg).filter("_known").drop("_known")
    words = q.withColumn("tokens", query_tokens(F.col("query")))
    words = cut_lineage(named_verbs(words, catalog.verbs).select("query_id", "tokens", "named"))
    hits = hits.join(words, "query_id")
    # hits of the text channel alone carry no steps when they are boosted and ordered
    seen = F.col("cosine").isNotNull()
    boost = F.when(seen, verb_boost(F.col("named"), F.col("tokens"), F.col("primary_verb"), F.col("verbs"), cfg)).otherwise(F.lit(0.0))
    hits = (
        hits.withColumn("boost", boost)
        .withColumn("score", F.when(F.col("boost") > 0, F.least(F.lit(1.0), F.col("score") + F.col("boost"))).otherwise(F.col("score")))
        .withColumns({"steps_json": F.when(seen, F.col("steps_json")).otherwise(F.lit('{"commands":[]}')), "step_count": F.when(seen, F.col("step_count")).otherwise(F.lit(1))})
        # scores that differ in the last bits only are ties
        .withColumn("score", F.round("score", 12))
    )
    results = cut_lineage(ranked(hits).select("query_id", "id", "rank", "score", "cosine", "bm25", "score_cosine", "score_bm25", "boost", "fingerprint"))
    gates = gate(head_scores(spread(results, rows, "query_id")), cfg)
    gates = q.join(gates, "query_id", "left").select(
        "query_id",
        "confidence",
        F.coalesce("display_count", F.lit(0)).alias("display_count"),
        F.coalesce("alert", F.lit("red")).alias("alert"),
        F.coalesce("status", F.lit("empty")).alias("status"),
    )
    return results, gates


def displayed(results: DataFrame, gates: DataFrame, rows: int = 0) -> DataFrame:
    """The rows shown per query: diverse, and as many as the gate lets through.  ``rows``: as many results as there may be."""
    return diversify(spread(results, rows, "query_id")).join(gates.select("query_id", "display_count"), "query_id").filter("display_rank <= display_count").drop("display_count")


def search(text: str, catalog: Catalog, cfg: SearchConfig = SearchConfig(), ports: Ports = Ports()) -> tuple[DataFrame, DataFrame]:
    """HLP-05: one query: (rows to show, gate)."""
    spark = catalog.recipes.sparkSession
    results, gates = hybrid_search(spark.createDataFrame([("q", text)], "query_id string, query string"), catalog, cfg, ports=ports)
    return displayed(results, gates), gates
