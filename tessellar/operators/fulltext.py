"""Inverted index and BM25 over AND-ed phrases (TXT-*, SRC-05, SNK-04, SRT-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions.commands import STEPS
from tessellar.functions.text import index_tokens, query_terms
from tessellar.session import cut_lineage, spread


def recipe_body(steps: str = "commands") -> Column:
    """PRJ-05: title, description, tags, paraphrases, then command and comment of each step, a line each, blanks skipped."""
    strings = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    lines = F.flatten(F.transform(F.coalesce(F.col(steps), F.array().cast(STEPS)), lambda s: F.array(s["command"], s["comment"])))
    every = F.concat(F.array("title", "description"), strings("tags"), strings("paraphrases"), lines)
    return F.array_join(F.filter(every, lambda x: x.isNotNull() & (F.trim(x) != "")), "\n")


def embed_text() -> Column:
    """PRJ-06: description and non-blank paraphrases; commands are never embedded."""
    every = F.concat(F.array("description"), F.coalesce("paraphrases", F.array().cast("array<string>")))
    return F.array_join(F.filter(every, lambda x: x.isNotNull() & (F.trim(x) != "")), "\n")


def build_index(docs: DataFrame, doc_id: str, body: Column) -> tuple[DataFrame, DataFrame]:
    """(postings: term, doc_id, pos) and (sizes: doc_id, dl)."""
    tokens = docs.select(F.col(doc_id).alias("doc_id"), index_tokens(body).alias("_t"))
    return tokens.select("doc_id", F.posexplode("_t").alias("pos", "term")).select("term", "doc_id", "pos"), tokens.select("doc_id", F.size("_t").alias("dl"))


def query_phrases(queries: DataFrame, query_id: str, query: str, compat: bool = True) -> DataFrame:
    """(query_id, n_phrases, phrase array<string>) - a query term of several index tokens is a phrase; a query of which a
    term has no token matches nothing and gives no row."""
    terms = queries.select(F.col(query_id).alias("query_id"), query_terms(F.col(query), compat).alias("_terms"))
    split = terms.select("query_id", F.transform("_terms", lambda t: index_tokens(t)).alias("phrases")).filter(F.size("phrases") > 0)
    split = split.filter(~F.exists("phrases", lambda p: F.size(p) == 0))
    return split.select("query_id", F.size("phrases").alias("n_phrases"), F.explode("phrases").alias("phrase"))


def bm25(queries: DataFrame, postings: DataFrame, sizes: DataFrame, query_id: str = "query_id", query: str = "query", compat: bool = True, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query_id``, ``doc_id``, ``bm25`` (lower is better) of every document holding all phrases of a query.

    Each distinct phrase is matched once, whatever the number of queries with it; a query then meets the documents of
    its rarest phrase only, and the other phrases are looked up for those.  No step multiplies queries by documents.
    Scores are summed as decimals, so they don't depend on the order in which their parts come.
    """
    total = sizes.agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("mean")).first()  # two numbers
    docs, mean, places = F.lit(total["docs"]), F.lit(float(total["mean"] or 1.0)), total["docs"] * float(total["mean"] or 1.0)
    wanted = cut_lineage(query_phrases(queries, query_id, query, compat))
    distinct = wanted.select("phrase").distinct().withColumn("n_terms", F.size("phrase"))
    terms = cut_lineage(distinct.select("phrase", "n_terms", F.posexplode("phrase").alias("offset", "term")))
    # one term: counted where its postings are.  No semi-joins, which would be moved below the spread; where both sides have
    # partitions of their own, those of a side without an exchange at its top would be taken, so both are spread
    alone = spread(postings.select("term", "doc_id"), places, "term").join(terms.filter("n_terms = 1").select("phrase", "term"), "term")
    single = alone.groupBy("term", "phrase", "doc_id").agg(F.count(F.lit(1)).alias("f")).select("phrase", "doc_id", "f")
    # several terms start from the postings of the rarest; the others are looked up at the places they would be
    linked = terms.filter("n_terms > 1")
    asked = cut_lineage(spread(postings, places, "term").join(spread(linked.select("term").distinct(), places, "term"), "term").select("term", "doc_id", "pos"))
    rare = linked.join(asked.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").groupBy("phrase", "n_terms").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("df", "offset", "term")).alias("r"))
    anchors = rare.filter("k = n_terms").select("phrase", "n_terms", F.col("r.term").alias("term"), F.col("r.offset").alias("offset")).join(asked, "term").select("phrase", "n_terms", "doc_id", (F.col("pos") - F.col("offset")).alias("start"))
    due = anchors.join(linked.select("phrase", "offset", "term"), "phrase").select("phrase", "n_terms", "doc_id", "start", "term", (F.col("start") + F.col("offset")).alias("pos"))
    met = due.join(asked, ["term", "doc_id", "pos"], "left_semi")
    several = met.groupBy("phrase", "n_terms", "doc_id", "start").agg(F.count(F.lit(1)).alias("k")).filter("k = n_terms").groupBy("phrase", "doc_id").agg(F.count(F.lit(1)).alias("f"))
    hits = cut_lineage(single.unionByName(several))  # read for the frequencies, the candidates and the scores
    df = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    ranked = wanted.join(df, "phrase", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("query_id", "n_phrases").agg(F.min(F.struct("n", "phrase")).alias("r")).filter("r.n > 0").select("query_id", "n_phrases", F.col("r.phrase").alias("phrase"))
    candidates = rarest.join(spread(hits.select("phrase", "doc_id"), places, "phrase"), "phrase").select("query_id", "n_phrases", "doc_id").join(sizes, "doc_id")
    found = candidates.join(ranked.select("query_id", "phrase", "n"), "query_id").join(spread(hits, places, "phrase", "doc_id"), ["phrase", "doc_id"])
    idf = F.log((docs - F.col("n") + 0.5) / (F.col("n") + 0.5))
    part = F.when(idf > 0, idf).otherwise(F.lit(1e-6)) * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / mean))
    scored = found.groupBy("query_id", "n_phrases", "doc_id").agg(F.count(F.lit(1)).alias("m"), F.sum(part.cast("decimal(38,28)")).cast("double").alias("s"))
    return scored.filter("m = n_phrases").select("query_id", "doc_id", (-F.col("s")).alias("bm25"))


def top(df: DataFrame, by: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows per key (SRT-01/02); Spark limits groups before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(out) <= k)
