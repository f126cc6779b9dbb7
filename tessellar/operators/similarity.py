"""Order-dependent de-duplication over similarity links, and token-set links (SIM-03..08, JN-07, SET-05)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions.text import plain_query
from tessellar.session import cut_lineage


#: Links settled by one task of a round.
RANGE_LINKS = 500_000


def _settle(g: pd.DataFrame) -> pd.DataFrame:
    """Links (v, u, su: 1 kept, 0 not, -1 unknown) of a range of rows, in order of v: the rows that can be decided."""
    done: dict = {}
    v, u, su = (g.sort_values("v", kind="stable")[c].tolist() for c in ("v", "u", "su"))
    at = 0
    while at < len(v):
        row, hit, unknown = v[at], False, False
        while at < len(v) and v[at] == row:
            known = su[at] if su[at] >= 0 else done.get(u[at], -1)
            hit, unknown = hit or known == 1, unknown or known < 0
            at += 1
        if hit or not unknown:
            done[row] = 0 if hit else 1
    return pd.DataFrame({"id": pd.Series(list(done), dtype=g["v"].dtype), "kept": pd.Series(list(done.values()), dtype="int32")})


def greedy_keep(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """SIM-04, SIM-06, SIM-07: ``nodes`` (id), ``links`` (a, b): going through the ids in order, one is kept unless linked to a
    kept earlier one.  ``id``, ``kept``, ``leader`` (the first kept id it is linked to; itself if kept).

    Rows are cut into ranges of the id with about ``RANGE_LINKS`` links to earlier rows each.  In a round a task a range goes
    through its rows in order and decides those whose earlier neighbours are decided, in the range or by earlier rounds.
    Links lead to later rows only, so round n has decided the first n ranges at the latest: rounds never exceed the number
    of ranges, however long the chains, and every row is decided.
    """
    edges = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v").distinct()
    edges = cut_lineage(edges)
    ranges = max(1, -(-edges.count() // RANGE_LINKS))
    left = cut_lineage(edges.repartitionByRange(ranges, "v").withColumn("part", F.spark_partition_id()))
    kind = edges.schema["v"].dataType.simpleString()
    # who has no earlier neighbour is kept
    state = cut_lineage(edges.select(F.col("u").alias("id")).distinct().join(edges.select(F.col("v").alias("id")), "id", "left_anti").withColumn("kept", F.lit(1)))
    while not left.isEmpty():
        known = left.join(state.select(F.col("id").alias("u"), F.col("kept").alias("su")), "u", "left").select("part", "v", "u", F.coalesce("su", F.lit(-1)).alias("su"))
        new = cut_lineage(known.groupBy("part").applyInPandas(_settle, f"id {kind}, kept int"))
        if new.isEmpty():
            raise RuntimeError("greedy_keep: rows are left undecided")
        left = cut_lineage(left.join(new.select(F.col("id").alias("v")), "v", "left_anti"))
        state = cut_lineage(state.unionByName(new))
    leads = edges.join(state.filter("kept = 1").select(F.col("id").alias("u")), "u").groupBy("v").agg(F.min("u").alias("leader"))
    out = nodes.select("id").distinct().join(state, "id", "left").join(leads.withColumnRenamed("v", "id"), "id", "left")
    # rows without links have no state
    kept = F.coalesce(F.col("kept") == 1, F.lit(True))
    return out.select("id", kept.alias("kept"), F.when(kept, F.col("id")).otherwise(F.col("leader")).alias("leader"))


def novel(batch: DataFrame, existing: DataFrame, links: DataFrame) -> DataFrame:
    """SIM-07: of a ``batch`` (id) against ``existing`` (id), by ``links`` (a, b) among both: ``id``, ``near``: 'existing' if linked to
    an existing row, 'batch' if to an earlier row of the batch that stays, null if it stays."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    old = both.join(existing.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).distinct()
    rest = cut_lineage(batch.select("id").join(old, "id", "left_anti"))
    inner = links.join(rest.select(F.col("id").alias("a")), "a", "left_semi").join(rest.select(F.col("id").alias("b")), "b", "left_semi")
    kept = greedy_keep(rest, inner)
    seen = batch.select("id").join(old, "id", "left_semi").select("id", F.lit("existing").alias("near"))
    return kept.select("id", F.when(~F.col("kept"), "batch").alias("near")).unionByName(seen)


def clusters(assigned: DataFrame, least: int = 3) -> DataFrame:
    """SIM-06: leaders with at least ``least`` members, themselves included."""
    return assigned.groupBy("leader").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= least)


def token_links(rows: DataFrame, key: str, text: str, threshold: float = 0.85, shortest: int = 3) -> DataFrame:
    """SIM-05: pairs of rows whose sets of tokens (of ``shortest`` characters or more) have a Jaccard of at least the
    threshold: ``a``, ``b``, ``jaccard``.  Equal sets are one node until the end; candidates share one of the rarest tokens."""
    t = threshold
    toks = F.array_sort(F.array_distinct(F.filter(F.split(plain_query(F.coalesce(F.col(text), F.lit(""))), " "), lambda x: F.length(x) >= shortest)))
    base = rows.select(F.col(key).alias("id"), toks.alias("w")).filter("size(w) > 0")
    sets = cut_lineage(base.groupBy("w").agg(F.min("id").alias("rep")))
    members = base.join(sets, "w").select("id", "rep")
    each = sets.select("rep", F.size("w").alias("n"), F.explode("w").alias("tok"))
    df = each.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "tok"))
    prefix = each.join(df, "tok").withColumn("p", place).filter(F.col("p") <= F.col("n") - F.ceil(F.lit(t) * F.col("n") - 1e-9) + 1)
    x, y = prefix.alias("x"), prefix.alias("y")
    o = F.ceil(F.lit(t / (1 + t)) * (F.col("x.n") + F.col("y.n")) - 1e-9)
    near = (F.col("x.p") <= F.col("x.n") - o + 1) & (F.col("y.p") <= F.col("y.n") - o + 1)
    cand = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.rep") < F.col("y.rep")) & near).select(F.col("x.rep").alias("ra"), F.col("y.rep").alias("rb")).distinct()
    exact = cand.join(sets.select(F.col("rep").alias("ra"), F.col("w").alias("wa")), "ra").join(sets.select(F.col("rep").alias("rb"), F.col("w").alias("wb")), "rb")
    both = F.size(F.array_intersect("wa", "wb"))
    linked = exact.withColumn("jaccard", both / (F.size("wa") + F.size("wb") - both)).filter(F.col("jaccard") >= t).select("ra", "rb", "jaccard")
    linked = linked.unionByName(sets.select(F.col("rep").alias("ra"), F.col("rep").alias("rb"), F.lit(1.0).alias("jaccard")))
    ma, mb = members.select(F.col("id").alias("ia"), F.col("rep").alias("ra")), members.select(F.col("id").alias("ib"), F.col("rep").alias("rb"))
    pairs = linked.join(ma, "ra").join(mb, "rb").filter((F.col("ra") != F.col("rb")) | (F.col("ia") < F.col("ib")))
    return pairs.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "jaccard")


def foreign_collisions(neighbours: DataFrame, threshold: float = 0.94) -> DataFrame:
    """JN-07, SIM-08: of ``neighbours`` (query_id, doc_id, own_id, cosine) the closest one of another owner at or above the threshold."""
    return neighbours.filter((F.col("doc_id") != F.col("own_id")) & (F.col("cosine") >= threshold)).groupBy("query_id").agg(F.min(F.struct((-F.col("cosine")).alias("d"), "doc_id")).alias("m")).select("query_id", "m.doc_id", (-F.col("m.d")).alias("cosine"))
