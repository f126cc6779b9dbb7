"""Coverage of verbs and leaves by a catalog (AGG-04..09, JN-09, JN-10, JN-12, WIN-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions.commands import flag_fingerprint, primary_command, state_bucket, verb

K, STATES, FLAGS = 24, 3, 3


def verb_coverage(recipes: DataFrame, k: int = K, states: int = STATES, flag_sets: int = FLAGS) -> DataFrame:
    """AGG-04, AGG-05, SRT-04: per primary verb the distinct records, starting states, flag sets and lengths, the progress
    of each axis (0..1), whether all floors are met, the mean progress and the weakest axis (ties: state, flag, composition)."""
    v = verb(primary_command(F.col("commands")))
    size = F.greatest(F.lit(1), F.least(F.lit(7), F.size("commands")))
    rows = recipes.select("id", v.alias("verb"), state_bucket(F.col("initial_state")).alias("_s"), flag_fingerprint(F.col("commands"), v).alias("_f"), size.alias("_n")).filter("verb <> ''")
    g = rows.groupBy("verb").agg(
        F.count_distinct("id").alias("records"),
        F.count_distinct("_s").alias("states"),
        F.count_distinct("_f").alias("flag_sets"),
        F.count_if(F.col("_n") == 1).alias("len1"),
        F.count_if(F.col("_n").between(2, 3)).alias("len23"),
        F.count_if(F.col("_n") >= 4).alias("len47"),
    )
    cap = lambda c, n: F.least(F.lit(1.0), F.col(c) / n)
    comp = (F.least("len1", F.lit(1)) + F.least("len23", F.lit(3)) + F.least("len47", F.lit(2))) / 6
    g = g.withColumns({"state_p": cap("states", states), "flag_p": cap("flag_sets", flag_sets), "comp_p": F.least(F.lit(1.0), comp), "count_p": cap("records", k)})
    axes = F.array_min(F.array(*[F.struct(F.col(c).alias("p"), F.lit(i).alias("o"), F.lit(n).alias("n")) for i, (c, n) in enumerate((("state_p", "state"), ("flag_p", "flag"), ("comp_p", "composition")))]))
    full = (F.col("records") >= k) & (F.col("states") >= states) & (F.col("flag_sets") >= flag_sets) & (F.col("len1") >= 1) & (F.col("len23") >= 3) & (F.col("len47") >= 2)
    return g.withColumns({"score": (F.col("state_p") + F.col("flag_p") + F.col("comp_p") + F.col("count_p")) / 4, "saturated": full, "weakest": axes["n"]})


def all_saturated(required: DataFrame, coverage: DataFrame) -> DataFrame:
    """AGG-06: one row ``all_saturated``; a verb without coverage isn't, an empty requirement isn't either."""
    j = required.select("verb").distinct().join(coverage.select("verb", "saturated"), "verb", "left")
    return j.agg(F.coalesce(F.bool_and(F.coalesce("saturated", F.lit(False))), F.lit(False)).alias("all_saturated"))


def leaf_priority(leaves: DataFrame, coverage: DataFrame) -> DataFrame:
    """AGG-07, AGG-08: ``leaves`` (leaf, verbs) -> least score over the leaf's verbs (0 for an unknown verb or none), and its weakest axis."""
    v = leaves.select("leaf", F.explode_outer("verbs").alias("verb"))
    j = v.join(coverage.select("verb", "score", "state_p", "flag_p", "comp_p"), "verb", "left")
    low = lambda c: F.min(F.coalesce(c, F.lit(0.0)))
    g = j.groupBy("leaf").agg(low("score").alias("priority"), low("state_p").alias("s"), low("flag_p").alias("f"), low("comp_p").alias("c"))
    kind = F.when((F.col("s") <= F.col("f")) & (F.col("s") <= F.col("c")), "state").when(F.col("f") <= F.col("c"), "flag").otherwise("composition")
    return g.select("leaf", "priority", kind.alias("kind"))


def unmapped(all_: DataFrame, mapped: DataFrame, key: str) -> DataFrame:
    """JN-09, SET-04: keys of ``all_`` that no row of ``mapped`` has."""
    return all_.select(key).distinct().join(mapped.select(key), key, "left_anti")


def mapping_report(nodes: DataFrame, mapped: DataFrame, limit: int = 6) -> DataFrame:
    """AGG-09: ``nodes`` (node), ``mapped`` (node, command): totals, empty nodes, repeated nodes and nodes with more than ``limit`` commands."""
    per = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("_times")).join(mapped.groupBy("node").agg(F.count_distinct("command").alias("_m")), "node", "left")
    return per.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("_m").isNull()).alias("empty"),
        F.count_if(F.col("_times") > 1).alias("repeated"),
        F.count_if(F.coalesce("_m", F.lit(0)) > limit).alias("over_mapped"),
    ).join(mapped.agg(F.count_distinct("command").alias("commands")))


def covers(need: Column, have: Column) -> Column:
    """JN-12: every needed element is there."""
    return F.size(F.array_except(need, have)) == 0


def covered_sets(needs: DataFrame, haves: DataFrame) -> DataFrame:
    """JN-12: ``needs`` (need_id, verbs) that some row of ``haves`` (have_id, verbs) covers, with the number of such rows.

    A row that covers a set holds each of its elements.  Each distinct set of either side is met once, however many rows
    have it, and a needed set only the sets that hold its rarest element: never all pairs, and nothing grows with the
    product of the rows that share an element.  An empty need is covered by every row and is left out, one with a null by none.
    """
    n = needs.select("need_id", F.array_sort(F.array_distinct("verbs")).alias("v")).filter(F.size("v") > 0)
    h = haves.groupBy(F.array_sort(F.array_distinct("verbs")).alias("have")).agg(F.count(F.lit(1)).alias("rows")).filter(F.size("have") > 0)
    held = h.select("have", "rows", F.explode("have").alias("e"))
    each = n.select("v").distinct().select("v", F.explode("v").alias("e"))
    often = held.groupBy("e").agg(F.count(F.lit(1)).alias("sets"))
    rarest = each.join(often, "e", "left").groupBy("v").agg(F.min(F.struct(F.coalesce("sets", F.lit(0)), "e")).alias("_r"))
    met = rarest.select("v", F.col("_r.e").alias("e")).join(held, "e").filter(covers(F.col("v"), F.col("have")))
    found = met.groupBy("v").agg(F.sum("rows").alias("covering"))
    return n.distinct().join(found, "v").groupBy("need_id").agg(F.max("covering").alias("covering"))


def childless(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """JN-10: rows that are no row's parent; all rows if there is none."""
    left = rows.join(rows.select(F.col(parent).alias(key)).filter(f"{key} is not null"), key, "left_anti")
    return rows if left.isEmpty() else left


def tercile_pick(rows: DataFrame, priority: str, risk: str, key: str, cap: int) -> DataFrame:
    """WIN-12: ``cap`` rows by priority, spread over the risk: the first 3 cap rows in (priority, risk, key) are cut into thirds
    by risk, and taken from the thirds in turn; adds ``pick`` (1..).  A top-k report: the pool is cap-sized."""
    pool = rows.orderBy(priority, risk, key).limit(3 * cap)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    by = F.row_number().over(Window.orderBy(risk, priority, key)) - 1
    cut1, cut2 = F.ceil(F.col("_n") / 3), F.ceil(2 * F.col("_n") / 3)
    p = pool.withColumns({"_n": n, "_r": by})
    p = p.withColumn("_t", F.when(F.col("_r") < cut1, 0).when(F.col("_r") < cut2, 1).otherwise(2))
    p = p.withColumn("_in", F.row_number().over(Window.partitionBy("_t").orderBy("_r")))
    return p.withColumn("pick", F.row_number().over(Window.orderBy("_in", "_t"))).filter(F.col("pick") <= cap).drop("_n", "_r", "_t", "_in")
