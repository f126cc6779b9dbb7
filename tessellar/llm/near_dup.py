"""Near-duplicate records: all pairs of word sets with a likeness of at least t, without comparing all pairs.

Every record has one *bottom-k sketch*: the ``k`` smallest values of its words under one hash function (64 bits, the same
for all).  Below the smaller of two sketches' largest values both are complete, so their union there is a uniform sample,
without replacement, of the union of the two sets: u values, s of them in both, and s / u estimates the likeness.

1. *Lists*: two sketches that share c values share one among the rarest |sketch| - c + 1 of either, so the inverted lists
   hold only those of the retained values, and common words make no long ones.  A record is listed for the case that it
   is the smaller of a pair, and looked up for the case that it is the larger, each with the least c of that case.  By
   Serfling's bound a pair of likeness >= t has s >= (t - e) u but for a chance of ``delta``, with
   e = sqrt((1 - (u - 1) / N) ln(1 / delta) / 2u) and N the size of the union; what the sketches leave out bounds s too.
   A list above ``list_rows`` records is salted over several tasks.
2. *Estimate*: pairs met in a list are kept if s >= (t - e) u.  Sets of at most k words are sketched whole; between two
   such sets e is 0 and nothing can be lost.
3. *Exact*: the likeness of the whole word sets (as 64-bit values) decides.

Equal word sets are one *class* before all this, so a third of all rows being copies of one record costs one list entry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.llm.words import SKETCH_CELLS, cell_counts, rarity_levels, salted, set_digest, word_hashes
from tessellar.session import cut_lineage

#: Values retained of each record: sets of up to K words are sketched whole, as are all recipes of the test tables (90 words at most).
K = 128
#: Chance that the estimate drops a pair of likeness t; sets of at most K words drop none.
DELTA = 1e-9
#: Records of an inverted list that one task pairs with the others.
LIST_ROWS = 2000


@dataclass
class Similar:
    members: DataFrame  #: id, class_id - every record that has words
    pairs: DataFrame  #: class_a < class_b, likeness - linked classes


def least_shared(u: Column, union: Column, t: float, delta: float = DELTA) -> Column:
    """Least of ``u`` values of the union sketch that must be shared, for sets whose union has at most ``union`` words."""
    left = F.greatest(F.lit(0.0), 1 - (u - 1) / union)
    e = F.when(u >= F.floor(union), F.lit(0.0)).otherwise(F.sqrt(left * F.lit(math.log(1 / delta)) / (2 * u)))
    return F.greatest(F.lit(1.0), F.ceil((F.lit(t) - e) * u - F.lit(1e-9))).cast("int")


def rarest_first(df: DataFrame, sketch: str, counts: np.ndarray, out: str) -> DataFrame:
    """Adds the values of a sketch ordered by the (counted) frequency of their cell, then by value."""
    shared = df.sparkSession.sparkContext.broadcast(rarity_levels(counts))

    @F.pandas_udf("array<bigint>")
    def order(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        level = shared.value
        for s in batches:
            size = s.map(len).to_numpy(dtype=np.int64)
            flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in s]) if len(s) else np.zeros(0, np.int64)
            flat = flat[np.lexsort((flat, level[flat & (SKETCH_CELLS - 1)], np.repeat(np.arange(len(s)), size)))]
            yield pd.Series(np.split(flat, np.cumsum(size)[:-1]) if len(s) else [], dtype=object)

    return df.withColumn(out, order(F.col(sketch)))


def similar_sets(records: DataFrame, id_col: str, words_col: str, threshold: float = 0.8, k: int = K, delta: float = DELTA, list_rows: int = LIST_ROWS) -> Similar:
    """Classes of equal word sets and the linked pairs of classes.

    Records without words are in no class.  A class is named by its smallest id.  Ids may repeat (copies of a row fall
    into one class); a null id is left out.  An empty table gives empty results.
    """
    t = threshold
    base = records.select(F.col(id_col).alias("id"), word_hashes(F.col(words_col)).alias("h")).filter("id is not null and size(h) > 0")
    base = cut_lineage(base.withColumn("digest", set_digest(F.col("h"))))
    # first() of the words: all members of a digest have the same set
    classes = base.groupBy("digest").agg(F.min("id").alias("class_id"), F.first("h").alias("h")).withColumn("n", F.size("h"))
    classes = cut_lineage(classes)
    sketch = F.slice("h", 1, k)
    members = base.select("id", "digest").join(classes.select("digest", "class_id"), "digest").select("id", "class_id").distinct()

    counts = cell_counts(classes, F.col("h"))
    up = lambda c: F.ceil(c - F.lit(1e-9)).cast("int")
    n = F.col("n")
    ordered = cut_lineage(rarest_first(classes.select("class_id", "n", sketch.alias("sketch")), "sketch", counts, "kept").select("class_id", "n", "kept"))
    # least of the values shared with any larger (listed) or smaller (looked up) partner; ``part``: a partner above k words
    in_part = F.greatest(least_shared(F.lit(k), n / F.lit(t), t, delta), up(n + k - n / F.lit(t)))
    listed = F.array(
        F.when(n <= k, F.struct(F.lit(False).alias("part"), up(F.lit(2 * t / (1 + t)) * n).alias("least"))),
        F.when(n > F.lit(t * k), F.struct(F.lit(True).alias("part"), F.least(in_part, F.least(n, F.lit(k))).alias("least"))),
    )
    asked_part = F.greatest(least_shared(F.lit(k), n * F.lit(2 / (1 + t)), t, delta), up(k - n * F.lit(1 - t)))
    asked = F.when(n <= k, up(F.lit(t) * n)).otherwise(asked_part)
    rows = lambda least: F.explode(F.slice("kept", F.lit(1), F.greatest(F.lit(0), F.size("kept") - least + 1)))
    lists = ordered.select("class_id", "n", "kept", F.explode(F.array_compact(listed)).alias("l")).select(F.col("class_id").alias("x"), F.col("n").alias("nx"), "l.part", rows(F.col("l.least")).alias("value"))
    looks = ordered.select(F.col("class_id").alias("y"), F.col("n").alias("ny"), (n > k).alias("part"), rows(asked).alias("value"))
    lists, looks = salted(lists, looks, ["value", "part"], "x", list_rows)
    once = (F.struct("nx", "x") < F.struct("ny", "y")) & (F.col("nx") >= F.ceil(F.lit(t) * F.col("ny") - F.lit(1e-9)))
    met = lists.join(looks, ["value", "part", "salt"]).filter(once).select("x", "y", "nx", "ny").distinct()

    sk = ordered.select("class_id", F.sort_array("kept").alias("sketch"))
    both = met.join(sk.select(F.col("class_id").alias("x"), F.col("sketch").alias("sx")), "x").join(sk.select(F.col("class_id").alias("y"), F.col("sketch").alias("sy")), "y")
    # the union sketch ends where the first of the two sketches ends
    end = F.least(F.when(F.col("nx") > k, F.element_at("sx", -1)), F.when(F.col("ny") > k, F.element_at("sy", -1)))
    below = lambda c: F.when(F.col("end").isNull(), F.size(c)).otherwise(F.size(F.filter(c, lambda v: v <= F.col("end"))))
    both = both.withColumn("end", end).withColumn("s", F.size(F.array_intersect("sx", "sy"))).withColumn("u", below("sx") + below("sy") - F.col("s"))
    union = F.when(F.col("end").isNull(), F.col("u")).otherwise((F.col("nx") + F.col("ny")) / F.lit(1 + t))
    kept = cut_lineage(both.filter(F.col("s") >= least_shared(F.col("u"), union, t, delta)).select("x", "y", "s", "u", "end"))

    # the sketches of two whole sets are the sets; of the others the sets themselves meet
    whole = kept.filter("end is null").select("x", "y", (F.col("s") / F.col("u")).alias("likeness"))
    w = classes.select("class_id", "h")
    rest = (
        kept.filter("end is not null")
        .join(w.select(F.col("class_id").alias("x"), F.col("h").alias("hx")), "x")
        .join(w.select(F.col("class_id").alias("y"), F.col("h").alias("hy")), "y")
        .withColumn("both", F.size(F.array_intersect("hx", "hy")))
        .select("x", "y", (F.col("both") / (F.size("hx") + F.size("hy") - F.col("both"))).alias("likeness"))
    )
    exact = whole.unionByName(rest).filter(F.col("likeness") >= t)
    pairs = exact.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), "likeness")
    return Similar(members, pairs)


def record_pairs(found: Similar) -> DataFrame:
    """All pairs of records (id_a < id_b) that the classes and their links stand for."""
    ma = found.members.select(F.col("id").alias("id_a"), F.col("class_id").alias("class_a"))
    mb = found.members.select(F.col("id").alias("id_b"), F.col("class_id").alias("class_b"))
    across = found.pairs.join(ma, "class_a").join(mb, "class_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    within = ma.join(mb, (F.col("class_a") == F.col("class_b")) & (F.col("id_a") < F.col("id_b"))).select("id_a", "id_b")
    return across.unionByName(within)


def component_labels(links: DataFrame, a: str, b: str) -> DataFrame:
    """``v``, ``label``: the smallest member of each linked node's connected component.

    Large-star and small-star in turn (Kiveris and others 2014): a node's larger, then its smaller neighbours are hooked
    to the smallest of all, until every component is a star around its smallest member.  Rounds grow with the square of
    the logarithm of the nodes at most, and there is no other end than that star, so no component is left split.  Each
    round is checkpointed, so a lost executor costs one round.
    """
    e = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("u <> v").distinct()
    e = cut_lineage(e)
    while True:
        # a star forest: one parent each, and no parent has a parent
        parents = e.select(F.col("u").alias("v")).distinct()
        open_ = e.groupBy("v").agg(F.count(F.lit(1)).alias("n")).join(parents.withColumn("up", F.lit(True)), "v", "left").filter("n > 1 or up")
        if open_.isEmpty():
            break
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least("v", F.min("u")).alias("m"))
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u <> v")
        e = cut_lineage(small.unionByName(least.withColumnRenamed("m", "u")).distinct())
    return e.select("v", F.col("u").alias("label")).unionByName(e.select(F.col("u").alias("v"), F.col("u").alias("label")).distinct())


def record_groups(found: Similar) -> DataFrame:
    """One row per record: ``id, class_id, group_id, links``; a group is a connected component of linked classes."""
    p = cut_lineage(found.pairs.select("class_a", "class_b"))
    edges = p.unionByName(p.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    labels = component_labels(p, "class_a", "class_b")
    degree = edges.groupBy(F.col("class_a").alias("class_id")).agg(F.count(F.lit(1)).alias("links"))
    return (
        found.members.join(labels.withColumnRenamed("v", "class_id"), "class_id", "left")
        .join(degree, "class_id", "left")
        .select("id", "class_id", F.coalesce("label", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    )
