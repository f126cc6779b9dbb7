"""Records that differ only in formatting: one row per canonical key, with the number of copies.

Hot keys are found exactly from partial counts (a count with map-side combine, so a key holding a third of all rows
costs each task one row).  A key is hot if it holds at least 1/HOT_SHARE of the rows, so there are at most HOT_SHARE hot
keys, and that list alone is broadcast.  Rows of hot keys are salted and aggregated in two levels, all others in one
shuffle.  The representative is the smallest identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.llm.words import text_digest, words
from tessellar.session import cut_lineage

HOT_SHARE = 1000
SALTS = 64


def sequence_key(text: Column) -> Column:
    """Canonical form of one text: its words in order, one blank between; '' if it has none."""
    return F.array_join(words(text), " ")


def set_of_sequences_key(texts: Column) -> Column:
    """Canonical form of a list of texts: the sorted set of their canonical forms; order, repeats and word-less entries don't count."""
    forms = F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda x: sequence_key(x)), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(forms)), "\n")


def collapse(records: DataFrame, id_col: str, canonical: Column, by: list[str] | None = None, hot_share: int = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """``by`` columns, ``first_id`` and ``copies`` (bigint), one row per distinct canonical text.

    Records whose canonical text is empty or null are left out; null ids count as copies but are never the
    representative (it is null if all ids are); ties and repeated rows count each.
    """
    by = by or []
    keyed = records.select(*by, F.col(id_col).alias("_id"), canonical.alias("_text")).filter("_text is not null and _text <> ''")
    # texts are read and brought into canonical form once; what follows runs over keys and ids
    keyed = cut_lineage(keyed.select(*by, "_id", text_digest(F.col("_text")).alias("_key")))
    keys = [*by, "_key"]
    partial = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    least = max(-(-keyed.count() // hot_share), 2)
    hot = partial.filter(F.col("_n") >= F.lit(least)).select(*keys, F.lit(True).alias("_hot"))
    marked = keyed.alias("r").join(F.broadcast(hot.alias("h")), [F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys], "left").select(*[F.col(f"r.{k}").alias(k) for k in keys], F.col("r._id").alias("_id"), F.coalesce("_hot", F.lit(False)).alias("_hot"))
    agg = lambda n: [F.min("_id").alias("_id"), n.cast("bigint").alias("_n")]
    one = marked.filter("not _hot").groupBy(*keys).agg(*agg(F.count(F.lit(1))))
    salt = F.pmod(F.xxhash64("_id", F.monotonically_increasing_id()), F.lit(salts)).alias("_salt")
    two = marked.filter("_hot").select(*keys, "_id", salt).groupBy(*keys, "_salt").agg(*agg(F.count(F.lit(1)))).groupBy(*keys).agg(*agg(F.sum("_n")))
    return one.unionByName(two).select(*by, F.col("_id").alias("first_id"), F.col("_n").alias("copies"))
