"""Words, word sets and a global rarity order of words.

A *word* is a longest run of letters and digits (Unicode L and N) of the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.session import cut_lineage

#: Cells of the word-frequency sketch.  A fixed number, so the sketch has one size (512 KB) at every input size.
SKETCH_CELLS = 1 << 16
#: Rows up to which the table of long lists is broadcast; a larger one is joined.
SMALL = 1 << 18


def words(text: Column) -> Column:
    """Word sequence of a text; null and word-less texts give an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.array().cast("array<string>"))


def all_text(*parts: Column) -> Column:
    """String columns and string-array columns as one text, nulls skipped."""
    return F.concat_ws(" ", *parts)


def text_digest(value: Column) -> Column:
    """256-bit key of a canonical text."""
    return F.unhex(F.sha2(value, 256))


def word_hashes(words_: Column) -> Column:
    """The distinct words of a text as ascending 64-bit values of the one hash function of all sketches and strings.  Two
    words of one pair of texts share a value with a chance of some 10^-15."""
    return F.sort_array(F.array_distinct(F.transform(words_, lambda w: F.xxhash64(w))))


def set_digest(hashes: Column) -> Column:
    """128-bit key of a set of words, from its word_hashes."""
    return F.struct(F.xxhash64(hashes).alias("d1"), F.xxhash64(F.lit(1), hashes).alias("d2"))


def cell_counts(sets: DataFrame, hashes: Column) -> np.ndarray:
    """For each hash cell the number of sets holding a word of it (``hashes``: word_hashes of a set).  Counts cover all rows; a third of all rows sharing a
    word cost one partial count per task."""
    cell = sets.select(F.explode(hashes).alias("_w")).select(F.col("_w").bitwiseAND(F.lit(SKETCH_CELLS - 1)).cast("int").alias("cell"))
    table = cell.groupBy("cell").count().toPandas()
    out = np.zeros(SKETCH_CELLS, dtype=np.int64)
    out[table["cell"].to_numpy()] = table["count"].to_numpy()
    return out


def rarity_levels(counts: np.ndarray) -> np.ndarray:
    """Frequency level (15 bits, logarithmic) of each cell."""
    return np.minimum(np.log2(np.maximum(counts, 1)) * 700, (1 << 15) - 1).astype(np.int64)


def rarity_keys(df: DataFrame, hashes: Column, counts: np.ndarray, out: str) -> DataFrame:
    """Adds the set's words as ascending 64-bit keys: 15 bits of (log) frequency, then 48 bits of one hash function.

    Any function of the word gives a valid global order of symbols, so two words that share a frequency cell cost
    selectivity and never a result.
    """
    shared = df.sparkSession.sparkContext.broadcast(rarity_levels(counts) << 48)

    @F.pandas_udf("array<bigint>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        level = shared.value
        for s in batches:
            size = s.map(len).to_numpy(dtype=np.int64)
            h = np.concatenate([np.asarray(x, dtype=np.int64) for x in s]) if len(s) else np.zeros(0, np.int64)
            key = level[h & (SKETCH_CELLS - 1)] | ((h >> 15) & ((1 << 48) - 1))
            key = key[np.lexsort((key, np.repeat(np.arange(len(s)), size)))]
            yield pd.Series(np.split(key, np.cumsum(size)[:-1]) if len(s) else [], dtype=object)

    return df.withColumn(out, keys(hashes))


def needed(n: Column, m: Column, t: float) -> Column:
    """Least overlap of sets of n and m words with likeness t; the slack absorbs the rounding of t."""
    return F.ceil(F.lit(t / (1 + t)) * (n + m) - F.lit(1e-9))


def salted(lists: DataFrame, looks: DataFrame, keys: list[str], owner: str, list_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``keys``, to be joined on ``keys`` and ``salt``.

    Lists that hold more than about ``list_rows`` rows, by a count over a sixteenth of their owners, are spread over
    salts, and what is looked up in them goes to each.  The count only decides how the work is spread, not what is found.
    """
    some = lists.filter(F.pmod(F.xxhash64(owner), F.lit(16)) == 0).groupBy(*keys).agg(F.count(F.lit(16)).alias("_c"))
    long = some.filter(F.col("_c") * 16 > list_rows).select(*keys, F.ceil(F.col("_c") * 16 / F.lit(list_rows)).cast("int").alias("_salts"))
    long = cut_lineage(long)
    found = long.count()
    if not found:
        return lists.withColumn("salt", F.lit(0)), looks.withColumn("salt", F.lit(0))
    if found <= SMALL:
        long = F.broadcast(long)  # at most a few keys and a number each
    n = F.coalesce("_salts", F.lit(1))
    a = lists.join(long, keys, "left").withColumn("salt", F.pmod(F.xxhash64(owner, F.lit(1)), n).cast("int")).drop("_salts")
    b = looks.join(long, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_salts")
    return a, b
