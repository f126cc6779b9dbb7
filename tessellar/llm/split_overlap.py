"""Evaluation records that occur, exactly or almost, in the training split: an edit-distance segment join.

A text is a string over the alphabet of words.  Likeness doesn't look at the order of words, so the string holds each
word once, in one global order, rarest first.  A likeness of at least t between strings of n and m words means at least
o = ceil(t/(1+t)(n+m)) common words, that is, an edit distance of at most k = n + m - 2o insertions and deletions.  The
evaluation string is cut into segments of ``span`` words (fewer where n words don't make k + 1 such segments), rarest
words first; k edits leave one of k + 1 segments untouched, so it is a substring of the training string, at a position at
most as far off as the edits allow.  Where segments are of one word, insertions can't touch them, and n - o + 1 are
enough, all among the rarest words; so one word is the default, and longer segments pay only where texts are long and t
is high.  A pair met in a segment is a candidate if 64-bit signatures of the two word sets differ in at most k bits; the
banded dynamic program over the two strings verifies it, and the likeness is computed last.  Equal texts are one string
on either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.words import cell_counts, needed, rarity_keys, salted, set_digest, word_hashes
from tessellar.session import cut_lineage

#: Training strings with one segment and length that one task handles; more are salted.
LIST_ROWS = 4000


def _padded(seqs: pd.Series, width: int, fill: int) -> np.ndarray:
    out = np.full((len(seqs), width), fill, dtype=np.int64)
    for r, s in enumerate(seqs):
        out[r, : len(s)] = s
    return out


def banded_edits(a: list | pd.Series, b: list | pd.Series, band: int) -> np.ndarray:
    """Insert/delete distance of each pair of sequences, by dynamic programming inside the diagonal band |j - i| <= band.

    All pairs of a batch advance together, a diagonal of the band at a time.  A distance above ``band`` is only known to
    be above it.
    """
    na = np.array([len(x) for x in a], dtype=np.int64)
    nb = np.array([len(x) for x in b], dtype=np.int64)
    if not len(na):
        return np.zeros(0, dtype=np.int64)
    A, B = _padded(a, int(na.max()) + 1, -1), _padded(b, int(nb.max()) + 1, -2)
    big, width = 1 << 30, 2 * band + 1
    row = np.full((len(na), width), big, dtype=np.int64)  # row[:, d] is the cost at j = i + d - band
    row[:, band:] = np.arange(band + 1)
    result = np.where((na == 0) & (nb <= band), nb, big)
    for i in range(1, int(na.max()) + 1):
        new = np.full_like(row, big)
        for d in range(width):
            j = i + d - band
            if j < 0 or j > B.shape[1]:
                continue
            if j == 0:
                new[:, d] = i
                continue
            best = row[:, d + 1] + 1 if d + 1 < width else np.full(len(na), big)
            if d > 0:
                best = np.minimum(best, new[:, d - 1] + 1)
            if j <= B.shape[1]:
                same = A[:, i - 1] == B[:, j - 1]
                best = np.where(same, np.minimum(best, row[:, d]), best)
            new[:, d] = best
        row = new
        done = na == i
        at = nb - na + band
        ok = done & (at >= 0) & (at < width)
        result[ok] = row[ok, at[ok]]
    return result


def segment_words(n: Column, t: float, span: int) -> Column:
    """Words per segment of an evaluation string of n words: at most ``span``, and what the largest edit budget leaves."""
    most = F.floor(n / F.lit(t) + F.lit(1e-9)) - n
    return F.least(F.lit(span), F.greatest(F.lit(1), F.floor(n / (most + 1)))).cast("int")


def near_matches(evals: DataFrame, trains: DataFrame, threshold: float = 0.8, span: int = 1, list_rows: int = LIST_ROWS) -> DataFrame:
    """``evals`` (eval_key, words) against ``trains`` (train_key, words): ``eval_key, train_key, edits, likeness``.

    Keys may be any type and may repeat; texts without words match nothing.
    """
    t = threshold
    side = lambda df, key, e: df.select(F.col(key), word_hashes(F.col("words")).alias("h"), F.lit(e).alias("e")).filter("size(h) > 0")
    texts = side(evals, "eval_key", True).unionByName(side(trains, "train_key", False), allowMissingColumns=True)
    texts = cut_lineage(texts.select("eval_key", "train_key", "e", set_digest(F.col("h")).alias("digest"), "h"))
    counts = cell_counts(texts, F.col("h"))
    strings = texts.groupBy("digest").agg(F.first("h").alias("h"), F.max("e").alias("e"), F.max(~F.col("e")).alias("t"))
    strings = rarity_keys(strings, F.col("h"), counts, "seq").withColumn("sid", F.monotonically_increasing_id())
    bits = F.aggregate("h", F.lit(0).cast("bigint"), lambda x, v: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(v, F.lit(64)).cast("int"))))
    strings = cut_lineage(strings.select("sid", "digest", "seq", F.size("seq").alias("n"), bits.alias("sig"), "e", "t"))
    n, m, i, j = (F.col(c) for c in ("n", "m", "i", "j"))
    least = lambda c: F.ceil(F.lit(t) * c - F.lit(1e-9)).cast("int")
    most = lambda c: F.floor(c / F.lit(t) + F.lit(1e-9)).cast("int")
    head = lambda at, size, case: F.xxhash64(F.slice("seq", at + 1, size), size, case)
    o = needed(n, m, t).cast("int")
    # Segments of one word are kept apart by the longer of the two strings, as that tells how far either may be cut into:
    # case 0 is a training string at least as long, 1 a shorter one.  Longer segments are all of case 2.
    upto = lambda last, size, case: F.transform(F.sequence(F.lit(0), last), lambda x: F.struct(x.alias("at"), F.lit(case).alias("case"), head(x, size, F.lit(case)).alias("head")))

    # training substrings; of one word only those that insertions alone can precede
    tr = strings.filter("t").select(F.col("sid").alias("td"), n.alias("m"), F.col("sig").alias("sig_t"), "seq")
    sizes = F.array_distinct(F.transform(F.sequence(least(m), most(m)), lambda x: segment_words(x, t, span)))
    one = F.concat(upto(m - least(m), F.lit(1), 0), upto(m - needed(m, m, t).cast("int"), F.lit(1), 1))
    subs = F.flatten(F.transform(F.filter(sizes, lambda s: s <= m), lambda s: F.when(s == 1, one).otherwise(upto(m - s, s, 2))))
    subs_of = tr.select("td", "m", "sig_t", F.explode(subs).alias("x")).select("td", "m", "sig_t", F.col("x.at").alias("j"), "x.head")

    # evaluation segments: as many as the partner length with the largest budget needs
    ev = strings.filter("e").select(F.col("sid").alias("ed"), "n", F.col("sig").alias("sig_e"), "seq").withColumn("size", segment_words(n, t, span))
    cuts = lambda m, o: F.when(F.col("size") == 1, n - o + 1).otherwise(n + m - 2 * o + 1)
    all_cuts = F.array_max(F.transform(F.sequence(least(n), most(n)), lambda x: cuts(x, needed(n, x, t).cast("int"))))
    own = F.concat(upto(n - needed(n, n, t).cast("int"), F.lit(1), 0), upto(n - least(n), F.lit(1), 1))
    long = F.filter(F.transform(F.sequence(F.lit(0), all_cuts - 1), lambda g: g * F.col("size")), lambda x: x + F.col("size") <= n)
    longer = F.transform(long, lambda x: F.struct(x.alias("at"), F.lit(2).alias("case"), head(x, F.col("size"), F.lit(2)).alias("head")))
    segments = ev.withColumn("x", F.explode(F.when(F.col("size") == 1, own).otherwise(longer))).select("ed", "n", "sig_e", "size", F.col("x.at").alias("i"), "x.case", "x.head")

    subs_of, segments = salted(subs_of, segments, ["head"], "td", list_rows)
    budget = n + m - 2 * o
    right = (F.col("case") == 2) | (F.col("case") == F.when(m >= n, 0).otherwise(1))
    sized = right & (m >= least(n)) & (m <= most(n)) & (o <= F.least(n, m)) & (i < cuts(m, o) * F.col("size"))
    near = F.abs(j - i) + F.abs((m - j) - (n - i)) <= budget
    alike = F.bit_count(F.col("sig_e").bitwiseXOR(F.col("sig_t"))) <= budget
    cand = segments.join(subs_of, ["head", "salt"]).filter(sized & near & alike).select("ed", "td", "n", "m", o.alias("o")).distinct()
    cand = cand.join(strings.select(F.col("sid").alias("ed"), F.col("seq").alias("a")), "ed").join(strings.select(F.col("sid").alias("td"), F.col("seq").alias("b")), "td")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for k, g in p.groupby(p["n"] + p["m"] - 2 * p["o"]):
                d = banded_edits(list(g["a"]), list(g["b"]), max(int(k), 1))
                size = (g["n"] + g["m"]).to_numpy()
                both = np.where(d <= k, (size - d) // 2, 0)
                like = both / (size - both)
                keep = like >= t
                yield pd.DataFrame({"ed": g["ed"][keep], "td": g["td"][keep], "edits": d[keep], "likeness": like[keep]})

    met = cand.mapInPandas(verify, "ed bigint, td bigint, edits bigint, likeness double")
    keyed = texts.join(strings.select("digest", "sid"), "digest")
    return (
        met.join(keyed.filter("e").select("eval_key", F.col("sid").alias("ed")), "ed")
        .join(keyed.filter("not e").select("train_key", F.col("sid").alias("td")), "td")
        .select("eval_key", "train_key", "edits", "likeness")
    )
