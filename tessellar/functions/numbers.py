"""Hashes, scores and small numeric rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha_unit(c: Column) -> Column:
    """MTH-01: the first four bytes of the SHA-256 as a fraction of 2^32 - 1."""
    return F.conv(F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def fnv1a(c: Column) -> Column:
    """MTH-02: 32-bit FNV-1a over the characters, as bigint."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    prime, mask = F.lit(16777619).cast("bigint"), F.lit(4294967295).cast("bigint")
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, x: (h.bitwiseXOR(x) * prime).bitwiseAND(mask))


def min_count_for_rate(n: Column, rate: Column) -> Column:
    """MTH-03."""
    return F.greatest(F.lit(0).cast("bigint"), F.ceil(rate * n - F.lit(1e-9)).cast("bigint"))


def distance_to_similarity(d: Column) -> Column:
    """PRJ-08: 1 - d cut to 0..1; null and non-finite distances give 0."""
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    return F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d))).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Inner product over the common prefix, in double."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """VEC-01: cosine over the common prefix, 0 if either is zero there."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(x, y) / norm)


def min_max(v: Column, low: Column, high: Column) -> Column:
    """RNK-01: to 0..1; a batch of equal values is all 1."""
    return F.when(v.isNull(), None).when(high == low, F.lit(1.0)).otherwise((v - low) / (high - low))


def confidence(first: Column, second: Column) -> Column:
    """RNK-06."""
    return F.when(second.isNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), first))).otherwise(F.least(F.lit(1.0), first * (1 + F.greatest(F.lit(0.0), first - second))))
