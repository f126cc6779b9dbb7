"""Messages delivered more than once: exactly one copy of each is kept.

Identifiers are read as *producer + number*: ``worker-7:1042`` is number 1042 of producer ``worker-7:``; a UUID,
in whichever spelling, is number (its low 60 bits) of producer (its high 68 bits).  What has been seen is a table of
disjoint number ranges per producer.  A number outside every range is accepted once - its first delivery - and the
accepted numbers are merged into the ranges.  Identifiers of another form (malformed) are resolved by exact lookup of
their trimmed text.  A null or blank identifier cannot repeat anything: each such delivery is a message of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from tessellar.session import cut_lineage

_SEQUENCE = r"^(.*?[^0-9]|)0*([0-9]{1,17})$"
#: Numbers per block of a producer's line; a range is cut at block borders so that lookups are equi-joins.
BLOCK = 1 << 16


def uuid_hex(raw: Column) -> Column:
    """The 32 lower-case hex digits of a UUID in any common spelling (dashes, braces, urn:uuid:, case, blanks), else null."""
    s = F.translate(F.lower(raw), "-{}()\"' \t\r\n", "")
    s = F.when(s.startswith("urn:uuid:"), F.substring(s, 10, 40)).when(s.startswith("uuid:"), F.substring(s, 6, 40)).otherwise(s)
    return F.when((F.length(s) == 32) & (F.translate(s, "0123456789abcdef", "") == ""), s)


def uuid_text(hex32: Column) -> Column:
    """8-4-4-4-12."""
    return F.concat_ws("-", *[F.substring(hex32, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def parse_identifier(df: DataFrame, id_col: str) -> DataFrame:
    """Adds ``_producer``, ``_number`` and ``_other`` (the exact text of a malformed identifier); all null for a missing one."""
    raw = F.col(id_col).cast("string")
    text = F.trim(raw)
    df = df.withColumn("_hex", uuid_hex(raw))
    seq = F.when(F.col("_hex").isNull(), F.regexp_extract(text, _SEQUENCE, 2))
    is_seq = F.coalesce(seq != "", F.lit(False))
    return (
        df.withColumn("_producer", F.when(F.col("_hex").isNotNull(), F.substring("_hex", 1, 17)).when(is_seq, F.concat(F.lit("#"), F.regexp_extract(text, _SEQUENCE, 1))))
        .withColumn("_number", F.when(F.col("_hex").isNotNull(), F.conv(F.substring("_hex", 18, 15), 16, 10)).when(is_seq, seq).cast("bigint"))
        .withColumn("_other", F.when(F.col("_producer").isNull() & (text != ""), text))
        .drop("_hex")
    )


def _block(c: str) -> Column:
    return F.floor(F.col(c) / F.lit(BLOCK)).cast("bigint")


def cut_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges (producer, lo, hi) with a row, and its own ``lo`` and ``hi``, for each block they touch."""
    cut = ranges.select("producer", "lo", "hi", F.explode(F.sequence(_block("lo"), _block("hi"))).alias("_block"))
    return cut.select("producer", "_block", F.greatest("lo", F.col("_block") * BLOCK).alias("lo"), F.least("hi", (F.col("_block") + 1) * BLOCK - 1).alias("hi"))


def uncovered(numbers: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of ``numbers`` (_producer, _number, ...) whose number lies in no range: an anti-join on producer and block."""
    cut = ranges if "_block" in ranges.columns else cut_ranges(ranges)
    cut = cut.select(F.col("producer").alias("_p"), F.col("_block").alias("_b"), "lo", "hi")
    n = numbers.withColumn("_block", _block("_number"))
    hit = (n["_producer"] == cut["_p"]) & (n["_block"] == cut["_b"]) & n["_number"].between(cut["lo"], cut["hi"])
    return n.join(cut, hit, "left_anti").drop("_block")


def merge_blocks(numbers: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """The state after ``numbers`` were accepted: ``producer, _block, lo, hi``, disjoint and maximal within each block.

    ``ranges`` is the state before.  A window holds the ranges of one block of one producer, at most ``BLOCK`` / 2 of
    them, so a producer of sparse numbers or with a third of all rows is spread over its blocks.
    """
    parts = numbers.select(F.col("_producer").alias("producer"), _block("_number").alias("_block"), F.col("_number").alias("lo"), F.col("_number").alias("hi")).distinct()
    if ranges is not None:
        parts = parts.unionByName(ranges.select("producer", "_block", "lo", "hi"))
    w = Window.partitionBy("producer", "_block").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0)
    return (
        parts.withColumn("_new", new)
        .withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("producer", "_block", "_k")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("_k")
    )


def stitch(blocks: DataFrame) -> DataFrame:
    """Ranges of a state joined over block borders: ``producer``, ``lo``, ``hi``.

    A border is bridged if a range ends before it and one begins behind it.  Only the first and last piece of what is
    bridged meet in a window by producer, and each such pair stands for a block border at least.
    """
    left = F.col("lo") == F.col("_block") * BLOCK
    right = F.col("hi") == (F.col("_block") + 1) * BLOCK - 1
    ends = blocks.filter(right).select("producer", (F.col("_block") + 1).alias("_border"))
    starts = blocks.filter(left).select("producer", F.col("_block").alias("_border"))
    bridged = ends.join(starts, ["producer", "_border"])
    marked = (
        blocks.join(bridged.select("producer", F.col("_border").alias("_block"), F.lit(True).alias("_l")), ["producer", "_block"], "left")
        .join(bridged.select("producer", (F.col("_border") - 1).alias("_block"), F.lit(True).alias("_r")), ["producer", "_block"], "left")
        .withColumn("_from", F.coalesce(F.col("_l") & left, F.lit(False)))
        .withColumn("_on", F.coalesce(F.col("_r") & right, F.lit(False)))
    )
    alone = marked.filter("not _from and not _on").select("producer", "lo", "hi")
    w = Window.partitionBy("producer").orderBy("lo")
    runs = marked.filter("_from <> _on").withColumn("_to", F.lead("hi").over(w)).filter("_on").select("producer", "lo", F.col("_to").alias("hi"))
    return alone.unionByName(runs)


def merge_ranges(numbers: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Disjoint maximal ranges of the numbers and the ranges seen before: ``producer``, ``lo``, ``hi``."""
    return stitch(merge_blocks(numbers, None if ranges is None else cut_ranges(ranges)))


def accept(deliveries: DataFrame, id_col: str, order: list[str], carry: list[str], seen: DataFrame | None = None, seen_other: DataFrame | None = None) -> DataFrame:
    """The first delivery of every message not seen before: ``_producer, _number, _other``, ``order`` and ``carry``.

    First means lowest in ``order`` (nulls lowest), then in ``carry``.  One row per identifier, by an aggregation with
    map-side combine, so an identifier that holds a third of all rows costs each task one row.  ``seen`` (producer, lo,
    hi) and ``seen_other`` (other) are what earlier batches accepted.
    """
    parsed = parse_identifier(deliveries, id_col)
    fields = [*order, *[c for c in carry if c not in order]]
    # a delivery without identifier is a group of its own
    missing = F.col("_producer").isNull() & F.col("_other").isNull()
    first = (
        parsed.withColumn("_alone", F.when(missing, F.monotonically_increasing_id()))
        .groupBy("_producer", "_number", "_other", "_alone")
        .agg(F.min(F.struct(*fields)).alias("_first"))
        .select("_producer", "_number", "_other", *[F.col(f"_first.{c}").alias(c) for c in fields])
    )
    return unseen(first, seen, seen_other)


def epoch_of(rows: DataFrame, by: str, epochs: int) -> Column:
    """Number (0 ..) of the batch a row belongs to: about equal slices of ``by``; nulls, which are lowest, come first."""
    kind = rows.schema[by].dataType
    if epochs < 2 or not isinstance(kind, (NumericType, TimestampType, TimestampNTZType, DateType)):
        return F.lit(0)
    cuts = rows.agg(F.percentile_approx(by, [k / epochs for k in range(1, epochs)], 1000).alias("c")).first()["c"] or []
    number = F.lit(0)
    for c in sorted(set(cuts)):
        number = number + F.when(F.col(by) > F.lit(c), 1).otherwise(0)
    return number


def accept_all(parsed: DataFrame, order: list[str], epochs: int = 3) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The accepted deliveries of a parsed table, and the state before its last batch.

    The deliveries are taken in ``epochs`` batches of rising ``order``.  Each batch first yields one row per number (the
    lowest in ``order``); those the seen ranges don't cover are accepted and merged into the ranges; malformed
    identifiers are looked up by their text.  The state is checkpointed after each batch.
    """
    keys = ["_producer", "_number", "_other"]
    taken, seen, seen_other = None, None, None
    parsed = parsed.withColumn("_epoch", epoch_of(parsed, order[0], epochs))
    for e in range(epochs):
        first = parsed.filter(F.col("_epoch") == e).groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first")).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order])
        fresh = unseen(first, seen, seen_other)
        if e + 1 < epochs:
            fresh = cut_lineage(fresh)
            seen = cut_lineage(merge_blocks(fresh.filter("_producer is not null"), seen))
            other = fresh.filter("_other is not null").select(F.col("_other").alias("other"))
            seen_other = other if seen_other is None else seen_other.unionByName(other)
        taken = fresh if taken is None else taken.unionByName(fresh)
    return taken, seen, seen_other


def unseen(first: DataFrame, seen: DataFrame | None, seen_other: DataFrame | None) -> DataFrame:
    """Rows of ``first`` whose number no seen range covers, and whose text, if malformed, was not seen."""
    if seen is not None:
        first = uncovered(first.filter("_producer is not null"), seen).unionByName(first.filter("_producer is null"))
    if seen_other is not None:
        first = first.join(seen_other.select(F.col("other").alias("_other")), "_other", "left_anti").select(first.columns)
    return first


def repeats(deliveries: DataFrame, id_col: str, order: list[str], epochs: int = 3) -> DataFrame:
    """Every delivery but the accepted one of each message: ``_producer, _number, _other`` and ``order``.

    Rows equal in identifier and order are copies; one of them is the accepted one.  Accepted rows are subtracted from
    all rows by one aggregation over identifier *and* order, which spreads the rows of a hot identifier evenly.  An
    empty table, or one of missing identifiers only, gives no rows.
    """
    keys = ["_producer", "_number", "_other", *order]
    parsed = parse_identifier(deliveries, id_col).filter("_producer is not null or _other is not null").select(*keys)
    parsed = cut_lineage(parsed)
    taken, _, _ = accept_all(parsed, order, epochs)
    left = parsed.withColumn("_n", F.lit(1)).unionByName(taken.withColumn("_n", F.lit(-1))).groupBy(*keys).agg(F.sum("_n").alias("_left"))
    return left.filter("_left > 0").select(*keys, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_left"))).alias("_copy")).drop("_copy")


def keep_one(deliveries: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """The table with exactly one delivery of each message, all columns kept."""
    cols = deliveries.columns
    taken = accept(deliveries.select(F.col(id_col).alias("_id_raw"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.struct(*[F.col(c) for c in cols]).alias("_row")), "_id_raw", [f"_o{k}" for k in range(len(order))], ["_row"])
    return taken.select(*[F.col("_row").getField(c).alias(c) for c in cols])
