"""Instants written in many forms (DAT-01)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?([Zz]|[+-]\d{2}(:?\d{2})?)?)?$"
_NUMBER = r"^\d{1,17}(\.\d+)?$"


def instant_ms(raw: Column) -> Column:
    """Epoch milliseconds of an ISO string (UTC where it names no zone) or of epoch seconds (< 10^12) or milliseconds.

    Anything else - null, blank, words, impossible dates - is null.
    """
    s = F.trim(raw.cast("string"))
    iso = F.translate(F.upper(s), ",", ".")
    zoned = F.substring(s, 11, 40).rlike("[Zz+-]")
    full = F.when(F.length(s) == 10, F.concat(iso, F.lit("T00:00:00Z"))).when(zoned, iso).otherwise(F.concat(iso, F.lit("Z")))
    number = s.try_cast("decimal(28,6)")
    epoch = F.when(number < F.lit(10**12), number * 1000).otherwise(number).cast("bigint")
    return F.when(s.rlike(_NUMBER), epoch).when(s.rlike(_ISO), F.unix_millis(full.try_cast("timestamp")))
