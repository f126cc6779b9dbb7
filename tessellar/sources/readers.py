"""Sources (SRC-*): tables, JSON and JSON-lines documents, text listings, tuple payloads, binary vector packs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType
from pyspark.sql.utils import AnalysisException

#: Schemas are always stated, never inferred.
RECIPE = (
    "id string, title string, description string, tags array<string>, taxonomy_leaf string, paraphrases array<string>, provenance string, "
    "validated boolean, commands array<struct<command:string,comment:string>>, initial_state string, risk double"
)
BANK = "report_id string, query_text string, command_id string, kind string, mutation_kind string, primary_verb string, source string, report_only boolean"
EVENT = (
    "id string, name string, createdAt string, sessionId string, distinctId string, data struct<query:string, mock:string, catalog_version:string, session_id:string, "
    "response:struct<status:string, confidence:double, displayCount:bigint, results:array<struct<command_id:string>>>>"
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """SRC-01: a Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False, missing_ok: bool = True) -> DataFrame:
    """SRC-08: a JSON document a line; a missing file is an empty table.  ``strict`` fails on a bad line, else bad lines are left out."""
    try:
        lines = spark.read.text(path).filter(F.trim("value") != "")
    except AnalysisException as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    if strict:
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    row = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(row.alias("r")).filter("r is not null and r._corrupt is null").select("r.*").drop("_corrupt")


def read_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07, SRC-09: recipes of a JSON document that is an array or an object with ``recipes``; nothing in it is an error."""
    text = spark.read.option("wholetext", True).text(path)
    rows = F.coalesce(F.from_json("value", f"recipes array<struct<{RECIPE}>>").getField("recipes"), F.from_json("value", f"array<struct<{RECIPE}>>"))
    df = text.select(F.explode(rows).alias("r")).select("r.*").filter("id is not null")
    if df.isEmpty():
        raise ValueError(f"no recipes in {path}")
    return df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: (doc, line_no, line) of text files, a file being a document."""
    whole = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("doc"), "value")
    return whole.select("doc", F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), "\n")).alias("line_no", "line"))


def rows_from_tuples(payload: Column, fields: list[str]) -> Column:
    """SRC-12: ``{"columns": [...], "results": [[...]]}`` as an array of structs, by column name; missing columns are null."""
    p = F.from_json(payload, "struct<columns:array<string>,results:array<array<string>>>")
    at = lambda name: F.array_position(p["columns"], name)
    pick = lambda row, name: F.when(at(name) > 0, F.get(row, at(name).cast("int") - 1))
    return F.transform(p["results"], lambda row: F.struct(*[pick(row, f).alias(f) for f in fields]))


def properties(raw: Column, schema: str) -> Column:
    """SRC-14: properties given as JSON text; text that isn't an object gives an empty struct."""
    return F.coalesce(F.from_json(F.when(F.trim(raw).startswith("{"), raw), schema), F.from_json(F.lit("{}"), schema))


def decode_vectors(df: DataFrame, blob: str, dim: int, out: str = "embedding") -> DataFrame:
    """SRC-15: little-endian float32 blobs as arrays; shorter ones are dropped, longer ones cut."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p = p[[b is not None and len(b) >= 4 * dim for b in p[blob]]]
            yield p.drop(columns=[blob]).assign(**{out: pd.Series([np.frombuffer(b, dtype="<f4", count=dim) for b in p[blob]], index=p.index, dtype=object)})

    keep = [f for f in df.schema.fields if f.name != blob]
    return df.mapInPandas(run, StructType(keep).add(out, ArrayType(FloatType())))


def read_dimension(spark: SparkSession, path: str, schema: str, fallback: list[tuple] | None = None) -> DataFrame:
    """HLP-14: a small table kept as one JSON array in a file, with or without a byte-order mark; ``fallback`` rows, or none,
    where there is no file or nothing in it."""
    given = spark.createDataFrame(fallback or [], schema)
    try:
        text = spark.read.option("wholetext", True).text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return given
        raise
    rows = text.select(F.explode(F.from_json(F.regexp_replace("value", "^\ufeff", ""), f"array<struct<{','.join(x.strip().replace(' ', ':', 1) for x in schema.split(', '))}>>")).alias("r")).select("r.*")
    return given if rows.isEmpty() else rows


#: UDF-03: ways to open a table by name; an adapter takes (session, place, name).
ADAPTERS: dict[str, Callable[[SparkSession, str, str], DataFrame]] = {
    "parquet": read_table,
    "view": lambda spark, place, name: spark.table(f"{place}_{name}" if place else name),
    "jsonl": lambda spark, place, name: spark.read.json(f"{place}/{name}.jsonl"),
}


def open_table(spark: SparkSession, kind: str, place: str, name: str) -> DataFrame:
    """UDF-03: a table through the adapter of its kind."""
    if kind not in ADAPTERS:
        raise ValueError(f"no adapter {kind!r}: there are {sorted(ADAPTERS)}")
    return ADAPTERS[kind](spark, place, name)
