"""Sinks (SNK-*): versioned publishing, split appends, binary packs, checksums, key/value metadata."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType
from pyspark.sql.utils import AnalysisException


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions published under a folder of any file system Spark reads."""
    fs, p, _ = _fs(spark, root)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def publish(df: DataFrame, root: str) -> int:
    """SNK-07, SNK-08, SNK-11: writes the next version beside the folder and renames it into place, so a reader sees all of
    it or nothing; returns the version."""
    spark = df.sparkSession
    version = max(versions(spark, root), default=0) + 1
    df.write.mode("overwrite").parquet(f"{root}/.staging-{version}")
    fs, _, path = _fs(spark, root)
    if not fs.rename(path(f"{root}/.staging-{version}"), path(f"{root}/v={version}")):
        raise OSError(f"version {version} can't be put into place")
    return version


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The given version, or the latest."""
    v = version or max(versions(spark, root), default=0)
    if not v:
        raise FileNotFoundError(f"no version under {root}")
    return spark.read.parquet(f"{root}/v={v}")


def append_routed(rows: DataFrame, main: str, other: str, route) -> None:
    """SNK-13: rows for which ``route`` holds are appended to ``other``, the rest to ``main``, as JSON lines."""
    flag = F.coalesce(route, F.lit(False))
    rows.filter(~flag).write.mode("append").json(main)
    rows.filter(flag).write.mode("append").json(other)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """SNK-09, SNK-14."""
    rows.write.mode("overwrite").json(path)


def put_meta(spark: SparkSession, path: str, values: dict[str, str | None]) -> None:
    """SNK-05, SNK-06: key/value metadata, null as ''; keys not given keep their values."""
    merged = {**read_meta(spark, path), **{k: v or "" for k, v in values.items()}}
    spark.createDataFrame(sorted(merged.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(path)


def read_meta(spark: SparkSession, path: str) -> dict[str, str]:
    """HLP-02."""
    try:
        return {r["key"]: r["value"] for r in spark.read.parquet(path).collect()}
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise


def require_version(meta: dict[str, str], key: str, wanted: str) -> None:
    """HLP-01: refuses tables of another layout."""
    if meta.get(key) != wanted:
        raise ValueError(f"{key} is {meta.get(key)!r}, not {wanted!r}: rebuild the tables")


def encode_vectors(df: DataFrame, vector: str, out: str = "vec") -> DataFrame:
    """SNK-10: arrays as little-endian float32 blobs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.drop(columns=[vector]).assign(**{out: pd.Series([None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in p[vector]], index=p.index, dtype=object)})

    keep = [f for f in df.schema.fields if f.name != vector]
    return df.mapInPandas(run, StructType(keep).add(out, BinaryType()))


def checksum(df: DataFrame) -> str:
    """SNK-12: of the rows in any order: number and wrapping sum of two row hashes, by one aggregation."""
    cols = [F.to_json(F.struct(*df.columns))]
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(20,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), *cols)).alias("b")).first()
    return f"{r['n']}-{r['a'] or 0}-{r['b'] or 0}"


def verify(df: DataFrame, expected: str | None) -> str:
    """'ok', 'missing_checksum' or 'mismatch'."""
    return "missing_checksum" if not expected else "ok" if checksum(df) == expected else "mismatch"


def stats_markdown(stats: dict[str, int | float | str], title: str) -> str:
    """SNK-15: counts as a Markdown table; values only, never the queries behind them."""
    rows = "\n".join(f"| {k} | {json.dumps(v) if isinstance(v, str) else v} |" for k, v in sorted(stats.items()))
    return f"# {title}\n\n| measure | value |\n| --- | --- |\n{rows}\n"
