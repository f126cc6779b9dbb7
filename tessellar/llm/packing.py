"""Filling containers of fixed capacity with texts, measured in tokens of a public tokenizer.

A container has three capacities: tokens, documents, and attention cost (the sum of squared lengths).  Items are taken
longest first; each goes to the open container whose residual vector, after it, has the least weighted norm, among those
where it keeps every constraint, and to a new one if there is none (vector best fit).  Only a text longer than the
capacity is split: into full containers and one rest.  A text whose cost alone is above the cost capacity is never split
for that: it has a container to itself.

Packing is local to shards of about ``SHARD_TOKENS`` tokens, drawn by a hash, so a task's work is bounded and no key
decides a shard's size.  What a shard leaves in containers that are not nearly full is packed again in fewer shards,
until one shard holds all of it or nothing improves; the space lost is that of a few containers a shard at most.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.session import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's byte-level BPE splits text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
CAPACITY = 2048
MAX_DOCS = 64
#: Attention cost a shared container may have, as a share of that of one text filling it.
COST_SHARE = 0.9
SHARD_TOKENS = 4_000_000
#: A container at least this full is not opened again.
FULL = 0.995
_ENCODERS: dict = {}


def encoder_of(vocabulary: bytes):
    """The tokenizer of a vocabulary file's content, one per worker process."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


@lru_cache(None)
def encoder(path: str):
    return encoder_of(Path(path).read_bytes())


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text; 0 for null and empty ones."""
    return len(encoder(path).encode_ordinary(text)) if text else 0


def best_fit(tokens: np.ndarray, capacity: int, max_docs: int, max_cost: int, weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> np.ndarray:
    """Container number of each item (each at most ``capacity`` tokens), items in the given order; an item of more than
    ``max_cost`` is alone in its container."""
    cap = np.array([capacity, max_docs, max_cost], dtype=np.float64)
    weight = np.array(weights)
    room = np.empty((max(16, len(tokens)), 3))  # residual capacities, as fractions
    used, out = 0, np.empty(len(tokens), dtype=np.int64)
    live = np.empty(0, dtype=np.int64)  # containers that can take anything at all
    one = 1.0 / max_docs
    for i, t in enumerate(tokens):
        if float(t) * t > max_cost:
            out[i], used = used, used + 1
            continue
        need = np.array([t, 1.0, float(t) * t]) / cap
        rest = room[live] - need
        fits = (rest > -1e-9).all(axis=1)
        if fits.any():
            norm = np.where(fits, (rest * rest) @ weight, np.inf)
            j = live[int(np.argmin(norm))]
            room[j] -= need
        else:
            j, used = used, used + 1
            room[j] = 1.0 - need
            live = np.append(live, j)
        out[i] = j
        if room[j, 0] * capacity < 0.5 or room[j, 1] < one - 1e-9:
            live = live[live != j]
    return out


def token_counts(docs: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc``, ``n``: tokens of each text, texts without tokens left out."""
    slim = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter("text is not null and text <> ''")
    kind = slim.schema["doc"].dataType.simpleString()
    # the file need be on the driver only; a vocabulary is some MB
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder_of(shared.value).encode_ordinary
        for p in batches:
            yield pd.DataFrame({"doc": p["doc"].to_numpy(), "n": [len(encode(t)) for t in p["text"]]})

    return slim.mapInPandas(run, f"doc {kind}, n bigint").filter("n > 0")


def _filler(level: int, capacity: int, max_docs: int, max_cost: int):
    def fill(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["tokens", "row", "token_start"], ascending=[False, True, True])
        bin_of = best_fit(p["tokens"].to_numpy(), capacity, max_docs, max_cost)
        full = np.bincount(bin_of, weights=p["tokens"].to_numpy()).astype(np.int64)
        return p.assign(container=[f"{level}.{int(key[0])}.{b}" for b in bin_of], fill=full[bin_of])[["container", "row", "doc", "token_start", "token_end", "tokens", "fill"]]

    return fill


def pack(docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int | None = None, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``container`` (string), ``doc``, ``token_start``, ``token_end``: what each container holds.

    Null and empty texts are in no container.  A repeated row or id is an item each time.  ``max_cost`` is the attention
    cost a container of several texts may have, by default ``COST_SHARE`` of that of one text filling it.
    """
    max_cost = max_cost or int(COST_SHARE * capacity * capacity)
    kind = docs.schema[id_col].dataType.simpleString()
    counts = cut_lineage(token_counts(docs, id_col, text_col, vocabulary).withColumn("row", F.monotonically_increasing_id()))
    pieces = counts.select("row", "doc", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / capacity))).alias("piece"))
    pieces = pieces.select("row", "doc", "piece", (F.col("piece") * capacity).alias("token_start"), F.least("n", (F.col("piece") + 1) * capacity).alias("token_end")).withColumn("tokens", F.col("token_end") - F.col("token_start"))
    alone = pieces.filter(F.col("tokens") == capacity).select(F.concat(F.lit("s"), F.col("row").cast("string"), F.lit("."), F.col("piece").cast("string")).alias("container"), "doc", "token_start", "token_end")
    left = pieces.filter(F.col("tokens") < capacity).select("row", "doc", "token_start", "token_end", "tokens")
    done = alone
    schema = f"container string, row bigint, doc {kind}, token_start bigint, token_end bigint, tokens bigint, fill bigint"
    total = left.agg(F.sum("tokens")).first()[0] or 0
    level, shards_before = 0, 0
    while total:
        shards = int(-(-total // shard_tokens))
        packed = left.withColumn("shard", F.pmod(F.xxhash64("row", "token_start", F.lit(level)), F.lit(shards)).cast("int")).repartition(shards, "shard").groupBy("shard").applyInPandas(_filler(level, capacity, max_docs, max_cost), schema)
        packed = cut_lineage(packed)
        last = shards == 1 or shards == shards_before
        keep = F.lit(True) if last else (F.col("fill") >= int(FULL * capacity)) | (F.col("tokens") * F.col("tokens") > max_cost)
        done = done.unionByName(packed.filter(keep).select("container", "doc", "token_start", "token_end"))
        if last:
            break
        left = packed.filter(~keep).select("row", "doc", "token_start", "token_end", "tokens")
        total = left.agg(F.sum("tokens")).first()[0] or 0
        level, shards_before = level + 1, shards
    return done.withColumnRenamed("doc", "doc_id")


def summary(contents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per container: tokens, documents, unused tokens and attention cost."""
    size = F.col("token_end") - F.col("token_start")
    return contents.groupBy("container").agg(F.sum(size).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum(size * size).alias("cost")).withColumn("unused", F.lit(capacity) - F.col("tokens"))


def invariants(contents: DataFrame, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int | None = None) -> DataFrame:
    """One row: documents packed, and how often each rule is broken (containers over a capacity; documents split though
    they fit, or whose pieces leave gaps or overlap)."""
    max_cost = max_cost or int(COST_SHARE * capacity * capacity)
    boxes = summary(contents, capacity).agg(
        F.count(F.when(F.col("tokens") > capacity, 1)).alias("over_tokens"),
        F.count(F.when(F.col("documents") > max_docs, 1)).alias("over_documents"),
        F.count(F.when((F.col("documents") > 1) & (F.col("cost") > max_cost), 1)).alias("over_cost"),
    )
    size = F.col("token_end") - F.col("token_start")
    docs = contents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum(size).alias("tokens"), F.max("token_end").alias("last"), F.min("token_start").alias("first"), F.countDistinct("token_start").alias("starts"))
    parts = docs.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count(F.when((F.col("pieces") > 1) & (F.col("tokens") <= capacity), 1)).alias("split_needlessly"),
        F.count(F.when((F.col("first") != 0) | (F.col("tokens") != F.col("last")) | (F.col("starts") != F.col("pieces")), 1)).alias("gaps"),
    )
    one = F.lit(1).alias("_one")
    return boxes.select("*", one).join(parts.select("*", one), "_one").drop("_one")
