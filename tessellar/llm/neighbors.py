"""The k most similar vectors of every vector: inverted file, product-quantised residuals, exact reranking.

1. *Fit*, on the driver, on a bounded sample (at most ``MAX_SAMPLE`` vectors): coarse centroids by spherical k-means,
   about sqrt(N) of them, and codebooks of the residuals for ``parts`` slices of the dimensions.
2. *Assign*, one pass over all vectors: each goes to the list of its nearest centroid, and as a query also to those
   whose centroids are nearly as similar, by a margin that gives ``probes`` lists a vector on average.  Vectors travel packed by (batch, list): as 16-bit decimals where that loses nothing, else
   as 32-bit floats.  Copies of a vector travel once per batch.
3. *Search*, a task per list: members are coded by the codebooks of their residuals; a query's inner products with all
   codewords (its asymmetric distance table) rank the members, and only the best ``rerank`` are compared with it: by
   32-bit cosines, and the best ``EXACT`` of those by the exact cosine in 64 bits.
4. *Merge* the lists' answers per query.

A list that holds many vectors in the sample is split by salt: its members are spread over several tasks and its queries
go to each, so a third of all vectors falling into one list costs more tasks, not one long one.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.session import cut_lineage

#: Most vectors the fit ever sees.  The sample is spread over the whole table by a hash of the id.
MAX_SAMPLE = 65_536
#: Members of a list that one task handles, as far as the sample tells.
LIST_ROWS = 4_000
CODEWORDS = 256
#: Most lists searched for one vector; ``probes`` is their mean.
MAX_PROBES = 8
#: Shortlisted members whose cosine is computed in 64 bits.
EXACT = 24
#: Rows assigned to lists at once, and vectors compared at once by the fit: bounds memory whatever the number of lists.
ASSIGN_ROWS = 512
FIT_CELLS = 1 << 24
#: Salts of the vectors that have more copies in a batch than answers are needed.
COPY_SALTS = 64


@dataclass
class Index:
    centroids: np.ndarray  # [lists, dim], unit
    codebooks: np.ndarray  # [parts, CODEWORDS, dim / parts]
    salts: np.ndarray  # tasks per list
    margin: float  # a list is searched if its centroid is at most this much less similar than the nearest one
    rerank: int
    k: int


def usable_rows(values: np.ndarray, lengths: np.ndarray, starts: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and matrix of the vectors that have exactly ``dim`` finite values, not all zero."""
    rows = np.flatnonzero(lengths == dim)
    m = values[starts[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim), np.float32)
    ok = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
    return rows[ok], m[ok]


def unit(m: np.ndarray) -> np.ndarray:
    x = m.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # very long vectors must not overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool = False) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, c, spherical)
        order = np.argsort(near, kind="stable")
        first = np.searchsorted(near[order], np.arange(len(c)))
        count = np.diff(np.concatenate([first, [len(x)]]))
        full = count > 0
        sums = np.add.reduceat(x[order], first[full], axis=0)
        c[full] = sums / count[full][:, None]
        empty = np.flatnonzero(~full)
        if len(empty):  # restart from rows of the fullest clusters
            crowded = np.argsort(-count)[: len(empty)]
            for e, big in zip(empty, crowded, strict=False):
                c[e] = x[order[first[big] + rng.integers(count[big])]]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, spherical: bool) -> np.ndarray:
    half = 0 if spherical else 0.5 * (c * c).sum(axis=1)
    rows = max(64, min(8192, FIT_CELLS // max(1, len(c))))
    return np.concatenate([np.argmax(x[a : a + rows] @ c.T - half, axis=1) for a in range(0, len(x), rows)])


def fit(sample: np.ndarray, total: int, k: int, probes: float, rerank: int, parts: int, list_rows: int = LIST_ROWS, seed: int = 7) -> Index:
    """``sample``: raw vectors; ``total``: rows of the table."""
    rng = np.random.default_rng(seed)
    x = unit(sample).astype(np.float32)
    lists = int(max(1, min(round(total**0.5), total // 64, len(x) // 4)))
    c = kmeans(x, lists, 8, rng, spherical=True)
    near = _nearest(x, c, True)
    res = (x - c[near]).reshape(len(x), parts, -1)
    few = res[rng.permutation(len(res))[:8192]]
    books = np.stack([_padded(kmeans(np.ascontiguousarray(few[:, j]), min(CODEWORDS, len(few)), 6, rng)) for j in range(parts)])
    share = np.bincount(near, minlength=lists) / max(len(x), 1)
    # the margin that gives ``probes`` lists a query on average: vectors inside a cluster need fewer, those between clusters more
    margin = 0.0
    if lists > 1:
        some = x[rng.permutation(len(x))[: max(256, min(8192, FIT_CELLS // lists))]] @ c.T
        near = -np.sort(-some, axis=1)[:, :MAX_PROBES]
        gaps = np.sort((near[:, :1] - near[:, 1:]).ravel())
        margin = float(gaps[min(len(gaps) - 1, int((probes - 1) * len(near)))])
    return Index(c, books, np.maximum(1, np.ceil(share * total / list_rows)).astype(int), margin, rerank, k)


def _padded(c: np.ndarray) -> np.ndarray:
    return np.concatenate([c, np.repeat(c[-1:], CODEWORDS - len(c), axis=0)]) if len(c) < CODEWORDS else c


def pack(m: np.ndarray) -> tuple:
    """float32 rows, losslessly: as 16-bit decimals (high bytes deflated) each row that four decimals give back exactly, the others as they are."""
    scaled = np.rint(m.astype(np.float64) * 1e4)
    short = (np.abs(scaled) < 32768).all(axis=1) & ((scaled / 1e4).astype(np.float32) == m).all(axis=1)
    b = scaled[short].astype("<i2").view(np.uint8).reshape(-1, 2)
    return m.shape, np.packbits(short).tobytes(), b[:, 0].tobytes(), zlib.compress(b[:, 1].tobytes(), 1), m[~short].astype("<f4").tobytes()


def unpack(p: tuple) -> np.ndarray:
    shape, flags, low, high, raw = p
    short = np.unpackbits(np.frombuffer(flags, np.uint8), count=shape[0]).astype(bool)
    out = np.empty(shape, dtype=np.float32)
    b = np.stack([np.frombuffer(low, np.uint8), np.frombuffer(zlib.decompress(high), np.uint8)], axis=1)
    out[short] = (np.ascontiguousarray(b).view("<i2").reshape(-1, shape[1]) / 1e4).astype(np.float32)
    out[~short] = np.frombuffer(raw, dtype="<f4").reshape(-1, shape[1])
    return out


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[list, np.ndarray]:
    """ids and matrix of the usable rows of a batch (id, embedding); rows with a null id are left out."""
    e, ids = batch.column(1), batch.column(0)
    offsets = e.offsets.to_numpy()
    lengths = np.where(e.is_null().to_numpy(zero_copy_only=False), -1, np.diff(offsets))
    values = e.values.to_numpy(zero_copy_only=False).astype(np.float32)  # nulls among the values become NaN
    rows, m = usable_rows(values, lengths, offsets[:-1], dim)
    known = ~ids.is_null().to_numpy(zero_copy_only=False)[rows]
    return [ids[int(r)].as_py() for r in rows[known]], m[known]


def _copies(ids: list, m: np.ndarray, keep: int) -> tuple[list[bytes], np.ndarray, list[list], list[tuple[bytes, object]]]:
    """Of a batch: digests, one row number per distinct vector, its ``keep`` smallest ids, and the other (digest, id)s."""
    group: dict[bytes, list[int]] = {}
    for r, row in enumerate(m):
        group.setdefault(hashlib.blake2b(row.tobytes(), digest_size=16).digest(), []).append(r)
    digests = list(group)
    names = [sorted(ids[r] for r in rows) for rows in group.values()]
    spare = [(d, i) for d, n in zip(digests, names, strict=True) for i in n[keep:]]
    return digests, np.array([rows[0] for rows in group.values()], dtype=int), [n[:keep] for n in names], spare


def _closest(m: np.ndarray, centroids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest lists of each row and their similarities, nearest first."""
    near = unit(m).astype(np.float32) @ centroids.T
    lists = np.argpartition(-near, most - 1, axis=1)[:, :most]
    close = np.take_along_axis(near, lists, 1)
    order = np.argsort(-close, axis=1, kind="stable")
    return np.take_along_axis(lists, order, 1), np.take_along_axis(close, order, 1)


def assign(batch: pa.RecordBatch, x: Index, dim: int) -> list[tuple[int, int, bool, bytes]]:
    """(list, salt, home, packed vectors) of a batch."""
    ids, m = _matrix(batch, dim)
    if not ids:
        return []
    digests, rows, names, _ = _copies(ids, m, x.k + 1)
    m = m[rows]
    most = min(MAX_PROBES, len(x.centroids))
    found = [_closest(m[a : a + ASSIGN_ROWS], x.centroids, most) for a in range(0, len(m), ASSIGN_ROWS)]
    lists, close = (np.concatenate(p) for p in zip(*found, strict=True))
    asked = close >= close[:, :1] - x.margin
    asked[:, 0] = True
    out: list[tuple[int, int, bool, bytes]] = []
    for rank in range(lists.shape[1]):
        mine = np.flatnonzero(asked[:, rank])
        for c in np.unique(lists[mine, rank]):
            at = mine[lists[mine, rank] == c]
            salts = int(x.salts[c])
            own = np.array([digests[i][0] + 256 * digests[i][1] for i in at]) % salts
            for s in range(salts):
                home = at[own == s] if rank == 0 else at[:0]
                if len(home):
                    out.append((int(c), s, True, pickle.dumps(([digests[i] for i in home], [names[i] for i in home], pack(m[home])), 5)))
                asks = at[own != s] if rank == 0 else at
                if len(asks):
                    out.append((int(c), s, False, pickle.dumps(([digests[i] for i in asks], None, pack(m[asks])), 5)))
    return out


def search_list(blobs: list[bytes], homes: list[bool], c: int, x: Index) -> tuple[list, list, list, list]:
    """Digest, known ids (members only), neighbour ids and cosines of each query of a list."""
    home: dict[bytes, list] = {}
    rows, asks, ask_rows = [], [], []
    for blob, is_home in zip(blobs, homes, strict=True):
        digests, names, packed = pickle.loads(blob)
        m = unpack(packed)
        if is_home:
            for r, d in enumerate(digests):
                if d not in home:
                    home[d] = []
                    rows.append(m[r])
                home[d] += names[r]
        else:
            asks += digests
            ask_rows.append(m)
    if not home:
        return [], [], [], []
    seen: dict[bytes, int] = {}
    for r, d in enumerate(asks):
        if d not in home:
            seen.setdefault(d, r)
    # members in the order of their smallest ids, so that of equal cosines the lower position wins
    digests = sorted(home, key=lambda d: min(home[d]))
    place = {d: r for r, d in enumerate(home)}
    member = unit(np.array(rows)[[place[d] for d in digests]])
    known = [sorted(set(home[d])) for d in digests]
    single = np.array([len(n) == 1 for n in known])
    names = np.empty(len(known), dtype=object)
    names[:] = [n[0] for n in known]
    query = member if not seen else np.concatenate([member, unit(np.concatenate(ask_rows)[list(seen.values())])])
    digests += seen
    n = len(member)
    take, exact_of, top = min(n, x.rerank), min(n, max(EXACT, 2 * x.k + 2)), min(n, x.k + 1)
    m32, cent = member.astype(np.float32), x.centroids[c]
    parts, _, size = x.codebooks.shape
    res = (m32 - cent).reshape(n, parts, size)
    codes = np.stack([_nearest(np.ascontiguousarray(res[:, j]), x.codebooks[j], False) for j in range(parts)])
    ids_out, cos_out = [], []
    for a in range(0, len(query), 64):
        q = query[a : a + 64]
        q32 = q.astype(np.float32)
        # asymmetric distance tables: a query's inner products with all codewords of each part
        score = np.zeros((len(q), n), dtype=np.float32)
        for j in range(parts):
            score += np.take(q32[:, j * size : (j + 1) * size] @ x.codebooks[j].T, codes[j], axis=1)
        short = np.argpartition(-score, take - 1, axis=1)[:, :take]
        fine = np.matmul(m32[short], q32[:, :, None])[:, :, 0]
        few = np.take_along_axis(short, np.argpartition(-fine, min(take, exact_of) - 1, axis=1)[:, : min(take, exact_of)], 1)
        exact = np.round(np.matmul(member[few], q[:, :, None])[:, :, 0], 12)
        order = np.lexsort((few, -exact), axis=1)[:, :top]
        few, exact = np.take_along_axis(few, order, 1), np.take_along_axis(exact, order, 1)
        plain = single[few].all(axis=1)
        named = names[few]
        for r in range(len(q)):
            if plain[r]:
                ids_out.append(named[r])
                cos_out.append(exact[r])
            else:  # copies stand side by side, by id; k + 1 members hold the k + 1 best ids
                best = sorted((-v, i) for v, p in zip(exact[r].tolist(), few[r], strict=True) for i in known[p][: x.k + 1])[: x.k + 1]
                ids_out.append([i for _, i in best])
                cos_out.append([-v for v, _ in best])
    return digests, [*known, *[[] for _ in seen]], ids_out, cos_out


def fit_table(vectors: DataFrame, id_col: str, vec_col: str, dim: int, k: int, probes: float, rerank: int, parts: int, list_rows: int = LIST_ROWS) -> Index | None:
    total = vectors.count()
    want = int(min(MAX_SAMPLE, max(4096, 48 * total**0.5)))
    share = min(1.0, want / max(total, 1))
    pick = F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)
    table = vectors.filter(pick).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("embedding")).limit(2 * want).toArrow()
    found = [_matrix(b, dim)[1] for b in table.to_batches()]
    sample = np.concatenate(found) if found else np.zeros((0, dim), np.float32)
    return fit(sample, total, k, probes, rerank, parts, list_rows) if len(sample) else None


def nearest(vectors: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int = 384, probes: float = 2.2, rerank: int = 128, parts: int = 48, list_rows: int = LIST_ROWS) -> DataFrame:
    """``id``, ``neighbor``, ``cosine``, ``rank`` (1..k): the k most similar other vectors of each usable vector.

    Usable are vectors of exactly ``dim`` finite values, not all zero, with an id.  Cosines equal to 12 decimals are
    ties, won by the smaller id.  Ids are taken to be unique.  Fewer than k others give fewer rows.  ``parts`` must
    divide ``dim``.
    """
    slim = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("embedding"))
    kind = slim.schema["id"].dataType.simpleString()
    spark = vectors.sparkSession
    index = fit_table(vectors, id_col, vec_col, dim, k, probes, rerank, parts, list_rows)
    if index is None:
        return spark.createDataFrame([], f"id {kind}, neighbor {kind}, cosine double, rank int")
    shared = spark.sparkContext.broadcast(index)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = assign(b, shared.value, dim)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[3] for r in rows], pa.binary())], names=["list", "salt", "home", "blob"])

    def search(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        d, known, ids, cos = search_list(list(p["blob"]), list(p["home"]), int(key[0]), shared.value)
        return pd.DataFrame({"d": d, "known": known, "ids": ids, "cos": cos})

    packed = slim.mapInArrow(spread, "list int, salt int, home boolean, blob binary")
    answers = packed.groupBy("list", "salt").applyInPandas(search, f"d binary, known array<{kind}>, ids array<{kind}>, cos array<double>")
    merged = answers.groupBy("d").agg(
        F.flatten(F.collect_list("known")).alias("known"),
        F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.transform("cos", lambda v: -v).alias("far"), F.col("ids").alias("name"))))), 1, k + 1).alias("best"),
    )
    merged = cut_lineage(merged)

    def leftover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, m = _matrix(b, dim)
            spare = _copies(ids, m, k + 1)[3] if ids else []
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in spare], pa.binary()), pa.array([i for _, i in spare], b.column(0).type)], names=["d", "id"])

    # ids beyond the k + 1 smallest of their copies in a batch; a vector that a third of all rows hold is salted
    spare = cut_lineage(slim.mapInArrow(leftover, f"d binary, id {kind}")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(COPY_SALTS)).cast("int"))
    of = merged.join(spare.select("d").distinct(), "d", "left_semi").select("d", "best", F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1))).alias("salt"))
    rest = spare.join(of, ["d", "salt"]).select("id", "best")
    all_ids = merged.select(F.explode("known").alias("id"), "best").unionByName(rest)
    own = F.slice(F.filter("best", lambda b: b["name"] != F.col("id")), 1, k)
    return all_ids.select("id", F.posexplode(own).alias("pos", "b")).select("id", F.col("b.name").alias("neighbor"), (-F.col("b.far")).alias("cosine"), (F.col("pos") + 1).alias("rank"))
