"""Passages of evaluation items inside training documents.

Both sides are reduced to their words, one blank between and around.  By the q-gram lemma a window of L characters that
occurs with at most e edits shares at least L + 1 - q(e + 1) of its q-grams with the place where it occurs, all on
diagonals (document position less item position) at most e apart.  The q-grams of a document that occur in an item are
counted in overlapping diagonal bands; bands that reach the bound of the item's shortest window are retained and
verified by an alignment inside the band.

The documents are read once and never shuffled.  The items are a bounded query set: they are gathered and broadcast in
blocks of at most ``BLOCK_CHARS`` characters, and a larger set costs another pass over the documents per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of evaluation text broadcast at once.
BLOCK_CHARS = 4_000_000
#: Characters of documents handled at once by a task; longer documents are cut into overlapping windows.
CHUNK = 1 << 20
_BITS = 22
_MULT = np.uint64(0x9E3779B97F4A7C15)


def normal_text(text: Column) -> Column:
    """Words in order, lower case, one blank between and around; '' for null and word-less texts."""
    joined = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.coalesce(joined, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" "), joined, F.lit(" ")))


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each position, q a power of two, by doubling."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * _MULT
    n = 1
    mult = 0xD1342543DE82EF95
    while n < q:
        if len(h) <= n:
            return np.zeros(0, dtype=np.uint64)
        h = h[:-n] * np.uint64(mult) + h[n:]
        h ^= h >> np.uint64(29)
        h *= _MULT
        mult = mult * 0x2545F4914F6CDD1D % (1 << 64)
        n *= 2
    return h


@dataclass
class ItemIndex:
    """The q-grams of a block of items."""

    ids: np.ndarray
    codes: np.ndarray  # all items, a separator after each
    starts: np.ndarray
    windows: list  # per item: (start, length) rows, an int32 array, of each window of ``words`` words, blanks around included
    bound: np.ndarray  # per item: least q-grams of a retained band; 0 if the item has no window
    grams: np.ndarray  # sorted hashes
    where: np.ndarray  # positions, by hash
    marks: np.ndarray  # 2^_BITS flags
    q: int
    words: int
    edits: int


def item_q(text: str, words: int, edits: int, q: int) -> int:
    """``q``, halved until ``edits`` edits leave the shortest window of the item a q-gram they don't touch."""
    blanks = [k for k, c in enumerate(text) if c == " "]
    shortest = min((blanks[k + words] - blanks[k] + 1 for k in range(len(blanks) - words)), default=None)
    while shortest is not None and q > 1 and shortest < q * (edits + 1):
        q //= 2
    return q


def build_index(items: list[tuple], words: int, edits: int, q: int) -> ItemIndex | None:
    """``items``: (id, normal text).  None if no item has ``words`` words."""
    ids, parts, starts, windows, bound, at = [], [], [], [], [], 0
    for key, text in items:
        codes = _codes(text)
        blanks = np.flatnonzero(codes == 32)
        if len(blanks) <= words:
            continue
        w = np.stack([blanks[:-words], blanks[words:] - blanks[:-words] + 1], axis=1).astype(np.int32)
        ids.append(key)
        starts.append(at)
        windows.append(w)
        bound.append(max(1, int(w[:, 1].min()) + 1 - q * (edits + 1)))
        parts += [codes, np.array([1], dtype=np.uint32)]
        at += len(codes) + 1
    if not ids:
        return None
    codes = np.concatenate(parts)
    grams = gram_hashes(codes, q)
    sep = np.concatenate([[0], np.cumsum(codes == 1)])
    inside = np.flatnonzero(sep[q : q + len(grams)] == sep[: len(grams)])
    grams = grams[inside]
    order = np.argsort(grams, kind="stable")
    marks = np.zeros(1 << _BITS, dtype=bool)
    marks[(grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return ItemIndex(np.array(ids, dtype=object), codes, np.array(starts), windows, np.array(bound), grams[order], inside[order], marks, q, words, edits)


def _hits(codes: np.ndarray, x: ItemIndex) -> tuple[np.ndarray, np.ndarray]:
    """Every (text position, item position) at which a q-gram of the text occurs."""
    g = gram_hashes(codes, x.q)
    p = np.flatnonzero(x.marks[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
    lo, hi = np.searchsorted(x.grams, g[p], "left"), np.searchsorted(x.grams, g[p], "right")
    n = hi - lo
    p, lo, n = p[n > 0], lo[n > 0], n[n > 0]
    if not len(p):
        return p, p
    first = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return np.repeat(p, n), x.where[first + np.arange(n.sum())]


def align_windows(item: np.ndarray, windows: np.ndarray, text: np.ndarray, lo: int, width: int) -> np.ndarray:
    """Least edits of each item window against the text, the path inside diagonals lo .. lo + width - 1 (start and end free).
    All windows advance together, a row of the dynamic program at a time."""
    start, length = windows[:, 0], windows[:, 1]
    longest = int(length.max())
    # what lies outside the text matches nothing
    text = np.concatenate([np.full(longest + width, 0xFFFFFFFF, np.uint32), text, np.full(longest + width, 0xFFFFFFFF, np.uint32)])
    item = np.concatenate([item, np.zeros(longest, np.uint32)])
    cols = np.arange(width)
    at = np.clip(start[:, None] + lo + longest + width + cols, 0, len(text) - longest - 1)
    far = np.full((len(windows), 1), 1 << 20)
    best = np.full(len(windows), 1 << 20)
    row = np.zeros((len(windows), width), dtype=np.int64)
    for i in range(longest):
        step = row + (text[at + i] != item[start + i][:, None])
        new = np.minimum(step, np.concatenate([row[:, 1:] + 1, far], axis=1)) - cols
        row = np.minimum.accumulate(new, axis=1) + cols
        done = length == i + 1
        if done.any():
            best[done] = row[done].min(axis=1)
    return best


def _banded(codes: np.ndarray, docs: np.ndarray, p: np.ndarray, g: np.ndarray, x: ItemIndex) -> list[tuple[int, int, int]]:
    """Overlapping bands of diagonals, each region aligned inside its band; (text position, item, windows found)."""
    e, b = x.edits, max(16, 2 * x.edits)
    diag = p - g
    band = diag // b
    again = diag - band * b < e
    p, g, band = np.concatenate([p, p[again]]), np.concatenate([g, g[again]]), np.concatenate([band, band[again] - 1])
    item = np.searchsorted(x.starts, g, "right") - 1
    doc = np.searchsorted(docs, p, "right") - 1
    key = np.stack([doc, item, band])
    order = np.lexsort((p, band, item, doc))
    key, p, g = key[:, order], p[order], g[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0).any(axis=0)]))
    ends = np.concatenate([first[1:], [len(p)]])
    many = ends - first >= x.bound[key[1, first]]
    out = []
    for f, z in zip(first[many], ends[many], strict=True):
        d, i, k = key[:, f]
        if len(np.unique(p[f:z])) < x.bound[i]:
            continue
        a, z_doc = docs[d], docs[d + 1] if d + 1 < len(docs) else len(codes)
        s = x.starts[i]
        stop = x.starts[i + 1] - 1 if i + 1 < len(x.starts) else len(x.codes) - 1
        # each window by its own bound: of its q-grams those that were met in the band
        met = np.unique(g[f:z]) - s
        w = x.windows[i].astype(np.int64)
        seen = np.searchsorted(met, w[:, 0] + w[:, 1] - x.q, "right") - np.searchsorted(met, w[:, 0])
        w = w[seen >= np.maximum(1, w[:, 1] + 1 - x.q * (e + 1))]
        if not len(w):
            continue
        best = align_windows(x.codes[s:stop], w, codes[a:z_doc], int(k * b + s - a) - e, b + 3 * e + 1)
        n = int((best <= e).sum())
        if n:
            out.append((int(p[f]), int(i), n))
    return out


def find_in(texts: list[str], x: ItemIndex) -> list[tuple[int, int, int]]:
    """(text number, item number, windows found in one place at most) for each text and item that meet."""
    best: dict[tuple[int, int], int] = {}
    longest = int(np.diff(np.concatenate([x.starts, [len(x.codes)]])).max()) + x.edits

    def flush(rows: list[int], parts: list[np.ndarray]) -> None:
        docs = np.cumsum([0, *[len(c) + 1 for c in parts]])[:-1]
        codes = np.concatenate([y for c in parts for y in (c, np.array([0], dtype=np.uint32))])
        p, g = _hits(codes, x)
        if not len(p):
            return
        found = _banded(codes, docs, p, g, x)
        for at, i, n in found:
            k = (rows[int(np.searchsorted(docs, at, "right")) - 1], i)
            best[k] = max(best.get(k, 0), n)

    rows, parts, held = [], [], 0
    for r, t in enumerate(texts):
        if not t:
            continue
        c = _codes(t)
        for s in range(0, max(1, len(c) - longest), CHUNK):
            piece = c[s : s + CHUNK + longest]
            rows.append(r)
            parts.append(piece)
            held += len(piece)
            if held >= CHUNK:
                flush(rows, parts)
                rows, parts, held = [], [], 0
    if rows:
        flush(rows, parts)
    return [(r, i, n) for (r, i), n in best.items()]


def leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, words: int = 12, edits: int = 0, q: int | None = None) -> DataFrame:
    """``doc_id``, ``item_id`` and ``shared``: documents holding a passage of at least ``words`` consecutive words of an item.

    ``shared`` counts the item's windows of ``words`` words that occur with at most ``edits`` character edits, in the region
    of the document that holds most of them; without edits an alignment must cost nothing.  Null and empty texts and items of fewer words match nothing; a
    repeated document row gives its rows again; a repeated item id counts as one item per row.
    """
    q = q or (16 if edits == 0 else 8)
    rows = items.select(F.col(item_id).alias("i"), normal_text(F.col(item_text)).alias("t")).filter("t <> '' and i is not null")
    ikind, dkind = items.schema[item_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("_d"), normal_text(F.col(doc_text)).alias("_t")).filter(F.length("_t") > 2 * words - edits)
    schema = f"_d {dkind}, _i {ikind}, shared bigint"
    out = docs.sparkSession.createDataFrame([], schema)

    def blocks() -> Iterator[tuple[int, list[tuple]]]:
        """Items in blocks, one q-gram length a block (items of short windows need shorter q-grams); the driver holds one
        unfinished block for each length, of which there are log2(q) + 1, and no block that is done."""
        filling: dict[int, tuple[list[tuple], int]] = {}
        for r in rows.toLocalIterator():
            k = item_q(r["t"], words, edits, q)
            block, held = filling.get(k, ([], 0))
            if held + len(r["t"]) > BLOCK_CHARS and block:
                yield k, block
                block, held = [], 0
            block.append((r["i"], r["t"]))
            filling[k] = (block, held + len(r["t"]))
        yield from ((k, block) for k, (block, _) in filling.items())

    for block_q, block in blocks():
        index = build_index(block, words, edits, block_q)
        if index is None:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(index)
        del index

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            x = shared.value
            for p in batches:
                found = find_in(list(p["_t"]), x)
                ids = p["_d"].to_numpy()
                yield pd.DataFrame({"_d": [ids[r] for r, _, _ in found], "_i": [x.ids[i] for _, i, _ in found], "shared": [n for _, _, n in found]})

        out = out.unionByName(slim.mapInPandas(run, schema))
    return out.select(F.col("_d").alias("doc_id"), F.col("_i").alias("item_id"), "shared")
