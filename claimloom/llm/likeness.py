"""The Jaccard likeness of texts by word shingles: sets, bands of their least hashes, and exact comparison inside tasks.

A text's shingles are those of `SHINGLE` lower-cased words (of all its words if it has fewer), hashed to 64 bits, each once. Texts that
agree in all `ROWS` least hashes of one of `BANDS` bands share a block; a pair at a likeness of 0.8 shares none with a probability of
(1 - 0.8^6)^24 = 0.0007, less above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from claimloom.llm.blocks import bounds
from claimloom.llm.common import columns, slices, words_of

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 24, 6
SEED = 42
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes): the different shingles of all texts in one array, and where each text's begin (one more entry than texts)."""
    import xxhash

    starts, words = words_of(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = words.dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w.encode(), seed) for w in coded.dictionary.to_pylist()], np.uint64)
    hashes = np.append(known[coded.indices.to_numpy()], np.uint64(0))  # the last is for texts without words
    n_words = np.diff(starts)
    counts = np.maximum(n_words - shingle + 1, 1)
    owner = np.repeat(np.arange(len(texts)), counts)
    at = np.repeat(starts[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    h = np.zeros(len(at), np.uint64)
    for k in range(shingle):
        has = k < n_words[owner]
        h = np.where(has, h * _STEP + hashes[np.where(has, at + k, -1)] + np.uint64(1), h)
    h = _mixed(h)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    fresh = np.append(True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    return np.append(0, np.cumsum(np.bincount(owner[fresh], minlength=len(texts)))), h[fresh]


def bands(starts: np.ndarray, hashes: np.ndarray, n_bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> np.ndarray:
    """A key for each text and band, of which the number of the band is part."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(starts) - 1, n_bands), np.uint64)
    for b in range(n_bands):
        out[:, b] = b + 1
        for _ in range(rows):
            flip, by = (np.uint64(x) for x in rng.integers(0, 1 << 63, 2, dtype=np.uint64))
            least = np.minimum.reduceat((hashes ^ flip) * (by | np.uint64(1)), starts[:-1])
            out[:, b] = _mixed(out[:, b] * _STEP + least)
    return out


def lists(starts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.view(np.int64)))


def shingle_sets(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows (g, node, size, fp, text) with their set of shingles in place of the text."""
    schema = pa.schema([("g", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            yield columns(schema, **{c: batch.column(c) for c in ("g", "node", "size", "fp")}, set=lists(*shingles(batch.column("text"), shingle)))

    return texts.select("g", "node", "size", "fp", "text").mapInArrow(run, "g long, node long, size long, fp long, set array<long>")


def alike_in_task(table: pa.Table, least: float, radius: int) -> pa.Table:
    """Edges (u, v) of a spanning forest of the pairs of each group whose sets are alike to `least`.

    A pair is read only if its sizes and fingerprints allow it and its rows aren't linked yet. One row's set is marked in an array of
    the task's shingles, and the marks under the sets it is compared with are summed.
    """
    table = table.take(pa.array(np.argsort(table.column("g").to_numpy(), kind="stable")))
    g, node, size, side = (table.column(c).to_numpy() for c in ("g", "node", "size", "side"))
    fp = table.column("fp").to_numpy().view(np.uint64)
    sets = table.column("set").combine_chunks()
    begin = sets.offsets.to_numpy().astype(np.int64)
    begin -= begin[0]
    known, codes = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    marked, root = np.zeros(len(known), np.int64), np.arange(len(g))
    u: list[int] = []
    v: list[int] = []
    for a, z in bounds(g):
        across = side[a:z].any()
        for i in range(a, z):
            if across and side[i]:
                continue
            j = np.arange(a if across else i + 1, z)
            fits = (root[j] != root[i]) & (np.minimum(size[j], size[i]) >= least * np.maximum(size[j], size[i])) & (np.bitwise_count(fp[j] ^ fp[i]) <= radius)
            j = j[fits & (side[j] == 1)] if across else j[fits]
            if not len(j):
                continue
            own = codes[begin[i] : begin[i + 1]]
            marked[own] = 1
            ends = np.cumsum(size[j])
            first = ends - size[j]
            shared = np.add.reduceat(marked[codes[np.arange(ends[-1]) + np.repeat(begin[j] - first, size[j])]], first)
            marked[own] = 0
            like = j[shared >= least * (size[i] + size[j] - shared) - 1e-9]
            for k in like[np.unique(root[like], return_index=True)[1]]:
                u.append(i)
                v.append(k)
                part = root[a:z]
                part[part == root[k]] = root[i]
    return pa.table({"u": node[np.array(u, np.int64)], "v": node[np.array(v, np.int64)]})
