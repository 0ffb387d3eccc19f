"""SimHash near-duplicates by tiled exact comparison.

Fingerprints come from whole texts: lower-cased words, shingles of `shingle` words, XXH64 with seed 42, and a bit set where over half
of the hashes have it. Distinct fingerprints (copies are one row from here on) are compared exactly: two that differ in at most
`radius` bits agree in one of radius + 1 blocks of bits, so each is put into one group per block, by as many leading bits of the
block as keep groups near `GROUP` rows at the present count. In a group, rows sorted by population count form tiles; a pair of tiles
is compared with exclusive-or and bit counts unless its population counts differ beyond the radius. A group past `MOST` rows is
dealt into parts, and every pair of parts is a task of its own. A task returns not its pairs but a spanning forest of them, so a
group of n near copies costs n rows, and the forests' union has the same components as all pairs.

Texts whose five-word shingles are alike to 0.8 (`deduplicate`) differ in some 10 of 64 bits, and no block of bits is selective at so wide
a radius. There the blocks are bands of least hashes (`likeness.py`); the tiles are compared as before, with the wide radius, and what
they link is confirmed on the shingles themselves.

Defined results: a null or empty text has fingerprint zero and links like any other; repeated rows and equal texts share a
fingerprint and a component; a row with a null id belongs to its component but never names it (a component of such rows alone has a
null id); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import likeness
from claimloom.llm.blocks import TASK, Forest, bounds, deal
from claimloom.llm.common import checkpoint, columns, name_of, slices, words_of
from claimloom.llm.components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Rows of a group as aimed at, and past which a group is dealt into parts; rows of a tile.
GROUP, MOST, TILE = 4096, 16384, 1024
#: Bits by which fingerprints of texts alike to 0.8 may differ: 10 on average, more than this with a probability below 1e-5.
WIDE_RADIUS = 24
#: Rows up to which groups are compared all at once; shingles of a part of a group that are read together.
FEW, PART_SHINGLES = 32, 1 << 20


def simhashes(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    import xxhash

    starts, words = words_of(pc.ascii_lower(pc.fill_null(texts, "")))
    out = np.zeros(len(texts), np.uint64)
    if not len(words):
        return out
    # one buffer of all words with a space between; shingle i runs from the start of word i to the end of word i + shingle - 1
    joined = " ".join(words.to_pylist()).encode()
    lengths = pc.binary_length(words).to_numpy().astype(np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    end = begin + lengths
    n_words = np.diff(starts)
    counts = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    first = np.cumsum(counts) - counts
    i = np.repeat(starts[:-1] - first, counts) + np.arange(counts.sum())
    last = i + np.repeat(np.minimum(shingle, np.maximum(n_words, 1)) - 1, counts)
    hash_ = xxhash.xxh64_intdigest
    h = np.array([hash_(joined[a:b], seed) for a, b in zip(begin[i].tolist(), end[last].tolist())], dtype="<u8")
    have = counts > 0
    out[have] = majority(h, first[have], counts[have])
    return out


def majority(h: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits that over half of them have."""
    out = np.empty(len(first), np.uint64)
    for lo in range(0, len(first), 256):  # bounds the memory of the unpacked bits
        f, n = first[lo : lo + 256], counts[lo : lo + 256]
        a, b = f[0], f[-1] + n[-1]
        set_ = np.add.reduceat(np.unpackbits(h[a:b].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), f - a, axis=0, dtype=np.int32)
        out[lo : lo + 256] = np.packbits(2 * set_ > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, *, key: str = "doc_id", kind: str = "long", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the column `key` as of the type `kind`, and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            schema = pa.schema([batch.schema.field("doc_id"), ("fp", pa.int64())])
            yield columns(schema, doc_id=batch.column("doc_id"), fp=simhashes(batch.column("text"), shingle, seed).view(np.int64))

    return docs.select(F.col(key).cast(kind).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def forest(fps: np.ndarray, side: np.ndarray, radius: int, tile: int = TILE, sizes: np.ndarray | None = None, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, row) of a spanning forest of the pairs within `radius`; side: with both 0 and 1 present, only pairs across sides.

    With `sizes`, a pair's smaller size must be `least` times its larger one at least.
    """
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    fps, side = fps[order], side[order]
    sizes = None if sizes is None else sizes[order]
    ones = np.bitwise_count(fps).astype(np.int64)
    across, found = len(np.unique(side)) > 1, Forest(len(fps))
    for a in range(0, len(fps), tile):
        x = fps[a : a + tile]
        for b in range(a, len(fps), tile):
            if ones[b] - ones[min(a + tile, len(fps)) - 1] > radius:
                break  # the tiles from here on have only larger population counts
            near = np.bitwise_count(x[:, None] ^ fps[None, b : b + tile]) <= radius
            if across:
                near &= side[a : a + tile, None] != side[None, b : b + tile]
            if sizes is not None:
                p, q = sizes[a : a + tile, None], sizes[None, b : b + tile]
                near &= np.minimum(p, q) >= least * np.maximum(p, q)
            i, j = np.nonzero(near)
            found.link(i + a, j + b)
    child, parent = found.edges()
    return order[child], order[parent]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) among distinct fingerprints `fp` whose components are those of all pairs within the radius."""
    blocks, width = radius + 1, 64 // (radius + 1)
    total = prints.count()
    bits = min(width, max(0, (max(total, 1) // GROUP).bit_length()))
    block = lambda k: F.shiftrightunsigned("fp", 64 - width * (k + 1)).bitwiseAND(F.lit((1 << width) - 1))
    groups = F.array(*(F.shiftright(block(k), width - bits) + F.lit(k << width) for k in range(blocks)))
    dealt = prints.select("fp", F.explode(groups).alias("g"))
    parts = dealt.groupBy("g").count().select("g", F.ceil(F.col("count") / F.lit(MOST)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("part", q).alias("a"), F.greatest("part", q).alias("b")))
    placed = dealt.join(parts, "g").withColumn("part", part).select("fp", "g", "part", F.explode(pairs).alias("p"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fps = group["fp"].to_numpy(np.int64)
        u, v = forest(fps.view(np.uint64), group["side"].to_numpy(), radius)
        return pd.DataFrame({"u": fps[u], "v": fps[v]})

    return placed.select("fp", "g", "p.a", "p.b", (F.col("part") == F.col("p.b")).cast("int").alias("side")).groupBy("g", "a", "b").applyInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, **options) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of `docs`."""
    return grouped(checkpoint(fingerprints(docs, **options)), radius)


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, name, size, fp, keys) of rows (id, name, text): fingerprints of the different shingles, and the blocks of each text."""
    schema = pa.schema([("id", pa.int64()), ("name", pa.binary()), ("size", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            starts, hashes = likeness.shingles(batch.column("text"), shingle)
            keys = likeness.bands(starts, hashes)
            yield columns(schema, id=batch.column("id"), name=batch.column("name"), size=np.diff(starts), fp=majority(hashes, starts[:-1], np.diff(starts)).view(np.int64), keys=likeness.lists(np.arange(len(keys) + 1) * keys.shape[1], keys.ravel()))

    return texts.select("id", "name", "text").mapInArrow(run, "id long, name binary, size long, fp long, keys array<long>")


def near_in_task(table: pa.Table, radius: int, least: float) -> pa.Table:
    """Edges (u, v) of a spanning forest of the pairs that share a group and lie within the radius; small groups are compared all at once."""
    fps = table.column("fp").to_numpy().view(np.uint64)
    order = np.lexsort((np.bitwise_count(fps), table.column("g").to_numpy()))
    g, size, side, node = (table.column(c).to_numpy()[order] for c in ("g", "size", "side", "node"))
    fps = fps[order]
    ids, at = np.unique(node, return_inverse=True)
    found = Forest(len(ids))
    runs = np.array(list(bounds(g)), np.int64).reshape(-1, 2)
    small = np.repeat(runs[:, 1] - runs[:, 0] <= FEW, runs[:, 1] - runs[:, 0])
    for k in range(1, FEW):
        i = np.flatnonzero(small[:-k] & (g[:-k] == g[k:])) if len(g) > k else np.empty(0, np.int64)
        if not len(i):
            break
        j = i + k
        near = (np.bitwise_count(fps[i] ^ fps[j]) <= radius) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j])) & ((side[i] != side[j]) | (table.column("a")[0].as_py() == table.column("b")[0].as_py()))
        found.link(at[i[near]], at[j[near]])
    for a, z in runs[runs[:, 1] - runs[:, 0] > FEW].tolist():
        i, j = forest(fps[a:z], side[a:z], radius, sizes=size[a:z], least=least)
        found.link(at[a + i], at[a + j])
    child, parent = found.edges()
    return pa.table({"u": ids[child], "v": ids[parent]})


def alike(nodes: DataFrame, texts: DataFrame, least: float, radius: int, shingle: int) -> DataFrame:
    """Edges (u, v) among rows (node, name, id, size, fp, keys), whose components are those of all pairs alike to `least` that share a block.

    In each block fingerprints are compared by tiles. What hangs together by that is a group whose shingles are read and compared; a
    text is in one such group only, and neither step returns more than a forest.
    """
    placed = nodes.select(F.explode("keys").alias("g"), "node", "size", "fp")
    dealt = deal(placed, F.lit(1), most=MOST, per_task=4 * MOST)
    near = dealt.groupBy(*TASK).applyInArrow(lambda t: near_in_task(t, radius, least), "u long, v long")
    groups = checkpoint(components(near).distinct().join(nodes.select("node", "name", "id", "size", "fp"), "node"))
    read = texts.join(groups.select("node", "name", "id", F.col("root").alias("g"), "size", "fp"), ["name", "id"]).dropDuplicates(["node"])  # one copy of each text is read
    sets = checkpoint(likeness.shingle_sets(read, shingle))
    return deal(sets, F.col("size"), most=PART_SHINGLES, per_task=2 * PART_SHINGLES).groupBy(*TASK).applyInArrow(lambda t: likeness.alike_in_task(t, least, radius), "u long, v long")


def deduplicate(docs: DataFrame, *, text: str = "text", least: float = likeness.LEAST, radius: int = WIDE_RADIUS, shingle: int = likeness.SHINGLE) -> DataFrame:
    """One row of each group of texts alike to `least`, that with the least id (null last), then the least name of its text; all columns stay."""
    ident, at = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), name_of(F.col(text).cast("string"))
    texts = docs.select(ident.alias("id"), at.alias("name"), F.col(text).cast("string").alias("text"))
    named = checkpoint(sketches(texts, shingle)).groupBy("name").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("size", "fp", "keys")))
    nodes = checkpoint(named.withColumn("node", F.monotonically_increasing_id()))  # numbers that stand for names from here on, fixed as they are written
    roots = nodes.select("node", "name", "id").join(components(alike(nodes, texts, least, radius, shingle)), "node", "left")
    best = roots.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("id", "name")).alias("b")).select(F.col("b.id").alias("__id"), F.col("b.name").alias("__at"))
    rows = docs.withColumn("__id", ident).withColumn("__at", at)
    return rows.join(best, ["__id", "__at"], "left_semi").dropDuplicates(["__id", "__at"]).drop("__id", "__at")


def grouped(prints: DataFrame, radius: int) -> DataFrame:
    """The rows (doc_id, fp) with their fingerprint in hexadecimal digits and the least id of their component."""
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
