"""Document fingerprints by randomised edit embedding.

All texts share one random walk: at step j, a text whose next character is c emits c and moves on to the character after it only if the
shared random bit of (c, j) is set. Two texts that differ by few edits fall back into step soon after each, so their emitted strings
differ in few places: edit distance becomes Hamming distance. A fingerprint samples the emitted string at places that all texts share,
SLOTS in the first SLOTS steps and in each octave after them, four hashed bits a place, and keeps the length of the walk. The likeness of
two fingerprints is the share of equal samples, each octave weighing as much as it is long, less what chance makes equal.

Near duplicates come from bands of samples: different fingerprints with equal bands meet, and pairs among them are verified by their
likeness. Between tasks a fingerprint is its end, its number of samples and two samples a byte; only bands that two fingerprints share
are dealt, as rows of numbers, and samples are joined to those alone.

Defined results: a null text counts as empty; the empty text has the fingerprint of an empty walk and is alike (1) only to itself;
equal texts have equal fingerprints; rows are in order of id, null first, then of their texts' names, so repeated rows follow each other
and rows of one id are in a fixed order; the last row's next row is the first, and a single row's next row is itself; an empty table gives an empty result; other columns are ignored. A class is named by its least id; one of null ids alone has a null name.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.blocks import TASK, bounds, deal
from claimloom.llm.common import checkpoint, columns, name_of, partitions, slices
from claimloom.llm.components import components

SLOTS, OCTAVES, PERIOD, CLASSES, SEED = 32, 28, 2048, 64, 1
#: Share of samples that are equal in unlike texts, from hashing to four bits and from the frequencies of letters.
BY_CHANCE = 0.12
#: Samples of a band, drawn from all samples by their weight, and bands for each of the two greatest multiples of STEP samples that a walk
#: has. At the stated likeness a sample agrees with a chance of 0.82 and a band with 0.82^8, so 32 bands all miss with 0.0006, 16 with 0.02.
BAND, BANDS, STEP = 8, 16, 8
LIKENESS = 0.8

_rng = np.random.default_rng(SEED)
_bits = _rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
_bits[:, -1] = 1
#: Steps that a walk takes from (class, step modulo PERIOD) until it has moved past the character.
STEPS = np.stack([(ones := np.flatnonzero(row))[np.searchsorted(ones, np.arange(PERIOD))] - np.arange(PERIOD) + 1 for row in _bits]).astype(np.int32).ravel()
#: The places sampled, ascending, and what each stands for in steps.
PLACES = np.concatenate([np.arange(SLOTS), *(np.sort(_rng.choice(SLOTS << k, SLOTS, replace=False) if k < 16 else np.unique(_rng.integers(0, SLOTS << k, 4 * SLOTS))[::4][:SLOTS]) + (SLOTS << k) for k in range(OCTAVES))]).astype(np.int64)
WEIGHTS = np.concatenate([np.ones(SLOTS), *(np.full(SLOTS, float(1 << k)) for k in range(OCTAVES))])
#: The places of the bands by the number of steps of samples that they are drawn from, made as they are needed.
_places: dict[int, np.ndarray] = {}
#: Lanes below which a walk goes on in plain Python, and steps between two gatherings of characters.
FEW, STRIDE = 40, 256


def char_class(points: np.ndarray) -> np.ndarray:
    return ((points * np.uint32(2654435761)) >> np.uint32(26)).astype(np.int32)


def walk(classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step at which each text's walk reaches each of its characters (in the places of `classes`), and where it ends."""
    reached, ends = np.empty(len(classes), np.int32), begin.astype(np.int32).copy()
    order = np.argsort(-lengths, kind="stable")
    sizes, base = lengths[order], starts[order]
    now, at = begin[order].astype(np.int32), 0
    active = int(np.searchsorted(-sizes, 0, side="left"))
    while active >= FEW:
        wide = min(STRIDE, int(sizes[0]) - at)
        index = np.minimum(base[:active] + at, len(classes) - 1)[None, :] + np.arange(wide)[:, None]
        cells = classes[np.minimum(index, len(classes) - 1)] * PERIOD
        steps = np.empty((wide + 1, active), np.int32)
        steps[0] = now[:active]
        slot, more = np.empty(active, np.int32), np.empty(active, np.int32)
        for t in range(wide):
            np.bitwise_and(steps[t], PERIOD - 1, out=slot)
            slot += cells[t]
            np.take(STEPS, slot, out=more)
            np.add(steps[t], more, out=steps[t + 1])
        left = sizes[:active] - at
        real = np.arange(wide)[:, None] < left[None, :]
        reached[index[real]] = steps[:-1][real]
        now[:active] = steps[np.minimum(left, wide), np.arange(active)]
        ends[order[:active]] = now[:active]
        at += wide
        active = int(np.searchsorted(-sizes, -at, side="left"))
    table = STEPS.reshape(CLASSES, PERIOD).tolist() if active else []
    for lane in range(active):
        j, out, mask = int(now[lane]), [], PERIOD - 1
        for c in classes[base[lane] + at : base[lane] + sizes[lane]].tolist():
            out.append(j)
            j += table[c][j & mask]
        reached[base[lane] + at : base[lane] + sizes[lane]] = out
        ends[order[lane]] = j
    return reached, ends


def sampled(points: np.ndarray, reached: np.ndarray, end: int) -> np.ndarray:
    """The four bits at each place before the walk's end."""
    n = int(np.searchsorted(PLACES, end))
    char = points[np.searchsorted(reached, PLACES[:n], side="right") - 1]
    mixed = (char.astype(np.uint64) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(60)).astype(np.uint8)


def as_text(end: int, samples: np.ndarray) -> str:
    return f"{end:x}-" + "".join("0123456789abcdef"[x] for x in samples)


def from_text(fingerprint: str) -> tuple[int, np.ndarray]:
    end, _, samples = fingerprint.partition("-")
    return int(end, 16), np.array([int(x, 16) for x in samples], np.uint8)


def packed(samples: np.ndarray) -> bytes:
    """Two samples a byte, the first in the upper half."""
    even = np.append(samples, np.zeros(len(samples) % 2, np.uint8))
    return (even[::2] << 4 | even[1::2]).tobytes()


def unpacked(bits: bytes, n: int) -> np.ndarray:
    both = np.frombuffer(bits, np.uint8)
    return np.stack([both >> 4, both & 15], axis=1).ravel()[:n]


def spelled(end: str, n: str, bits: str) -> Column:
    """The string that as_text gives, from the columns of a fingerprint."""
    return F.concat(F.lower(F.hex(end)), F.lit("-"), F.substring(F.lower(F.hex(bits)), F.lit(1), F.col(n)))


def print_name(end: str, n: str, bits: str) -> Column:
    """A fingerprint's name in 96 bits."""
    return name_of(F.concat(F.col(bits), F.concat_ws(":", end, n).cast("binary")))


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """0 to 1: the share of the longer walk on which the two agree, less chance."""
    if a[0] == b[0] and np.array_equal(a[1], b[1]):
        return 1.0
    n, most = min(len(a[1]), len(b[1])), max(len(a[1]), len(b[1]))
    if not n:
        return 0.0
    equal = float(WEIGHTS[:n][a[1][:n] == b[1][:n]].sum() / WEIGHTS[:most].sum())
    return min(1.0, max(0.0, (equal - BY_CHANCE) / (1 - BY_CHANCE)))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprints_of(points: list[np.ndarray], after: list[np.ndarray] | None = None) -> list[tuple[int, np.ndarray]] | list[tuple]:
    """Fingerprints of texts; with `after`, of each text and of its last quarter replaced by as much of `after`, which shares the walk before."""
    lengths = np.array([len(p) for p in points], np.int64)
    starts = np.cumsum(lengths) - lengths
    flat = np.concatenate(points) if len(points) else np.empty(0, np.uint32)
    reached, ends = walk(char_class(flat), starts, lengths, np.zeros(len(points), np.int64))
    own = [(int(e), sampled(p, reached[s : s + n], int(e))) for p, s, n, e in zip(points, starts, lengths, ends)]
    if after is None:
        return own
    kept = lengths - lengths // 4
    tails = [a[: n // 4] for a, n in zip(after, lengths)]
    sizes = np.array([len(t) for t in tails], np.int64)
    places = np.cumsum(sizes) - sizes
    begin = np.array([reached[s + k] if k < n else e for s, k, n, e in zip(starts, kept, lengths, ends)], np.int64)
    more, last = walk(char_class(np.concatenate(tails) if len(tails) else np.empty(0, np.uint32)), places, sizes, begin)
    edited = []
    for p, t, s, k, q, m, e in zip(points, tails, starts, kept, places, sizes, last):
        edited.append((int(e), sampled(np.concatenate([p[:k], t]), np.concatenate([reached[s : s + k], more[q : q + m]]), int(e))))
    return list(zip(own, edited))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(part, guest, doc_id, at, text) in parts that are ranges of ids; each part ends with the row that follows it, marked as a guest.

    `at` is the name of the text, by which rows of one id are in order.
    """
    cuts = [int(c) for c in sorted(set(docs.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)))] if parts > 1 else []
    wide = max(1, math.isqrt(len(cuts)))
    rows = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    below = lambda values: F.size(F.filter(values, lambda c: c <= F.col("doc_id")))
    literal = lambda values: F.array(*(F.lit(c) for c in values))
    row = F.greatest(below(literal([x[0] for x in rows])) - 1, F.lit(0)) if rows else None  # first which row of cuts, then where in it
    part = row * wide + below(F.get(F.array(*map(literal, rows)), row)) if rows else F.lit(0)
    dealt = docs.select(F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(part).alias("part"), "doc_id", name_of(F.col("text")).alias("at"), "text")
    heads = [(r["part"], r["null_"], r["least"]) for r in dealt.groupBy("part").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("null_")).orderBy("part").collect()]  # one row for each part
    if not heads:
        return dealt.select("part", F.lit(False).alias("guest"), "doc_id", "at", "text")
    table = docs.sparkSession.createDataFrame([(heads[i - 1][0], None if null_ else least) for i, (_, null_, least) in enumerate(heads)], "part int, head long")
    headed = docs.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("head")))
    first = headed.groupBy("part", "doc_id").agg(F.min(F.struct(name_of(F.col("text")).alias("at"), "text")).alias("least"))
    return dealt.select("part", F.lit(False).alias("guest"), "doc_id", "at", "text").union(first.select("part", F.lit(True), "doc_id", "least.at", "least.text"))


def zipped(rows: DataFrame) -> DataFrame:
    """The rows of with_next with zstandard frames in place of texts, which take some two thirds of the room in a shuffle."""
    schema = pa.schema([("part", pa.int32()), ("guest", pa.bool_()), ("doc_id", pa.int64()), ("at", pa.binary()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor().compress
        for batch in slices(batches, "text", 4 << 20):
            frames = [squeeze(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield columns(schema, **{c: batch.column(c) for c in ("part", "guest", "doc_id", "at")}, text=frames)

    return rows.mapInArrow(run, "part int, guest boolean, doc_id long, at binary, text binary")


def unzipped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows (part, guest, doc_id, text) in runs of some `most` bytes of text each; a longer text is a run of its own."""
    import zstandard

    unpack, rows, held = zstandard.ZstdDecompressor().decompress, [], 0
    for batch in batches:
        for part, guest, doc, frame in zip(*(batch.column(c) for c in ("part", "guest", "doc_id", "text"))):
            text = unpack(frame.as_py())
            if rows and held + len(text) > most:
                yield rows
                rows, held = [], 0
            rows.append((part.as_py(), guest.as_py(), doc.as_py(), text.decode()))
            held += len(text)
    if rows:
        yield rows




PACKED = pa.schema([("doc_id", pa.int64()), ("end", pa.int64()), ("n", pa.int32()), ("bits", pa.binary())])
OUT = """doc_id long, n_chars long, sha binary, end long, n int, bits binary, edited_end long, edited_n int, edited_bits binary,
near_edited double, near_next double, edited_bands int, next_bands int, edited_near boolean, next_near boolean"""


def edit_report(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text, its likeness to that and to the next row's, and the class of its near duplicates.

    The edited text and the next row are also put to the banding: how many bands of samples they share with the row's own, and whether they
    are near duplicates of it, which takes a shared band and a likeness of LIKENESS or more. `class_id` is the class over all rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = partitions(docs.sparkSession)
    dealt = zipped(with_next(rows, 4 * parts)).repartition(parts, "part").sortWithinPartitions("part", "guest", "doc_id", "at")
    numbers = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(name, numbers[kind]) for name, kind in (column.split() for column in OUT.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows whose next row hasn't come

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            """All rows but the last, and none that are guests."""
            points = [code_points(r[3]) for r in rows]
            pairs = fingerprints_of(points, points[1:] + points[-1:])
            keys, out = [band_keys(own[1]) for own, _ in pairs], []
            for r, nxt, (own, edited), (other, _), key, other_key in zip(rows, rows[1:], pairs, pairs[1:], keys, keys[1:]):
                if not r[1]:
                    like = likeness(own, edited), likeness(own, other)
                    shared = shared_bands(key, band_keys(edited[1])), shared_bands(key, other_key)
                    n = len(r[3])
                    sha = hashlib.sha256((r[3][: n - n // 4] + nxt[3][: n // 4]).encode("utf-8", "surrogatepass")).digest()
                    prints = [x for end, samples in (own, edited) for x in (end, len(samples), packed(samples))]
                    out.append((r[2], n, sha, *prints, *like, *shared, *(bool(n and x >= LIKENESS) for n, x in zip(shared, like))))
            return columns(schema, **dict(zip(schema.names, map(list, zip(*out)) if out else [[]] * len(schema))))

        for run_ in unzipped(batches, 4 << 20):
            rows = held + run_
            if len(rows) > 1:
                yield emit(rows)
            held = rows[-1:]

    report = dealt.mapInArrow(run, OUT).withColumn("h", print_name("end", "n", "bits")).join(classes(prints_of(rows)), "h")
    prints = spelled("end", "n", "bits").alias("fingerprint"), spelled("edited_end", "edited_n", "edited_bits").alias("edited_fingerprint")
    likes = "near_edited", "near_next", "edited_bands", "next_bands", "edited_near", "next_near", "class_id"
    return report.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), *prints, *likes)


def prints_of(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, text) with the columns of their fingerprints in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            found = fingerprints_of([code_points(t or "") for t in batch.column("text").to_pylist()])
            ends, samples = [end for end, _ in found], [x for _, x in found]
            yield columns(PACKED, doc_id=batch.column("doc_id"), end=ends, n=list(map(len, samples)), bits=list(map(packed, samples)))

    return rows.mapInArrow(run, "doc_id long, end long, n int, bits binary")


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return prints_of(rows).select("doc_id", spelled("end", "n", "bits").alias("fingerprint"))


def band_keys(samples: np.ndarray) -> np.ndarray:
    """The keys of a fingerprint's bands, of which what they cover is part; a walk of fewer samples than a step has one key for all."""
    step = len(samples) // STEP
    if not step:
        return np.array([zlib.crc32(samples.tobytes(), len(samples))], np.int64)
    out = []
    for top in range(step, max(0, step - 2), -1):
        if top not in _places:
            share = WEIGHTS[: top * STEP] / WEIGHTS[: top * STEP].sum()
            rng = np.random.default_rng((SEED, top))
            _places[top] = np.stack([rng.choice(top * STEP, BAND, replace=False, p=share) for _ in range(BANDS)])
        packed = (samples[_places[top]].astype(np.uint64) << (np.arange(BAND, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)
        out.append((packed + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(top << 40)) * np.uint64(0xD6E8FEB86659FD93))
    return np.concatenate(out).view(np.int64)


def shared_bands(a: np.ndarray, b: np.ndarray) -> int:
    """How many bands of two fingerprints have equal keys."""
    return len(set(a.tolist()) & set(b.tolist()))


def alike_in_task(table: pa.Table, least: float) -> pa.Table:
    """Edges (u, v) of a spanning forest of the pairs of each group whose fingerprints reach the likeness."""
    table = table.take(pa.array(np.argsort(table.column("g").to_numpy(), kind="stable")))
    g, node, side = (table.column(c).to_numpy() for c in ("g", "node", "side"))
    rows = [unpacked(*x) for x in zip(table.column("bits").to_pylist(), table.column("n").to_pylist())]
    grid = np.full((len(rows), max(map(len, rows), default=0)), 16, np.uint8)
    for i, x in enumerate(rows):
        grid[i, : len(x)] = x
    own, root = np.array([WEIGHTS[: len(x)].sum() for x in rows]), np.arange(len(rows))
    u: list[int] = []
    v: list[int] = []
    for a, z in bounds(g):
        across = side[a:z].any()
        for i in range(a, z):
            j = np.arange(a if across else i + 1, z)
            j = j[(root[j] != root[i]) & ((side[j] == 1) | (not across))]
            if (across and side[i]) or not len(j):
                continue
            equal = ((grid[j] == grid[i]) & (grid[j] < 16)) @ WEIGHTS[: grid.shape[1]]
            like = j[(equal / np.maximum(own[j], own[i]) - BY_CHANCE) / (1 - BY_CHANCE) >= least]
            for k in like[np.unique(root[like], return_index=True)[1]]:
                u.append(i)
                v.append(k)
                part = root[a:z]
                part[part == root[k]] = root[i]
    return pa.table({"u": node[np.array(u, np.int64)], "v": node[np.array(v, np.int64)]})


def classes(prints: DataFrame, *, likeness_of: float = LIKENESS, most: int = 4096) -> DataFrame:
    """(h, class_id) of each different fingerprint of the rows (doc_id, end, n, bits), h its name.

    Fingerprints that share a band and reach the likeness, and what is linked through them, are a class. They get numbers, and a row for
    the shuffle is a band's key and a number; bands of one fingerprint alone go no further than their count.
    """
    named = prints.withColumn("h", print_name("end", "n", "bits"))
    distinct = named.groupBy("h").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = checkpoint(distinct.withColumn("node", F.monotonically_increasing_id()))  # numbers that are fixed as they are written
    schema = pa.schema([("node", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = map(unpacked, batch.column("bits").to_pylist(), batch.column("n").to_pylist())
            yield columns(schema, node=batch.column("node"), keys=[band_keys(x) for x in samples])

    banded = nodes.select("node", "n", "bits").mapInArrow(cut, "node long, keys array<long>").select(F.explode("keys").alias("g"), "node")
    met = deal(banded, F.lit(1), most=most, per_task=4 * most).join(nodes.select("node", "n", "bits"), "node")
    edges = met.groupBy(*TASK).applyInArrow(lambda t: alike_in_task(t, likeness_of), "u long, v long")
    rooted = nodes.select("node", "h", "least").join(components(edges), "node", "left").select("h", "least", F.coalesce("root", "node").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("h", "class_id")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, class_id), a row for each of `docs`; equal texts are of one class."""
    prints = prints_of(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    return prints.select("doc_id", print_name("end", "n", "bits").alias("h")).join(classes(prints, **options), "h").select("doc_id", "class_id")
