"""Cross-tokenizer alignment by an event sweep.

Two tokenizers cut the same bytes (a space and the text). Every token is an event at the byte where it ends. A task that reads texts
emits the events of both tokenizers, in blocks of BLOCK bytes of text: a row is what one tokenizer ends in one block. The rows of both
are repartitioned by document and sorted by block within partitions, and a sweep streams through them. Where both tokenizers end, a group
closes; what hasn't closed yet is all that the sweep holds besides its counters, so a document of any length takes the memory of a block.
Each place where either ends is one link: the tokens that cover the byte before it.

How many documents hold an id pair linked is counted over the corpus, each task's pairs being added up before the shuffle. The counts go
back to the documents as one broadcast while they are at most MOST_PAIRS, and beyond that by a join that Spark may split where it is skewed.

Tokenizers work on chunks that start at a space after something that isn't white space. Neither joins characters over such a place
(checked against the vocabulary of pieces as it is loaded), so a distinct chunk is encoded once for as long as the cache holds it.

Defined results: a null or empty text, and one whose joined token bytes differ from space and text, has no tokens: zeros and an empty
digest; repeated rows are documents of their own and count once each; a null id is kept; an empty table gives an empty result; other
columns are ignored. Links with equal counts are all best.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import columns, partitions, shared_folder, slices

#: Bytes of text in a block; entries of a worker's cache of chunks, past which it starts anew.
BLOCK, CACHE = 1 << 18, 250_000
#: Up to so many counted pairs they are sent to all tasks (some 100 MB); pairs that a counting task holds before it adds them up.
MOST_PAIRS, HELD = 4_000_000, 4_000_000
#: Characters of new chunks that are encoded in one call.
TOGETHER = 1 << 14
#: Fixed value: how byte-level vocabularies part a text before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word that ends so doesn't end a chunk.
OPEN_END = r"(^|[\s\v\x{1c}-\x{1f}\x{85}\p{Z}])$"

EVENTS = "row binary, doc_id long, block int, side int, ids binary"
SWEPT = "row binary, doc_id long, n_a long, n_b long, n_groups long, n_links long, pairs binary, times binary, groups_sha256 string"
GROUPS = "row binary, doc_id long, first_byte long, end_byte long, a_ids array<int>, b_ids array<int>"


@functools.cache
def _zstandard():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned numbers as bytes, those of one rank next to each other, compressed."""
    return _zstandard()[0].compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(_zstandard()[1].decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ChunkIds:
    """Ids of chunks by one tokenizer, with the bytes of each id; it encodes a chunk with a space before it."""

    def __init__(self, encode: Callable[[str], list[int]], spelled: list[bytes], most: int = CACHE):
        self.encode, self.spelled, self.most = encode, spelled, most
        self.sizes = np.array([len(x) for x in spelled], np.int64)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 18, np.uint32), 0
        self.starts, self.lengths, self.whole = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64), np.empty(1 << 16, bool)

    def add(self, chunks: list[str]) -> None:
        """Encode new chunks: many at once where the bytes tell each chunk's ids apart, else one by one."""
        size, run = 0, []
        for k, c in enumerate(chunks):
            run.append(c)
            size += len(c)
            if size >= TOGETHER or k + 1 == len(chunks):
                ids = np.array(self.encode(" ".join(run)), np.uint32)
                ends = np.cumsum(np.fromiter((1 + len(c.encode()) for c in run), np.int64, len(run)))
                reached = np.cumsum(self.sizes[ids])
                cuts = np.minimum(np.searchsorted(reached, ends), max(0, len(ids) - 1))
                if len(ids) and np.array_equal(reached[cuts], ends) and b"".join(map(self.spelled.__getitem__, ids.tolist())) == b" " + " ".join(run).encode():
                    self.keep(run, ids, np.diff(cuts, prepend=-1), np.ones(len(run), bool))
                else:
                    self.one_by_one(run)
                size, run = 0, []

    def one_by_one(self, chunks: list[str]) -> None:
        found, spell = [self.encode(c) for c in chunks], self.spelled.__getitem__
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.keep(chunks, np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())), lengths, np.array([b"".join(map(spell, x)) == b" " + c.encode() for x, c in zip(found, chunks)], bool))

    def keep(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray, whole: np.ndarray) -> None:
        n, total = len(self.index), len(ids)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + len(chunks) > len(self.starts):
            self.starts, self.lengths, self.whole = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths, self.whole))
        self.ids[self.used : self.used + total] = ids
        self.starts[n : n + len(chunks)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(chunks)] = lengths
        self.whole[n : n + len(chunks)] = whole
        self.index.update(zip(chunks, range(n, n + len(chunks))))
        self.used += total

    def of(self, chunks: list[str], codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of texts that are runs of chunks, each text's start among them, and whether a text's ids spell all its bytes."""
        if len(self.index) > self.most:
            self.clear()
        if missing := [c for c in chunks if c not in self.index]:
            open_ = pc.match_substring_regex(pa.array(missing, pa.string()), OPEN_END).to_pylist()
            self.add([c for c, x in zip(missing, open_) if not x])
            self.one_by_one([c for c, x in zip(missing, open_) if x])
        place = np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks))[codes]
        lengths = self.lengths[place]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(self.starts[place] - ends[:-1], lengths) + np.arange(ends[-1])]
        bad = np.concatenate([[0], np.cumsum(~self.whole[place])])
        return ids, ends[starts], bad[starts[1:]] == bad[starts[:-1]]


def byte_tokenizer(path: str) -> ChunkIds:
    """A byte-level vocabulary, encoded by its merges' ranks."""
    import tiktoken
    from tokenizers import Tokenizer

    byte, parts = byte_level(), json.loads(open(path, encoding="utf-8").read())
    vocabulary = Tokenizer.from_file(path).get_vocab()
    spelled = [b""] * (1 + max(vocabulary.values()))
    for token, i in vocabulary.items():
        spelled[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    special = {x["id"] for x in parts["added_tokens"]}
    merged = [parts["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in parts["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError("the ids of merges don't follow their ranks")
    model = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks={x: i for i, x in enumerate(spelled) if i not in special and x}, special_tokens={})
    return ChunkIds(lambda chunk: model.encode_ordinary(" " + chunk), spelled)


def piece_tokenizer(path: str) -> ChunkIds:
    """A vocabulary of pieces that puts a space before what it encodes."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError("a piece goes on over a space, so chunks can't be encoded by themselves")
    spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    space = [model.piece_to_id("▁")]  # encoding nothing gives no id, not even the space's
    return ChunkIds(lambda chunk: model.encode(chunk) or space, spelled)


_loaded: dict[tuple[str, str], tuple[ChunkIds, ChunkIds]] = {}


def tokenizers_of(paths: tuple[str, str]) -> tuple[ChunkIds, ChunkIds]:
    if paths not in _loaded:
        _loaded[paths] = byte_tokenizer(paths[0]), piece_tokenizer(paths[1])
    return _loaded[paths]


def chunks_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each text's chunks start (one more entry than texts), and the chunks of all texts without the space before each."""
    lists = pc.split_pattern(texts, " ")
    words, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts -= starts[0]
    first = np.ones(len(words), bool)
    first[1:] = ~pc.match_substring_regex(words, OPEN_END).to_numpy(zero_copy_only=False)[:-1]
    first[starts[:-1][starts[:-1] < len(words)]] = True
    if first.all():
        return starts, words
    at = np.append(np.flatnonzero(first), len(words))
    return np.searchsorted(at, starts), pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), words), " ")


def events(docs: DataFrame, paths: tuple[str, str], *, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(row, doc_id, block, side, ids): the ids that end in a block, side 0 for the first tokenizer; block -1 tells of a row without tokens.

    row names the row of `docs`: by id and text, the task's partition and a count of the task's equal rows, so equal rows stay apart
    and a task that is run again names them as before.
    """
    schema = pa.schema([("row", pa.binary()), ("doc_id", pa.int64()), ("block", pa.int32()), ("side", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, part, met = tokenizers_of(paths), TaskContext.get().partitionId(), {}
        for batch in slices(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            starts, chunks = chunks_of(texts)
            coded = chunks.dictionary_encode()
            told = [x.of(coded.dictionary.to_pylist(), coded.indices.to_numpy(), starts) for x in sides]
            whole = told[0][2] & told[1][2] & (pc.binary_length(texts).to_numpy() > 0)
            out: list[tuple] = []
            for k, (doc, body) in enumerate(zip(batch.column("doc_id").to_pylist(), texts.to_pylist())):
                own = hashlib.md5(f"{doc}:".encode() + body.encode()).digest()
                met[own] = seen = met.get(own, 0) + 1
                row = hashlib.md5(own + b"%d:%d" % (part, seen)).digest()
                if not whole[k]:
                    out.append((row, doc, -1, 0, b""))
                    continue
                for side, (tokenizer, (ids, at, _)) in enumerate(zip(sides, told)):
                    mine = ids[at[k] : at[k + 1]]
                    blocks = (np.cumsum(tokenizer.sizes[mine]) - 1) // block
                    cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(mine)]
                    out += ((row, doc, int(blocks[a]), side, squeeze(mine[a:b])) for a, b in zip(cuts, cuts[1:]))
            yield columns(schema, **dict(zip(schema.names, map(list, zip(*out)))))

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, EVENTS)


@dataclass
class Closed:
    """Whole groups: the ids of both tokenizers, where the first one's end, which of the second covers each end, and who ends a group."""

    a: np.ndarray
    b: np.ndarray
    ends: np.ndarray
    over: np.ndarray
    in_a: np.ndarray
    in_b: np.ndarray

    def links(self) -> np.ndarray:
        """The id pair of each link, the first tokenizer's id in the upper half: one where each token ends, common ends counted once."""
        high = self.a.astype(np.uint64) << np.uint64(32)
        under = np.cumsum(np.bincount(self.over, minlength=len(self.b)))  # how many of the first end before or with each of the second
        return np.concatenate([high | self.b[self.over], high[under[~self.in_b]] | self.b[~self.in_b]])


class Sweep:
    """One document's tokens that no common end has closed yet, with the byte where each ends."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray]):
        self.sizes = sizes
        self.ids = [np.empty(0, np.uint32), np.empty(0, np.uint32)]
        self.ends = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.at = [0, 0]

    def add(self, side: int, ids: np.ndarray) -> None:
        ends = self.at[side] + np.cumsum(self.sizes[side][ids])
        self.at[side] = int(ends[-1]) if len(ends) else self.at[side]
        self.ids[side] = np.concatenate([self.ids[side], ids]) if len(self.ids[side]) else ids
        self.ends[side] = np.concatenate([self.ends[side], ends]) if len(self.ends[side]) else ends

    def close(self) -> Closed | None:
        """What lies before the last common end."""
        (a, b), (x, y) = self.ids, self.ends
        if not len(x) or not len(y):
            return None
        over = np.searchsorted(y, x)  # for each token of the first, the one of the second that covers its last byte
        in_a = y[np.minimum(over, len(y) - 1)] == x
        i = len(x) - int(np.argmax(in_a[::-1])) if in_a.any() else 0
        if not i:
            return None
        j = int(over[i - 1]) + 1
        self.ids, self.ends = [a[i:], b[j:]], [x[i:], y[j:]]
        over, in_a, in_b = over[:i], in_a[:i], np.zeros(j, bool)
        in_b[over[in_a]] = True
        return Closed(a[:i], b[:j], x[:i], over, in_a, in_b)


def sweep(batches: Iterator[pa.RecordBatch], sizes: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple]:
    """(row, doc_id, what closed or None, whether the document ends) in the order of the events."""
    now: tuple | None = None
    state = Sweep(sizes)
    for batch in batches:
        for row, doc, block, side, ids in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "block", "side", "ids"))):
            if now is None or row != now[0]:
                if now:
                    yield *now, state.close(), True
                now, state = (row, doc), Sweep(sizes)
            if block >= 0:
                state.add(side, unsqueeze(ids, np.uint32))
                if side and block and (closed := state.close()):
                    yield *now, closed, False
    if now:
        yield *now, state.close(), True


class Notation:
    """Groups as text: ids in order, `,` within a tokenizer's, `|` between the two and `;` between groups."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray]):
        self.first = 2 * len(sizes[0])
        self.words = np.array([b"%d%c" % (i, sep) for n, last in ((len(sizes[0]), b"|"), (len(sizes[1]), b";")) for i in range(n) for sep in (b",", last)])

    def __call__(self, c: Closed) -> bytes:
        """With a `;` at the end."""
        before = lambda ends: np.concatenate([[0], np.flatnonzero(ends) + 1])  # noqa: E731  tokens in the groups before each
        codes = np.empty(len(c.a) + len(c.b), np.int64)
        codes[np.arange(len(c.a)) + before(c.in_b)[np.cumsum(c.in_a) - c.in_a]] = 2 * c.a.astype(np.int64) + c.in_a
        codes[np.arange(len(c.b)) + before(c.in_a)[np.cumsum(c.in_b) - c.in_b + 1]] = self.first + 2 * c.b.astype(np.int64) + c.in_b
        return self.words[codes].tobytes().translate(None, b"\0")


def arranged(docs: DataFrame, paths: tuple[str, str], **options) -> DataFrame:
    """The events of whole documents, each document's together and in the order of its bytes."""
    return events(docs, paths, **options).repartition(partitions(docs.sparkSession), "row").sortWithinPartitions("row", "block", "side")


def groups(docs: DataFrame, paths: tuple[str, str], **options) -> DataFrame:
    """(row, doc_id, first_byte, end_byte, a_ids, b_ids): the groups of each document, in bytes of space and text; row names a row of `docs`."""
    schema = pa.schema([("row", pa.binary()), ("doc_id", pa.int64()), ("first_byte", pa.int64()), ("end_byte", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = 0
        for row, doc, closed, over in sweep(batches, tuple(t.sizes for t in tokenizers_of(paths))):
            if closed:
                common = closed.ends[closed.in_a]
                cut = lambda ids, ends: pa.ListArray.from_arrays(pa.array(np.append(0, np.flatnonzero(ends) + 1), pa.int32()), pa.array(ids.astype(np.int32)))
                yield columns(schema, row=[row] * len(common), doc_id=[doc] * len(common), first_byte=np.append(begin, common[:-1]), end_byte=common, a_ids=cut(closed.a, closed.in_a), b_ids=cut(closed.b, closed.in_b))
                begin = int(common[-1])
            begin = 0 if over else begin

    return arranged(docs, paths, **options).mapInArrow(run, GROUPS)


def swept(docs: DataFrame, paths: tuple[str, str], **options) -> DataFrame:
    """One row per row of `docs`: its counts, its distinct id pairs with how often each is linked, and the digest of its groups."""
    schema = pa.schema([("row", pa.binary()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("pairs", pa.binary()), ("times", pa.binary()), ("groups_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = tuple(t.sizes for t in tokenizers_of(paths))
        notation, out, counts, sha, pairs = Notation(sizes), [], np.zeros(3, np.int64), hashlib.sha256(), []
        for row, doc, closed, over in sweep(batches, sizes):
            if closed:
                sha.update((b";" if counts[2] else b"") + notation(closed)[:-1])
                counts += len(closed.a), len(closed.b), int(closed.in_a.sum())
                pairs.append(np.unique_counts(closed.links()))
            if over:
                held = np.concatenate([p.values for p in pairs]) if pairs else np.empty(0, np.uint64)
                times = np.concatenate([p.counts for p in pairs]) if pairs else np.empty(0, np.int64)
                if len(pairs) > 1:
                    held, place = np.unique(held, return_inverse=True)
                    times = np.bincount(place, times).astype(np.int64)
                out.append((row, doc, *counts.tolist(), int(times.sum()), squeeze(np.diff(held, prepend=np.uint64(0))), squeeze(times.astype(np.uint32)), sha.hexdigest() if counts[2] else ""))
                counts, sha, pairs = np.zeros(3, np.int64), hashlib.sha256(), []
                if len(out) >= 256:
                    yield columns(schema, **dict(zip(schema.names, map(list, zip(*out)))))
                    out = []
        if out:
            yield columns(schema, **dict(zip(schema.names, map(list, zip(*out)))))

    return arranged(docs, paths, **options).mapInArrow(run, SWEPT)


def pairs_in(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each id pair is linked, and whether no pair of its first id is in more."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        known, n = np.empty(0, np.uint64), np.empty(0, np.int64)

        def added() -> tuple[np.ndarray, np.ndarray]:
            new, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            both, place = np.unique(np.concatenate([known, new]), return_inverse=True)
            return both, np.bincount(place, np.concatenate([n, times]), len(both)).astype(np.int64)

        for batch in batches:
            for data in batch.column("pairs").to_pylist():
                held.append(pairs_in(data))
                size += len(held[-1])
                if size >= HELD:
                    known, n = added()
                    held, size = [], 0
                    if len(known) >= HELD:
                        yield columns(schema, pair=known.view(np.int64), n=n)
                        known, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        known, n = added()
        yield columns(schema, pair=known.view(np.int64), n=n)

    counted = rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    most = counted.groupBy(F.shiftrightunsigned("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return counted.join(most, F.shiftrightunsigned("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def shares(rows: DataFrame, counts: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """`rows` with n_best, the links whose pair is best, and count_sum, the counts of all links added up."""
    told = [c for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
    if counts.count() <= most:
        table = counts.toArrow()  # at most `most` rows
        order = np.argsort(table.column("pair").to_numpy().view(np.uint64))
        shared = rows.sparkSession.sparkContext.broadcast((table.column("pair").to_numpy().view(np.uint64)[order], table.column("n").to_numpy()[order], table.column("best").to_numpy()[order]))
        schema = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs, n, best = shared.value
            for batch in batches:
                n_best, total = [], []
                for data, often in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                    at, times = np.searchsorted(pairs, pairs_in(data)), unsqueeze(often, np.uint32).astype(np.int64)
                    n_best.append(int(times[best[at]].sum()))
                    total.append(int((times * n[at]).sum()))
                yield columns(schema, **{c: batch.column(c) for c in told}, n_best=n_best, count_sum=total)

        return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    flat = pa.schema([("row", pa.binary()), ("pair", pa.int64()), ("times", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, often in zip(*(batch.column(c).to_pylist() for c in ("row", "pairs", "times"))):
                pairs = pairs_in(data)
                yield columns(flat, row=[row] * len(pairs), pair=pairs.view(np.int64), times=unsqueeze(often, np.uint32).astype(np.int64))

    linked = rows.select("row", "pairs", "times").mapInArrow(spread, "row binary, pair long, times long").join(counts, "pair")
    sums = linked.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.select("row", *told).join(sums, "row", "left").select(*told, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")))


def report(docs: DataFrame, paths: tuple[str, str], *, most: int = MOST_PAIRS, **options) -> DataFrame:
    """One row per row of `docs`: what the two tokenizers share there, and how usual its links are in the whole table."""
    spark = docs.sparkSession
    place = shared_folder(spark)
    swept(docs, paths, **options).write.parquet(f"{place}/swept")
    rows = spark.read.parquet(f"{place}/swept")
    pair_counts(rows).write.parquet(f"{place}/counts")
    return shares(rows, spark.read.parquet(f"{place}/counts"), most)
