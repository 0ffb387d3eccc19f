"""Substring deduplication with a compressed full-text index for each shard.

Every window of `window` words hashes its grams of GRAM words, and the least hash is the window's anchor. Equal windows have equal
anchors, so the corpus can be sharded by anchor: a run of windows of one text with the same anchor, a segment, goes to its anchor's
shard with its words, and no window has an equal anywhere else. Anchors met once can't hold a repeated window and stay behind; equal
segments are one with a count. Each shard builds an FM-index over its segments and streams them through it by backward search; the
matching statistics, cut at the window, tell how often each window occurs, and windows that occur twice or more come back as bits.
An anchor whose segments hold more than `SHARD_WORDS` words is dealt into parts, each with an index of its own; the segments of each
part are streamed through the indexes of all others too, and a window found there or twice at home is repeated.

Defined results: a null or empty text has no words and nothing is removed; repeated rows repeat each other's windows; a null id is
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.blocks import TASK, place
from claimloom.llm.common import checkpoint, columns, partitions, slices, words_of
from claimloom.llm.fm_index import FMIndex

WINDOW, GRAM = 35, 8
#: What names a row: its id (for a null id a hash of the text), and another hash of the text, for ids that several texts have.
ROW = ["rid", "tid"]
#: Words that a shard holds, about, and past which an anchor is dealt into parts.
SHARD_WORDS = 400_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Base of the hashes of word sequences, odd so that it has an inverse modulo 2**64.
_BASE = 0xD6E8FEB86659FD93


def word_hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    coded = words.dictionary_encode()
    each = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return each[coded.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Sequences:
    """Hashes of any stretch of words, from running sums."""

    def __init__(self, hashes: np.ndarray, base: int = _BASE):
        n = len(hashes)
        powers = np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]).cumprod(dtype=np.uint64)
        self.inverse = np.concatenate([[np.uint64(1)], np.full(n, pow(base, -1, 1 << 64), np.uint64)]).cumprod(dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes ^ np.uint64(base)) * powers[:n], dtype=np.uint64)])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64) * _ODD)


def segments_of(hashes: np.ndarray, starts: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor, hash of the words) of each segment; starts as from words_of."""
    n = np.maximum(np.diff(starts) - window + 1, 0)
    if not n.sum():
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    for k in range(gram):
        grams = (grams ^ hashes[k : k + len(grams)]) * _ODD
        grams ^= grams >> np.uint64(29)
    place = (1 << 28) - 1  # a slice holds fewer words
    least = (mixed(grams) & ~np.uint64(place)) | np.arange(len(grams), dtype=np.uint64)
    need, have = window - gram + 1, 1
    while have < need:
        by = min(have, need - have)
        least = np.minimum(least[:-by], least[by:])
        have += by
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[:-1], n)
    anchor = (least[at] & np.uint64(place)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.append(first, len(at)))
    begin = at[first]
    return doc[first], begin - starts[doc[first]], count, grams[anchor[first]], Sequences(hashes)(begin, begin + count + window - 1)


def _segments(rows: DataFrame) -> DataFrame:
    """(rid, tid, i, n, key, seg): all segments of the texts."""
    schema = pa.schema([("rid", pa.int64()), ("tid", pa.int32()), ("i", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("seg", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            starts, words = words_of(batch.column("text"))
            doc, i, n, key, seg = segments_of(word_hashes(words), starts)
            yield columns(schema, **{c: batch.column(c).take(pa.array(doc)) for c in ROW}, i=i, n=n, key=key.view(np.int64), seg=seg.view(np.int64))

    return rows.select(*ROW, "text").mapInArrow(run, "rid long, tid int, i int, n int, key long, seg long")


def _words(asked: DataFrame) -> DataFrame:
    """(key, seg, many, parts, words) for each segment asked of a text: its words, joined by spaces."""
    schema = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("many", pa.bool_()), ("parts", pa.int32()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            out: list[tuple] = []
            for text, want in zip(batch.column("text").to_pylist(), batch.column("want").to_pylist()):
                words = words_of(pa.array([text], pa.string()))[1].to_pylist()
                out += ((w["key"], w["seg"], w["many"], w["parts"], " ".join(words[w["i"] : w["i"] + w["n"] + WINDOW - 1])) for w in want)
            yield columns(schema, **dict(zip(schema.names, map(list, zip(*out)) if out else [[]] * len(schema))))

    return asked.select("text", "want").mapInArrow(run, "key long, seg long, many boolean, parts int, words string")


def occurrences(codes: np.ndarray, starts: np.ndarray, indexed: np.ndarray, streamed: np.ndarray) -> np.ndarray:
    """How often the window at each place of `codes` occurs in the indexed texts, for places of the streamed ones."""
    lengths, out = np.diff(starts), np.zeros(len(codes), np.int64)
    inside = np.repeat(indexed, lengths)
    dense = np.full(int(codes.max(initial=0)) + 1, -1, np.int64)
    known = np.unique(codes[inside])
    dense[known] = np.arange(1, len(known) + 1)
    own = lengths[indexed]
    joined = np.zeros(int(own.sum()) + len(own) + 1, np.int64)  # a 0 after each text, and one at the front
    joined[np.arange(own.sum()) + np.repeat(np.arange(len(own)), own) + 1] = dense[codes[inside]]
    if streamed.any() and len(own):
        out = FMIndex(joined, WINDOW).matches(dense[codes], starts[:-1][streamed], lengths[streamed])
    return out


def search_shard(table: pa.Table) -> pa.Table:
    """(key, seg, mask) of a shard: for segments that are met once, a bit for each window that occurs twice or more."""
    starts, words = words_of(table.column("words").combine_chunks())
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    lengths, own, side = np.diff(starts), ~table.column("many").to_numpy(), table.column("side").to_numpy() == 1
    if side.any():  # two parts of one anchor, each searched in the other
        twice = (occurrences(codes, starts, side, own & ~side) > 0) | (occurrences(codes, starts, ~side, own & side) > 0)
    else:
        twice = occurrences(codes, starts, np.ones(len(own), bool), own) >= 2
    masks = np.zeros(len(lengths), np.int64)
    for k in range(WINDOW - GRAM + 1):
        has = lengths >= WINDOW + k
        masks[has] |= twice[starts[:-1][has] + k].astype(np.int64) << k
    keep = own & (masks > 0)
    return pa.table({"key": table.column("g").filter(pa.array(keep)), "seg": table.column("node").filter(pa.array(keep)), "mask": pa.array(masks[keep].astype(np.int32))})


def repeated_segments(rows: DataFrame) -> DataFrame:
    """(rid, tid, i, mask): segments with windows that occur twice or more in the corpus, with a bit for each such window."""
    spark = rows.sparkSession
    segments = _segments(rows)
    shared = checkpoint(segments.groupBy("key").count().where("count > 1").select("key"))  # else the join couldn't split a hot anchor
    met = checkpoint(segments.join(shared, "key", "left_semi"))
    distinct = met.groupBy("key", "seg").agg(F.count("*").alias("times"), F.min(F.struct(*ROW, "i", "n")).alias("where"))
    distinct = checkpoint(distinct.select("key", "seg", "times", "where.*"))
    kinds = distinct.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + WINDOW - 1).alias("held")).where("kinds > 1")
    kinds = checkpoint(kinds.select("key", "held", F.ceil(F.col("held") / F.lit(SHARD_WORDS)).cast("int").alias("parts")))
    total = kinds.agg(F.sum("held")).first()[0] or 0
    varied = distinct.join(kinds.select("key", "parts"), "key")
    asked = varied.groupBy(*ROW).agg(F.collect_list(F.struct("key", "seg", "i", "n", (F.col("times") > 1).alias("many"), "parts")).alias("want"))
    words = _words(rows.select(*ROW, "text").join(asked, ROW))
    placed = place(words.select(F.col("key").alias("g"), F.col("seg").alias("node"), "many", "parts", "words"), max(partitions(spark), -(-total // SHARD_WORDS)))
    masks = placed.groupBy(*TASK).applyInArrow(lambda t: search_shard(t), "key long, seg long, mask int").groupBy("key", "seg").agg(F.bit_or("mask").alias("mask"))
    whole = distinct.where("times > 1").select("key", "seg", (F.pow(F.lit(2.0), F.col("n")) - 1).cast("int").alias("mask"))
    return met.join(whole.union(masks), ["key", "seg"]).select(*ROW, "i", "mask")


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): the words of each text that no repeated window covers, joined by a space."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("text"), F.coalesce(F.col(key).cast("long"), F.xxhash64(body)).alias("rid"), F.hash(body).alias("tid"))
    found = repeated_segments(rows).groupBy(*ROW).agg(F.collect_set(F.struct("i", "mask")).alias("found"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            starts, words = words_of(batch.column("text"))
            lists = batch.column("found")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            at = starts[:-1][np.repeat(np.arange(len(sizes)), sizes)] + flat.field("i").to_numpy(zero_copy_only=False)
            masks = flat.field("mask").to_numpy(zero_copy_only=False)
            edge = np.zeros(len(words) + WINDOW + 1, np.int64)
            for k in range(WINDOW - GRAM + 1):
                hit = at[masks >> k & 1 == 1] + k
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + WINDOW, -1)
            gone = np.cumsum(edge)[: len(words)] > 0
            kept = words.filter(pa.array(~gone)).to_pylist()
            left = np.concatenate([[0], np.cumsum(~gone)])[starts]
            texts = [" ".join(kept[a:b]) for a, b in zip(left[:-1], left[1:])]
            n = np.diff(starts)
            yield columns(schema, doc_id=batch.column("doc_id"), n_words=n, n_removed=n - np.diff(left), kept_sha256=[hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], kept=texts)

    return rows.join(found, ROW, "left").select("doc_id", "text", "found").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


#: The same rows from all windows of the corpus, each as its words.
ORACLE_SQL = rf"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT r, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS sequence FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM rows_)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY sequence) > 1),
covered AS (SELECT DISTINCT r, i + k AS i FROM twice, range({WINDOW}) AS t(k)),
each AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM rows_),
kept AS (SELECT r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept FROM each ANTI JOIN covered USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM rows_ LEFT JOIN kept USING (r)
"""
