"""Packing tokenised documents into fixed-length sequences by first-fit decreasing.

Each task tokenises whole texts and cuts a document longer than a sequence into full-length pieces and a rest. The pieces, which
carry no text, are dealt into randomised groups of about `group_size`; each group is packed on its own by first-fit decreasing,
with a tournament tree over the bins' free room that finds the first bin with room in a logarithmic number of steps.

Defined results: a null text counts as empty (one piece with the end id alone); repeated rows are packed once per row; ties in
length go by document and start; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import checkpoint, columns, slices

CAPACITY = 4096
END_ID = 2
#: Pieces that are packed together, on average.
GROUP_SIZE = 4096
#: Entries of a worker's token cache; past it the cache starts anew.
CACHE_WORDS = 500_000
#: Chunks of letters that are encoded in one call.
TOGETHER = 4096
#: Letters whose composed and lower-case forms are single letters, and marks between such a letter and white space.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
MARKS = r"([a-zß-öø-ÿ])([.,;:!?#$%&*)]+)([ \t-\r]|$)"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, tie int"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ChunkTokenizer:
    """Token ids of chunks between white space, which the tokenizer never joins; each distinct chunk is encoded once per cache.

    The tokenizer lower-cases and parts letters from marks by itself, so doing both beforehand changes no id and leaves fewer distinct
    chunks. Texts with the opening of a special token are left as they are.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.empty(1 << 20, np.uint32), np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)
        self.used = 0

    def keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.index)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + len(words) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(words)] = lengths
        self.index.update(zip(words, range(n, n + len(words))))
        self.used += len(ids)

    def add(self, words: list[str]) -> None:
        """Encode new chunks: those of letters alone many at a time, as each ends with a token that only ends a word."""
        letters, others = [], []
        for w in words:
            (letters if LETTERS(w) else others).append(w)
        for at in range(0, len(letters), TOGETHER):
            some = letters[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.is_end[ids])
            if len(ends) != len(some):
                raise ValueError("the tokenizer doesn't end each word with a token of its own")
            self.keep(some, ids, np.diff(ends, prepend=-1))
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.keep(others, np.fromiter((i for ids in encoded for i in ids), np.uint32, int(lengths.sum())), lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and each text's start among them (one more entry than texts)."""
        eased = pc.replace_substring_regex(pc.ascii_lower(texts), MARKS, r"\1 \2\3")
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, eased))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.index) > self.most:
            self.clear()
        if missing := [w for w in words if w not in self.index]:
            self.add(missing)
        place = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()] if words else np.empty(0, np.int64)
        lengths = self.lengths[place]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(self.starts[place] - ends[:-1], lengths) + np.arange(ends[-1])]
        offsets = lists.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]


_tokenizers: dict[str, ChunkTokenizer] = {}


def _tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer_path: str, *, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids, with the end id, cut into pieces of at most `capacity`; what a piece holds is told by its checksum."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("tie", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen = _tokenizer(tokenizer_path), 0
        for batch in slices(batches, "text"):
            ids, starts = tokenizer.encode(pc.fill_null(batch.column("text"), ""))
            rows: list[tuple] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
                whole = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                seen = (seen + 1) & 0x7FFFFFFF
                rows += ((doc, at, len(part := whole[at : at + capacity]), zlib.crc32(part.tobytes()), len(whole), seen) for at in range(0, len(whole), capacity))
            yield columns(schema, **dict(zip(schema.names, map(list, zip(*rows)))))

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; the items come longest first."""
    leaves = 1 << max(0, math.ceil(math.log2(max(1, len(lengths)))))
    tree = [capacity] * (2 * leaves)  # tree[k]: the most free room of the bins below k; bins start empty
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i, need in enumerate(lengths.tolist()):
        k = 1
        while k < leaves:
            k *= 2
            if tree[k] < need:
                k += 1
        bins[i], offsets[i] = k - leaves, capacity - tree[k]
        tree[k] -= need
        while k > 1:
            k //= 2
            left, right = tree[2 * k], tree[2 * k + 1]
            tree[k] = left if left > right else right
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def pack(parts: DataFrame, *, capacity: int = CAPACITY, group_size: int = GROUP_SIZE, seed: int = 8) -> DataFrame:
    """Deal pieces into randomised groups and pack each; a sequence's id is its group and its bin there."""
    parts = checkpoint(parts)
    groups = max(1, -(-parts.count() // group_size))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32", "tie"], ascending=[False, True, True, True, True], na_position="first")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=(group["g"].to_numpy(np.int64) << 32) + bins, offset=offsets)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    dealt = parts.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "tie", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(fit, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row per piece."""
    return pack(pieces(docs, tokenizer_path, **options))
