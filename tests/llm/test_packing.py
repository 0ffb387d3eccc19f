import zlib
from collections import defaultdict

import numpy as np
import pytest

from claimloom.llm import packing
from claimloom.llm.registry import tokenizer_path
from tests.llm.helpers import empty_documents, odd_documents


def brute_first_fit(lengths, capacity):
    room, out = [], []
    for n in lengths:
        k = next((i for i, r in enumerate(room) if r >= n), len(room))
        if k == len(room):
            room.append(capacity)
        out.append((k, capacity - room[k]))
        room[k] -= n
    return out


def test_tournament_tree_is_first_fit():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 300):
        lengths = np.sort(rng.integers(1, 101, n))[::-1]
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        assert list(zip(bins.tolist(), offsets.tolist())) == brute_first_fit(lengths.tolist(), 100)


def whole_ids(text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [2]
    return np.array(ids, "<u4")


def check(rows, texts, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids = whole_ids(text)
        got = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc]})
        assert sum(n for _, n, _, _ in got) == len(ids) and all(t == len(ids) for *_, t in got)
        at = 0
        for start, n, crc, _ in got:
            assert start == at and crc == zlib.crc32(ids[start : start + n].tobytes())
            at += n
    for held in by_sequence.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity


def test_packs_odd_documents(spark):
    docs = odd_documents(spark)
    rows = packing.pack_documents(docs, tokenizer_path(), capacity=packing.CAPACITY).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(rows, texts, packing.CAPACITY)
    assert len([r for r in rows if r.doc_id == 4]) == 2  # a repeated row is packed once per row
    assert packing.pack_documents(empty_documents(spark), tokenizer_path()).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_little_padding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    check(rows, {r.doc_id: r.text for r in docs.collect()}, packing.CAPACITY)
    used = sum(r.length for r in rows)
    assert used / (len({r.sequence_id for r in rows}) * packing.CAPACITY) > 0.97


def test_cache_restarts(spark):
    import pyarrow as pa

    small = packing.ChunkTokenizer(tokenizer_path(), most=2)
    for text in ("one two three", "four five one", "two\nseven  eight"):
        ids, starts = small.encode(pa.array([text]))
        assert ids.tolist() == whole_ids(text)[:-1].tolist() and starts.tolist() == [0, len(ids)]
