"""Alignment of two tokenizers against a plain version that encodes whole texts."""

import collections
import hashlib
import random

import pyarrow as pa
import pytest

from claimloom.llm import alignment
from claimloom.llm.registry import op11_alignment, tokenizer_path
from tests.llm.helpers import empty_documents, odd_documents

PATHS = (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
ODD = ["a  b", "  a", " ", "a ", " \n x", "x\ty \r\n  z", "a\xa0 b　  c", "ñ ́x", "<|endoftext|> <s> <0x0A> </s>", "▁x", "x▁ y", "tab\t\t tab", "\x00a", "😀 😀😀 日本語 テスト", "ﬁne", "don't 's we'll", "1234567 12 345", "line\n\nline\n  indented   code\n", "e" * 3000]


def whole(texts):
    """Ids and their bytes of whole texts by both tokenizers."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second, byte = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1]), alignment.byte_level()
    first.encode_special_tokens = True
    out = []
    for t in texts:
        a = first.encode(" " + t, add_special_tokens=False)
        b = second.encode(t)
        spelled = [bytes(byte[c] for c in x) for x in a.tokens], [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
        out.append(((a.ids, b), spelled))
    return out


def brute(rows):
    """The rows of the report, by a walk over bytes."""
    told = []
    for doc, text in rows:
        (ids, spelled), = whole([text or ""])
        if not text or any(b"".join(x) != (" " + text).encode() for x in spelled):
            told.append((doc, [], [], []))
            continue
        ends = []
        for x in spelled:
            at, own = 0, []
            for s in x:
                at += len(s)
                own.append(at)
            ends.append(own)
        links = [(ids[0][i], ids[1][j]) for i in range(len(ids[0])) for j in range(len(ids[1])) if max((ends[0][i - 1] if i else 0), (ends[1][j - 1] if j else 0)) < min(ends[0][i], ends[1][j])]
        parts, a, b = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            i, j = ends[0].index(e) + 1, ends[1].index(e) + 1
            parts.append(",".join(map(str, ids[0][a:i])) + "|" + ",".join(map(str, ids[1][b:j])))
            a, b = i, j
        told.append((doc, ids, links, parts))
    n = collections.Counter(p for _, _, links, _ in told for p in set(links))
    best = collections.defaultdict(int)
    for (a, _), k in n.items():
        best[a] = max(best[a], k)
    return sorted(((d, len(i[0]), len(i[1]), len(g), len(x), sum(n[p] == best[p[0]] for p in x), sum(n[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest()) if i else (d, 0, 0, 0, 0, 0, 0, "") for d, i, x, g in told), key=repr)


def told(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def test_chunks_give_the_ids_of_whole_texts():
    rng = random.Random(11)
    texts = [*ODD, *("".join(rng.choice([" ", "  ", "\n", "\t", "\xa0", "a", "The", "é", "ß", ",", "'s", "9", "́", " ", "日", ".", "<0x0A>", "\x1c", "\x85"]) for _ in range(rng.randrange(1, 40))) for _ in range(3000))]
    starts, chunks = alignment.chunks_of(pa.array(texts))
    coded = chunks.dictionary_encode()
    for side, tokenizer in enumerate(alignment.tokenizers_of(PATHS)):
        ids, at, ok = tokenizer.of(coded.dictionary.to_pylist(), coded.indices.to_numpy(), starts)
        for k, (t, (by_whole, spelled)) in enumerate(zip(texts, whole(texts))):
            assert bool(ok[k]) == (b"".join(spelled[side]) == (" " + t).encode()), t
            assert not ok[k] or ids[at[k] : at[k + 1]].tolist() == by_whole[side], t


@pytest.mark.parametrize(("most", "block"), [(alignment.MOST_PAIRS, alignment.BLOCK), (0, 64)])
def test_report_against_plain_version(spark, most, block):
    docs = odd_documents(spark, [(100 + k, t, "en", "a", 1) for k, t in enumerate(ODD)]).where("length(text) is null or length(text) < 5000")
    got = told(alignment.report(docs, PATHS, most=most, block=block))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()]) and sum(r[1] == 0 for r in got) >= 3


def test_groups_cover_each_text(spark):
    docs = odd_documents(spark).where("doc_id in (3, 6)")
    (_, spell_a), (_, spell_b) = ((t, t.spelled) for t in alignment.tokenizers_of(PATHS))
    by_doc = collections.defaultdict(list)
    for r in alignment.groups(docs, PATHS, block=4096).collect():
        by_doc[r.doc_id].append(r)
    for row in docs.collect():
        data, at = (" " + row.text).encode(), 0
        for r in sorted(by_doc[row.doc_id], key=lambda r: r.first_byte):
            assert r.first_byte == at and b"".join(spell_a[i] for i in r.a_ids) == b"".join(spell_b[i] for i in r.b_ids) == data[at : r.end_byte]
            at = r.end_byte
        assert at == len(data)


def test_long_text_and_empty_table(spark):
    text = "word " * 2_000_000
    docs = spark.createDataFrame([(1, text), (None, "word"), (None, "word")], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.report(docs, PATHS).collect()}
    assert got[1].n_a == got[1].n_b == 2_000_001 and got[None].count_sum == 3
    assert alignment.report(empty_documents(spark), PATHS).count() == 0


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) is null or length(text) < 1500").select("doc_id", "text").collect()
    got = op11_alignment(spark, "/root/testdata/sf0.001")
    by_id = {r[0]: r for r in told(got)}
    for r in brute([(r.doc_id, r.text) for r in rows]):
        assert by_id[r[0]][:5] + by_id[r[0]][7:] == r[:5] + r[7:]
