"""The pipeline's near-duplicate stage against all pairs of five-word shingle sets."""

import random
import re
from itertools import combinations

import numpy as np

import corpus_pipeline
from claimloom.llm import likeness, quality, simhash
from claimloom.llm.common import checkpoint
from tests.llm.helpers import empty_documents, odd_documents

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def close_pairs(sets):
    return [(i, j) for i, j in combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


def brute_kept(rows):
    """The least ids of the components of all pairs alike to 0.8, for rows (doc_id, text) with an id."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i, j in close_pairs(sets):
        a, b = root[i], root[j]
        root = [a if r == b else r for r in root]
    return sorted(min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root))


def edited(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"e{rng.randrange(10**9)}"
    return out


def planted():
    rng, rows = random.Random(8), []
    passage = [f"p{i}" for i in range(40)]  # shared by texts that aren't alike
    for d in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(160)] + passage
        rows += [(1000 + 10 * d + k, " ".join(edited(words, n, rng)), "en", "s", 0) for k, n in enumerate((0, 1, 2, 3, 4, 5, 9))]
    return rows


def test_stage_keeps_one_of_each_group_alike(spark):
    docs = spark.createDataFrame(planted(), odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars").schema)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert got == brute_kept([(r[0], r[1]) for r in planted()]) and len(got) < 420


def test_stage_on_cleaned_documents(spark):
    docs = checkpoint(quality.clean(spark.read.parquet(f"{SF}/documents.parquet")))
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert got == brute_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_bands_share_a_key_at_the_limit():
    import pyarrow as pa

    rng, texts = random.Random(9), []
    for _ in range(1500):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        at = rng.randrange(20, 100)
        texts += [" ".join(words), " ".join(edited(words[:at], 0, rng) + [f"x{rng.randrange(10**9)}" for _ in range(18)] + words[at + 18 :])]
    sets = [shingle_set(t) for t in texts]
    like = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert 0.8 <= min(like) and max(like) < 0.81
    starts, hashes = likeness.shingles(pa.array(texts))
    keys, prints = likeness.bands(starts, hashes), simhash.majority(hashes, starts[:-1], np.diff(starts))
    near = np.bitwise_count(prints[::2] ^ prints[1::2]) <= simhash.WIDE_RADIUS
    assert near.all() and (keys[::2] == keys[1::2]).any(axis=1).mean() >= 0.995
    starts, hashes = likeness.shingles(pa.array(texts[:50] + ["", None, "a", "A b c"]))
    assert (starts[1:] - starts[:-1]).tolist() == [len(shingle_set(t)) for t in [*texts[:50], "", None, "a", "A b c"]]


def test_large_groups_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", 16)
    monkeypatch.setattr(simhash, "PART_SHINGLES", 2000)
    rng = random.Random(10)
    base = [f"w{i}" for i in range(80)]
    rows = [(k, " ".join(edited(base, rng.choice((0, 1, 2, 4, 6, 9)), rng)), "en", "s", 0) for k in range(150)]
    docs = spark.createDataFrame(rows, odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars").schema)
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == brute_kept([(r[0], r[1]) for r in rows])


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = {r.doc_id for r in simhash.deduplicate(docs).collect()}
    assert got == {0, 1, 3, 6, None, 7} and simhash.deduplicate(docs).columns == docs.columns
    assert simhash.deduplicate(empty_documents(spark)).count() == 0
