import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from claimloom.llm import simhash
from claimloom.llm.components import components
from tests.llm.helpers import empty_documents, odd_documents


def brute_print(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64))


def brute_components(prints):
    """doc -> least doc reachable, for a list of (doc, fingerprint)."""
    out = {d: d for d, _ in prints}
    for d, f in sorted(prints):
        for e, g in prints:
            if (f ^ g).bit_count() <= 3 and out[d] != out[e]:
                lo, hi = sorted((out[d], out[e]))
                out = {k: lo if v == hi else v for k, v in out.items()}
    return out


def test_fingerprints_match_definition():
    texts = ["", None, "one", "Two words", "A b c", "É ÀB ça  va\tbien\nmerci", "x y z " * 50, "w " * 3000]
    assert simhash.simhashes(pa.array(texts)).tolist() == [brute_print(t) for t in texts]


@pytest.mark.parametrize("sides", [1, 2])
def test_forest_has_all_components(sides):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)]))
    side = rng.integers(0, sides, len(fps))
    u, v = simhash.forest(fps, side, 3, tile=16)
    def roots(pairs):
        p = list(range(len(fps)))
        for a, b in pairs:
            ra, rb = p[a], p[b]
            p = [min(ra, rb) if x in (ra, rb) else x for x in p]
        return p
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3 and (sides == 1 or side[i] != side[j])]
    assert roots(zip(u.tolist(), v.tolist())) == roots(pairs) and len(u) < len(fps)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(7, 7), (300, 299)] + [(k, 1500) for k in range(1000, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 1 for k in range(1, 40)}, 299: 299, 300: 299, **{k: 1000 for k in range(1000, 2000)}}


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", 16)  # deals groups into parts
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for d in range(40):
        words = [rng.choice(vocab) for _ in range(300)]
        for k in range(3):
            rows.append((1000 + 3 * d + k, " ".join(words), "en", "s", 0))
            words[rng.randrange(300)] = "edited"
    docs = odd_documents(spark, rows)
    prints = [(r.doc_id, brute_print(r.text)) for r in docs.collect() if r.doc_id is not None]
    want = brute_components(prints)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.fingerprint == f"{dict(prints)[r.doc_id]:016x}"
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0
