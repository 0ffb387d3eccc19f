"""Ranked search against plain integers."""

import collections
import math
import random
import re

import pytest

from claimloom.llm import ranking
from tests.llm.helpers import empty_documents, odd_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return [t.translate(SMALL) for t in TERM.findall(text or "")]


def brute(docs, items, top=50):
    counted = [(d, collections.Counter(split(t))) for d, t in docs if split(t)]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    by_item, out = collections.defaultdict(set), []
    for i, t in items:
        by_item[i] |= set(split(t))
    for i, terms in by_item.items():
        found = []
        for d, c in counted:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, d is None, d if d is not None else 0))
        out += [(i, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def told(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("most", [ranking.ITEM_TERMS, 10])
def test_against_plain_integers(spark, most, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 40)  # many blocks in each task; the tasks fork from here only if they start after it
    rng, words = random.Random(13), ["alpha", "béta", "gamma", "The", "the", "of", "42", "don't", "日本", "É", "rare", "x1"]
    rows = [(k if k % 9 else None, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))), "en", "a", 1) for k in range(100, 400)]
    docs = odd_documents(spark, [*rows, *rows[:20]])
    items = [(1, "the rare of"), (2, "béta, É"), (2, "gamma gamma"), (None, "42 x1"), (3, None), (4, ""), (5, "nobody has this1"), (6, "quick FOX alpha")]
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS score", "2 AS doc_id", "'n' AS n")
    assert told(ranking.search(docs, table, most=most)) == brute([(r.doc_id, r.text) for r in docs.collect()], items)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "the fox")], "item_id long, text string")
    assert ranking.search(empty_documents(spark), items).count() == 0
    assert ranking.search(odd_documents(spark), items.limit(0)).count() == 0
    assert ranking.search(odd_documents(spark), spark.createDataFrame([(1, None)], "item_id long, text string")).count() == 0


def test_one_very_long_text(spark):
    docs = spark.createDataFrame([(1, "fox " * 2_000_000), (2, "a fox"), (3, "none")], "doc_id long, text string")
    items = [(1, "Fox a")]
    assert told(ranking.search(docs, spark.createDataFrame(items, "item_id long, text string"))) == brute([(r.doc_id, r.text) for r in docs.collect()], items)
