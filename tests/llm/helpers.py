"""Small document tables for the tests: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark, extra=()):
    rng = random.Random(5)
    words = ["alpha", "béta", "Gamma", "delta,", "don't", "ε", "zeta.", "eta", "x" * 40, "42"]
    long = " ".join(rng.choice(words) + (" " if rng.random() < 0.9 else "\n") for _ in range(6000))
    rows = [
        (0, "the quick brown fox", "en", "a", 19),
        (1, None, "en", "a", None),
        (2, "", None, "b", 0),
        (3, long, "en", "a", len(long)),
        (4, "the quick brown fox", "en", None, 19),
        (4, "the quick brown fox", "en", None, 19),
        (5, " \t\n\x0b ", "en", "b", 5),
        (6, "single", "fr", "b", 6),
        (None, "no id here", "fr", "c", 10),
        (7, "nbsp\xa0joined words line <|endoftext|> é", "fr", "c", 30),
        *extra,
    ]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score", "'x' AS key", "2 AS shard", "3 AS length", "'k' AS kind", "0 AS n_words")


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
