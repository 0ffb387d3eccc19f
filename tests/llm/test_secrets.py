"""Recall of random keys by class, and clean runs that must stay."""

import random
import time

from claimloom.llm import secrets
from tests.llm.helpers import SCHEMA
from tests.llm.test_operators import brute_secrets

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# upper-case hexadecimal, as the pattern kind takes lower-case runs first
ALPHABETS = {"hexadecimal": DIGITS + "ABCDEF", "mixed": LOWER + UPPER + DIGITS, "lower": LOWER + DIGITS, "upper": UPPER + DIGITS}
CLEAN = [
    "internationalization_report_2024_final",
    "release/version2/chapter14/page200",
    "QUARTERLY-SUMMARY-2024-EDITION-3",
    "123e4567-e89b-12d3-a456-426614174000",
    "internationalization/of/everything_is_fine",
    "2024-01-15-weekly-meeting-minutes",
    "zzzzzzzzzzzzzzzzzzzzzzzzzzzz1",
    "================================",
]


def spans(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r.spans for r in secrets.report(docs).collect()}


def test_random_keys_of_every_class_are_found(spark):
    rng, texts, of = random.Random(11), [], []
    for name, alphabet in ALPHABETS.items():  # 120 keys a class, stated recall 0.95
        for n in (20, 24, 32, 40):
            texts += [f"see {''.join(rng.choice(alphabet) for _ in range(n))} here" for _ in range(30)]
            of += [name] * 30
    got = spans(spark, texts)
    for group in set(of):
        found = [got[i] != "" for i, g in enumerate(of) if g == group]
        assert sum(found) / len(found) >= 0.95, (group, sum(found))


def test_clean_runs_stay(spark):
    assert not any(spans(spark, [f"a {t} b" for t in CLEAN]).values())


def test_allowed_stretches_cover_only_themselves(spark):
    rng = random.Random(12)
    key = lambda n: "".join(rng.choice(LOWER + UPPER + DIGITS) for _ in range(n))
    ahead = ["========", "--------", "api_example_", "Sample-", key(40) + "A" * 12, "xxxx", "123e4567-e89b-12d3-a456-426614174000/"]
    texts = [f"see {a}{key(40)} end" for a in ahead]
    got = spans(spark, texts)
    for i, a in enumerate(ahead):
        ends = [tuple(map(int, x.split(":")[1:])) for x in got[i].split(",") if x.startswith("entropy")]
        assert ends and max(e for _, e in ends) == len(texts[i]) - 4, (a, got[i])
        assert a not in ("api_example_", "Sample-") or min(s for s, _ in ends) >= 4 + len(a) - 1
    assert not any(spans(spark, ["an example_of_dummy_placeholder1 b", "id=123e4567-e89b-12d3-a456-426614174000 b"]).values())


def test_very_long_texts_end_in_time(spark):
    rng = random.Random(13)
    key = lambda n, a=LOWER + UPPER + DIGITS: "".join(rng.choice(a) for _ in range(n))
    texts = ["-=" * 100_000, "a_" * 100_000, "a1" * 100_000, "A-1" * 70_000, key(100_000), " ".join(key(24, DIGITS + "abcdef") for _ in range(20_000)), " ".join(f"{key(24)} x" for _ in range(5_000)), "\n".join(f"token: {key(12)}" for _ in range(5_000))]
    spans(spark, ["warm"])
    began = time.time()
    got = spans(spark, texts)
    assert time.time() - began < 90
    for i, t in enumerate(texts):
        assert got[i] == brute_secrets(t)[1], (i, got[i][:200])
    docs = spark.createDataFrame([(5, texts[5], "en", "s", 0), (6, texts[6], "en", "s", 0)], SCHEMA)
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[5] == " ".join([secrets.MASK] * 20_000) and clean[6].count(secrets.MASK) > 4_500
