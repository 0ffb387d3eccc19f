import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from claimloom.llm import sharding
from tests.llm.helpers import empty_documents, odd_documents


def test_jump_moves_rows_only_into_the_new_shard(spark):
    keys = spark.range(20_000)
    rows = keys.select(*(sharding.jump_shard(F.col("id"), n).alias(f"s{n}") for n in (1, 2, 7, 8, 9))).collect()
    for r in rows:
        assert r.s1 == 0 and r.s2 in (0, 1) and r.s8 in (r.s7, 7) and r.s9 in (r.s8, 8)
    held = Counter(r.s8 for r in rows)
    assert set(held) == set(range(8)) and min(held.values()) > 2250 and max(held.values()) < 2750


def brute_shard(key, shards):
    """Jumps from shard to shard until the next one lies past the last."""
    at, following, i = -1, 0, 0
    while following < shards:
        at, i = following, i + 1
        draw = 1 - int(hashlib.md5(f"jump {sharding.SEED}:{key}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        following = int((at + 1) / draw)
    return at


def test_shards_against_brute_force(spark):
    for r in spark.range(3000).select("id", sharding.jump_shard(F.col("id"), 8).alias("s"), sharding.jump_shard(F.col("id"), 1000).alias("t")).collect():
        assert (r.s, r.t) == (brute_shard(r.id, 8), brute_shard(r.id, 1000))


def test_slots_and_digests(spark):
    docs = odd_documents(spark)
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert sharding.shard_documents(empty_documents(spark)).count() == 0


def test_slots_do_not_depend_on_the_session(spark):
    docs, setting = odd_documents(spark), "spark.sql.shuffle.partitions"
    want, before = sorted(map(str, sharding.shard_documents(docs).collect())), spark.conf.get(setting)
    spark.conf.set(setting, "3")
    try:
        assert sorted(map(str, sharding.shard_documents(docs.repartition(5)).collect())) == want
    finally:
        spark.conf.set(setting, before)
