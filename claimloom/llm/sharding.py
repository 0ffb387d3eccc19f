"""Jump consistent hashing into shards, in DataFrame functions alone.

A document jumps from shard to shard as shards are appended: from shard b the next jump goes to floor((b + 1) / r), r uniform from
(0, 1] and drawn by hashing the key and the number of the jump; the shard is where the last jump below the shard count lands. So the
key and the count decide, no ring is stored, and one more shard takes only the rows that land in it. Slots, too, follow from the rows
alone and not from the session's settings.

Defined results: a null key hashes as a value of its own; a null text has no bytes (size 1, checksum 0); repeated rows share a
shard and get slots of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import uniform

SHARDS, SEED = 8, 7
#: Hexadecimal digits of a hash that tell a shard's part: 16 to this power parts, each numbered by itself.
PART_DIGITS = 3
#: Draws tried for each key; a key makes about ln(shards) jumps, and more than this many with a chance below 1e-60 at 10 million shards.
MOST_JUMPS = 128


def jump_shard(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard of each key among `shards`."""
    name = F.coalesce(key.cast("string"), F.lit("null"))
    draw = lambda i: F.lit(1.0) - uniform(F.lit(f"jump {seed}"), name, i.cast("string"))
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(state: Column, i: Column) -> Column:
        landed = F.when(state["j"] < shards, F.floor((state["j"] + 1) / draw(i)).cast("long")).otherwise(state["j"])
        return F.struct(F.when(state["j"] < shards, state["j"]).otherwise(state["b"]).alias("b"), landed.alias("j"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, min(shards, MOST_JUMPS)))), start, jump, lambda s: s["b"]).cast("int")


def shard_documents(docs: DataFrame, *, shards: int = SHARDS, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Shard, slot and checksum of each document, with the shard it would have if one were appended.

    Slots run from 0 without gaps in each shard. They are dealt by parts of a shard, so that no task holds a whole shard: rows are
    numbered in their part, and the parts' sizes, of which there are 4096 for each shard, give each part its first slot.
    """
    bytes_ = F.coalesce(F.col(text).cast("string"), F.lit(""))
    crc = F.crc32(F.encode(bytes_, "utf-8")).cast("long")
    hashed = F.md5(F.concat_ws(":", F.lit(f"slot {seed}"), F.coalesce(F.col(key).cast("string"), F.lit("null")), crc.cast("string")).cast("binary"))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(bytes_) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col(key), shards, seed).alias("shard"),
        jump_shard(F.col(key), shards + 1, seed).alias("grown_shard"),
        F.substring(hashed, 1, PART_DIGITS).alias("part"),
    )
    sizes = rows.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(firsts, ["shard", "part"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), "grown_shard")


#: What op7_jump_sharding returns, over the table of documents. The checksum goes byte by byte through its table of 256 remainders.
ORACLE_SQL = f"""
WITH RECURSIVE bits AS (SELECT n, n AS c, 0 AS k FROM range(256) AS t(n) UNION ALL
  SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
remainders AS (SELECT list(c ORDER BY n) AS rem FROM bits WHERE k = 8),
rows_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body, coalesce(CAST(doc_id AS VARCHAR), 'null') AS name FROM documents),
summed AS (SELECT r, doc_id, name, strlen(body) + 1 AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(body), '..'), lambda p: CAST('0x' || p AS BIGINT))),
    lambda c, b: xor(c >> 8, rem[CAST(xor(c, b) & 255 AS BIGINT) + 1]))) AS crc FROM rows_, remainders),
jumps AS (SELECT r, name, 0 AS i, CAST(0 AS BIGINT) AS j FROM rows_ UNION ALL
  SELECT r, name, i + 1, CAST(floor((j + 1) / (1.0::DOUBLE - CAST('0x' || substr(md5('jump {SEED}:' || name || ':' || (i + 1)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)) AS BIGINT) FROM jumps WHERE j <= {SHARDS}),
landed AS (SELECT r, max(j) FILTER (j < {SHARDS}) AS shard, max(j) FILTER (j <= {SHARDS}) AS grown FROM jumps GROUP BY r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5('slot {SEED}:' || name || ':' || crc), 1, {PART_DIGITS}), doc_id NULLS FIRST, crc, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM summed JOIN landed USING (r)
"""
