"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source's repetition rate is its target share of the corpus, in bytes, over its present share. Every row draws its number of copies
by inverting the Poisson distribution of that mean at a number hashed from its id, is exploded by it, and all copies are shuffled
over all partitions by another hash. The draw needs no state, so rows can be added or tasks repeated without changing other rows.

Defined results: null sources are a source of their own; a null or empty text has size 1; rows that repeat an id draw the same number
each; a null id hashes as a value of its own; sources without a weight in an explicit table are left out (rate 0); an empty table
gives an empty result; all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import checkpoint, partitions, uniform

EXPONENT = 0.5
SEED = 6
#: A larger mean is drawn as the sum of equal parts no larger than this.
LARGEST_MEAN = 16.0
#: Up to so many sources their rates are sent to all tasks; more are joined by a shuffle.
MOST_BROADCAST = 10_000


def poisson(u: Column, mean: Column) -> Column:
    """The Poisson quantile of u: how many of the values 0, 1, ... have a cumulative probability of at most u."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), (s["n"] + (u >= s["c"]).cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), (24 + 4 * mean).cast("int")), start, step, lambda s: s["n"])


def copies(key: Column, rate: Column, seed: int = SEED) -> Column:
    """The number of copies that a row draws at this rate."""
    parts = F.greatest(F.lit(1), F.ceil(rate / LARGEST_MEAN).cast("int"))
    draws = F.transform(F.sequence(F.lit(1), parts), lambda j: poisson(uniform(F.lit(seed).cast("string"), key, j.cast("string")), rate / parts))
    return F.aggregate(draws, F.lit(0), lambda a, n: a + n)


def rates(docs: DataFrame, *, weights: Mapping[str | None, float] | None = None, exponent: float = EXPONENT, source: str = "source", text: str = "text") -> DataFrame:
    """(source, rate): weights, or else sizes to the power `exponent`, as shares of the whole, over present shares."""
    sizes = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.sum(F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + F.lit(1).cast("long")).alias("size"))
    if weights is None:
        wanted = sizes.withColumn("w", F.pow(F.col("size").cast("double"), F.lit(exponent)))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "name string, w double")
        wanted = sizes.join(table, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "size", F.coalesce("w", F.lit(0.0)).alias("w"))
    wanted = checkpoint(wanted)
    whole = wanted.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    return wanted.select("source", F.coalesce(F.try_divide(F.col("w") / F.col("size") * F.lit(whole["size"]), F.lit(whole["w"])), F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", seed: int = SEED, **options) -> DataFrame:
    """(row, copies, copy, mix_key): each copy of each row, row being a struct of the columns of `docs`, in globally shuffled order."""
    table = rates(docs, source=source, **options)
    if table.count() <= MOST_BROADCAST:
        table = F.broadcast(table)
    id_ = F.coalesce(F.col(f"row.{key}").cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rated = rows.join(table.withColumnRenamed("source", "name"), F.col(f"row.{source}").cast("string").eqNullSafe(F.col("name")))
    counted = rated.select("row", copies(id_, F.col("rate"), seed).alias("copies")).where("copies > 0")
    each = counted.select("row", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    keyed = each.withColumn("mix_key", F.substring(F.md5(F.concat_ws(":", F.lit(f"shuffle {seed}"), id_, F.col("copy").cast("string")).cast("binary")), 1, 16))
    return keyed.repartition(partitions(docs.sparkSession), "mix_key").sortWithinPartitions("mix_key")


#: What op6_mixing returns, over the table of documents.
ORACLE_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(SUM(strlen(coalesce(text, '')) + 1) AS BIGINT) AS size FROM documents GROUP BY source
), wanted AS (SELECT source, size, pow(CAST(size AS DOUBLE), {EXPONENT}) AS w FROM sizes),
rated AS (
  SELECT source, w / size * (SELECT CAST(SUM(size) AS BIGINT) FROM wanted) / (SELECT SUM(w) FROM wanted) AS rate FROM wanted
), parted AS (SELECT source, greatest(1, CAST(ceil(rate / {LARGEST_MEAN}) AS INTEGER)) AS parts, rate / greatest(1, CAST(ceil(rate / {LARGEST_MEAN}) AS INTEGER)) AS mean FROM rated
), numbered AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents
), drawn AS (
  SELECT r, source, CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || j), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM (SELECT d.r, d.doc_id, d.source, unnest(generate_series(1, p.parts)) AS j FROM numbered d JOIN parted p ON d.source IS NOT DISTINCT FROM p.source)
), terms AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM parted
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM terms WHERE k < 24 + 4 * mean
), quantiles AS (
  SELECT d.r, (SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM d.source AND t.c <= d.u) AS n FROM drawn d
), counted AS (
  SELECT d.doc_id, d.source, d.text, q.copies FROM numbered d JOIN (SELECT r, CAST(sum(n) AS INTEGER) AS copies FROM quantiles GROUP BY r) q USING (r)
), each AS (SELECT *, unnest(generate_series(1, copies)) AS copy FROM counted)
SELECT doc_id, source, text, copies, CAST(copy AS INTEGER) AS copy,
  substr(md5('shuffle {SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy), 1, 16) AS mix_key
FROM each
"""
