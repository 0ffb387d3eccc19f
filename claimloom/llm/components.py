"""Connected components of an edge list by alternating star contractions, all in joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.blocks import Forest
from claimloom.llm.common import checkpoint

#: Parts that a node's neighbours are dealt into; edges that a task holds at once to contract them.
PARTS, HELD = 64, 1 << 19


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs with the same components: of each run of HELD edges in a task, its nodes hung on the least they reach."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ids, at = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
        found = Forest(len(ids))
        found.link(at[: table.num_rows], at[table.num_rows :])
        child, root = found.edges()
        return pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[root])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD:
                yield star(held)
                held = []
        if held:
            yield star(held)

    return edges.mapInArrow(run, "u long, v long")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of the different edges (u, v) hangs on one node and has none hanging on it, or hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if((F.col("up") > 1) | (F.col("up") + F.col("down") > 1))).first()[0] == 0


def _with_least(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) with m, the least v of its u. A node's edges lie in PARTS parts by v, so a hub's never meet in one task."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))
    least = dealt.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("part").alias("parts"))
    return dealt.join(least.select("u", F.explode("parts").alias("part"), "m"), ["u", "part"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least node among the node and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _with_least(down).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v), which are longs: root is the least node that can be reached. Self loops are ignored.

    Edges are first contracted HELD at a time, in as many tasks as that takes, so that few edges need no rounds; rounds end once all that is
    left are stars.
    """
    larger_first = edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    found = checkpoint(larger_first.distinct())
    tasks = max(1, -(-found.count() // HELD))
    edges = checkpoint(_contracted(found.coalesce(tasks)).distinct())
    while tasks > 1 and not _are_stars(edges):
        edges = checkpoint(_small_star(_large_star(edges)).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
