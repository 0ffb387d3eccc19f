"""Groups of rows compared inside tasks, and what a task finds as a spanning forest.

Small groups share tasks by hash; a group past `most` is dealt into parts, and every pair of parts is a task of its own, so no task holds
an unbounded group. A forest has a row less than it has nodes, however many pairs of a group are alike, and the union of all forests has
the same components as all pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import checkpoint, partitions


class Forest:
    """Components of rows 0 to n - 1 as they are linked; every row points at the root of its component."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        parent = self.parent
        while (apart := (ri := parent[i]) != (rj := parent[j])).any():
            np.minimum.at(parent, np.maximum(ri, rj)[apart], np.minimum(ri, rj)[apart])
            while not np.array_equal(up := parent[parent], parent):
                parent = up
        self.parent = parent

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return child, self.parent[child]


def bounds(groups: np.ndarray) -> zip:
    """(begin, end) of each run of equal values."""
    cuts = np.flatnonzero(groups[1:] != groups[:-1]) + 1
    return zip([0, *cuts.tolist()] if len(groups) else [], [*cuts.tolist(), len(groups)])


def place(rows: DataFrame, tasks: int) -> DataFrame:
    """`rows` (g, node, parts, ...) with the task (shared, task, a, b) and side of each; parts: into how many its group g is dealt.

    Where a and b differ, only pairs of side 0 with side 1 are that task's.
    """
    rest = [c for c in rows.columns if c != "parts"]
    part, shared = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.col("parts") == 1
    task = F.when(shared, F.pmod(F.xxhash64("g"), F.lit(tasks))).otherwise(F.col("g"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("part_", q).alias("a"), F.greatest("part_", q).alias("b")))
    placed = rows.withColumn("part_", part).select(*rest, "part_", shared.alias("shared"), task.alias("task"), "parts").withColumn("p", F.explode(pairs))
    return placed.select(*rest, "shared", "task", "p.a", "p.b", ((F.col("part_") == F.col("p.b")) & (F.col("p.a") != F.col("p.b"))).cast("int").alias("side"))


def deal(rows: DataFrame, weight: Column, *, most: int, per_task: int) -> DataFrame:
    """`rows` (g, node, ...) of groups with two rows or more, placed so that a part weighs about `most` and a shared task `per_task`."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("held"), F.sum(weight).alias("weight_")).where("held > 1")
    sizes = checkpoint(sizes.select("g", "weight_", F.ceil(F.col("weight_") / F.lit(most)).cast("int").alias("parts")))
    total = sizes.agg(F.sum("weight_")).first()[0] or 0
    return place(rows.join(sizes.select("g", "parts"), "g"), max(partitions(rows.sparkSession), -(-int(total) // per_task)))


TASK = ("shared", "task", "a", "b")
