"""Newly stored scans compared with those before them, batch by batch: beyond the batch functions, the same checks on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def check_new_scans(spark: SparkSession, arrivals: str, schema: str, check: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run `check` on every batch of newly arrived Parquet files and append what it finds; all that is there now, then stop.

    A batch that is repeated after a failure overwrites its own folder, so each finding is there once.
    """

    def one(batch: DataFrame, number: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(arrivals).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
