"""Session settings shared by tests, the benchmark and local runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", app: str = "claimloom") -> SparkSession:
    """A local session: UTC, adaptive execution on, no UI."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local run makes one of its own."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def checkpoint(rows: DataFrame) -> DataFrame:
    """Rows written to the shared folder and read from there."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def written(rows: DataFrame) -> DataFrame:
    """Rows written once as Parquet in the shared folder and read from there, so that Spark knows their size before it plans a join."""
    path = f"{shared_folder(rows.sparkSession)}/written_{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def laid_out(rows: DataFrame, key: str = "scan_id") -> DataFrame:
    """Rows written once as Parquet in the shared folder, in buckets by a key, and read from there.

    What reads them takes the columns it needs, and joins and groups by the key without another shuffle.
    """
    spark, name = rows.sparkSession, f"laid_out_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, key).write.bucketBy(n, key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name, format="parquet")
    return spark.table(name)
