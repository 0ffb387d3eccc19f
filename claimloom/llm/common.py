"""What the text operators share: reading, checkpoints, word splitting in Arrow."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a task's Python code handles at a time, unless one text alone is longer.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which whoever runs the job sets for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local run without one gets its own, a cluster has no folder to fall back on."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def uniform(*parts: Column) -> Column:
    """A number from [0, 1) hashed from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def name_of(text: Column) -> Column:
    """A text's name in 96 bits, so that no two of any number of texts that a cluster holds are likely to share it; null counts as empty."""
    return F.substring(F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))), 1, 12)


def shared_folder(spark: SparkSession) -> str:
    """A new place for tables, in the shared folder."""
    return f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about `most` bytes of text each; a longer text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words `[^\\x20\\x09-\\x0D]+` of all texts in one array, and where each text's words start (one more entry than texts)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    keep = pc.greater(pc.binary_length(flat), 0)
    count = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False).astype(np.int64))])
    offsets = lists.offsets.to_numpy()
    return count[offsets - offsets[0]], flat.filter(keep)


#: What terms are made of: digits, letters (A-Z become a-z) and all that isn't ASCII; every other byte parts them.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """As words_of, for the terms `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of texts whose A-Z are lower-cased."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    if not len(texts):
        return np.zeros(1, np.int64), pa.array([], pa.string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    flat = memoryview(data)[ends[0] : ends[-1]].tobytes().translate(_TERM_BYTES) if data else b""
    return words_of(pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(flat)))


def columns(schema: pa.Schema, **values) -> pa.RecordBatch:
    """A batch of the given schema from arrays, lists or numpy arrays by name."""
    return pa.RecordBatch.from_arrays([x if isinstance(x := values[f.name], pa.Array) else pa.array(x, type=f.type) for f in schema], schema=schema)
