"""Whole groups from sorted partitions, for work that one call for each small group would make slow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches sorted by `key`; a batch's last group waits for what the next one has of it."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(key)[-1]
        at = pc.index(batch.column(key), last).as_py() if last.is_valid else 0  # nulls come first
        if at or (waiting and waiting[-1].column(key)[-1] != last):
            yield pa.Table.from_batches([*waiting, batch.slice(0, at)])
            waiting = []
        waiting.append(batch.slice(at))
    if waiting:
        yield pa.Table.from_batches(waiting)
