"""Helpers for functions that run over Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.functions.store import ship

#: Rows of an Arrow batch and characters worked on at once: bounds a Python worker's memory.
ROWS, CHARS = 500, 1 << 21


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ROWS; texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, ROWS)


def runs(texts: list[str], chars: int = CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about so many characters each (a longer text is a range of its own)."""
    first = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > chars:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null is empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of consecutive rows, sorted by key, that never part a key's rows."""
    import pyarrow.compute as pc

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key)
        last, first = column[-1], column[0]
        if held and first != held[-1].column(key)[-1]:
            yield pa.Table.from_batches(held)
            held = []
        if held and first == last:
            held.append(batch)
            continue
        tail = pc.sum(pc.equal(column, last)).as_py()
        if tail < batch.num_rows:
            yield pa.Table.from_batches([*held, batch.slice(0, batch.num_rows - tail)])
            held = []
        held.append(batch.slice(batch.num_rows - tail))
    if held:
        yield pa.Table.from_batches(held)
