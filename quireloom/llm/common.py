"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quireloom.session import ship_package

#: Bytes of a column that a kernel sees at once, so that memory stays bounded
#: whatever the lengths of the texts; one longer value still goes alone.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str | None, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose values of ``column`` fit ``limit``."""
    if column is None or batch.num_rows < 2 or batch.column(column).nbytes <= limit:
        yield batch
        return
    at, size = 0, 0
    for i, value in enumerate(batch.column(column)):
        n = len(value.as_buffer()) if value.is_valid else 0
        if size and size + n > limit:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    yield batch.slice(at)


def add_columns(df: DataFrame, fields: list[T.StructField], make: Callable, by: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns that a kernel computes from Arrow batches.

    ``make()`` runs once for each task and returns ``kernel(batch) -> arrays``,
    one for each of ``fields``.  Columns of ``df`` with the name of a new one
    give way to it; all others pass through untouched.
    """
    ship_package(df.sparkSession)
    new = {f.name.lower() for f in fields} | {c.lower() for c in drop}
    carried = [f for f in df.schema.fields if f.name.lower() not in new]
    names = [f.name for f in carried] + [f.name for f in fields]

    def run(batches):
        kernel = make()
        for batch in batches:
            for part in slices(batch, by):
                if part.num_rows:
                    arrays = kernel(part)
                    yield pa.RecordBatch.from_arrays([part.column(f.name) for f in carried] + arrays, names=names)

    return df.mapInArrow(run, T.StructType([*carried, *fields]))


def texts_of(array: pa.Array) -> list[str]:
    """Python strings of a string column; null counts as empty."""
    return ["" if x is None else x for x in array.to_pylist()]


def table_groups(batches, keys: list[str], rows: int = 8192) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """Runs of equal integer keys in sorted batches, whole, with their keys."""
    held: list[pa.RecordBatch] = []

    def runs(table: pa.Table) -> np.ndarray:
        columns = [table.column(k).to_numpy() for k in keys]
        return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))

    def groups(table: pa.Table, cut: np.ndarray):
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            part = table.slice(s, e - s)
            yield tuple(part.column(k)[0].as_py() for k in keys), part

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            cut = runs(table)
            yield from groups(table, cut)
            held = table.slice(int(cut[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        if len(table):
            yield from groups(table, np.append(runs(table), len(table)))
