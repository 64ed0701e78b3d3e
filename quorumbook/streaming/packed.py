"""Rows of a group as one row of bytes.

What Spark hands to keyed state in Python, and takes from it, costs some ten microseconds
a row and column.  Rows of numbers are therefore packed before they are shuffled: those of
one group (and one label) in a portion of the input are one row, whose bytes numpy reads
as they are.  What comes out is packed in the same way and spelt out again by a map.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows of a task's input that are packed together.
PORTION_ROWS = 250_000
_KINDS = {"bigint": "i8", "int": "i4", "boolean": "?"}
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


def _fields(ddl: str) -> list[tuple[str, str]]:
    return [tuple(part.split(" ")) for part in ddl.split(", ")]


class Layout:
    """The numbers of a row as bytes: each column, and a bit per column that tells nulls."""

    def __init__(self, ddl: str):
        self.columns = _fields(ddl)
        self.dtype = np.dtype([(name, _KINDS[kind]) for name, kind in self.columns] + [("nulls", "u4")])
        self._bits = {name: np.uint32(1 << k) for k, (name, _) in enumerate(self.columns)}

    def read(self, *packed: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(packed), self.dtype)

    def is_null(self, rows: np.ndarray, name: str) -> np.ndarray:
        return rows["nulls"] & self._bits[name] != 0

    def put(self, rows: np.ndarray, name: str, values, null=False) -> None:
        """Set a column where ``null`` does not hold, and the bit where it does."""
        rows[name] = np.where(null, 0, values)
        rows["nulls"] = np.where(null, rows["nulls"] | self._bits[name], rows["nulls"] & ~self._bits[name])

    def from_arrow(self, table: pa.Table) -> np.ndarray:
        rows = np.zeros(table.num_rows, self.dtype)
        for name, _ in self.columns:
            column = table.column(name).combine_chunks()
            if column.null_count:
                rows["nulls"] |= np.where(column.is_null().to_numpy(zero_copy_only=False), self._bits[name], np.uint32(0))
                column = column.fill_null(False if pa.types.is_boolean(column.type) else 0)
            rows[name] = column.to_numpy(zero_copy_only=False)
        return rows

    def to_arrow(self, rows: np.ndarray, name: str) -> pa.Array:
        return pa.array(np.ascontiguousarray(rows[name]), mask=self.is_null(rows, name))


def _packer(layout: Layout, key: str, label: str | None, portion_rows: int) -> Callable:
    names = [key, *([label] if label else []), "rows"]

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        keys, labels = table.column(key).combine_chunks(), None
        order_by = [keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False)]
        if label:
            labels = table.column(label).combine_chunks()
            order_by.append(labels.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False))
        order = np.lexsort(order_by)
        new = np.zeros(len(order), bool)
        new[0] = True
        for values in order_by:
            values = values[order]
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new)
        rows = layout.from_arrow(table)[order]
        offsets = np.append(starts, len(rows)).astype("i4") * np.int32(layout.dtype.itemsize)
        first = pa.array(order[starts])
        columns = [column.take(first) for column in (keys, labels) if column is not None]
        columns.append(pa.Array.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())]))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= portion_rows:
                yield packed(held)
                held, rows = [], 0
        if rows:
            yield packed(held)

    return run


def packed(df: DataFrame, layout: Layout, key: str, label: str | None = None, portion_rows: int = PORTION_ROWS) -> DataFrame:
    """One row per key, label and portion of the input: the key, the label and ``rows``, the bytes of a ``layout``."""
    ddl = f"{key} bigint, {f'{label} string, ' if label else ''}rows binary"
    return df.mapInArrow(_packer(layout, key, label, portion_rows), ddl)


def unpacked(df: DataFrame, layout: Layout, ddl: str) -> DataFrame:
    """The rows of packed rows: columns of the ``layout`` from the bytes, the others are labels of the packed row."""
    fields, known = _fields(ddl), {name for name, _ in layout.columns}
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in enumerate(batch.column("rows")):
                rows = np.frombuffer(data.as_buffer(), layout.dtype)
                yield pa.RecordBatch.from_arrays([
                    layout.to_arrow(rows, name) if name in known
                    else pa.repeat(pc.cast(batch.column(name)[number], _ARROW[kind]), len(rows))
                    for name, kind in fields], schema=schema)

    return df.mapInArrow(run, ddl)


def starts_of(rows: np.ndarray, names: Sequence[str]) -> np.ndarray:
    """Where rows that are in order differ from the one before in one of the columns."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for name in names:
        new[1:] |= rows[name][1:] != rows[name][:-1]
    return np.flatnonzero(new)
