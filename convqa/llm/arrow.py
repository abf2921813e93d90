"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

Step = Callable[[pa.RecordBatch], dict[str, pa.Array]]


def give_back() -> None:
    """Return freed memory to the system. A worker outlives its task, and would hold what the arrays of one stage took through the next ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], column: int, limit: int = 8 << 20, tidy: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one hold about ``limit`` bytes; a longer text is a batch of its own.

    ``tidy``: freed memory goes back to the system after each batch that came in.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum([0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()])
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        if tidy:
            give_back()


def add_columns(df: DataFrame, column: str, fields: list[StructField], make: Callable[[], Step], limit: int = 8 << 20) -> DataFrame:
    """``df`` with ``fields`` computed from the text column; input columns of these names are replaced.

    ``make`` runs once a task and returns the function from a batch of one string column to the new columns.
    """
    names = [f.name for f in fields]
    kept = [c for c in df.columns if c not in names]
    source = df.select(*[f"`{c}`" for c in kept], df[f"`{column}`"].alias("__text"))
    schema = StructType([f for f in source.schema.fields if f.name != "__text"] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in small_batches(batches, len(kept), limit, tidy=True):
            made = step(batch.column(len(kept)))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [made[n] for n in names], names=kept + names)

    return source.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column laid end to end, and where each starts (one more entry than texts); nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]
