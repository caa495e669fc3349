"""Arrow batches in and out of Python helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Rows = list[tuple]
#: Texts of one batch are turned into Python strings together; more are worked on in slices.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of one slice stay under ``SLICE_BYTES`` (or are one row)."""
    lengths = batch.column(text_at).cast(pa.large_string())
    start, held = 0, 0
    for i in range(batch.num_rows):
        size = len(lengths[i].as_buffer()) if lengths[i].is_valid else 0
        if held + size > SLICE_BYTES and i > start:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def map_texts(
    df: DataFrame, make: Callable[[], Callable[[list[tuple]], Rows]], schema: str, arrow_schema: pa.Schema,
    text_at: int = 1,
) -> DataFrame:
    """Run ``make()`` once per task and the function it returns on slices of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text_at):
                rows = work(list(zip(*[c.to_pylist() for c in part.columns])))
                columns = list(zip(*rows)) if rows else [[] for _ in arrow_schema]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema
                )

    return df.mapInArrow(run, schema)
