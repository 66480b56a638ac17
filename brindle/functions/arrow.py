"""Arrow-batch functions: run a Python kernel over column lists, never row by row through Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def pieces(batch: pa.RecordBatch, rows: int | None) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``rows`` rows, or whole; none of an empty one."""
    for i in range(0, batch.num_rows, rows or batch.num_rows or 1):
        yield batch.slice(i, rows)


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, rows: int | None = None) -> DataFrame:
    """``kernel`` maps each Arrow batch, or each piece of at most ``rows`` rows of it, to one batch, or to None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, rows):
                if (out := kernel(piece)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
