"""Whole-number vectors from a column of arrays, batch by batch. Used inside tasks."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components handled at once, whatever the vectors' length.
COMPONENTS = 1 << 20


def usable(column: str, dims: Column | int) -> Column:
    """Whether the array has ``dims`` components, none of them null or not finite."""
    value = F.col(column)
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(value) == dims) & ~bad, F.lit(False))


def slices(stream: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``COMPONENTS`` components."""
    rows = max(1, COMPONENTS // max(1, dims))
    for batch in stream:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def whole_numbers(column: pa.Array, dims: int, scale: int, largest: int) -> np.ndarray:
    """floor(scale * x) of each component, x as a double.

    Components so large that squared distances would leave 64 bits are an error: a result can't hold them.
    """
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(values) and np.abs(values).max() > largest:
        raise ValueError(f"a component of {np.abs(values).max() / scale:g} is too large for distances of 64 bits; "
                         f"at most {largest / scale:g} is possible")
    return values.astype(np.int64).reshape(-1, dims)
