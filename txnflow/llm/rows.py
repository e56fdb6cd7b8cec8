"""Functions over the texts of a table, batch by batch, with all other columns carried along untouched."""

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(),
          "binary": pa.binary()}
_TYPES |= {f"array<{k}>": pa.list_(v) for k, v in _TYPES.items()}

#: Rows handled at once, so that what is made of them stays small beside the batch.
ROWS = 512

Made = tuple[Any, dict[str, Iterable]]


def map_texts(df: DataFrame, text: str, made: Callable[[list[str | None]], Iterable[Made]], fields: dict[str, str],
              keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Columns ``row`` (a struct of the ``keep`` columns) and ``fields``, from one pass in Arrow batches.

    ``made`` gets the texts of a batch and yields any number of (positions, values by field); ``positions`` says which
    row of the batch each value belongs to, None that there is one for each row. Since the kept columns sit
    in a struct their names can't clash with those of the fields.
    """
    keep = list(keep)
    # A text that is kept travels in its row only, not beside it once more.
    beside = [] if text in keep else [F.col(f"`{text}`").alias("text")]
    source = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), *beside)
    schema = f"row {source.schema['row'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in fields.items())

    beside_row = bool(beside)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, ROWS) for whole in stream for k in range(0, whole.num_rows, ROWS)):
            row = batch.column(0)
            texts = (batch.column(1) if beside_row else row.field(keep.index(text))).to_pylist()
            for positions, values in made(texts):
                kept = row if positions is None else row.take(pa.array(positions, pa.int64()))
                arrays = [pa.array(values[k], _TYPES[v]) for k, v in fields.items()]
                yield pa.RecordBatch.from_arrays([kept, *arrays], ["row", *fields])

    return source.mapInArrow(batches, schema)
