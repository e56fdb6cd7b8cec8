"""Batch sources: CSV, tables by format, in-memory rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Column of :func:`read_csv_marked` with the raw line of a row that has bad cells.
BAD_LINE = "bad_line"


def read_csv(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """CSV with a header line. Columns bind to ``schema`` by position; a bad number becomes NULL."""
    return spark.read.options(**{"header": True, "mode": "PERMISSIVE", **options}).schema(schema).csv(path)


def read_csv_marked(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """As :func:`read_csv`, and ``bad_line`` is the raw line of a row with a bad cell or too few or many cells, else NULL.

    ``schema`` is a DDL string. Whatever is selected later, every pass marks the same lines.
    """
    rows = read_csv(spark, path, f"{schema}, {BAD_LINE} string", **options, columnNameOfCorruptRecord=BAD_LINE, columnPruning=False)
    names = [f.name for f in rows.schema if f.name != BAD_LINE]
    # Spark reads only the columns a query uses and sees no bad cell in others; this condition always holds and uses all that can be bad.
    typed = [c for c in names if not isinstance(rows.schema[c].dataType, StringType)] or names[:1]
    read = F.xxhash64(*(F.col(f"`{c}`") for c in typed)).bitwiseOR(F.lit(1)) != 0
    return rows.withColumn(BAD_LINE, F.when(read, F.col(BAD_LINE)))


def rejects(marked: DataFrame, **options) -> DataFrame:
    """The marked rows of :func:`read_csv_marked` as ``line`` and ``reason``: the columns that hold text that isn't of their type, or
    ``cells`` if only their number is wrong; then the columns as far as they were read. ``options`` are those of the reader."""
    names = [c for c in marked.columns if c != BAD_LINE]
    cells = F.from_csv(BAD_LINE, ", ".join(f"`{c}` string" for c in names), {k: str(v) for k, v in options.items()})
    wrong = F.array_compact(F.array(*(F.when(cells[c].isNotNull() & F.col(f"`{c}`").isNull(), F.lit(c)) for c in names)))
    reason = F.when(F.size(wrong) > 0, F.concat_ws(", ", wrong)).otherwise("cells")
    return marked.where(F.col(BAD_LINE).isNotNull()).select(F.col(BAD_LINE).alias("line"), reason.alias("reason"), *(F.col(f"`{c}`") for c in names))


def read_csv_infer(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV with a header line, types found in an extra pass over the whole data.

    For large inputs give a schema to :func:`read_csv`, or a ``samplingRatio`` here.
    """
    return spark.read.options(**{"header": True, "inferSchema": True, **options}).csv(path)


def load_table(spark: SparkSession, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Any table Spark has a source for. A file table is given by ``path``."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load()


def rows_to_df(spark: SparkSession, rows, schema) -> DataFrame:
    """A few rows held by the caller as a DataFrame."""
    return spark.createDataFrame(rows, schema)
