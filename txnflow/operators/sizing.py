"""Broadcasting behind a check of the measured size."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A hashed relation of this size is copied to every executor; beyond it the join shuffles.
BROADCAST_LIMIT_BYTES = 128 * 1024 * 1024
# A shuffled side whose partitions measure at most this on average is hashed, so that the other side is not sorted.
HASH_LIMIT_BYTES = 64 * 1024 * 1024

_ROW_OVERHEAD = 32
_FIELD_BYTES = 16
_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_VARIABLE = (T.StringType, T.BinaryType)


def _bounded(kind: T.DataType) -> bool:
    return isinstance(kind, _FIXED + _VARIABLE) or (isinstance(kind, T.ArrayType) and _bounded(kind.elementType))


def _own_bytes(value: Column, kind: T.DataType) -> Column:
    """What a value takes beyond its field, as a Column."""
    if isinstance(kind, _VARIABLE):
        size = F.octet_length(value).cast("bigint")
    elif isinstance(kind, T.ArrayType):
        size = F.size(value) * F.lit(_FIELD_BYTES).cast("bigint")
        if not isinstance(kind.elementType, _FIXED):
            size = size + F.aggregate(value, F.lit(0).cast("bigint"), lambda total, x: total + _own_bytes(x, kind.elementType))
    else:
        return F.lit(0).cast("bigint")
    return F.coalesce(size, F.lit(0).cast("bigint"))


def measured_bytes(df: DataFrame) -> int | None:
    """Upper estimate of the size of all rows in memory, from one aggregate over the data.

    None if a column's type has no simple bound.
    """
    if not all(_bounded(f.dataType) for f in df.schema.fields):
        return None
    own = sum((_own_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if not isinstance(f.dataType, _FIXED)), F.lit(0).cast("bigint"))
    rows, more = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(own), F.lit(0))).first()
    return rows * (_ROW_OVERHEAD + _FIELD_BYTES * len(df.columns)) + more


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows, else unchanged.

    Without the hint Spark shuffles both sides of the join, and adaptive execution splits the partitions
    that a frequent key makes too large.
    """
    size = measured_bytes(df) if limit > 0 else None
    return F.broadcast(df) if size is not None and size <= limit else df


def hinted_by_size(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """The smaller side of a join: broadcast as by :func:`broadcast_if_small`, hashed after the shuffle, or unchanged.

    A hashed side leaves the other one unsorted, which is what spills when that one is large; adaptive execution
    splits frequent keys of that other side all the same. Without the hint both sides are sorted.
    """
    size = measured_bytes(df)
    if size is None:
        return df
    if limit > 0 and size <= limit:
        return F.broadcast(df)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.hint("shuffle_hash") if size <= partitions * HASH_LIMIT_BYTES else df
