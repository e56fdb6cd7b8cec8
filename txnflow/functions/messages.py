"""JSON messages: decoding, casting, encoding."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnflow.functions.times import parse_time
from txnflow.schemas import TRANSACTION_MESSAGE


def decode_json(value: str | Column, schema) -> Column:
    """Binary or text JSON to a struct. Malformed text gives NULL fields, a bad field a NULL field."""
    value = F.col(value) if isinstance(value, str) else value
    return F.from_json(value.cast("string"), schema)


def flatten_json(df: DataFrame, schema, value: str = "value", keep=()) -> DataFrame:
    """Fields of the JSON in ``value`` as columns, after the columns named in ``keep``."""
    return df.select(*keep, decode_json(value, schema).alias("decoded")).select(*keep, "decoded.*")


def cast_numbers(df: DataFrame, columns=("amt", "merch_lat", "merch_long")) -> DataFrame:
    """Text columns to double; NULL where the text is no number."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def parse_transactions(messages: DataFrame, keep=(), time_type: str = "timestamp") -> DataFrame:
    """Topic messages to typed transactions, without the holder's name, which the customer table has too.

    ``keep`` names topic columns to carry along, such as ``partition`` and ``offset``.
    """
    rows = flatten_json(messages, TRANSACTION_MESSAGE, keep=keep)
    rows = cast_numbers(rows).withColumn("trans_time", parse_time(F.col("trans_time"), time_type))
    return rows.drop("first", "last")


def encode_json(*columns) -> Column:
    """A JSON object of the columns, every value as text; NULL values are left out."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]))
