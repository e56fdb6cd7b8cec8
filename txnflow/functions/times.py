"""Dates, times and ages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_prefix(column: str | Column) -> Column:
    """The part of an ISO timestamp text before its ``T``."""
    return F.substring_index(column, "T", 1)


def parse_time(text: Column, time_type: str = "timestamp") -> Column:
    """Text to time; NULL where it does not parse, also under ANSI mode, and where there is no date: Spark would read a time
    alone as today."""
    return F.when(F.trim(text).rlike("^[+-]?[0-9]{4,}"), text.try_cast(time_type))


def normalize_time(df: DataFrame, time_type: str = "timestamp") -> DataFrame:
    """Replace ``trans_date`` by its date part and ``trans_time`` by the full time.

    ``concat_ws`` skips a missing time, leaving midnight. A missing date must not be skipped, since Spark
    reads a time alone as today, so those rows get NULL. ``time_type="timestamp_ntz"`` keeps wall-clock time.
    """
    day = date_prefix("trans_date")
    moment = parse_time(F.concat_ws(" ", day, F.col("trans_time")), time_type)
    return df.withColumns({
        "trans_date": day,
        "trans_time": F.when(F.trim(day) != "", moment),
    })


def age_in_years(dob: str | Column, as_of=None) -> Column:
    """Whole 365-day years from ``dob`` to ``as_of``, truncated toward zero.

    ``as_of`` is a ``datetime.date`` or Column and defaults to the current date.
    """
    day = F.current_date() if as_of is None else as_of if isinstance(as_of, Column) else F.lit(as_of)
    return (F.datediff(day, F.to_date(dob)) / 365).cast("int")
