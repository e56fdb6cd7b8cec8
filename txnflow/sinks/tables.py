"""Batch sinks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.schemas import FRAUD, NON_FRAUD
from txnflow.workspace import COMPRESSION


def save_table(df: DataFrame, fmt: str = "parquet", mode: str = "overwrite", partition_by=(), **options) -> None:
    """Write to any sink Spark knows; ``overwrite`` replaces the whole table.

    A database connector may want to be told that truncating is meant; pass its option. Parquet is compressed as stored tables are,
    unless ``compression`` says otherwise.
    """
    if fmt == "parquet":
        options = {"compression": COMPRESSION} | options
    df.write.format(fmt).mode(mode).options(**options).partitionBy(*partition_by).save()


def save_routes(routed: DataFrame, fmt: str = "parquet", mode: str = "overwrite", **options) -> None:
    """Both routes in one pass, as partitions ``route=...`` of one file table; nothing is cached or shuffled."""
    save_table(routed, fmt, mode, ["route"], **options)


def save_routes_apart(routed: DataFrame, targets: dict[str, dict], fmt: str, mode: str = "overwrite") -> None:
    """Each route to a table of its own, for sinks without partitions.

    ``targets`` maps a route to the writer options of its table. Each write computes ``routed`` for its
    route only: on stored labels the filter reaches the scan, so no cache of all rows is needed.
    """
    for route in (FRAUD, NON_FRAUD):
        save_table(routed.where(F.col("route") == route).drop("route"), fmt, mode, **targets[route])
