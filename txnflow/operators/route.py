"""Two-way routing by label."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from txnflow.schemas import FRAUD, LABEL, NON_FRAUD


def route_of(label: str = LABEL, rest_is_negative: bool = False) -> Column:
    """``fraud`` for label 1; ``non_fraud`` for label 0, or for every other label if ``rest_is_negative``.

    Anything else, a NULL label in both cases, has no route. Stored labels use the strict form,
    predictions the other.
    """
    value = F.col(label)
    negative = value != 1 if rest_is_negative else value == 0
    return F.when(value == 1, FRAUD).when(negative, NON_FRAUD)


def route_by_label(df: DataFrame, label: str = LABEL, rest_is_negative: bool = False,
                   counts: Observation | None = None) -> DataFrame:
    """Routed rows tagged with ``route``.

    ``counts`` receives the numbers of routed and unrouted rows from the same pass, once an action has run.
    """
    tagged = df.withColumn("route", route_of(label, rest_is_negative))
    if counts is not None:
        tagged = tagged.observe(
            counts,
            F.count("route").alias("routed"),
            F.count_if(F.col("route").isNull()).alias("unrouted"),
        )
    return tagged.where(F.col("route").isNotNull())


def with_label(df: DataFrame, value: float, label: str = LABEL) -> DataFrame:
    """Rows whose label equals ``value``. On a stored table the filter reaches the scan."""
    return df.where(F.col(label) == F.lit(float(value)))


def union_tables(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both tables, columns matched by name."""
    return first.unionByName(second)


def label_union(positives: DataFrame, negatives: DataFrame, label: str = "label") -> DataFrame:
    """Rows of both frames with label 1 for ``positives`` and 0 for ``negatives``."""
    return positives.withColumn(label, F.lit(1.0)).unionByName(negatives.withColumn(label, F.lit(0.0)))
