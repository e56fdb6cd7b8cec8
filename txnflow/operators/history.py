"""Newest-first reads."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_first(df: DataFrame, time: str = "timestamp", ties=()) -> DataFrame:
    """All rows, newest first; Spark sorts by ranges of time."""
    return df.orderBy(F.col(time).desc(), *[F.col(c).desc() for c in ties])


def newest(df: DataFrame, n: int = 5, time: str = "timestamp", ties=()) -> DataFrame:
    """The ``n`` newest rows. Every task keeps only its own ``n``; nothing is fully sorted.

    Also stands for the last ``n`` rows of a growing table, which have no order of their own.
    """
    return newest_first(df, time, ties).limit(n)


def card_history(df: DataFrame, cc_num: str | None = None, ties=()) -> DataFrame:
    """Transactions card by card, newest first within a card; of one card if ``cc_num`` is given.

    Ranges run over card and time together, so the rows of a busy card spread over several tasks.
    """
    chosen = df if cc_num is None else df.where(F.col("cc_num") == F.lit(cc_num))
    return chosen.orderBy("cc_num", F.col("trans_time").desc(), *[F.col(c).desc() for c in ties])


def cluster_by_card(df: DataFrame) -> DataFrame:
    """Rows laid out for storage so that a read of one card skips most files.

    Partitions are ranges of (card, time), each sorted newest first within a card.
    """
    layout = [F.col("cc_num"), F.col("trans_time").desc()]
    return df.repartitionByRange(*layout).sortWithinPartitions(*layout)
