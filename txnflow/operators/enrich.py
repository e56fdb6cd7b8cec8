"""Transactions joined with their card holder."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from txnflow.functions.geo import haversine
from txnflow.functions.times import age_in_years
from txnflow.operators.sizing import BROADCAST_LIMIT_BYTES, hinted_by_size
from txnflow.schemas import ENRICHED, LABEL


def holder_side(customers: DataFrame) -> DataFrame:
    """The customer columns the join needs, under names that clash with no transaction column."""
    return customers.select(
        "cc_num",
        F.col("lat").alias("home_lat"),
        F.col("long").alias("home_long"),
        F.to_date("dob").alias("born"),
    )


def join_holders(transactions: DataFrame, holders: DataFrame, as_of=None, variant: str = "radians",
                 counts: Observation | str | None = None, keep=()) -> DataFrame:
    """Join on the card with ``distance`` (km, 2 places) and ``age`` added; works on streams too.

    Transactions of unknown or NULL cards are lost, and a card listed twice yields two rows. ``counts`` receives the
    numbers of rows ``with_card`` and of those ``unknown_card``. Columns of ``holders`` named ``*_index`` stay, and those of
    ``transactions`` named in ``keep``.
    """
    distance = F.round(haversine("home_lat", "home_long", "merch_lat", "merch_long", variant), 2)
    label = [LABEL] if LABEL in transactions.columns else []
    kept = [*keep, *(c for c in holders.columns if c.endswith("_index"))]
    if counts is None:
        joined = transactions.join(holders, "cc_num")
    else:
        known = transactions.join(holders.withColumn("is_known", F.lit(True)), "cc_num", "left")
        with_card, is_known = F.col("cc_num").isNotNull(), F.col("is_known").isNotNull()
        joined = known.observe(counts, F.count_if(with_card).alias("with_card"),
                               F.count_if(with_card & ~is_known).alias("unknown_card")).where(is_known)
    return joined.withColumns({"distance": distance, "age": age_in_years("born", as_of)}).select(*ENRICHED, *label, *kept)


def enrich(transactions: DataFrame, customers: DataFrame, as_of=None, variant: str = "radians",
           broadcast_limit: int = BROADCAST_LIMIT_BYTES, counts: Observation | None = None) -> DataFrame:
    """Canonical transactions with distance and age.

    The customer side is broadcast if it measures at most ``broadcast_limit`` bytes; otherwise the join
    shuffles on the card, and hashes the customers where their partitions are small enough, so that transactions aren't sorted.
    """
    return join_holders(transactions, hinted_by_size(holder_side(customers), broadcast_limit), as_of, variant, counts)
